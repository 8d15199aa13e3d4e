"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Every passage of the whole text is encoded as a vector; a gated attention layer
gives each passage a weight from its vector; the weighted sum is the document's vector, and a
logistic layer scores it. Only documents have labels: the weights of passages are learned from them.

Learning runs on the driver over a bounded sample of labelled documents, with all passages of each: at most ``sample``
of them and ``most_bytes`` of text together, taken by the order of a hash. Scoring is one pass
over whole texts, no row moves, and the model (some ten thousand numbers) goes to the tasks by broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specula.llm._worker import Remembering, once, slices
from specula.llm.bpe import _q

WORDS, HASHED = 64, 96
LONG, PIECE = 256, 8
PLACES = 32 + 8 + 6 + HASHED


def passages(text: str | None) -> list[list[bytes]]:
    """Consecutive runs of ``WORDS`` words of the whole text; one empty passage if there are none.

    What has no blanks for more than ``LONG`` bytes, like text in scripts without them, is cut into words of ``PIECE`` code points.
    """
    words = (text or "").encode("utf-8").split()
    if max(map(len, words), default=0) > LONG:
        words = [x for w in words for x in ([w] if len(w) <= LONG else [s[i:i + PIECE].encode() for s in [w.decode()] for i in range(0, len(s), PIECE)])]
    return [words[i:i + WORDS] for i in range(0, len(words), WORDS)] or [[]]


def encode(bags: list[list[list[bytes]]], slot) -> object:
    """A row for each passage: shares of character classes and single marks, word shapes, and hashed words."""
    import numpy as np
    every = [p for bag in bags for p in bag]
    out = np.zeros((len(every), PLACES), np.float32)
    marks = np.frombuffer(bytes(b for b in range(33, 127) if not chr(b).isalnum()), np.uint8)
    for i, words in enumerate(every):
        if not words:
            continue
        data = np.frombuffer(b" ".join(words), np.uint8)
        seen = np.bincount(data, minlength=256)
        n = len(data)
        row = out[i]
        row[:32] = np.sqrt(seen[marks] / n)
        row[32:37] = seen[65:91].sum() / n, seen[97:123].sum() / n, seen[48:58].sum() / n, seen[128:].sum() / n, len(words) / n
        size = np.fromiter(map(len, words), np.int64, len(words))
        row[37:40] = size.mean() / 10, min(size.max() / 40, 3), size.std() / 10
        row[40:46] = len(set(words)) / len(words), len(words) / WORDS, (size == 1).mean(), (size > 20).mean(), 1.0, len(set(w.lower() for w in words)) / len(words)
        at = np.bincount(np.fromiter(map(slot, words), np.int64, len(words)), minlength=2 * HASHED)
        row[46:] = (at[:HASHED] - at[HASHED:]) / np.sqrt(len(words)) / 2
    return out


def _slots():
    import xxhash
    return once("quality", lambda: Remembering(lambda w: xxhash.xxh3_64_intdigest(w.lower()) % (2 * HASHED))).__getitem__


def _attend(x, owner, n, m):
    """Forward pass: document logits and what the backward pass needs. ``owner`` is sorted."""
    import numpy as np
    h = np.tanh(x @ m["w"] + m["b"])
    v, u = np.tanh(h @ m["v"]), 1 / (1 + np.exp(-(h @ m["u"])))
    g = (v * u) @ m["a"]
    start = np.searchsorted(owner, np.arange(n))
    top = np.maximum.reduceat(g, start)
    e = np.exp(g - top[owner])
    alpha = e / np.add.reduceat(e, start)[owner]
    z = np.add.reduceat(alpha[:, None] * h, start, axis=0)
    return z @ m["c"] + m["d"], (h, v, u, alpha, z, start)


def fit(x, owner, y, hidden: int = 32, gate: int = 16, epochs: int = 24, batch: int = 256, rate: float = 5e-3, decay: float = 1e-4):
    """Adam on the mean log loss with both classes of equal weight."""
    import numpy as np
    draw = np.random.default_rng(7)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    x = (x - mean) / scale
    m = {"w": draw.normal(size=(x.shape[1], hidden)) / np.sqrt(x.shape[1]), "b": np.zeros(hidden), "v": draw.normal(size=(hidden, gate)) / np.sqrt(hidden),
         "u": draw.normal(size=(hidden, gate)) / np.sqrt(hidden), "a": draw.normal(size=gate) / np.sqrt(gate), "c": draw.normal(size=hidden) / np.sqrt(hidden), "d": np.zeros(())}
    first, second = ({k: np.zeros_like(v) for k, v in m.items()} for _ in range(2))
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    begin, end = np.searchsorted(owner, np.arange(len(y))), np.searchsorted(owner, np.arange(len(y)), side="right")
    turn = 0
    for _ in range(epochs):
        order = draw.permutation(len(y))
        for s in range(0, len(y), batch):
            docs = order[s:s + batch]
            rows = np.concatenate([np.arange(begin[d], end[d]) for d in docs])
            own = np.repeat(np.arange(len(docs)), end[docs] - begin[docs])
            xb = x[rows]
            logit, (h, v, u, alpha, z, start) = _attend(xb, own, len(docs), m)
            gap = weight[docs] * (1 / (1 + np.exp(-logit)) - y[docs]) / len(docs)
            dz = gap[:, None] * m["c"]
            dh = alpha[:, None] * dz[own]
            dalpha = (h * dz[own]).sum(axis=1)
            dg = alpha * (dalpha - np.add.reduceat(alpha * dalpha, start)[own])
            dv, du = dg[:, None] * m["a"] * u * (1 - v * v), dg[:, None] * m["a"] * v * u * (1 - u)
            dh += dv @ m["v"].T + du @ m["u"].T
            dp = dh * (1 - h * h)
            grad = {"w": xb.T @ dp, "b": dp.sum(axis=0), "v": h.T @ dv, "u": h.T @ du, "a": (v * u).T @ dg, "c": z.T @ gap, "d": gap.sum()}
            turn += 1
            for k, g in grad.items():
                g = g + decay * m[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                m[k] = m[k] - rate * (first[k] / (1 - 0.9 ** turn)) / (np.sqrt(second[k] / (1 - 0.999 ** turn)) + 1e-8)
    return m | {"mean": mean, "scale": scale}


def learn(docs: DataFrame, doc_id: str, text: str, labels: DataFrame, label_id: str, label: str, sample: int = 5000, most_bytes: int = 64 << 20):
    """A model from labelled documents; labels other than 0 and 1, and ids that are null or whose labels differ, are left out.

    ``sample`` and ``most_bytes`` bound what is learned from: labelled documents by the order of a hash of their id, until either is
    reached. Each of them counts with its whole text.
    """
    import numpy as np
    known = (labels.filter(_q(label).isin(0, 1)).groupBy(_q(label_id).alias("id")).agg(F.min(_q(label)).alias("y"), F.max(_q(label)).alias("other"))
             .filter("y = other AND id IS NOT NULL").select("id", "y"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(sample)  # TakeOrdered: the sample is small and its size fixed
    held = docs.select(_q(doc_id).alias("id"), _q(text).alias("text")).join(F.broadcast(chosen), "id")
    sizes = held.select(F.xxhash64("id").alias("draw"), "id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("size")).orderBy("draw", "id").limit(sample).collect()
    total, last = 0, None
    for r in sizes:
        total += r["size"]
        if total > most_bytes:
            break
        last = r["draw"]
    held = held.filter(F.xxhash64("id") <= F.lit(last)) if last is not None else held.limit(0)

    def run(batches):
        import pyarrow as pa
        slot = _slots()
        for batch in slices(batches, 64):
            bags = [passages(t) for t in batch.column(1).to_pylist()]
            x = encode(bags, slot)
            ends = np.cumsum([len(b) for b in bags])
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(2).cast(pa.int32()),
                                              pa.array([x[e - len(b):e].astype(np.float16).tobytes() for e, b in zip(ends, bags)], pa.binary())], names=["id", "y", "x"])
    rows = held.select("id", "text", "y").mapInArrow(run, "id string, y int, x binary").orderBy("id").limit(sample).toArrow()
    y = rows.column("y").to_numpy().astype(np.float64)
    if len(set(y.tolist())) < 2:
        return {"constant": float(y.mean()) if len(y) else 0.5}
    parts = [np.frombuffer(b, np.float16).reshape(-1, PLACES) for b in rows.column("x").to_pylist()]
    return fit(np.concatenate(parts).astype(np.float32), np.repeat(np.arange(len(parts)), [len(p) for p in parts]), y)


def score(docs: DataFrame, text: str, model: dict, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and score: how likely the label is 1, from 0 to 1, for every row.

    Null and empty texts are one empty passage and get a score too. Without two classes to learn from, every score is the
    share of label 1 (0.5 without any label). Repeated rows get repeated scores, an empty table stays empty. A kept column named score gives way.
    """
    keep = [c for c in keep if c != "score"]
    held = docs.sparkSession.sparkContext.broadcast(model)
    fields = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.select(*[_q(c) for c in keep]).schema]

    def run(batches):
        import numpy as np
        import pyarrow as pa
        m, slot = held.value, _slots()
        for batch in slices(batches, 64):
            texts = batch.column(batch.num_columns - 1).to_pylist()
            if "constant" in m:
                out = np.full(len(texts), m["constant"])
            else:
                bags = [passages(t) for t in texts]
                x = (encode(bags, slot) - m["mean"]) / m["scale"]
                logit, _ = _attend(x, np.repeat(np.arange(len(bags)), [len(b) for b in bags]), len(bags), m)
                out = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.float64())], names=[*keep, "score"])
    return docs.select(*[_q(c) for c in keep], _q(text).alias("__text")).mapInArrow(run, ", ".join([*fields, "score double"]))
