"""Benchmark decontamination with a positional inverted index that is spread with the documents.

Each task indexes the documents it reads: the words that any test item has become term numbers,
and every term gets the sorted list of its positions. A test window is answered from its rarest
term in that index: the list of that term, moved back by the term's offset in the window, gives
the possible starts; each further term, rarest first, leaves those whose position at its own
offset holds it. What is left are the exact places of the phrase. Proximity matches ask for the
rarest terms of an item within a span of words.

The index never leaves its task and no document moves. Test items are sent to the tasks in
blocks of bounded size; with several blocks, each block is one more pass over the rows within
the same task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specula.llm._worker import slices
from specula.llm.bpe import _q

#: ASCII characters that are no letter or digit separate words; all others belong to words.
SEPARATORS = bytes(range(0x30)) + bytes(range(0x3A, 0x61)) + bytes(range(0x7B, 0x80))
ANY, NONE, BORDER = -1, -2, -3


def words_of(text: str | None) -> list[bytes]:
    table = bytes(32 if b in SEPARATORS else b for b in range(256))
    return (text or "").encode("utf-8").lower().translate(table).split()


class Questions:
    """The windows of a block of test items: one row of term numbers each, ``ANY`` past the end of short ones."""

    def __init__(self, items: list[tuple[str, str | None]], length: int):
        import numpy as np
        self.terms: dict[bytes, int] = {}
        rows: dict[tuple[int, ...], set[int]] = {}
        self.names = [name for name, _ in items]
        self.bags: list[list[int]] = []
        for k, (_, text) in enumerate(items):
            ids = [self.terms.setdefault(w, len(self.terms)) for w in words_of(text)]
            self.bags.append(sorted(set(ids)))
            if ids:
                for i in range(max(1, len(ids) - length + 1)):
                    part = ids[i:i + length]
                    rows.setdefault(tuple(part + [ANY] * (length - len(part))), set()).add(k)
        self.windows = np.array(list(rows), dtype=np.int32).reshape(len(rows), length)
        self.sizes = (self.windows != ANY).sum(axis=1)
        self.owners = list(rows.values())


class Index:
    """Positions of terms in a run of documents. Borders of ``gap`` places keep documents apart."""

    def __init__(self, texts: list[str | None], terms: dict[bytes, int], gap: int):
        import numpy as np
        at, parts, self.counts, self.starts = gap, [np.full(gap, BORDER, np.int32)], [], []
        for text in texts:
            get = terms.get
            ids = np.array([get(w, NONE) for w in words_of(text)], dtype=np.int32)
            self.starts.append(at)
            self.counts.append(len(ids))
            parts += [ids, np.full(gap, BORDER, np.int32)]
            at += len(ids) + gap
        self.forward = np.concatenate(parts)
        known = np.flatnonzero(self.forward >= 0)
        held = self.forward[known]
        order = np.argsort(held, kind="stable")
        self.postings = known[order]
        self.frequency = np.bincount(held, minlength=len(terms))
        self.offset = np.concatenate([[0], np.cumsum(self.frequency)])

    def phrases(self, q: Questions, most: int = 2_000_000):
        """(start, window) of every occurrence, found from the rarest term on; ``most`` only bounds memory."""
        import numpy as np
        if not len(q.windows):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        often = np.where(q.windows == ANY, np.iinfo(np.int64).max, self.frequency[q.windows])
        live = np.flatnonzero((often > 0).all(axis=1))
        order = np.argsort(often[live], axis=1, kind="stable")
        first = np.take_along_axis(often[live], order[:, :1], axis=1)[:, 0]
        starts, windows = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for run, part, rank in self._runs(live, first, order, q, most):
            start, w, o = run, part, rank
            for k in range(1, q.windows.shape[1]):
                column = o[:, k]
                term = q.windows[w, column]
                ok = (term == ANY) | (self.forward[np.minimum(start + column, len(self.forward) - 1)] == term)
                start, w, o = start[ok], w[ok], o[ok]
            starts.append(start)
            windows.append(w)
        return np.concatenate(starts), np.concatenate(windows)

    def _runs(self, live, first, order, q, most):
        """The list of each window's rarest term moved back by its offset; a long list comes in parts."""
        import numpy as np
        at = 0
        while at < len(live):
            end = max(at + 1, int(np.searchsorted(np.cumsum(first[at:]), most, side="right")) + at)
            w, size = live[at:end], first[at:end]
            column = order[at:end, 0]
            begin = self.offset[q.windows[w, column]]
            for low in range(0, int(size.max()), most):  # one turn unless a single list is longer
                n = np.clip(size - low, 0, most)
                which = np.repeat(np.arange(len(w)), n)
                within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                yield self.postings[begin[which] + low + within] - column[which], w[which], order[at:end][which]
            at = end

    def close(self, q: Questions, span: int, terms: int, often: list[int]):
        """(position, item): places of an item's rarest term with its next rarest ones within ``span`` words.

        ``often`` has the counts of the terms over all documents, so that a document's answer does not depend on its neighbours.
        """
        import numpy as np
        out = []
        for k, bag in enumerate(q.bags):
            rare = sorted(bag, key=lambda t: (often[t], t))[:terms]
            if not rare or not all(self.frequency[t] for t in rare):
                continue
            place = self.postings[self.offset[rare[0]]:self.offset[rare[0] + 1]]
            document = np.searchsorted(self.starts, place, side="right")
            for t in rare[1:]:
                held = self.postings[self.offset[t]:self.offset[t + 1]]
                right = np.searchsorted(held, place)
                ok = np.zeros(len(place), bool)
                for side in (right - 1, right):
                    there = held[np.clip(side, 0, len(held) - 1)]
                    ok |= (np.abs(there - place) <= span) & (np.searchsorted(self.starts, there, side="right") == document)
                place, document = place[ok], document[ok]
            out += [(int(p), k) for p in place]
        return out


def match(docs: DataFrame, text: str, items: DataFrame, item_id: str, item_text: str, keep: list[str],
          length: int = 13, span: int = 0, span_terms: int = 8, block_bytes: int = 8_000_000) -> DataFrame:
    """Columns ``keep`` with n_words, hits, items and, if ``span`` is over 0, near.

    hits: merged word intervals (start, end) of all exact occurrences of ``length`` consecutive
    words of an item (of the whole item if it is shorter); items: ids, as sorted strings, of the items
    with an occurrence; near: ids of items whose ``span_terms`` rarest words, by their counts over all documents (one
    more pass over the texts), lie within ``span`` words of the rarest. An item without id counts as one named null. Null and empty
    texts have no words and no hits, items without words never occur; repeated documents get
    repeated rows and repeated items count once by id. No document row moves. Kept columns named like the added ones give way.
    """
    keep = [c for c in keep if c not in ("n_words", "hits", "items", "near")]
    spark = docs.sparkSession
    held = items.select(_q(item_id).cast("string").alias("name"), _q(item_text).alias("text"))
    total = held.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-int(total) // block_bytes))
    fields = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.select(*[_q(c) for c in keep]).schema]
    added = "n_words bigint, hits array<struct<start:int,end:int>>, items array<string>, near array<string>"
    out = docs.select(*[_q(c) for c in keep], F.lit(0).cast("bigint").alias("n_words"), F.lit(None).cast("array<struct<start:int,end:int>>").alias("hits"),
                      F.lit(None).cast("array<string>").alias("items"), F.lit(None).cast("array<string>").alias("near"), _q(text).alias("__text"))
    for b in range(blocks):
        rows = held.filter(F.pmod(F.xxhash64("name"), F.lit(blocks)) == b).collect()
        block = [(r["name"], r["text"]) for r in rows]
        often = _often(docs, text, Questions(block, length).terms) if span else []
        asked = spark.sparkContext.broadcast((block, often))
        out = out.mapInArrow(_pass(asked, length, span, span_terms, b + 1 == blocks), ", ".join([*fields, added] + ["__text string"] * (b + 1 < blocks)))
    return out if span else out.drop("near")


def _often(docs: DataFrame, text: str, terms: dict[bytes, int]) -> list[int]:
    """How often each of ``terms`` occurs in all documents; as long as the vocabulary of a block of test items."""
    held = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        counts = np.zeros(len(held.value), np.int64)
        for batch in slices(batches):
            ids = [k for t in batch.column(0).to_pylist() for w in words_of(t) if (k := held.value.get(w)) is not None]
            counts += np.bincount(np.array(ids, np.int64), minlength=len(counts))
        there = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(counts[there], pa.int64())], names=["term", "n"])
    often = [0] * len(terms)
    for r in docs.select(_q(text).alias("text")).mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect():
        often[r["term"]] = r["n"]
    return often


def in_order(names: set[str | None]) -> list[str | None]:
    return sorted(names, key=lambda n: (n is not None, n or ""))


def _pass(asked, length: int, span: int, span_terms: int, last: bool):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        block, often = asked.value
        questions = Questions(block, length)
        intervals = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in slices(batches):
            table = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            texts = table["__text"].to_pylist()
            index = Index(texts, questions.terms, max(length, span + 1))
            start, window = index.phrases(questions)
            document = np.searchsorted(index.starts, start, side="right") - 1
            hits = [[(h["start"], h["end"]) for h in x] if x else [] for x in table["hits"].to_pylist()]
            names = [set(x or ()) for x in table["items"].to_pylist()]
            near = [set(x or ()) for x in table["near"].to_pylist()]
            for s, w, d in zip(start.tolist(), window.tolist(), document.tolist()):
                s -= index.starts[d]
                hits[d].append((s, s + int(questions.sizes[w])))
                names[d].update(questions.names[k] for k in questions.owners[w])
            if span:
                for p, k in index.close(questions, span, span_terms, often):
                    near[int(np.searchsorted(index.starts, p, side="right")) - 1].add(questions.names[k])
            table["n_words"] = pa.array(index.counts, pa.int64())
            table["hits"] = pa.array([[{"start": a, "end": b} for a, b in joined(h)] for h in hits], intervals)
            table["items"] = pa.array([in_order(x) for x in names], pa.list_(pa.string()))
            table["near"] = pa.array([in_order(x) for x in near], pa.list_(pa.string()))
            if last:
                del table["__text"]
            yield pa.RecordBatch.from_arrays(list(table.values()), names=list(table))
    return run


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching intervals as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def contaminated(matched: DataFrame, share: int = 20) -> DataFrame:
    """Adds n_hit and contaminated: some word is hit and at least one in ``share`` words is."""
    hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda n, h: n + (h["end"] - h["start"]).cast("bigint"))
    return (matched.withColumn("n_hit", hit)
            .withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words"))))
