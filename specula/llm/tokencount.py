"""Token counts of a sentencepiece BPE model, with a shortcut for pre-tokens that are whole tokens.

Merges only ever build vocabulary strings. Two characters that stand side by side in no
vocabulary string are therefore never merged across, whatever surrounds them. The driver
derives from the vocabulary alone, before any text is read:

* the pre-tokens: texts are cut where the mark for a space follows another character, and
  around characters that occur in no longer vocabulary string, if the vocabulary allows it;
* the vocabulary strings that the merges, run on them alone, turn into one token.

A pre-token of the second kind counts one without merging; only the rest is merged, once per
distinct pre-token and worker. Characters outside the vocabulary count their UTF-8 bytes.
"""

from __future__ import annotations

import heapq
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specula.llm._worker import Remembering, once, slices
from specula.llm.bpe import _q

SPACE = "▁"
LETTER = re.compile(r"[^\W\d_]")


def merged(text: str, score: dict[str, float]) -> list[str]:
    """The symbols that remain: join the pair of highest score, the leftmost of equal ones, until none is left."""
    if len(text) < 64:
        return _merged_short(text, score)
    parts: list[str | None] = list(text)
    before, after = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
    heap: list[tuple[float, int, int, str]] = []

    def offer(i: int, j: int) -> None:
        if i >= 0 and j < len(parts):
            joined = parts[i] + parts[j]
            if joined in score:
                heapq.heappush(heap, (-score[joined], i, j, joined))

    for i in range(len(parts) - 1):
        offer(i, i + 1)
    while heap:
        _, i, j, joined = heapq.heappop(heap)
        if parts[i] is None or parts[j] is None or after[i] != j or parts[i] + parts[j] != joined:
            continue
        parts[i], parts[j] = joined, None
        after[i] = after[j]
        if after[i] < len(parts):
            before[after[i]] = i
        offer(before[i], i)
        offer(i, after[i])
    return [p for p in parts if p is not None]


def _merged_short(text: str, score: dict[str, float]) -> list[str]:
    """The same for short texts, by looking through all pairs for each merge."""
    parts, none, of = list(text), float("-inf"), score.get
    pairs = [of(a + b, none) for a, b in zip(parts, parts[1:])]
    while pairs and (best := max(pairs)) > none:
        i = pairs.index(best)
        parts[i] += parts.pop(i + 1)
        del pairs[i]
        if i < len(pairs):
            pairs[i] = of(parts[i] + parts[i + 1], none)
        if i:
            pairs[i - 1] = of(parts[i - 1] + parts[i], none)
    return parts


def size(text: str, score: dict[str, float]) -> int:
    return sum(1 if p in score else len(p.encode("utf-8")) for p in merged(text, score))


def vocabulary(path: str) -> dict[str, float]:
    """Strings that merges may build, with their scores. Control, unknown and byte pieces are none."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return {model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}


def shortcuts(score: dict[str, float]) -> tuple[str, dict[str, int]]:
    """The pattern of pre-tokens, and the strings that are one token by themselves."""
    whole = {p: 1 for p in score if len(merged(p, score)) == 1}
    beside = {(a, b) for p in score for a, b in zip(p, p[1:])}
    if any(b == SPACE != a for a, b in beside):
        return r"(?s:.+)", whole
    inside = {c for two in beside for c in two}
    plain = {chr(c) for c in range(128)} - {" "}
    alone = plain - inside  # always a pre-token by itself
    opens = {c for c in plain & inside if not any(b == c and LETTER.match(a) for a, b in beside)}  # begins one after a letter
    one, first = ("".join(re.escape(c) for c in sorted(x)) for x in (alone, opens))
    pattern = f"(?:{SPACE}+|[^{SPACE}{one}])(?:[^{SPACE}{one}{first}]" + (f"|(?<!{LETTER.pattern})[{first}]" if first else "") + ")*" + (f"|[{one}]" if one else "")
    return pattern, whole


def count(df: DataFrame, text: str, model_path: str, keep: list[str], limit: int) -> DataFrame:
    """Columns ``keep`` with n_bytes, n_tokens and over_limit of the whole of column ``text``.

    As the library counts with a leading space mark added and no begin, end or other special
    tokens; their strings inside texts are ordinary text. A null or empty text has 0 bytes and
    0 tokens. No row moves; repeated rows give repeated results, an empty table an empty one.
    A column of ``keep`` named like an added one gives way to it.
    """
    keep = [c for c in keep if c not in ("n_bytes", "n_tokens", "over_limit")]
    score = vocabulary(model_path)
    tables = df.sparkSession.sparkContext.broadcast((score, *shortcuts(score)))
    fields = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.select(*[_q(c) for c in keep]).schema]
    key = ("spm", model_path)

    def run(batches):
        import pyarrow as pa

        def build():
            score, pattern, whole = tables.value
            rest = Remembering(lambda p: size(p, score), 400_000)

            class Counts(dict):
                def __missing__(self, piece):
                    return rest[piece]
            return re.compile(pattern), Counts(whole)
        rx, counts = once(key, build)
        for batch in slices(batches):
            sizes, tokens = [], []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                sizes.append(len(text.encode("utf-8")) if text else 0)
                tokens.append(sum(map(counts.__getitem__, rx.findall(SPACE + text.replace(" ", SPACE)))) if text else 0)
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            columns += [pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "n_bytes", "n_tokens", "over_limit"])

    return (df.select(*[_q(c) for c in keep], F.coalesce(_q(text), F.lit("")).alias("__text"))
            .mapInArrow(run, ", ".join([*fields, "n_bytes bigint", "n_tokens bigint", "over_limit boolean"])))
