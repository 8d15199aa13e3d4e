"""Byte-level BPE encoding and decoding in linear time by backtracking over longest matches.

The ranks are read once on the driver, which also derives, for every token, the pair whose
merge makes it. Workers get these tables (bounded by the vocabulary) by broadcast, build an
Aho-Corasick automaton over the bytes as Latin-1 text, and encode each pre-token by taking the
longest token at a place and stepping back to shorter ones while a neighbouring pair could
not have come from the merges. Answers on pairs and on pre-tokens are remembered.
"""

from __future__ import annotations

import base64
import hashlib
from array import array

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specula.llm._worker import Remembering, once, slices

KINDS = {"ids": "array<int>", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank from a file of ``base64 rank`` lines."""
    tokens: dict[int, bytes] = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                text, rank = line.split()
                tokens[int(rank)] = base64.b64decode(text)
    if sorted(tokens) != list(range(len(tokens))):
        raise ValueError(f"{path}: ranks are not 0..{len(tokens) - 1}")
    return [tokens[i] for i in range(len(tokens))]


def last_merges(tokens: list[bytes]) -> tuple[array, array]:
    """For each token the two tokens that its last merge joins.

    A single byte has itself on both sides; a token that merges alone never reach has -1.
    """
    rank = {t: i for i, t in enumerate(tokens)}
    left, right = array("i"), array("i")
    for i, token in enumerate(tokens):
        parts = [rank.get(token[k:k + 1], -1) for k in range(len(token))]
        if len(parts) == 1:
            left.append(i)
            right.append(i)
            continue
        while len(parts) > 2:
            best, at = i, -1
            for k in range(len(parts) - 1):
                r = rank.get(tokens[parts[k]] + tokens[parts[k + 1]], i)
                if r < best:
                    best, at = r, k
            if at < 0:
                break
            parts[at:at + 2] = [best]
        whole = len(parts) == 2 and min(parts) >= 0
        left.append(parts[0] if whole else -1)
        right.append(parts[1] if whole else -1)
    return left, right


class Encoder:
    """Encodes pre-tokens; one per worker process."""

    def __init__(self, tokens: list[bytes], left, right):
        import ahocorasick
        self.tokens, self.left, self.right = tokens, left, right
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.pair = {(left[i], right[i]): i for i, t in enumerate(tokens) if left[i] >= 0 and len(t) > 1}
        self.size = [len(t) for t in tokens]
        reached = [i for i in range(len(tokens)) if left[i] >= 0]
        self.machine = ahocorasick.Automaton()
        for i in reached:
            if self.size[i] > 1:
                self.machine.add_word(tokens[i].decode("latin-1"), i)
        self.single = [self.rank.get(bytes([b]), -1) for b in range(256)]
        self.machine.make_automaton()
        usable = {tokens[i]: i for i in reached}
        self.shorter = {i: next((usable[tokens[i][:k]] for k in range(self.size[i] - 1, 0, -1) if tokens[i][:k] in usable), -1)
                        for i in reached}
        self.pair = {a * len(tokens) + b: i for (a, b), i in self.pair.items()}
        self.fits: dict[int, bool] = {}

    def _stable(self, a: int, b: int) -> bool:
        """Would the merges leave ``a`` and ``b`` side by side?

        Undo the merges on both sides of the border from the latest to the earliest. At each
        time a pair across the border that has a merge of its own, due before the next one
        undone, would have been joined instead.
        """
        due = many = len(self.tokens)
        merged, left, right = self.pair.get, self.left, self.right
        while True:
            if merged(a * many + b, due) < due:
                return False
            # a single byte cannot be undone: then only the other side can
            if a > b and right[a] != a or left[b] == b:
                if right[a] == a:
                    return True
                due, a = a, right[a]
            else:
                due, b = b + 1, left[b]

    def piece(self, data: bytes) -> list[int]:
        """Ids of one pre-token. A pre-token in the vocabulary is that token, as the library has it."""
        if data in self.rank:
            return [self.rank[data]]
        longest = list(map(self.single.__getitem__, data))
        size, shorter, fits, many = self.size, self.shorter, self.fits, len(self.tokens)
        for end, token in self.machine.iter(data.decode("latin-1")):
            longest[end + 1 - size[token]] = token  # later ends are longer matches of the same start
        dead = bytearray(len(data) + 1)
        out: list[int] = []
        at, token, end = 0, longest[0], len(data)
        while at < end:
            previous = out[-1] if out else -1
            while token >= 0:
                if not dead[at + size[token]]:
                    if previous < 0:
                        break
                    two = previous * many + token
                    fit = fits.get(two)
                    if fit is None:
                        if len(fits) >= 1_000_000:
                            fits.clear()
                        fit = fits[two] = self._stable(previous, token)
                    if fit:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += size[token]
                token = longest[at] if at < end else -1
            else:
                if not out:
                    raise ValueError("the vocabulary lacks single bytes that the text has")
                dead[at] = 1
                token = shorter[out.pop()]
                at -= size[previous]
        return out


def encode(df: DataFrame, text: str, ranks_path: str, pattern: str, keep: list[str],
           outputs: tuple[str, ...] = ("ids",)) -> DataFrame:
    """Columns ``keep`` and the ``outputs`` of encoding the whole of column ``text``.

    Each match of ``pattern`` is encoded by itself, without special tokens. Outputs: ``ids``;
    ``n_tokens``; ``ids_sha256`` of the ids as little-endian unsigned 32-bit integers;
    ``decoded_sha256`` of the bytes that the ids stand for. A null text counts as empty: no
    ids. Repeated rows give repeated results, an empty table an empty one. No row moves.
    A column of ``keep`` named like an output gives way to it.
    """
    keep = [c for c in keep if c not in outputs]
    tokens = read_ranks(ranks_path)
    spark = df.sparkSession
    tables = spark.sparkContext.broadcast((tokens, *last_merges(tokens)))
    fields = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.select(*[_q(c) for c in keep]).schema]
    schema = ", ".join(fields + [f"{o} {KINDS[o]}" for o in outputs])
    key = ("bpe", ranks_path, pattern)
    slot = "__text"

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import regex

        def build():
            encoder = Encoder(*tables.value)
            packed = Remembering(lambda p: np.array(encoder.piece(p.encode("utf-8")), "<u4").tobytes(), 500_000)
            return regex.compile(pattern), packed, np.array(encoder.tokens, dtype=object)
        rx, packed, words = once(key, build)
        for batch in slices(batches):
            found = []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                data = b"".join(map(packed.__getitem__, rx.findall(text))) if text else b""
                found.append(data)
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            for o in outputs:
                if o == "n_tokens":
                    columns.append(pa.array([len(d) // 4 for d in found], pa.int64()))
                elif o == "ids_sha256":
                    columns.append(pa.array([hashlib.sha256(d).hexdigest() for d in found], pa.string()))
                elif o == "decoded_sha256":
                    columns.append(pa.array([hashlib.sha256(b"".join(words[np.frombuffer(d, "<u4")])).hexdigest() for d in found], pa.string()))
                else:
                    columns.append(pa.array([np.frombuffer(d, "<u4").astype("i4") for d in found], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *outputs])

    return df.select(*[_q(c) for c in keep], _q(text).alias(slot)).mapInArrow(run, schema)


def decode(df: DataFrame, ids: str, ranks_path: str, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and ``decoded``, the bytes of the ids. Null ids give null, no ids empty bytes."""
    tokens = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    fields = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.select(*[_q(c) for c in keep]).schema]

    def run(batches):
        import pyarrow as pa
        words = tokens.value
        for batch in slices(batches):
            rows = batch.column(batch.num_columns - 1).to_pylist()
            data = [None if r is None else b"".join([words[i] for i in r]) for r in rows]
            columns = [batch.column(i) for i in range(batch.num_columns - 1)] + [pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "decoded"])

    return df.select(*[_q(c) for c in keep], _q(ids).alias("__ids")).mapInArrow(run, ", ".join([*fields, "decoded binary"]))


def _q(name: str):
    return F.col("`" + name.replace("`", "``") + "`")
