"""Repeated passages of a corpus, byte by byte, by longest-previous-factor arrays over dealt-out suffixes.

A suffix that repeats for ``length`` bytes has an equal string elsewhere, so both fall under the same key if the key
is a function of these bytes alone. The key is their anchor, the piece of ``ANCHOR`` bytes with the smallest hash;
neighbouring suffixes mostly share it and travel as one run. Runs whose anchor is found nowhere else end there,
equal runs are recognised by their digest, and only what is left sends its bytes to the task of its
anchor. There the suffixes are sorted by prefix doubling, and the previous and next smaller position within
neighbours of ``length`` common bytes say for each suffix whether it came earlier, and where.

An anchor that too many different runs share is replaced by longer pieces to its left and right, half of what is missing to
``length`` at a time, until its runs are dealt out finely enough; at full length they are equal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specula.llm._worker import once, slices
from specula.llm.bpe import _q
from specula.plans.ordered import spread_lookup
from specula.session import settle, shuffle_width

#: odd factors of the rolling hash and of its mixing
BASE, MIX = 0x9E3779B97F4A7C15 | 1, 0xBF58476D1CE4E5B9
#: bytes of text that a task looks at together
CHUNK = 1 << 20
EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
ROWS = "digest binary, start bigint, stop bigint"


def _mixed(v):
    import numpy as np
    v = (v ^ (v >> np.uint64(30))) * np.uint64(MIX)
    v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return v ^ (v >> np.uint64(31))


def _powers(n: int):
    """(factors, inverse factors, words of the 256 bytes) for texts of up to ``n`` bytes."""
    import numpy as np

    def build():
        size = 1 << max(21, n.bit_length())
        up, down = np.full(size, BASE, np.uint64), np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64), _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
    return once(("repeats", max(21, n.bit_length())), build)


def cut(data, ends, length: int, anchor: int, hot):
    """(key, first, last) of the runs of suffixes in the texts of ``data`` that end at ``ends``; first and last are places in data.

    ``hot`` has the keys, sorted, that are replaced by keys of longer pieces.
    """
    import numpy as np
    n, none = len(data), np.zeros(0, np.int64)
    if n < length:
        return none.astype(np.uint64), none, none
    up, down, byte = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(byte[data] * up[:n], out=sums[1:])

    def hashed(lo, hi):
        return _mixed((sums[hi] - sums[lo]) * down[lo] + (hi - lo).astype(np.uint64))
    lows = np.arange(n - anchor + 1)
    every = hashed(lows, lows + anchor)
    least, size, wide = (every & np.uint64(0xFFFFFFFF00000000)) | lows.astype(np.uint64), 1, length - anchor + 1
    while 2 * size <= wide:
        least, size = np.minimum(least[:-size], least[size:]), 2 * size
    if size < wide:
        least = np.minimum(least[:size - wide], least[wide - size:])
    place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    inside = np.zeros(n + 1, np.int32)
    long = ends - starts >= length
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - length + 1, -1)
    at = np.flatnonzero(np.cumsum(inside[:n - length + 1]) > 0)
    if not len(at):
        return none.astype(np.uint64), none, none
    new = np.concatenate([[0], np.flatnonzero(np.diff(place[at])) + 1])
    first, last = at[new], at[np.concatenate([new[1:], [len(at)]]) - 1]
    lo = place[first]
    hi, key = lo + anchor, every[lo]
    done = []
    while len(hot) and len(key):
        split = (hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key) & (hi - lo < length)
        done.append((key[~split], first[~split], last[~split]))
        first, last, lo, hi = first[split], last[split], lo[split], hi[split]
        half = (length - (hi - lo) + 1) // 2
        border = lo - half
        left, right = first <= border, last > border
        first, last, lo, hi = (np.concatenate(x) for x in (
            (first[left], np.maximum(first, border + 1)[right]), (np.minimum(last, border)[left], last[right]),
            ((lo - half)[left], lo[right]), (hi[left], (border + 1 + length)[right])))
        key = hashed(lo, hi)
    done.append((key, first, last))
    return tuple(np.concatenate(x) for x in zip(*done))


def _texts(batches, length: int, chunk: int):
    """(body, digest, offset) of texts; long ones in parts that have each suffix of ``length`` bytes once."""
    import hashlib

    import pyarrow as pa
    for batch in slices(batches, 64):
        for body in batch.column(0).cast(pa.binary()).to_pylist():
            if body and len(body) >= length:
                digest = hashlib.sha256(body).digest()[:16]
                for at in range(0, len(body) - length + 1, chunk):
                    yield body[at:at + chunk + length - 1], digest, at


def _cuts(batches, length: int, anchor: int, hot, seen: set, chunk: int):
    """(key, first, last, data, ends, digests, offsets) of about ``chunk`` bytes of different texts at a time; ``seen`` has their digests."""
    import numpy as np
    held, size = [], 0

    def out():
        data, ends = np.frombuffer(b"".join(x[0] for x in held), np.uint8), np.cumsum([len(x[0]) for x in held])
        return *cut(data, ends, length, anchor, hot), data, ends, np.frombuffer(b"".join(x[1] for x in held), ">u8").astype(np.uint64).reshape(-1, 2), np.array([x[2] for x in held], np.int64)
    for body, digest, at in _texts(batches, length, chunk):
        if (digest, at) in seen:
            continue
        seen.add((digest, at))
        held.append((body, digest, at))
        size += len(body)
        if size >= chunk:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def _equal(column):
    """Which entries equal the one before."""
    import numpy as np
    return np.concatenate([[False], column[1:] == column[:-1]])


def _binary(digest):
    """Pairs of words as an Arrow column of 16 bytes each."""
    import numpy as np
    import pyarrow as pa
    return pa.Array.from_buffers(pa.binary(16), len(digest), [None, pa.py_buffer(np.ascontiguousarray(digest.astype(">u8")).tobytes())]).cast(pa.binary())


def _merged(doc, start, stop):
    """Overlapping or touching spans of a document joined; (doc, start, stop) sorted."""
    import numpy as np
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    far = np.int64(1) << np.int64(40)
    reach = np.maximum.accumulate(stop + doc * far)
    new = np.concatenate([[True], (start + doc * far)[1:] > reach[:-1]])
    at = np.flatnonzero(new)
    return doc[at], start[at], (reach - doc * far)[np.concatenate([at[1:], [len(doc)]]) - 1]


def hot_keys(docs: DataFrame, text: str, length: int, anchor: int, most: int, chunk: int = CHUNK, share: int = 8):
    """Keys that more than ``most`` runs have, or one in 100,000 runs of larger tables: they are to be split.

    Runs are counted in one of ``share`` texts, by the text's hash. This decides how work is dealt out and no result.
    """
    import numpy as np
    part = docs.filter(F.pmod(F.xxhash64(_q(text)), F.lit(share)) == 0).select(_q(text).alias("text"))
    hot = np.zeros(0, np.uint64)
    while True:
        def count(batches, hot=hot):
            import pyarrow as pa
            for key, *_ in _cuts(batches, length, anchor, hot, set(), chunk):
                key, n = np.unique(key, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64), pa.int64()), pa.array(n.astype(np.int64), pa.int64())], names=["key", "n"])
        counts = settle(part.mapInArrow(count, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")))
        least = max(most / share, (counts.agg(F.sum("n")).first()[0] or 0) / 100_000)
        found = np.array([r[0] for r in counts.filter(F.col("n") > least).select("key").collect()], np.int64).view(np.uint64)
        new = np.setdiff1d(found, hot)
        if not len(new):  # pieces of full length stay what they are
            return hot
        hot = np.union1d(hot, new)


def _entries(length: int, anchor: int, hot, bits: int, first: bool, chunk: int):
    """Blocks of runs by bucket of their key; runs that a task holds twice are settled within it."""
    from hashlib import blake2b

    import numpy as np
    import pyarrow as pa
    names = ["bucket", "keys", "runs", "digests", "starts", "sizes", "known"]

    def block(bucket, *columns):
        order = np.argsort(bucket, kind="stable")
        bucket, columns = bucket[order], [c[order] for c in columns]
        at = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
        return pa.RecordBatch.from_arrays([pa.array(bucket[at[:-1]], pa.int64())] + [
            pa.array([c[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary()) for c in columns], names=names)

    def settled(parts):
        key, run, digest, start, size = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((start, digest[:, 1], digest[:, 0], run[:, 1], run[:, 0], key))
        key, run, digest, start, size = (c[order] for c in (key, run, digest, start, size))
        same = _equal(key) & _equal(run[:, 0]) & _equal(run[:, 1])
        known = ~same & np.concatenate([same[1:], [False]])
        again = same if first else same | known
        if again.any():
            doc = np.unique(digest[again], axis=0, return_inverse=True)
            d, a, b = _merged(doc[1].reshape(-1), start[again], (start + size)[again])
            d = doc[0][d]
            yield block((1 << bits) + (d[:, 0] >> np.uint64(64 - bits)).astype(np.int64), np.zeros(len(d), np.uint64), np.zeros((len(d), 2), np.uint64), d, a, b - a, np.zeros(len(d), np.uint8))
        o = ~same
        yield block((key[o] >> np.uint64(64 - bits)).astype(np.int64), key[o], run[o], digest[o], start[o], size[o], known[o].astype(np.uint8))

    def send(batches):
        parts, many, seen = [], 0, set()
        for key, lo, hi, data, ends, digests, offsets in _cuts(batches, length, anchor, hot.value, seen, chunk):
            doc, view = np.searchsorted(ends, lo, side="right"), memoryview(data)
            run = np.frombuffer(b"".join([blake2b(view[a:b], digest_size=16).digest() for a, b in zip(lo.tolist(), (hi + length).tolist())]), np.uint64).reshape(-1, 2)
            parts.append((key, run, digests[doc], lo - np.concatenate([[0], ends[:-1]])[doc] + offsets[doc], hi - lo + length))
            many += len(key) + len(ends)
            if many > 400_000:
                yield from settled(parts)
                parts, many = [], 0
                seen.clear()
        if parts:
            yield from settled(parts)
    return send


def _gather(bits: int, first: bool):
    """Of a bucket's runs: spans that are repeated, and with a key the runs that others of it are to be compared with."""
    import numpy as np
    import pyarrow as pa
    names = ["key", "digest", "start", "stop", "known"]

    def rows(key, digest, start, stop, known):
        for at in range(0, len(digest), 50_000):
            p = slice(at, at + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array([None] * len(digest[p]) if key is None else key[p].view(np.int64), pa.int64()), _binary(digest[p]),
                                              pa.array(start[p], pa.int64()), pa.array(stop[p], pa.int64()), pa.array(known[p], pa.bool_())], names=names)

    def gather(batches):
        held = []
        for batch in batches:
            for bucket, *parts in zip(*(batch.column(i).to_pylist() for i in range(7))):
                key, run, digest, start, size, known = (np.frombuffer(p, k) for p, k in zip(parts, (np.uint64, np.uint64, np.uint64, np.int64, np.int64, np.uint8)))
                digest = digest.reshape(-1, 2)
                if bucket >= 1 << bits:
                    yield from rows(None, digest, start, start + size, known > 0)
                else:
                    held.append((key, run.reshape(-1, 2), digest, start, size, known > 0))
        if not held:
            return
        key, run, digest, start, size, known = (np.concatenate(x) for x in zip(*held))
        held.clear()
        order = np.lexsort((start, digest[:, 1], digest[:, 0], run[:, 1], run[:, 0], key))
        key, run, digest, start, size, known = (c[order] for c in (key, run, digest, start, size, known))
        same_key = _equal(key)
        same_run = same_key & _equal(run[:, 0]) & _equal(run[:, 1])
        copy = same_run & _equal(digest[:, 0]) & _equal(digest[:, 1]) & _equal(start)  # one text, met by several tasks
        known = np.logical_or.reduceat(known, np.flatnonzero(~copy))
        key, digest, start, size, same_key, same_run = (c[~copy] for c in (key, digest, start, size, same_key, same_run))
        begins = np.flatnonzero(~same_run)
        counts = np.diff(np.concatenate([begins, [len(key)]]))
        # with ``first`` all but the first of equal runs; else all of them but those that their task has reported
        again = same_run if first else np.repeat(counts > 1, counts) & ~known
        yield from rows(None, digest[again], start[again], (start + size)[again], known[again])
        groups = np.flatnonzero(~same_key[begins])
        runs = np.diff(np.concatenate([groups, [len(begins)]]))
        unsure = np.repeat(runs > 1, runs)
        o = begins[unsure]
        yield from rows(key[o], digest[o], start[o], (start + size)[o], ((counts > 1) | known[begins])[unsure] & (not first))
    return gather


def suffix_ranks(data, length: int):
    """Ranks of the suffixes of ``data`` by their first ``length`` bytes, by prefix doubling; equal ones have one rank."""
    import numpy as np
    size = 8
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, size)).view(">u8")[:, 0].astype(np.uint64)
    rank = np.unique(words, return_inverse=True)[1].astype(np.uint64)
    while size < length:
        step = min(size, length - size)
        rank = np.unique((rank[:-step] << np.uint64(32)) | rank[step:], return_inverse=True)[1].astype(np.uint64)
        size += step
    return rank


def smaller_before(same, position):
    """For each place of an array the nearest earlier place of smaller position that is linked by ``same``, or -1.

    ``same[i]`` says that place i shares enough with place i - 1.
    """
    import numpy as np
    n = len(position)
    begin = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
    found = np.where(same, np.arange(n) - 1, -1)
    open_ = np.flatnonzero(found >= 0)
    while len(open_):
        open_ = open_[position[found[open_]] > position[open_]]
        back = found[found[open_]]
        found[open_] = np.where(back >= begin[open_], back, -1)
        open_ = open_[found[open_] >= 0]
    return found


def previous_factors(data, places, position, length: int):
    """(earlier, source): which suffixes at ``places`` of ``data`` share ``length`` bytes with one of smaller position, and that one's index.

    The suffixes are sorted, and among neighbours with that much in common the previous and the next smaller position are earlier matches.
    """
    import numpy as np
    rank = suffix_ranks(data, length)[places]
    order = np.argsort(rank, kind="stable")
    same = np.concatenate([[False], rank[order][1:] == rank[order][:-1]])
    there = position[order]
    before = smaller_before(same, there)
    after = smaller_before(np.concatenate([[False], same[1:][::-1]]), there[::-1])[::-1]
    after = np.where(after >= 0, len(order) - 1 - after, -1)
    match = np.where(before >= 0, before, after)
    earlier, source = np.zeros(len(places), bool), np.full(len(places), -1)
    earlier[order] = match >= 0
    source[order] = np.where(match >= 0, order[match], -1)
    return earlier, source


def _compare(length: int, first: bool, chunk: int):
    """Spans of repeated suffixes among the runs of whole keys, which come one after the other."""
    import numpy as np
    import pyarrow as pa

    def spans(runs):
        data = np.frombuffer(b"".join(r[4] for r in runs), np.uint8)
        sizes = np.array([len(r[4]) for r in runs])
        ends = np.cumsum(sizes)
        n = sizes - length + 1
        owner = np.repeat(np.arange(len(runs)), n)
        shift = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        names = np.frombuffer(b"".join(r[1] for r in runs), ">u8").astype(np.uint64).reshape(-1, 2)
        start = np.array([r[2] for r in runs], np.int64)
        rank = np.unique(names, axis=0, return_inverse=True)[1].reshape(-1)
        position = np.empty(len(owner), np.int64)
        position[np.lexsort((start[owner] + shift, rank[owner]))] = np.arange(len(owner))
        again, source = previous_factors(data, (ends - sizes)[owner] + shift, position, length)
        if not first:
            again[source[again]] = True
            again &= ~np.array([r[3] for r in runs])[owner]
        at = np.flatnonzero(again)
        if not len(at):
            return
        new = np.concatenate([[True], (np.diff(at) != 1) | (np.diff(owner[at]) != 0)])
        lo, hi = at[new], at[np.concatenate([np.flatnonzero(new)[1:], [len(at)]]) - 1]
        yield pa.RecordBatch.from_arrays([_binary(names[owner[lo]]), pa.array(start[owner[lo]] + shift[lo], pa.int64()),
                                          pa.array(start[owner[hi]] + shift[hi] + length, pa.int64())], names=["digest", "start", "stop"])

    def compare(batches):
        held, size, begin = [], 0, 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if held and held[-1][0] != row[0]:
                    if size > chunk:
                        yield from spans(held)
                        held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield from spans(held)
    return compare


def _take(batches):
    """Bytes of the runs that each text is asked for."""
    import pyarrow as pa
    names, kinds = ["key", "digest", "start", "known", "bytes"], (pa.int64(), pa.binary(), pa.int64(), pa.bool_(), pa.binary())
    for batch in slices(batches, 64):
        out = [(w["key"], digest, w["start"], w["known"], body[w["start"]:w["stop"]])
               for digest, body, wanted in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()) for w in wanted]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)


def _leave(batches):
    """What is left of each text without its spans."""
    import hashlib

    import pyarrow as pa
    names = ["digest", "spans", "n_removed", "kept", "kept_sha256"]
    kinds = (pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.int64(), pa.binary(), pa.string())
    for batch in slices(batches, 64):
        out = []
        for digest, body, spans in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
            merged = []
            for a, b in sorted((s["start"], s["stop"]) for s in spans):
                if merged and a <= merged[-1]["stop"]:
                    merged[-1]["stop"] = max(b, merged[-1]["stop"])
                else:
                    merged.append({"start": a, "stop": b})
            ends = [0, *(x for s in merged for x in (s["start"], s["stop"])), len(body)]
            kept = b"".join(body[a:b] for a, b in zip(ends[::2], ends[1::2]))
            out.append((digest, merged, len(body) - len(kept), kept, hashlib.sha256(kept).hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)


def _sha(text):
    return F.sha2(F.coalesce(text.cast("binary"), F.lit(b"")), 256)


def _digest(sha):
    return F.unhex(F.substring(sha, 1, 32))


def _held(docs: DataFrame, text: str, wanted: DataFrame, small: int) -> DataFrame:
    """(digest, text): one row for each text that ``wanted`` (digest, distinct) names; the names are broadcast up to ``small`` of them."""
    rows = docs.select(_digest(_sha(_q(text))).alias("digest"), _q(text).alias("text"))
    found = rows.join(F.broadcast(wanted) if wanted.count() <= small else wanted, "digest", "left_semi")
    return found.groupBy("digest").agg(F.first("text").alias("text"))


def repeats(docs: DataFrame, text: str, length: int = 200, keep: str | None = "first", anchor: int = 64, most: int = 20_000, small: int = 500_000, chunk: int = CHUNK) -> DataFrame:
    """(digest, spans, n_removed, kept, kept_sha256) of each different text of ``docs`` with a repeated string of ``length`` bytes.

    Texts are their UTF-8 bytes. Spans (start, stop; in order, apart) are the bytes of strings of ``length`` that also start
    elsewhere, in the same text or another one; kept are the other bytes. With ``keep`` 'first' the first of equal strings stays: the one in the text of
    smallest digest, there the one that starts first. Digests are the first half of the text's SHA-256. Copies of a
    text are one text here. Null and short texts have no row, an empty table gives an empty result.
    ``anchor``, ``most``, ``small`` and ``chunk`` (bytes that a task looks at together) change the work, not the result.
    """
    if not 16 <= anchor < length or length - anchor > 2048 or keep not in ("first", None):
        raise ValueError("length is to exceed anchor, which is 16 at least, by 2048 at most; keep is 'first' or None")
    spark, first = docs.sparkSession, keep == "first"
    bytes_ = docs.agg(F.sum(F.octet_length(_q(text).cast("binary")))).first()[0] or 0
    bits = max(10, (bytes_ >> 27).bit_length())
    width = max(shuffle_width(spark), bytes_ >> 26)
    hot = spark.sparkContext.broadcast(hot_keys(docs, text, length, anchor, most, chunk))
    schema = "bucket bigint, keys binary, runs binary, digests binary, starts binary, sizes binary, known binary"
    live = settle(docs.select(_q(text).alias("text")).mapInArrow(_entries(length, anchor, hot, bits, first, chunk), schema).repartition(width, "bucket")
                  .mapInArrow(_gather(bits, first), f"key bigint, {ROWS}, known boolean"))
    hot.destroy()
    asked = live.filter("key IS NOT NULL").groupBy("digest").agg(F.collect_list(F.struct("key", "start", "stop", "known")).alias("wanted"))
    asked = settle(asked)
    runs = _held(docs, text, asked.select("digest"), small).join(asked, "digest").mapInArrow(_take, "key bigint, digest binary, start bigint, known boolean, bytes binary")
    more = runs.repartition(width, "key").sortWithinPartitions("key").mapInArrow(_compare(length, first, chunk), ROWS)
    spans = settle(live.filter("key IS NULL").select("digest", "start", "stop").union(more).groupBy("digest").agg(F.collect_list(F.struct("start", "stop")).alias("spans")))
    return (_held(docs, text, spans.select("digest"), small).join(spans, "digest")
            .mapInArrow(_leave, "digest binary, spans array<struct<start:bigint,stop:bigint>>, n_removed bigint, kept binary, kept_sha256 string"))


def without_repeats(docs: DataFrame, doc_id: str, text: str, length: int = 200, keep: str | None = "first", **work) -> DataFrame:
    """(id, n_bytes, n_removed, spans, kept_sha256) for each row of ``docs``.

    As ``repeats``, and rows of one and the same text repeat each other: without ``keep`` all bytes of such rows of at least ``length``
    bytes go, with 'first' those of all but the rows with the smallest id. Null texts are empty ones. Repeated rows are repeated in the
    result, other columns are ignored.
    """
    t = _q(text).cast("binary")
    rows = docs.select(_q(doc_id).alias("id"), F.coalesce(F.octet_length(t), F.lit(0)).cast("bigint").alias("n_bytes"), _sha(_q(text)).alias("sha"))
    rows = rows.select("id", "n_bytes", "sha", _digest(F.col("sha")).alias("digest"))
    copies = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least")).filter("n > 1")
    found = repeats(docs, text, length, keep, **work).select("digest", "spans", "n_removed", "kept_sha256")
    facts = copies.join(found, "digest", "full").withColumn("n", F.coalesce("n", F.lit(1))).withColumn("total_n", F.lit(docs.count()))
    told = spread_lookup(rows, facts, ["digest"], ["n", "least", "spans", "n_removed", "kept_sha256"], "n")
    again = (F.col("n") > 1) & (F.col("n_bytes") >= length)
    if keep == "first":
        again &= ~F.col("id").eqNullSafe(F.col("least"))
    again = F.coalesce(again, F.lit(False))
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.col("n_bytes").alias("stop")))
    return told.select("id", "n_bytes", F.when(again, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
                       F.when(again, whole).otherwise(F.coalesce("spans", F.array().cast("array<struct<start:bigint,stop:bigint>>"))).alias("spans"),
                       F.when(again, F.lit(EMPTY)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"))
