"""N-gram Jaccard self-join by rare-first prefix filtering.

1. Every document becomes the set of its word n-grams (64-bit hashes) and a digest of that set.
   Equal sets form one class, however many copies there are; from here on work is per class.
2. All n-grams of all classes are counted. They travel packed, 4 bytes each, pre-aggregated per
   task. The most frequent ones, bounded in number, go back to the tasks, so that all agree on
   one order: rare n-grams first, frequent ones last, by their counts.
3. Two sets as similar as asked share an n-gram among the first few of both in this order. The
   tasks send just this prefix, again packed; what is alone under its n-gram ends there. Frequent
   n-grams are never gathered: their entries come as plain rows that joins may split.
4. Candidates must pass the length filter, the positional filter (what is left after the shared
   n-gram must suffice) and the suffix filter (parities of hash cells bound the difference), and
   are verified once per pair on whole sets.
5. A group of thousands of variants has millions of similar pairs. As only components are asked
   for, a first round groups classes by a leader that they share n-grams with, pairs all of a group with
   some of it and joins what is verified; the second takes every pair across what is not connected yet.
   So no connection between different sets is lost, and none is verified twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specula.llm._links import components as connected_components
from specula.llm._worker import once, release, slices
from specula.llm.bpe import _q
from specula.session import settle, shuffle_width

MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
BASE = 0xD6E8FEB86659FD93
BASE_INVERSE = pow(BASE, -1, 1 << 64)
PIECE = 1 << 18
ROWS = 1 << 16
#: of classes that have the same leader, about so many are paired with all others in the first round
CHIEFS = 32


def _mixed(v):
    import numpy as np
    v = (v ^ (v >> np.uint64(30))) * np.uint64(MIX[1])
    v = (v ^ (v >> np.uint64(27))) * np.uint64(MIX[2])
    return v ^ (v >> np.uint64(31))


def _powers(base: int, n: int):
    import numpy as np

    def build():
        table = np.full(n, base, np.uint64)
        table[0] = 1
        return np.multiply.accumulate(table)
    n = 1 << max(18, (n - 1).bit_length())
    return once(("powers", base, n), build)


def word_hashes(data):
    """(hashes, starts) of the words in UTF-8 bytes: A-Z lower-cased, cut at ASCII white space.

    A word's hash is its polynomial over 2^64, taken from running sums and moved to the word's start.
    """
    import numpy as np
    lower = once("lower", lambda: np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint64))
    space = once("space", lambda: np.array([b == 32 or 9 <= b <= 13 for b in range(256)]))
    blank = space[data]
    edge = np.diff(np.concatenate([[True], blank, [True]]).view(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(lower[data] * _powers(BASE, len(data) + 1)[:len(data)], out=sums[1:])
    return _mixed((sums[end] - sums[start]) * _powers(BASE_INVERSE, len(data) + 1)[start] + (end - start).astype(np.uint64)), start


def shingle_sets(texts, n: int):
    """(hashes, ends) for an Arrow column of texts: per text the sorted hashes of its distinct runs of ``n`` words.

    A text of fewer words has its whole sequence as the one run, a text without words none.
    """
    import numpy as np
    import pyarrow as pa
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]] if len(texts) and offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    kept, ends, at = [], [], 0
    first = 0
    while first < len(texts):
        # a few texts at once; the end of a text ends a word
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + PIECE, side="right")) - 1)
        low, high = int(offsets[first]), int(offsets[last])
        cuts = offsets[first:last + 1] - low
        gap = np.arange(len(cuts))
        padded = np.full(high - low + len(cuts), 32, np.uint8)
        if last - first == 1:
            padded[:high - low] = data[low:high]
        else:
            place = np.ones(len(padded), bool)
            place[cuts[1:] + gap[:-1]] = False
            place[-1] = False
            padded[place] = data[low:high]
        h, begin = _long_words(padded) if len(padded) > 2 * PIECE else word_hashes(padded)
        bound = np.searchsorted(begin, cuts + gap)
        run = np.full(max(0, len(h) - n + 1), n, np.uint64)
        for i in range(n):
            run = _mixed(run * np.uint64(MIX[0]) + h[i:len(h) - n + 1 + i]) if len(run) else run
        for a, b in zip(bound[:-1].tolist(), bound[1:].tolist()):
            if b - a >= n:
                s = np.sort(run[a:b - n + 1])
                s = s[np.concatenate([[True], s[1:] != s[:-1]])]
            elif b > a:
                s = np.full(1, b - a, np.uint64)
                for x in h[a:b]:
                    s = _mixed(s * np.uint64(MIX[0]) + x)
            else:
                s = h[:0]
            kept.append(s)
            at += len(s)
            ends.append(at)
        first = last
    return (np.concatenate(kept) if kept else np.empty(0, np.uint64)), np.array(ends, np.int64)


def _long_words(data):
    """``word_hashes`` of a long text in pieces that end at white space, to bound memory."""
    import numpy as np
    blank = np.flatnonzero((data == 32) | (data == 10))
    hashes, starts, at = [], [], 0
    while at < len(data):
        k = int(np.searchsorted(blank, at + PIECE))
        end = int(blank[k]) + 1 if k < len(blank) else len(data)
        h, s = word_hashes(data[at:end])
        hashes.append(h)
        starts.append(s + at)
        at = end
    return np.concatenate(hashes), np.concatenate(starts)


def _digests(hashes, ends):
    """For sets one after another: two digests each, and the parities of the sizes of 256 hash cells."""
    import numpy as np
    size = np.diff(np.concatenate([[0], ends]))
    first, second = np.zeros(len(ends), np.uint64), np.zeros(len(ends), np.uint64)
    some = np.flatnonzero(size)
    if len(some):
        start = (ends - size)[some]
        first[some] = np.add.reduceat(_mixed(hashes + np.uint64(MIX[0])), start)
        second[some] = np.add.reduceat(_mixed(hashes ^ np.uint64(MIX[2])), start)
    cell = np.repeat(np.arange(len(ends)), size) * 256 + (hashes & np.uint64(255)).astype(np.int64)
    odd = (np.bincount(cell, minlength=256 * len(ends)) & 1).astype(np.uint8).reshape(-1, 256)
    return size, first.view(np.int64), second.view(np.int64), np.packbits(odd, axis=1).view(np.int64)


def sets(docs: DataFrame, doc_id: str, text: str, n: int) -> DataFrame:
    """(id, size, class, check, parity) of every document."""
    kind = docs.select(_q(doc_id)).schema[0].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa
        for batch in slices(batches, 64):
            size, first, second, parity = _digests(*shingle_sets(batch.column(1), n))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()),
                                              pa.array(list(parity), pa.list_(pa.int64()))], names=["id", "size", "class", "check", "parity"])
    return docs.select(_q(doc_id).alias("id"), _q(text).alias("text")).mapInArrow(
        run, f"id {kind}, size bigint, class bigint, check bigint, parity array<bigint>")


def _blocks(bucket, columns, schema, planes: int = 0):
    """One record batch with a row for each bucket: the bucket, and each column's part as bytes.

    Of the first ``planes`` columns all lowest bytes come first, then all second ones and so on.
    """
    import numpy as np
    import pyarrow as pa
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(bucket)]])
    arrays = [pa.array(bucket[starts].astype(np.int64), pa.int64())]
    for i, c in enumerate(columns):
        c = np.ascontiguousarray(c[order])
        if i < planes:
            c = c.view(np.uint8).reshape(len(c), -1)
            arrays.append(pa.array([c[a:b].T.tobytes() for a, b in zip(starts, ends)], pa.binary()))
        else:
            arrays.append(pa.array([c[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()))
    return pa.RecordBatch.from_arrays(arrays, names=schema)


def frequent(docs: DataFrame, text: str, n: int, bits: int, width: int, least: int, most: int):
    """Counts of the most frequent n-grams as sorted (keys, counts) arrays: at least ``least``, and at most ``most`` of them."""
    import numpy as np

    def send(batches):
        seen, held, many = set(), [], 0

        def flush():
            keys, count = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            again = count > 1
            for part, weights in ((~again, False), (again, True)):
                if part.any():
                    k = keys[part]
                    c = count[part].astype(np.uint32) if weights else np.empty((len(k), 0), np.uint32)
                    gap = np.diff(k, prepend=np.uint64(0))
                    gap = np.where(np.diff(k >> np.uint64(32), prepend=np.uint64(1 << 40)) != 0, k & np.uint64(0xFFFFFFFF), gap)
                    yield _blocks(k >> np.uint64(32), [gap.astype(np.uint32), c], ["bucket", "keys", "counts"], planes=1)
        for batch in slices(batches, 64):
            hashes, ends = shingle_sets(batch.column(0), n)
            names = _digests(hashes, ends)[1].tolist()
            keys = hashes >> np.uint64(32 - bits)
            start = 0
            for name, end in zip(names, ends.tolist()):
                if end > start and name not in seen:  # a task counts equal sets once
                    seen.add(name)
                    held.append(keys[start:end])
                    many += end - start
                start = end
            if many > 1_500_000:
                yield from flush()
                many = 0
        if held:
            yield from flush()

    def tally(batches):
        import pyarrow as pa
        keys, counts = [], []
        for batch in batches:
            for b, k, c in zip(*(batch.column(i).to_pylist() for i in range(3))):
                gap = np.ascontiguousarray(np.frombuffer(k, np.uint8).reshape(4, -1).T).view(np.uint32)[:, 0]
                k = np.cumsum(gap, dtype=np.uint64) | np.uint64(b << 32)
                keys.append(k)
                counts.append(np.frombuffer(c, np.uint32) if c else np.ones(len(k), np.uint32))
        if keys:
            keys, counts = np.concatenate(keys), np.concatenate(counts)
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            at = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1])
            total = np.add.reduceat(counts.astype(np.int64), at)
            top = total >= least
            yield pa.RecordBatch.from_arrays([pa.array(keys[at[top]].astype(np.int64), pa.int64()), pa.array(total[top], pa.int64())], names=["key", "n"])
        release()

    counted = settle(docs.select(_q(text).alias("text")).mapInArrow(send, "bucket bigint, keys binary, counts binary")
                     .repartition(width, "bucket").mapInArrow(tally, "key bigint, n bigint"))
    level = F.floor(F.log2(F.col("n").cast("double"))).cast("int")
    floor, total = least, 0
    for r in sorted(counted.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):
        total += r["count"]
        if total > most:
            floor = max(least, 2 ** (r["level"] + 1))
            break
    table = counted.filter(F.col("n") >= floor).toArrow()
    keys, counts = table.column("key").to_numpy(), table.column("n").to_numpy()
    order = np.argsort(keys)
    return keys[order], counts[order]


def postings(docs: DataFrame, text: str, n: int, percent: int, heavy, bits: int, width: int) -> DataFrame:
    """(key, class, size, place): prefix entries whose n-gram another class may share."""

    def send(batches):
        import numpy as np
        keys, counts = heavy.value
        seen, held, many = set(), [], 0
        names = ["bucket", "keys", "classes", "sizes", "places"]

        def often(key):
            if not len(keys):
                return np.zeros(len(key), np.int64)
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            return np.where(keys[at] == key, counts[at], 0)

        def flush():
            key, owner, size, place, count = (np.concatenate(x) for x in zip(*held))
            held.clear()
            # entries of frequent n-grams are only passed on: they are dealt out by class
            bucket = np.where(count > 0, (1 << bits) + (owner.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64), key >> 32)
            return _blocks(bucket, [key, owner, size, place], names)
        for batch in slices(batches, 64):
            hashes, ends = shingle_sets(batch.column(0), n)
            every = (hashes >> np.uint64(32 - bits)).astype(np.int64)
            start = 0
            for name, end in zip(_digests(hashes, ends)[1].tolist(), ends.tolist()):
                size, key = end - start, every[start:end]
                start = end
                if not size or name in seen:
                    continue
                seen.add(name)
                want = size + (-percent * size // 100) + 1
                # hashes are sorted: if enough rare ones are among the first, the rest need not be looked up
                part = key[:2 * want]
                count = often(part)
                if (count == 0).sum() < want and len(part) < size:
                    part, count = key, often(key)
                first = np.argsort(count, kind="stable")[:want]
                held.append((part[first], np.full(want, name, np.int64), np.full(want, size, np.int32), np.arange(want, dtype=np.int32), count[first]))
                many += want
            if many > 500_000:
                yield flush()
                many = 0
        if held:
            yield flush()

    def gather(batches):
        import numpy as np
        import pyarrow as pa
        kinds = (np.int64, np.int64, np.int32, np.int32)
        names = ["key", "class", "size", "place"]

        def rows(columns):
            return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64), pa.int64()) for c in columns], names=names)
        held = []
        for batch in batches:
            for b, *parts in zip(*(batch.column(i).to_pylist() for i in range(5))):
                columns = [np.frombuffer(p, k) for p, k in zip(parts, kinds)]
                if b >= 1 << bits:
                    yield rows(columns)
                else:
                    held.append(columns)
        if held:
            columns = [np.concatenate(x) for x in zip(*held)]
            held.clear()
            order = np.lexsort((columns[1], columns[0]))
            for i in range(len(columns)):  # one by one, so that only one is there twice
                columns[i] = columns[i][order]
            key, owner = columns[:2]
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])])
            at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            many = np.add.reduceat(new.astype(np.int64), at)  # different owners of each key
            shared = np.flatnonzero(new & np.repeat(many > 1, np.diff(np.append(at, len(key)))))
            del key, owner, order, new
            for i in range(0, len(shared), ROWS):
                yield rows([c[shared[i:i + ROWS]] for c in columns])
        release()

    return (docs.select(_q(text).alias("text")).mapInArrow(send, "bucket bigint, keys binary, classes binary, sizes binary, places binary")
            .repartition(width, "bucket").mapInArrow(gather, "key bigint, class bigint, size bigint, place bigint"))


def _may_match(a, b, percent: int):
    """Length and positional filter of entries of one n-gram."""
    small, large = F.least(a["size"], b["size"]), F.greatest(a["size"], b["size"])
    left = F.least(a["size"] - a["place"], b["size"] - b["place"])
    return (100 * small >= percent * large) & ((100 + percent) * left >= percent * (small + large))


def _may_link(size_a, size_b, parity_a, parity_b, percent: int):
    """Length and suffix filter of two sets: at least as many n-grams are in one of them only as cell parities differ."""
    apart = sum(F.bit_count(parity_a[i].bitwiseXOR(parity_b[i])) for i in range(4))
    return (100 * F.least(size_a, size_b) >= percent * F.greatest(size_a, size_b)) & ((100 + percent) * apart <= (100 - percent) * (size_a + size_b))


def verified(docs: DataFrame, doc_id: str, text: str, n: int, percent: int, pairs: DataFrame, small: int = 500_000) -> DataFrame:
    """Of ``pairs`` (a, b, a_id, b_id) those whose sets are similar enough."""
    need = settle(pairs.select(F.col("a").alias("class"), F.col("a_id").alias("id"))
                  .union(pairs.select("b", "b_id")).distinct())
    # below a counted size the ids go to every task; beyond it the documents are shuffled
    ids = need.select("id").distinct()
    held = docs.select(_q(doc_id).alias("id"), _q(text).alias("text")).join(F.broadcast(ids) if need.count() <= small else ids, "id", "left_semi")

    def build(batches):
        import pyarrow as pa
        for batch in slices(batches, 64):
            hashes, ends = shingle_sets(batch.column(1), n)
            names = _digests(hashes, ends)[1]
            starts = [0, *ends[:-1].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([hashes[a:b].tobytes() for a, b in zip(starts, ends.tolist())], pa.binary())],
                                             names=["class", "grams"])

    def compare(batches):
        import numpy as np
        import pyarrow as pa
        for batch in slices(batches, 64):
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a_id", "b_id"]).filter(pa.array(keep, pa.bool_()))

    grams = held.mapInArrow(build, "class bigint, grams binary")
    kind = pairs.schema["a_id"].dataType.simpleString()
    return (pairs.join(grams.select(F.col("class").alias("a"), F.col("grams").alias("x")), "a")
            .join(grams.select(F.col("class").alias("b"), F.col("grams").alias("y")), "b")
            .select("a_id", "b_id", "x", "y").mapInArrow(compare, f"a_id {kind}, b_id {kind}"))


def components(docs: DataFrame, doc_id: str, text: str, n: int = 4, percent: int = 85, least: int = 8,
               most: int = 1_000_000) -> DataFrame:
    """(id, size, component): each document's number of n-grams, and the smallest id it is connected to by links.

    Two documents link when 100 * |intersection| >= percent * |union| of their n-gram sets. Texts are
    lower-cased in A-Z and cut at ASCII white space; with fewer words than ``n`` the whole sequence
    is the one n-gram. Null and wordless texts have size 0 and link with nothing. Rows without an id take the
    component of their copies, or null. Repeated rows are repeated in the result. ``least`` and ``most``
    say which n-grams count as frequent; they change the work, not the result.
    """
    spark = docs.sparkSession
    held = settle(sets(docs, doc_id, text, n))
    classes = settle(held.filter("size > 0 AND id IS NOT NULL").groupBy("class").agg(
        F.min("id").alias("id"), F.first("size").alias("size"), F.first("parity").alias("parity"), F.min("check").alias("low"), F.max("check").alias("high")))
    facts = classes.agg(F.sum("size").alias("grams"), F.max(F.col("low") != F.col("high")).alias("clash")).first()
    if facts["clash"]:
        raise ValueError("two different sets have the same 64-bit digest; change MIX")
    total = facts["grams"] or 0
    bits = max(10, (total >> 23).bit_length())
    width = max(shuffle_width(spark), total >> 20)
    texts = docs.filter(_q(doc_id).isNotNull())
    heavy = spark.sparkContext.broadcast(frequent(texts, text, n, bits, width, least, most))
    live = settle(postings(texts, text, n, percent, heavy, bits, width))
    heavy.destroy()
    found = connected_components(_links(docs, doc_id, text, n, percent, live, classes), "a_id", "b_id")
    named = (classes.select("class", "id").join(found.withColumnRenamed("node", "id"), "id", "left")
             .select("class", F.coalesce("component", "id").alias("component")))
    return (held.join(settle(named), "class", "left")
            .select("id", "size", F.when(F.col("size") > 0, F.col("component")).otherwise(F.col("id")).alias("component")))


def _links(docs, doc_id, text, n, percent, live, classes):
    """Links that connect whatever is connected."""
    about = classes.select("class", "id", "size", "parity")

    # first: classes with the same leader among those they share n-grams with are paired with some of them
    leaders = settle(live.groupBy("key").agg(F.min(F.struct(F.xxhash64("class").alias("draw"), "class")).alias("lead")))
    home = settle(live.join(leaders, "key").groupBy("class").agg(F.min("lead").alias("lead")).select("class", F.col("lead.class").alias("home")).join(about, "class"))
    sizes = settle(home.groupBy("home").agg(F.count(F.lit(1)).alias("n")))
    draw = F.pmod(F.xxhash64("class", F.lit("chief")), F.lit(1 << 30)).cast("double") / (1 << 30)
    chiefs = settle(home.join(sizes, "home").filter((draw * F.col("n") < CHIEFS) | (F.col("class") == F.col("home"))).drop("n"))
    x, y = home.alias("x"), chiefs.alias("y")
    met = x.join(y, (F.col("x.home") == F.col("y.home")) & (F.col("x.class") != F.col("y.class")) & _may_link(F.col("x.size"), F.col("y.size"), F.col("x.parity"), F.col("y.parity"), percent))
    first = F.col("x.class") < F.col("y.class")
    tried = settle(met.select(*[F.when(first, F.col(f"x.{c}")).otherwise(F.col(f"y.{c}")).alias(n) for c, n in (("class", "a"), ("id", "a_id"))],
                              *[F.when(first, F.col(f"y.{c}")).otherwise(F.col(f"x.{c}")).alias(n) for c, n in (("class", "b"), ("id", "b_id"))]).distinct())
    found = settle(verified(docs, doc_id, text, n, percent, tried))
    # then all pairs across what is not connected yet; components are named by the digest of one of their classes
    ids = connected_components(found, "a_id", "b_id")
    owner = about.select("class", "id").join(ids.withColumnRenamed("node", "id"), "id").select("class", F.xxhash64("component").alias("owner"))
    owned = settle(live.join(settle(owner), "class", "left").select("key", "class", "size", "place", F.coalesce("owner", F.xxhash64("class", F.lit("alone"))).alias("owner")))
    open_keys = owned.groupBy("key").agg(F.min("owner").alias("low"), F.max("owner").alias("high")).filter("low <> high").select("key")
    entry = settle(owned.join(settle(open_keys), "key", "left_semi").join(about.select("class", "id", "parity"), "class"))
    x, y = entry.alias("x"), entry.alias("y")
    a, b = ({c: F.col(f"{p}.{c}") for c in ("class", "id", "owner", "size", "place", "parity")} for p in "xy")
    pairs = (x.join(y, (F.col("x.key") == F.col("y.key")) & (a["class"] < b["class"]) & (a["owner"] != b["owner"]) & _may_match(a, b, percent)
                    & _may_link(a["size"], b["size"], a["parity"], b["parity"], percent))
             .select(a["class"].alias("a"), b["class"].alias("b"), a["id"].alias("a_id"), b["id"].alias("b_id")).distinct())
    left = settle(pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti"))
    return found.union(settle(verified(docs, doc_id, text, n, percent, left)))
