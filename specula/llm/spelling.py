"""Words that differ by one letter, by a trie over letter-group counts.

Letters fall into groups; a word is the vector of how often each group occurs in it. One edit adds at most one to one
group and takes at most one from another, so words near each other lie on paths of a trie over these vectors that
differ by a surplus and a deficit of one each. The first levels of the trie deal the words out: a word is stored
under the counts of its first groups and looked for under all such keys within its budget. A task builds the
other levels for the words of its key and searches them depth first with what is left of the budget.
"""

from __future__ import annotations

import zlib
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specula.llm._worker import slices
from specula.llm.bpe import _q
from specula.session import settle

GROUPS = 16
RUN = "[A-Za-zÀ-ÿ]"
LOWER = {c: c + 32 for c in range(65, 91)}


def vector(word: str) -> bytes:
    """Counts of the letter groups, 255 standing for more; a letter's group is its code point modulo their number."""
    counts = [0] * GROUPS
    for c in word:
        counts[ord(c) % GROUPS] += 1
    return bytes(min(c, 255) for c in counts)


def words(docs: DataFrame, doc_id: str, text: str, letters: int = 6, least: int = 5, every: int = 0, entries: int = 300_000) -> DataFrame:
    """(word, n): lower-cased runs of letters with at least ``letters`` code points and ``least`` occurrences.

    Only A-Z are lower-cased. With ``every``, a run loses one letter if that number divides the crc32 of
    ``<doc_id>:<run>`` (the letter at that crc32 modulo the length). Null texts have no runs, a null id is an empty one.
    """

    def count(batches):
        import re
        from collections import Counter

        import pyarrow as pa
        find = re.compile(RUN + f"{{{letters},}}").findall
        held = Counter()
        for batch in slices(batches):
            for own, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                runs = Counter(find((body or "").translate(LOWER)))
                if every:
                    start = zlib.crc32(f"{own}:".encode())
                    for run, n in runs.items():
                        draw = zlib.crc32(run.encode(), start)
                        if draw % every == 0:
                            at = draw % len(run)
                            run = run[:at] + run[at + 1:]
                            if len(run) < letters:
                                continue
                        held[run] += n
                else:
                    held.update(runs)
            if len(held) > entries:
                yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
                held.clear()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    rows = docs.select(F.coalesce(_q(doc_id).cast("string"), F.lit("")).alias("own"), _q(text).alias("text"))
    return rows.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _keys(v: bytes, depth: int):
    """(key, surplus, deficit): where the first levels can hold a longer word, or one as long that does not come earlier."""
    head = v[:depth]
    yield head, 0, 0
    for i in range(depth):
        if head[i] < 255:
            yield head[:i] + bytes([head[i] + 1]) + head[i + 1:], 1, 0
    for i, j in combinations(range(depth), 2):
        if head[j] and head[i] < 255:
            yield head[:i] + bytes([head[i] + 1]) + head[i + 1:j] + bytes([head[j] - 1]) + head[j + 1:], 1, 1


def one_edit(a: str, b: str) -> bool:
    """Is ``b``, at least as long as ``a``, one inserted or replaced letter away?"""
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)):] == b[i + 1:]


class Trie:
    """Words under the counts of the groups from ``depth`` on."""

    def __init__(self, depth: int):
        self.depth, self.root = depth, {}

    def add(self, word: str, v: bytes, n: int) -> None:
        node = self.root
        for c in v[self.depth:-1]:
            node = node.setdefault(c, {})
        node.setdefault(v[-1], []).append((word, v, n))

    def search(self, v: bytes, surplus: int, deficit: int) -> list:
        """Leaves whose counts exceed those of ``v`` by ``surplus`` at most in all, and fall short by ``deficit`` at most."""
        found, stack = [], [(self.root, self.depth, surplus, deficit)]
        last = GROUPS - 1
        while stack:
            node, level, more, fewer = stack.pop()
            c = v[level]
            for count, up, down in ((c, more, fewer), (c + 1, more - 1, fewer), (c - 1, more, fewer - 1)):
                if up >= 0 and down >= 0 and count in node:
                    if level == last:
                        found += node[count]
                    else:
                        stack.append((node[count], level + 1, up, down))
        return found


def near_pairs(vocabulary: DataFrame, most: int = 5_000) -> DataFrame:
    """(a, b, a_n, b_n): the pairs of distinct words of ``vocabulary`` (word, n) one edit apart, each once.

    The first levels are as many as it takes for keys of at most ``most`` words; words of a key that is larger even with all
    levels are dealt out in blocks, and what looks for them goes to every block.
    """
    spark = vocabulary.sparkSession

    def describe(batches):
        import pyarrow as pa
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([vector(w) for w in batch.column(0).to_pylist()], pa.binary())], names=["word", "n", "v"])

    described = settle(vocabulary.select("word", "n").mapInArrow(describe, "word string, n bigint, v binary"))
    for depth in (2, 3, 4, 6, 8, 12, GROUPS):
        sizes = described.groupBy(F.substring("v", 1, depth).alias("key")).agg(F.count(F.lit(1)).alias("size"))
        largest = sizes.agg(F.max("size")).first()[0]
        if not largest or largest <= most:
            break
    sizes = settle(sizes.select("key", F.ceil(F.col("size") / most).cast("int").alias("blocks")))

    def ask(batches):
        import pyarrow as pa
        for batch in slices(batches, 2_000):
            out = [(key, w, n, v, 1 - up, 1 - down) for w, n, v in zip(*(batch.column(i).to_pylist() for i in range(3))) for key, up, down in _keys(v, depth)]
            kinds = (pa.binary(), pa.string(), pa.int64(), pa.binary(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["key", "word", "n", "v", "up", "down"])

    asked = (described.mapInArrow(ask, "key binary, word string, n bigint, v binary, up int, down int").join(sizes, "key")
             .select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "word", "n", "v", "up", "down"))
    stored = (described.select(F.substring("v", 1, depth).alias("key"), "word", "n", "v").join(sizes, "key")
              .select("key", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int").alias("block"), "word", "n", "v", F.lit(None).cast("int").alias("up"), F.lit(None).cast("int").alias("down")))

    def match(batches):
        import pyarrow as pa
        here, trie = None, None
        kinds, names = (pa.string(), pa.string(), pa.int64(), pa.int64()), ["a", "b", "a_n", "b_n"]
        for batch in slices(batches, 5_000):
            out, known = [], {}
            for key, block, word, n, v, up, down in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if (key, block) != here:
                    here, trie = (key, block), Trie(depth)
                    known = {}
                if up is None:  # stored words come before those that look for them
                    trie.add(word, v, n)
                    continue
                rest = (v[depth:], up, down)
                if rest not in known:
                    known[rest] = trie.search(v, up, down) if depth < GROUPS else [x for x in trie.root.get(key[-1], [])]
                head, size = v[:depth], len(word)
                for other, w, m in known[rest]:
                    longer = len(other) - size
                    if (longer == 1 or longer == 0 and (w[:depth] > head or w[:depth] == head and other > word)) and one_edit(word, other):
                        out.append((word, other, n, m))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return (stored.unionByName(asked).repartition("key", "block").sortWithinPartitions("key", "block", F.col("up").isNotNull())
            .mapInArrow(match, "a string, b string, a_n bigint, b_n bigint"))


def variants(vocabulary: DataFrame, ratio: int = 5, most: int = 5_000) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``vocabulary`` (word, n; words are distinct).

    Near words differ by one inserted, deleted or replaced letter. A word's form is its most frequent near
    word, of these the first in code-point order, if it occurs at least ``ratio`` times as often; its root is what
    following the forms leads to, the word itself if it has none. n_near counts near words, form_n is the
    form's n. An empty vocabulary gives an empty result.
    """
    vocabulary = settle(vocabulary.select("word", "n"))
    pairs = settle(near_pairs(vocabulary, most))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).union(pairs.select("b", "a", "a_n"))
    about = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    found = settle(vocabulary.join(about, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(
        -F.col("best.less") >= ratio * F.col("n"), F.struct(F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n"))).alias("f"))
        .select("word", "n", "n_near", F.col("f.form").alias("form"), F.col("f.form_n").alias("form_n")))
    ways = settle(found.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    # forms are ever more frequent, so paths end; each round doubles the steps taken
    while True:
        step = ways.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = settle(ways.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        ways = longer.select("word", "root")
        if not longer.filter("moved").limit(1).count():
            break
    return found.join(ways, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
