"""How sources of a language differ in their use of words, from stripes folded inside the tasks.

A task folds whole documents into one hash table: for every language and term a stripe with the number of
documents and a count for each source. A full table is written out and begun anew; Spark merges stripes by
term. Each merged stripe then gives its share of every divergence by itself, so no term meets another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from specula.llm._worker import slices
from specula.llm.bpe import _q
from specula.session import settle

#: probabilities are whole multiples of one in this many
SCALE = 1_000_000_000
#: everything but ASCII letters and characters beyond ASCII parts terms; A-Z become a-z
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
COUNTS = "stripe array<struct<source:string,n:bigint>>"


def stripes(docs: DataFrame, text: str, lang: str, source: str, entries: int = 300_000) -> DataFrame:
    """(lang, term, documents, stripe, n): merged stripes of every term, and with a null term the sources of each language.

    Null texts, languages and sources count as ''. ``entries`` bounds a task's table of (term, source) counts; it
    changes the work, not the result.
    """

    def fold(batches):
        from collections import Counter

        import pyarrow as pa
        kind = pa.list_(pa.struct([("source", pa.string()), ("n", pa.int64())]))
        held, used = {}, 0

        def rows():
            for name, terms in held.items():
                keys = list(terms)
                for at in range(0, len(keys), 50_000):
                    part = keys[at:at + 50_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(part), pa.string()), pa.array([k if k is None else k.decode() for k in part], pa.string()),
                         pa.array([[{"source": s, "n": n} for s, n in terms[k].items()] for k in part], kind)], names=["lang", "term", "stripe"])
        for batch in slices(batches):
            for words, name, own in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                terms = held.setdefault(name, {})
                terms.setdefault(None, {})[own] = 0
                for term, n in Counter((words or b"").translate(TABLE).split()).items():
                    stripe = terms.get(term)
                    if stripe is None:
                        stripe = terms[term] = {None: 0}  # the entry without a source counts documents
                        used += 1
                    stripe[None] += 1
                    if own in stripe:
                        stripe[own] += n
                    else:
                        stripe[own] = n
                        used += 1
                if used > entries:
                    yield from rows()
                    held.clear()
                    used = 0
        yield from rows()

    rows = docs.select(_q(text).alias("text"), F.coalesce(_q(lang).cast("string"), F.lit("")).alias("lang"), F.coalesce(_q(source).cast("string"), F.lit("")).alias("source"))
    parts = rows.mapInArrow(fold, f"lang string, term string, {COUNTS}").repartition("lang", "term")
    # counts are added up before they meet in one row: a row holds a source once, from however many tasks it comes
    counts = parts.select("lang", "term", F.explode("stripe").alias("x")).groupBy("lang", "term", F.col("x.source").alias("source")).agg(F.sum("x.n").alias("n"))
    return counts.groupBy("lang", "term").agg(
        F.coalesce(F.max(F.when(F.col("source").isNull(), F.col("n"))), F.lit(0)).alias("documents"),
        F.collect_list(F.when(F.col("source").isNotNull(), F.struct("source", "n"))).alias("stripe"),
        F.coalesce(F.sum(F.when(F.col("source").isNotNull(), F.col("n"))), F.lit(0)).alias("n"))


def _share(count, total):
    """1 + floor(SCALE * count / total) of numpy integers, exact up to totals of 9e15."""
    out = 0
    for _ in range(3):
        count = count * 1000
        out, count = out * 1000 + count // total, count % total
    return out + 1


def _apart(p, q):
    return (p - q) * (p - q) // (p + q)


def _shares(batches, top: int):
    """Shares of divergences from merged stripes: pairs as sums of a task's terms, terms as the largest ones of a task."""
    import numpy as np
    import pyarrow as pa
    names = ["lang", "source", "part", "item", "value"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()]
    contexts, sums, best, cells = {}, {}, {}, 0

    def pairs():
        for name, acc in sums.items():
            sources = contexts[name][0]
            for i, row in acc.items():
                at = np.flatnonzero(row)
                if len(at):
                    a = [(sources[i], sources[j]) if i < j else (sources[j], sources[i]) for j in at.tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(
                        ([name] * len(at), [x for x, _ in a], ["pair"] * len(at), [y for _, y in a], row[at]), kinds)], names=names)

    for whole in batches:
        langs = whole.column(0).to_pylist()
        cuts = [0, *[i for i in range(1, len(langs)) if langs[i] != langs[i - 1]], len(langs)]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo == hi:
                continue
            name = langs[lo]
            if name not in contexts:
                facts = whole.slice(lo, 1).to_pylist()[0]
                sources = [g["source"] for g in facts["groups"]]
                totals = np.array([g["n"] for g in facts["groups"]], np.int64) + 2 * facts["v"]
                contexts[name] = (sources, {s: i for i, s in enumerate(sources)}, totals, facts["n_lang"] + 2 * facts["v"], _share(np.full(len(sources), 2, np.int64), totals))
            sources, place, totals, whole_total, none = contexts[name]
            step = max(1, 1_000_000 // len(sources))
            for start in range(lo, hi, step):
                piece = whole.slice(start, min(step, hi - start))
                terms, all_n = piece.column(1).to_pylist(), piece.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
                c = np.zeros((len(terms), len(sources)), np.int64)
                for r, stripe in enumerate(piece.column(3).to_pylist()):
                    for x in stripe:
                        c[r, place[x["source"]]] = x["n"]
                p, q = _share(c + 2, totals[None, :]), _share(all_n + 2, whole_total)
                acc = sums.setdefault(name, {})
                for i in range(len(sources)):
                    rows = np.flatnonzero(c[:, i])
                    if not len(rows):
                        continue
                    # against what two sources without the term would give; terms of both are counted with the first one
                    more = _apart(p[rows, i][:, None], p[rows]) - _apart(none[i], none)[None, :]
                    more[:, :i][c[rows, :i] > 0] = 0
                    more[:, i] = 0
                    if i not in acc:
                        acc[i] = np.zeros(len(sources), np.int64)
                        cells += len(sources)
                    acc[i] += more.sum(0)
                    rows = rows[p[rows, i] > q[rows]]
                    value = _apart(p[rows, i], q[rows])
                    if len(rows) > top:
                        large = value >= np.partition(value, -top)[-top]
                        rows, value = rows[large], value[large]
                    held = best.get((name, i), []) + [(-v, terms[r]) for v, r in zip(value.tolist(), rows.tolist())]
                    # strings in the order of their code points are in the order of their UTF-8 bytes
                    best[name, i] = sorted(held)[:top]
                if cells > 4_000_000:
                    yield from pairs()
                    sums.clear()
                    cells = 0
    yield from pairs()
    for (name, i), held in best.items():
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(
            ([name] * len(held), [contexts[name][0][i]] * len(held), ["term"] * len(held), [t for _, t in held], [-v for v, _ in held]), kinds)], names=names)


def divergences(docs: DataFrame, text: str, lang: str, source: str, least: int = 10, top: int = 10, most: int = 100_000) -> DataFrame:
    """(lang, source, part, item, value, rank): how far sources of a language are from each other and which terms mark them.

    Terms of at least ``least`` documents of a language are kept. A source's share of a term is
    p = 1 + floor(1e9 (count + 2) / (N + 2 V)) for N occurrences of V kept terms, and the divergence of p and q is
    floor((p - q)^2 / (p + q)). Part ``pair`` has every other source of the language with the sum over all kept
    terms; part ``term`` the ``top`` terms that the source has more often than its language. Ranks are by falling value, ties in
    the order of UTF-8. Null and empty texts still name their group; without kept terms pairs have value 0. Repeated rows count as
    documents of their own. ``most`` is the number of sources up to which their totals are broadcast; with more they are joined by
    shuffle. An empty table gives an empty result, other columns are ignored.
    """
    merged = settle(stripes(docs, text, lang, source).filter(F.col("term").isNull() | (F.col("documents") >= least)))
    kept = merged.filter(F.col("term").isNotNull())
    groups = merged.filter(F.col("term").isNull()).select("lang", F.explode("stripe.source").alias("source"))
    counts = kept.select("lang", F.explode("stripe").alias("x")).groupBy("lang", F.col("x.source").alias("source")).agg(F.sum("x.n").alias("n"))
    totals = settle(groups.join(counts, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n")))
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("n_lang"))
    context = settle(totals.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("groups")).join(sizes, "lang", "left")
                     .select("lang", "groups", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("n_lang", F.lit(0)).alias("n_lang")))
    small = totals.count() <= most
    beside = F.broadcast(context) if small else context
    shares = settle(kept.join(beside, "lang").select("lang", "term", "n", "stripe", "groups", "v", "n_lang")
                    .mapInArrow(lambda batches: _shares(batches, top), "lang string, source string, part string, item string, value bigint"))
    between = shares.filter("part = 'pair'").groupBy("lang", F.col("source").alias("a"), F.col("item").alias("b")).agg(F.sum("value").alias("more"))
    none = "1 + {0} div ({1} + 2 * v)".format
    every = (totals.join(beside, "lang").select("lang", "source", "n", "v", F.explode("groups").alias("g")).filter(F.col("g.source") != F.col("source"))
             .select("lang", "source", F.col("g.source").alias("item"), "v", F.expr(f"if(v > 0, {none(2 * SCALE, 'n')}, null)").alias("p"), F.expr(f"if(v > 0, {none(2 * SCALE, 'g.n')}, null)").alias("q"))
             .select("lang", "source", "item", F.coalesce(F.expr("v * ((p - q) * (p - q) div (p + q))"), F.lit(0)).alias("base"),
                     F.least("source", "item").alias("a"), F.greatest("source", "item").alias("b")))
    pairs = every.join(between, ["lang", "a", "b"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("base") + F.coalesce("more", F.lit(0))).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(order))
    marks = shares.filter("part = 'term'").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.unionByName(marks)
