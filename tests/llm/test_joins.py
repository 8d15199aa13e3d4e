"""Joins, shards, pseudonyms, the classifier and the pipeline."""

import random
import re
import time
import zlib
from datetime import datetime

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from specula.llm import caps, ngramjoin, pii, quality, queries, sharding
from tests import oracle


def brute_components(rows, n, percent):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        k = min(n, len(w))
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set())
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[top(i)] = top(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        least[top(i)] = min(key, least.get(top(i), key))
    return sorted((key, len(sets[i]), least[top(i)] if sets[i] else key) for i, (key, _) in enumerate(rows))


def near_texts():
    draw = random.Random(8)
    word = lambda: "".join(draw.choice("abcdé") for _ in range(4))
    texts = [None, "", " \t\n", "a", "A", "a b", "a b c", "a b c d", "A  b\tc\nd", "x " * 5000]
    passage = [word() for _ in range(60)]
    for _ in range(12):  # variants of a base, from nearly equal to just too different
        base = [word() for _ in range(draw.choice([8, 30, 90]))]
        for _ in range(8):
            copy = list(base)
            for _ in range(draw.choice([0, 0, 1, 1, 2, 3])):
                copy[draw.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    texts += [" ".join(passage + [word() for _ in range(draw.choice([3, 8, 60]))]) for _ in range(40)]  # a passage that many share
    return texts


@pytest.mark.parametrize("n, percent, least", [(4, 85, 8), (5, 80, 2)])
def test_ngram_join_by_brute_force(spark, n, percent, least):
    rows = [(i * 7 % 1009, t) for i, t in enumerate(near_texts())] + [(3, "repeated row of the table"), (3, "repeated row of the table")]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id bigint, text string, class string, size int")
    got = ngramjoin.components(df, "doc_id", "text", n, percent, least=least).collect()
    assert sorted((r.id, r.size, r.component) for r in got) == brute_components(rows, n, percent)


def test_ngram_join_of_nothing(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (5, "a b c d e"), (None, "alone in the world"), (9, None)], "doc_id bigint, text string")
    assert sorted(((r.id, r.size, r.component) for r in ngramjoin.components(df, "doc_id", "text").collect()), key=repr) == sorted(
        [(None, 2, 5), (5, 2, 5), (None, 1, None), (9, 0, 9)], key=repr)
    assert ngramjoin.components(df.limit(0), "doc_id", "text").count() == 0


def test_shingles_of_a_long_text_do_not_depend_on_pieces(monkeypatch):
    text = " ".join(f"w{i % 700}" for i in range(4000))
    whole, _ = ngramjoin.shingle_sets(pa.array([text, None, "a b c d"]), 4)
    monkeypatch.setattr(ngramjoin, "PIECE", 512)
    parts, ends = ngramjoin.shingle_sets(pa.array([text, None, "a b c d"]), 4)
    assert (whole == parts).all() and ends.tolist() == [700, 700, 701]


def vectors():
    draw = np.random.default_rng(4)
    base = draw.normal(size=(30, 16))
    rows = [(i, (base[i % 30] + draw.normal(size=16) * draw.choice([0.0, 0.1, 0.2])).tolist(), i % 3) for i in range(300)]
    rows += [(1000, rows[5][1], rows[5][2]), (1001, rows[5][1], rows[5][2]), (1002, None, 1), (1003, [], 1), (1004, [0.0] * 16, 1), (1005, rows[5][1], None),
             (1006, [None] + [1.0] * 15, 1), (1007, [float("nan")] + [1.0] * 15, 1), (1008, [float("inf")] + [1.0] * 15, 1), (1009, [1.0, 0.5], 1), (1010, [2.0, 1.0], 1),
             (1011, [1e300] * 16, 1), (1012, [1e-300] * 16, 1), (1012, [1e-300] * 16, 1), (1013, [3.0], 2), (1014, [4.0], 2), (1015, [-4.0], 2)]
    return rows


@pytest.mark.parametrize("block, per_filter", [(4096, 48), (16, 8)])
def test_cap_filters_by_brute_force(spark, block, per_filter):
    rows = vectors()
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id bigint, embedding array<double>, label int, weight string")
    got = sorted((r.id, r.n_links, r.component) for r in caps.links(df, "vec_id", "embedding", "label", 0.98, block=block, per_filter=per_filter).collect())
    unit = [np.array(v) / max(abs(x) for x in v) if v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) else None for _, v, label in rows]
    unit = [u / np.linalg.norm(u) if u is not None else None for u in unit]
    links = [[j for j in range(len(rows)) if j != i and unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j])
              and unit[i] @ unit[j] >= 0.98] for i in range(len(rows))]
    want = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        want.append((rows[i][0], len(links[i]), min(rows[k][0] for k in seen)))
    assert got == sorted(want)
    assert caps.links(df.limit(0), "vec_id", "embedding", "label").count() == 0


def test_cap_filters_of_floats_are_those_of_doubles(spark):
    rows = [(i, [float(np.float32(x)) for x in v], label) for i, v, label in vectors()[:300]]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    asked = lambda d: sorted(map(tuple, caps.links(d, "vec_id", "embedding", "label", 0.98).collect()))
    assert asked(df) == asked(df.withColumn("embedding", F.col("embedding").cast("array<float>")))


@pytest.mark.parametrize("dim, size", [(64, 12), (64, 21), (128, 16)])
def test_recall_of_pairs_at_the_least_cosine(dim, size):
    """Codes for one to ten million vectors: pairs at exactly 0.98, the hardest, share a filter but for one in a thousand at most."""
    code, draw, missed = caps.Code(dim, size, 40), np.random.default_rng(dim + size), 0
    for _ in range(6):
        a, b = draw.normal(size=(2, 1000, dim))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b -= (a * b).sum(axis=1, keepdims=True) * a
        b = 0.98 * a + (1 - 0.98 ** 2) ** 0.5 * b / np.linalg.norm(b, axis=1, keepdims=True)
        missed += sum(not np.intersect1d(x, y).size for x, y in zip(code.decode(a, 28), code.decode(b, 28)))
    print(f"{dim} dimensions, code of {size}: {missed} of 6000 missed")
    assert missed <= 6


def test_shards(spark):
    draw = random.Random(6)
    rows = [(i, draw.choice([0, 5, 40, 200, None])) for i in range(400)] + [(7, 900), (7, 900), (None, 3), (5000, 5000)]
    df = spark.createDataFrame([(k, n, "clash") for k, n in rows], "doc_id bigint, n int, shard string")
    got = sharding.shards(df, "doc_id", F.col("n"), 1000).collect()
    assert sorted(((r.key, r.bytes) for r in got), key=repr) == sorted(((k, n or 0) for k, n in rows), key=repr)
    total = {}
    for r in got:
        total[r.shard] = total.get(r.shard, 0) + r.bytes
    names = sorted(total)
    assert all(not b.startswith(a) for a, b in zip(names, names[1:]))  # no shard within another
    for r in got:
        assert r.shard_bytes == total[r.shard] and r.depth == len(r.shard)
        assert r.oversized == (r.shard_bytes > 1000)
        assert not r.oversized or r.key in (7, 5000)
        if r.depth:  # split because the parent was too large
            assert sum(n for s, n in total.items() if s.startswith(r.shard[:-1])) > 1000
    one = sharding.shards(df.limit(3), "doc_id", F.col("n"), 10_000).collect()
    assert {r.shard for r in one} == {""}
    assert sharding.shards(df.limit(0), "doc_id", F.col("n"), 10).count() == 0


VALUES = {
    "card": ["4785380592391139", "4111 1111 1111 1111", "3782-822463-10005"], "phone": ["+1 (974) 555-3436", "+49 30 1234 5678"], "ip": ["152.143.123.131", "8.8.4.4"],
    "ssn": ["123-45-6789"], "date": ["1987-02-28", "2024-02-29"], "iban": ["DE89370400440532013000", "GB82WEST12345698765432"], "email": ["Été.22@mail7.example.com", "a@b.io"],
    "secret": ["24be64439e3e49cf46b2d7c90f3602a3d0b907ff"],
}
CLEAN = ["4785380592391138 is no card", "version 4.0. or 1.2.3", "300.1.1.1", "1987-02-30", "000-12-3456", "DE89370400440532013001", "a @ b", "plain prose, 12 of 340", "", None, "1" * 5000, "x@" * 900]


def luhn(s):
    d = [int(c) for c in reversed(re.sub(r"\D", "", s))]
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0


def iban_ok(s):
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def test_pseudonyms(spark):
    rows = [(k, v, f'Begin {v} middle ({v}), end.' if k != "secret" else f'token = "{v}"!!') for k, vs in VALUES.items() for v in vs]
    rows += [(k, v, "!! " + t) for k, v, t in rows] + [("clean", None, t) for t in CLEAN]
    df = spark.createDataFrame([(*r, 1) for r in rows], "kind string, value string, text string, n_values int")
    out = pii.pseudonymise(df, "text", "key", into="made", found="n_values").collect()
    other = {r.value: r.made for r in pii.pseudonymise(df, "text", "another", into="made").collect() if r.value}
    seen = {}
    for r in out:
        if r.kind == "clean":
            assert r.made == r.text and r.n_values == 0
            continue
        a, b = r.text.split(r.value)[0], r.text.split(r.value)[-1]
        assert r.value not in r.made and r.made.startswith(a) and r.made.endswith(b) and r.n_values == r.text.count(r.value)
        new = r.made[len(a):len(r.made) - len(b)].split(" middle (")[0]
        assert seen.setdefault(r.value, new) == new  # linked across texts
        assert other[r.value] != r.made
        if r.kind != "ip" and r.kind != "email":
            assert re.sub(r"[0-9]", "9", re.sub("[a-f]", "9" if r.kind == "secret" else "a", new)) == re.sub(r"[0-9]", "9", re.sub("[a-f]", "9" if r.kind == "secret" else "a", r.value)) or r.kind == "iban"
        check = {"card": luhn, "iban": iban_ok, "ip": lambda s: all(0 <= int(x) < 256 for x in s.split(".")), "date": np.datetime64,
                 "ssn": lambda s: re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", s), "email": lambda s: re.fullmatch(r"\w+\.?\w*@[\w.]+", s)}.get(r.kind)
        assert not check or check(new), (r.kind, new)
    assert pii.pseudonymise(df.limit(0), "text", "key").count() == 0


def test_pseudonyms_of_values_among_other_digits(spark):
    """What holds the value (given in braces) stays as it is, and the value gets the pseudonym that it has alone."""
    card, iban = "4111111111111111", "DE89370400440532013000"
    texts = ["{4111 1111 1111 1111} 12/27", "{4111111111111111} 123", "no 5 {4111111111111111}", "id 12 {4785380592391139}", "{4111-1111-1111-1111} 123 4", "1 2 3 {4111111111111111} {4111111111111111}",
             "{4111111111111111} {2020-01-31}", "{4111111111111111} {123-45-6789}", "{4111111111111111} {192.168.0.1}", "{3782 822463 10005} 1234", "{4111111111111111} 2nd",
             "{DE89 3704 0044 0532 0130 00} BIC COBADEFF", "IBAN {GB29 NWBK 6016 1331 9268 19}, {NO93 8601 1117 947} 12", "DE12 {4111 1111 1111 1111} 12",
             "{+33 6 12 34 56 78}", "{+33.6.12.34.56.78} 9", "{+33 (0)6 12 34 56 78}", "{+41 44 668 18 00}, {+47 123 45 678}", "{+33 6 12 34 56 78} {4111 1111 1111 1111}",
             "GB29 NWBK 6016 1331 9268 18 x", "4785380592391138 12", "7 " * 6 + "x"]
    df = spark.createDataFrame([(i, re.sub("[{}]", "", t)) for i, t in enumerate(texts)], "id int, text string")
    made = {r.id: r for r in pii.pseudonymise(df, "text", "key", into="made", found="n").collect()}
    alone = sorted({v for t in texts for v in re.findall("{(.*?)}", t)} | {card, iban})
    one = {r.text: r.made for r in pii.pseudonymise(spark.createDataFrame([(v,) for v in alone], "text string"), "text", "key", into="made").collect()}
    assert all(v != new for v, new in one.items())
    for i, t in enumerate(texts):
        assert made[i].made == re.sub("{(.*?)}", lambda m: one[m[1]], t) and made[i].n == t.count("{"), (t, made[i])
    plain = lambda s: re.sub("[ -]", "", s)
    assert plain(one["4111 1111 1111 1111"]) == one[card] == plain(one["4111-1111-1111-1111"]) and luhn(one[card])
    assert plain(one["DE89 3704 0044 0532 0130 00"]) == one[iban] and iban_ok(one[iban])
    long = spark.createDataFrame([(" ".join(["12345"] * 3000) + " x " + card + " 9" * 40,)], "text string")
    assert one[card] in pii.pseudonymise(long, "text", "key").first().text


def test_no_text_ends_the_job_or_takes_long(spark):
    """100 KB and more of every format's unit; addresses and numbers beyond what the formats allow stay as they are."""
    units = ["a@" + "b." * 50_000 + "com", "x@" * 50_000, "a@b.c-" * 20_000, "." * 100_000 + "@a.de", "4111 1111 1111 1111 " * 6_000, "4 " * 60_000, "1234-" * 25_000, "+1 2 " * 25_000, "+" * 100_000,
             "1.2.3." * 20_000, "1:2:" * 30_000, "::" * 60_000, "12/12/" * 20_000, "2020-01-" * 15_000, "key=" * 30_000, "token = " + "0f" * 60_000, "DE89 3704 " * 12_000, "(415) " * 20_000, "9" * 120_000]
    df = spark.createDataFrame(list(enumerate(units)), "id int, text string").repartition(8)
    start = time.time()
    got = {r.id: r for r in pii.pseudonymise(df, "text", "key", into="made", found="n").collect()}
    assert time.time() - start < 120
    for i, text in enumerate(units):
        assert len(got[i].made) == len(text)
    assert got[0].made == units[0] and got[4].n == 6_000 and got[4].made[:20] == got[4].made[20:40] != units[4][:20]


def test_formats_of_dates_phones_and_addresses(spark):
    values = ["01/02/1990", "12/31/1990", "31/12/1990", "29/02/2000", "13/06/1815", "31.12.1990", "1990/01/02", "(415) 555-0132", "(415)555-0132", "415-555-0132", "415.555.0132",
              "2001:db8:0:42:8a2e:370:7334:1", "2001:db8::8a2e:370:7334", "fe80::1", "FE80::A1"]
    stays = ["32/13/1990", "30.02.1990", "1990/13/02", "29/02/1999", "12/31/1790", "115-555-0132", "1415-555-0132", "a::b", "std::size", "12:30:45", "1:2:3:4:5:6:7:8:9", "v1.02.1990.3"]
    rows = [(v, f"see {v}, or ({v}).") for v in values + stays]
    df = spark.createDataFrame(rows, "value string, text string")
    got = {r.value: r for r in pii.pseudonymise(df, "text", "key", into="made", found="n").collect()}
    shape = lambda t: re.sub("[0-9a-f]", "9", t)
    for v in values:
        r = got[v]
        new = r.made[4:4 + len(v)]
        assert r.n == 2 and new != v and r.made == f"see {new}, or ({new})." and shape(new.lower()) == shape(v.lower()), r
    dates = {"/": lambda t: datetime.strptime(t, "%d/%m/%Y" if int(t[:2]) > 12 else "%m/%d/%Y"), ".": lambda t: datetime.strptime(t, "%d.%m.%Y")}
    for v in values[:6]:
        new = got[v].made[4:14]
        assert dates[v[2]](new) and (int(new[:2]) > 12) == (int(v[:2]) > 12) or "." in v
    for v in stays:
        assert got[v].n == 0 and got[v].made == got[v].text, got[v]
    secret = "24be64" * 6
    plain = spark.createDataFrame([(f"key={secret} x",), (f"token: '{secret}'",), (f"monkey {secret}",)], "text string")
    made = [r.made for r in pii.pseudonymise(plain, "text", "key", into="made").collect()]
    assert secret not in made[0] + made[1] and secret in made[2]


def test_the_key_is_not_in_the_plan(spark):
    df = pii.pseudonymise(spark.createDataFrame([("x",)], "text string"), "text", "a very secret key")
    assert "a very secret key" not in df._jdf.queryExecution().toString()


def test_late_dates_are_permuted_among_themselves(spark):
    days = [f"{d}/{y}" for d in pii.LATE_DAYS.split(",") for y in range(1990, 1994)] + [f"29/02/{y}" for y in pii.LEAP_YEARS.split(",")]
    df = spark.createDataFrame([(d,) for d in days], "text string").repartition(8)
    made = {r.text: r.made for r in pii.pseudonymise(df, "text", "key", into="made").collect()}
    assert len(set(made.values())) == len(days) and all(datetime.strptime(v, "%d/%m/%Y") and int(v[:2]) > 12 for v in made.values())
    assert {v for d, v in made.items() if d.startswith("29/02")} == {d for d in days if d.startswith("29/02")}


def test_permutations_have_no_collisions(spark):
    df = spark.range(2000).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("s"), F.floor(F.col("id") / 50).alias("l"), (F.col("id") % 50).alias("r"))
    left, right = pii.permute_number(F.col("l"), F.col("r"), 40, 50, "k", "test")
    got = df.select(pii.permute_text(F.col("s"), "k", "t", [pii.DIGITS]).alias("s"), left.alias("l"), right.alias("r")).collect()
    assert len({r.s for r in got}) == 2000 and len({(r.l, r.r) for r in got}) == 2000
    assert all(0 <= r.l < 40 and 0 <= r.r < 50 and re.fullmatch(r"\d{4}", r.s) for r in got)


def test_quality_learns_from_passages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = {r.doc_id: r for r in queries.attention_quality(spark, folder).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    known = {r.doc_id: r.quality for r in labels.collect()}
    held = [(got[i].predicted, y) for i, y in known.items() if got[i].held_out]
    assert sum(p == y for p, y in held) >= 0.9 * len(held)
    odd = spark.createDataFrame([(1, None, "c"), (2, "", "c"), (3, "word " * 60_000, "c"), (3, "word " * 60_000, "c")], "doc_id bigint, text string, score string")
    model = quality.learn(docs, "doc_id", "text", labels, "doc_id", "quality", sample=100)
    scores = quality.score(odd, "text", model, ["doc_id", "score"]).collect()
    assert len(scores) == 4 and all(0 <= r.score <= 1 for r in scores) and scores[0].score == scores[1].score
    alone = quality.learn(docs, "doc_id", "text", labels.filter("quality = 1"), "doc_id", "quality", sample=50)
    assert {r.score for r in quality.score(odd, "text", alone, ["doc_id"]).collect()} == {1.0}
    none = quality.learn(docs, "doc_id", "text", labels.limit(0), "doc_id", "quality")
    assert {r.score for r in quality.score(odd, "text", none, ["doc_id"]).collect()} == {0.5}
    assert quality.score(odd.limit(0), "text", model, ["doc_id"]).count() == 0


def test_gradients_of_the_attention_model():
    draw = np.random.default_rng(0)
    x, owner = draw.normal(size=(400, 5)), np.repeat(np.arange(100), 4)
    y = (x[:, 0].reshape(100, 4).max(axis=1) > 1).astype(float)  # one passage decides
    m = quality.fit(x, owner, y, hidden=8, gate=4, epochs=200, batch=50, rate=2e-2)
    logit, _ = quality._attend((x - m["mean"]) / m["scale"], owner, 100, m)
    assert ((logit > 0) == (y == 1)).mean() > 0.95


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_against_sql(spark, folder, name):
    ok, message, _ = oracle.compare(spark, oracle.connect(folder), name, queries.QUERIES[name], queries.ORACLES[name], folder)
    assert ok, message


def test_pipeline(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, made = docs, stage(spark, docs, folder)
        if name != "bpe":
            assert made.columns == docs.columns
        docs = spark.createDataFrame(made.collect(), made.schema)
        if name not in ("pii", "bpe"):
            assert docs.join(before, ["doc_id"], "left_anti").count() == 0 and 0 < docs.count() < before.count()
        else:
            assert docs.count() == before.count()
    assert sorted(r.doc_id for r in docs.collect()) == sorted(r.doc_id for r in corpus_pipeline.run(spark, folder).collect())


def test_stages_of_odd_tables(spark, folder):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "mail a.b@c.org", None, "s", 14), (4, "the same text in this row", "en", "s", 1), (4, "the same text in this row", "en", "s", 1)]
    for table in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        n = table.count()
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, table, folder).count()
            assert got == (n - 1 if n and name == "near_duplicates" else n) or name == "quality" and got <= n


def test_texts_under_one_id_are_judged_by_themselves(spark, folder):
    words = lambda seed, n=40: " ".join(str(x) for x in random.Random(seed).sample(range(1000), n))
    near = words(1).split()
    rows = [(1, words(1)), (7, words(1)), (7, words(2)), (9, words(3)), (9, words(4)), (9, words(4)), (11, " ".join(near + ["more"])), (None, words(1)), (12, "")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, df, folder).collect()), key=repr)
    assert got == sorted([(1, words(1)), (7, words(2)), (9, words(3)), (9, words(4)), (None, words(1)), (12, "")], key=repr)


def test_learning_uses_whole_texts_within_its_bounds(spark):
    decisive = "bad " * 64 * 40 + "good " * 64  # what tells the classes apart comes after many passages
    rows = [(i, decisive if i % 2 else "bad " * 64 * 41, i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "id bigint, text string, y int")
    model = quality.learn(df.select("id", "text"), "id", "text", df, "id", "y")
    assert all((r.score > 0.5) == (r.id % 2 == 1) for r in quality.score(df, "text", model, ["id"]).collect())
    assert quality.learn(df.select("id", "text"), "id", "text", df, "id", "y", most_bytes=100) == {"constant": 0.5}
    assert len(quality.passages("日本語の文" * 4000)) > 30 and b"".join(b"".join(p) for p in quality.passages("日本語 x" * 900)) == ("日本語x" * 900).encode()


def test_attention_by_a_plain_loop():
    draw = np.random.default_rng(3)
    x, owner = draw.normal(size=(9, 4)), np.repeat(np.arange(3), [2, 4, 3])
    m = {"w": draw.normal(size=(4, 3)), "b": draw.normal(size=3), "v": draw.normal(size=(3, 2)), "u": draw.normal(size=(3, 2)), "a": draw.normal(size=2), "c": draw.normal(size=3), "d": np.array(0.3)}
    logit, _ = quality._attend(x, owner, 3, m)
    for doc in range(3):
        h = [np.tanh(row @ m["w"] + m["b"]) for row in x[owner == doc]]
        gate = [sum(a * np.tanh(hi @ m["v"][:, k]) / (1 + np.exp(-(hi @ m["u"][:, k]))) for k, a in enumerate(m["a"])) for hi in h]
        share = np.exp(gate) / np.exp(gate).sum()
        assert np.isclose(logit[doc], sum(s * hi for s, hi in zip(share, h)) @ m["c"] + m["d"])
