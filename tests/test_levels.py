"""Splits and codes by columns with any number of levels, against plain sorting."""

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from specula.operators.shaping import Step, run
from specula.operators.shaping.rows import level_thresholds
from specula.plans.ordered import running_totals, text_cells


def plain_parts(rows, test, valid, seed=7):
    by_level, parts = defaultdict(list), {}
    for i, level in rows:
        by_level[level].append((hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))
    for members in by_level.values():
        first, second = round(test * len(members)), round(valid * len(members))
        for k, (_, i) in enumerate(sorted(members)):
            parts[i] = "test" if k < first else "valid" if k < first + second else "train"
    return parts


@pytest.fixture(scope="module")
def rows():
    hot = [(i, "hot") for i in range(3000)]  # three fifths of all rows
    few = [(3000 + i, f"l{i % 700}") for i in range(1900)]
    return hot + few + [(4900 + i, None) for i in range(100)]


def test_stratified_split_by_many_levels(spark, rows):
    df = spark.createDataFrame(rows, "id long, by string").repartition(5)
    out = run(df, [Step("s", "split", params={"kind": "stratified", "by": "by", "test": 0.2, "valid": 0.1})], "id").df
    assert set(out.columns) == {"id", "by", "_part"}
    got = {r["id"]: r["_part"] for r in out.collect()}
    assert got == plain_parts(rows, 0.2, 0.1)


def test_thresholds_in_several_rounds(spark, rows):
    df = spark.createDataFrame(rows, "id long, by string").na.fill("<null>")
    draws = df.select(F.col("by").alias("level"), F.md5(F.concat(F.lit("7:"), F.col("id").cast("string"))).alias("h"))
    ends = {r["level"]: r for r in level_thresholds(draws, 0.2, 0.1, most=2).collect()}
    by_level = defaultdict(list)
    for r in draws.collect():
        by_level[r["level"]].append(r["h"])
    assert set(ends) == set(by_level)
    for level, hs in by_level.items():
        first, second, hs = round(0.2 * len(hs)), round(0.1 * len(hs)), sorted(hs)
        assert ends[level]["n"] == len(hs)
        assert ends[level]["test_to"] == (hs[first - 1] if first else "")
        assert ends[level]["valid_to"] == (hs[first + second - 1] if first + second else "")


def test_stratified_split_of_nothing_and_of_repeats(spark):
    none = spark.createDataFrame([], "id long, by string")
    step = [Step("s", "split", params={"kind": "stratified", "by": "by", "test": 0.5})]
    assert run(none, step, "id").df.count() == 0
    same = spark.createDataFrame([(1, "a")] * 4, "id long, by string")
    parts = Counter(r["_part"] for r in run(same, step, "id").df.collect())
    assert parts == {"test": 4}  # rows with one id share a part


def test_codes_of_texts_with_one_beginning(spark):
    names = [f"Customer#{i:06d}" for i in range(0, 9000, 7)]
    df = spark.createDataFrame([(n, 1) for n in names], "cat string, one int")
    cells = text_cells(df, "cat", most=100)
    assert cells.groupBy("bucket").count().agg(F.max("count")).first()[0] < 500
    got = {r["cat"]: r["before_one"] for r in running_totals(cells, [], "cat", ["one"]).collect()}
    assert got == {n: i for i, n in enumerate(sorted(names))}
