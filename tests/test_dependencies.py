"""Functional dependencies of up to three columns against plain loops over groups."""

import random
from itertools import combinations

from specula.operators import derive


def brute(rows, columns, most, near, near_key):
    found = []
    level = lambda v: "<null>" if v is None else str(v)
    cells = [[level(v) for v in r] for r in rows]
    pool = [c for j, c in enumerate(columns) if len({r[j] for r in cells}) <= near_key * len(rows)]
    for k in range(1, most + 1):
        before = [(set(lhs), r) for lhs, r, exact, *_ in found if exact]
        for side in combinations(pool, k):
            at = [columns.index(c) for c in side]
            groups = {}
            for r in cells:
                groups.setdefault(tuple(r[i] for i in at), []).append(r)
            if len(groups) > near_key * len(rows):
                continue
            for j, c in enumerate(columns):
                if c in side or any(r == c and lhs < set(side) for lhs, r in before):
                    continue
                ratio = sum(len({r[j] for r in g}) == 1 for g in groups.values()) / len(groups)
                if ratio >= near:
                    found.append((tuple(side), c, ratio == 1.0, round(ratio, 9), len(groups)))
    return sorted(found)


def test_dependencies_by_brute_force(spark):
    draw = random.Random(3)
    rows = []
    for i in range(600):
        a, b, c, d = draw.randint(0, 5), draw.randint(0, 4), draw.choice([None, "x", "y", ""]), draw.randint(0, 20)
        rows.append((i, a, b, c, a * 10 + b, f"{a}{b}{c}", (a + 2 * b + (3 if c else 5)) % 7 if draw.random() > 0.001 else 9, d, d // 4, None))
    columns = ["key", "a", "b", "c", "ab", "abc", "sum", "d", "part", "nothing"]
    df = spark.createDataFrame(rows, "key int, a int, b int, c string, ab int, abc string, sum int, d int, part int, nothing string").repartition(4)
    for most, near_key in ((2, 0.1), (3, 0.3)):
        got = derive.functional_dependencies(df, columns, max_lhs=most, near_key=near_key).collect()
        assert sorted((tuple(r["lhs"]), r["rhs"], r["exact"], round(r["determination_ratio"], 9), r["groups"]) for r in got) == brute(rows, columns, most, 0.95, near_key)
        assert most < 3 or any(len(r["lhs"]) == 3 for r in got)


def test_dependencies_of_an_empty_table(spark):
    assert derive.functional_dependencies(spark.createDataFrame([], "a int, b string"), ["a", "b"], 3).count() == 0
