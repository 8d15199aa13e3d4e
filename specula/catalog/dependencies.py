"""Derivability, functional dependencies and association queries."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from specula.catalog import query
from specula.catalog import sqltext as q
from specula.catalog.profiles import LINE_NUM, union_sql
from specula.operators import depend, derive, geometry
from specula.plans.longform import rnd

# ----------------------------------------------------------------- formulas

LINEAR = "(SELECT l_quantity, l_discount, l_tax, 2 * l_quantity - 100 * l_discount + 5 AS mix FROM lineitem)"
LINEAR_COLS = ["l_quantity", "l_discount", "l_tax", "mix"]


@query("linear_formulas", "SELECT * FROM (" + union_sql([
    f"SELECT '{c}' AS \"column\", 'linear' AS kind, round({q.r_squared(i, [j for j in (1, 2, 0, 3) if j != i])}, 5) AS r2 FROM {q.corr_cte(LINEAR, LINEAR_COLS)}"
    for i, c in enumerate(LINEAR_COLS)]) + ") WHERE r2 >= 0.999")
def linear_formulas(t):
    df = t.lineitem.select("l_quantity", "l_discount", "l_tax", (2 * F.col("l_quantity") - 100 * F.col("l_discount") + 5).alias("mix"))
    return derive.derivable_columns(df, LINEAR_COLS).select("column", "kind", F.round("r2", 5).alias("r2"))


PRODUCT = "(SELECT l_quantity AS q, l_tax + 0.01 AS x, l_quantity * (l_tax + 0.01) AS qx, ln(l_quantity) AS lq, ln(l_tax + 0.01) AS lx, ln(l_quantity * (l_tax + 0.01)) AS lqx FROM lineitem)"


@query("product_formulas", f"""SELECT 'qx' AS "column", 'polynomial-2' AS kind, round({q.r_squared(2, [0, 1, 3])}, 5) AS r2 FROM {q.corr_cte(PRODUCT, ['q', 'x', 'qx', 'q * x'])}
UNION ALL SELECT 'q', 'multiplicative', round({q.r_squared(0, [1, 2])}, 5) FROM {q.corr_cte(PRODUCT, ['lq', 'lx', 'lqx'])}
UNION ALL SELECT 'x', 'multiplicative', round({q.r_squared(1, [0, 2])}, 5) FROM {q.corr_cte(PRODUCT, ['lq', 'lx', 'lqx'])}""")
def product_formulas(t):
    df = t.lineitem.select(F.col("l_quantity").alias("q"), (F.col("l_tax") + 0.01).alias("x"))
    df = df.withColumn("qx", F.col("q") * F.col("x"))
    return derive.derivable_columns(df, ["q", "x", "qx"]).select("column", "kind", F.round("r2", 5).alias("r2"))


@query("formula_check", """SELECT 'net' AS "column", count(*) AS rows, count(*) FILTER (abs(net - l_extendedprice * (1 - l_discount)) <= 1e-6 * greatest(1.0, abs(l_extendedprice * (1 - l_discount)))) AS agree,
 count(*) = count(*) FILTER (abs(net - l_extendedprice * (1 - l_discount)) <= 1e-6 * greatest(1.0, abs(l_extendedprice * (1 - l_discount)))) AS confirmed
 FROM (SELECT *, l_extendedprice * (1 - l_discount) AS net FROM lineitem)
UNION ALL SELECT 'twice', count(*), count(*) FILTER (l_linenumber <> 3), count(*) = count(*) FILTER (l_linenumber <> 3) FROM lineitem""")
def formula_check(t):
    df = t.lineitem.select("*", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"),
                           F.when(F.col("l_linenumber") == 3, -1.0).otherwise(F.col("l_quantity") * 2).alias("twice"))
    return derive.formula_check(df, {"net": "l_extendedprice × (1 − l_discount)", "twice": "l_quantity·2"})


# ----------------------------------------------------------------- functional dependencies

FD_FRAME = """(SELECT c_nationkey AS nation, n_name, n_regionkey AS region, r_name, c_mktsegment AS segment, c_custkey % 50 AS batch,
 CASE WHEN c_custkey % 50 = 5 AND c_custkey % 4 = 1 THEN 'odd' ELSE 'b' || CAST((c_custkey % 50) // 10 AS VARCHAR) END AS shelf
 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
FD_COLS = ["nation", "n_name", "region", "r_name", "segment", "batch", "shelf"]


def fd_frame(t):
    c = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    batch = F.col("c_custkey") % 50
    return c.select(F.col("c_nationkey").alias("nation"), "n_name", F.col("n_regionkey").alias("region"), "r_name",
                    F.col("c_mktsegment").alias("segment"), batch.alias("batch"),
                    F.when((batch == 5) & (F.col("c_custkey") % 4 == 1), "odd")
                    .otherwise(F.concat(F.lit("b"), F.floor(batch / 10).cast("string"))).alias("shelf"))


def _fd_sql():
    parts = []
    for k in (1, 2):
        for lhs in combinations(FD_COLS, k):
            for rhs in FD_COLS:
                if rhs not in lhs:
                    parts.append(f"SELECT '{','.join(lhs)}' AS lhs, '{rhs}' AS rhs, {k} AS k, avg(CASE WHEN nd = 1 THEN 1.0 ELSE 0.0 END) AS ratio, count(*) AS groups "
                                 f"FROM (SELECT count(DISTINCT {rhs}) AS nd FROM f GROUP BY {', '.join(lhs)})")
    return f"""WITH f AS {FD_FRAME}, r AS ({union_sql(parts)}), e AS (SELECT * FROM r WHERE ratio = 1 AND k = 1 AND groups <= 0.3 * (SELECT count(*) FROM f))
SELECT lhs, rhs, ratio = 1 AS exact, round(ratio, 4) AS determination_ratio, groups FROM r
WHERE ratio >= 0.95 AND groups <= 0.3 * (SELECT count(*) FROM f)
 AND NOT (k = 2 AND EXISTS (SELECT 1 FROM e WHERE e.rhs = r.rhs AND list_contains(string_split(r.lhs, ','), e.lhs)))"""


@query("functional_dependencies", _fd_sql())
def functional_dependencies(t):
    return derive.functional_dependencies(fd_frame(t), FD_COLS).select(
        F.concat_ws(",", "lhs").alias("lhs"), "rhs", "exact", F.round("determination_ratio", 4).alias("determination_ratio"), "groups")


@query("row_determination", "\nUNION ALL\n".join(
    f"""SELECT '{l}' AS lhs, '{r}' AS rhs, CAST(sum(n) AS BIGINT) AS rows, round(sum(CASE WHEN nd = 1 THEN n ELSE 0 END) / sum(n), 6) AS determination
 FROM (SELECT count(DISTINCT {r}) AS nd, count(*) AS n FROM {FD_FRAME} GROUP BY {l})""" for l, r in (("batch", "shelf"), ("nation", "r_name"), ("region,segment", "nation"))))
def row_determination(t):
    f = fd_frame(t)
    one = derive.row_determination(f, ["batch"], "shelf").union(derive.row_determination(f, ["nation"], "r_name"))
    one = one.union(derive.row_determination(f, ["region", "segment"], "nation"))
    return one.select("lhs", "rhs", "rows", F.round("determination", 6).alias("determination"))


FOUND = """(SELECT lhs, rhs FROM (""" + _fd_sql() + """) WHERE exact AND lhs NOT LIKE '%,%')"""


@query("label_candidates", f"""WITH r AS (SELECT lhs, rhs FROM {FOUND} WHERE lhs IN ('nation', 'segment', 'batch')), b AS (SELECT rhs, min(lhs) AS lhs FROM r GROUP BY rhs)
SELECT rhs AS label, rhs = 'r_name' AS stated, CASE WHEN count(*) > 0 THEN 'classification' END AS task, array_to_string(list_sort(list_filter(['batch', 'nation', 'segment'], lambda x: x <> lhs AND x <> rhs)), ',') AS features, lhs AS leakage
FROM b GROUP BY ALL""")
def label_candidates(t):
    f = fd_frame(t)
    rules = derive.functional_dependencies(f, FD_COLS, max_lhs=1).filter("exact").select(
        "lhs", "rhs", (F.col("rhs") == "r_name").alias("stated"))
    types = f.sparkSession.createDataFrame([(c, "nominal") for c in FD_COLS], "column string, semantic_type string")
    return derive.label_candidates(rules, ["nation", "segment", "batch"], types).select(
        "label", "stated", "task", F.concat_ws(",", "features").alias("features"), F.concat_ws(",", "leakage").alias("leakage"))


@query("basis_columns", f"""SELECT "column" FROM (SELECT unnest(['nation', 'n_name', 'region', 'r_name', 'segment', 'batch', 'shelf']) AS "column")
WHERE "column" NOT IN (SELECT rhs FROM {FOUND}) OR "column" = 'nation' """)
def basis_columns(t):
    """nation and n_name determine each other: the cycle is oriented so that n_name is derived."""
    f = fd_frame(t)
    rules = derive.functional_dependencies(f, FD_COLS, max_lhs=1).filter("exact").select(F.col("rhs").alias("head"))
    s = f.sparkSession
    cycles = s.createDataFrame([("c1", "by_key", True, "nation", False), ("c1", "by_key", True, "n_name", True),
                                ("c1", "by_name", False, "n_name", False), ("c1", "by_name", False, "nation", True)],
                               "cycle string, orientation string, is_default boolean, column string, derived boolean")
    heads = derive.active_heads(rules, cycles)
    columns = s.createDataFrame([(c, "dimension") for c in FD_COLS], "column string, role string")
    return derive.basis_columns(columns, heads).select("column")


DEPTH_RULES = f"""(SELECT rhs AS head, lhs AS body FROM {FOUND} WHERE (lhs = 'nation' AND rhs IN ('n_name', 'region')) OR (lhs = 'region' AND rhs = 'r_name'))"""


@query("derivation_depth", f"""WITH RECURSIVE r AS {DEPTH_RULES}, c("column", depth) AS (SELECT DISTINCT body, 0 FROM r WHERE body NOT IN (SELECT head FROM r)
 UNION ALL SELECT r.head, c.depth + 1 FROM c JOIN r ON r.body = c."column") SELECT "column", CAST(max(depth) AS BIGINT) AS depth FROM c GROUP BY 1""")
def derivation_depth(t):
    return derive.derivation_depth(_depth_rules(t))


def _depth_rules(t):
    found = derive.functional_dependencies(fd_frame(t), FD_COLS, max_lhs=1).filter("exact").select(
        F.col("rhs").alias("head"), F.col("lhs")[0].alias("body"))
    return found.filter("(body = 'nation' AND head IN ('n_name', 'region')) OR (body = 'region' AND head = 'r_name')")


@query("column_groups", f"""WITH RECURSIVE r AS {DEPTH_RULES}, e AS (SELECT head AS a, body AS b FROM r UNION SELECT body, head FROM r),
 w(a, b) AS (SELECT a, a FROM e UNION SELECT w.a, e.b FROM w JOIN e ON w.b = e.a) SELECT a AS node, min(b) AS component FROM w GROUP BY 1""")
def column_groups(t):
    from specula.plans.components import connected_components
    return connected_components(_depth_rules(t), "head", "body")


# ----------------------------------------------------------------- association

@query("discretise", f"""WITH e AS (SELECT {q.quantile_edges('l_extendedprice', 'lineitem', 10)} AS e)
SELECT {q.right_closed_bin('l_extendedprice', 'e')} AS bin, strftime(l_shipdate, '%Y-%m') AS month, count(*) AS n FROM lineitem, e GROUP BY 1, 2""")
def discretise(t):
    levels = depend.discrete_levels(t.lineitem, {"l_extendedprice": "numeric", "l_shipdate": "datetime"})
    return (t.lineitem.select(levels["l_extendedprice"].cast("long").alias("bin"), levels["l_shipdate"].alias("month"))
            .groupBy("bin", "month").agg(F.count(F.lit(1)).alias("n")))


def _pairs_sql(table, cols, expr, name):
    return union_sql([f"SELECT '{a}' AS a, '{b}' AS b, {expr(a, b)} AS {name} FROM {table}" for a, b in combinations(cols, 2)])


@query("pearson_pairs", _pairs_sql("lineitem", LINE_NUM, lambda a, b: f"round(corr({a}, {b}), 6) + 0.0", "pearson"))
def pearson_pairs(t):
    return depend.pearson_pairs(t.lineitem, LINE_NUM).select("a", "b", rnd(F.col("pearson")).alias("pearson"))


RANKED = "(SELECT " + ", ".join(f"{q.average_rank(c)} AS {c}" for c in LINE_NUM) + " FROM lineitem)"


@query("spearman_pairs", _pairs_sql(RANKED, LINE_NUM, lambda a, b: f"round(corr({a}, {b}), 6) + 0.0", "spearman"))
def spearman_pairs(t):
    return depend.spearman_pairs(t.lineitem, LINE_NUM).select("a", "b", rnd(F.col("spearman")).alias("spearman"))


GAP_FRAME = "(SELECT CASE WHEN l_linenumber = 2 THEN NULL ELSE l_quantity END AS g, l_extendedprice AS e, l_tax AS x FROM lineitem)"


def _gap_spearman(a, b):
    return (f"SELECT '{a}' AS a, '{b}' AS b, round(corr(ra, rb), 6) + 0.0 AS spearman FROM (SELECT {q.average_rank(a)} AS ra, {q.average_rank(b)} AS rb "
            f"FROM {GAP_FRAME} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)")


@query("spearman_pairs_with_gaps", union_sql([_gap_spearman(a, b) for a, b in combinations(["g", "e", "x"], 2)]))
def spearman_pairs_with_gaps(t):
    df = t.lineitem.select(F.when(F.col("l_linenumber") != 2, F.col("l_quantity")).alias("g"), F.col("l_extendedprice").alias("e"), F.col("l_tax").alias("x"))
    return depend.spearman_pairs(df, ["g", "e", "x"]).select("a", "b", rnd(F.col("spearman")).alias("spearman"))


@query("spearman_family", f"""WITH s AS ({_pairs_sql(RANKED, LINE_NUM, lambda a, b: f"corr({a}, {b})", "s")}), n AS (SELECT count(*) AS n FROM lineitem),
p AS (SELECT a, b, s, n, {q.p_t('s * sqrt((n - 2) / (1 - s * s))', '(n - 2)')} AS p FROM s, n), o AS (SELECT *, row_number() OVER (ORDER BY p, a, b) AS i, count(*) OVER () AS m FROM p)
SELECT a, b, round(s, 6) + 0.0 AS spearman, round(tanh(atanh(s) - 1.96 / sqrt(n - 3)), 6) + 0.0 AS ci_low, round(tanh(atanh(s) + 1.96 / sqrt(n - 3)), 6) + 0.0 AS ci_high, n, round(p, 5) + 0.0 AS p,
 round(least(1.0, min(p * m / i) OVER (ORDER BY i DESC)), 5) + 0.0 AS p_adj FROM o""")
def spearman_family(t):
    r = lambda c, d=6: rnd(F.col(c), d).alias(c)
    return depend.spearman_family(t.lineitem, LINE_NUM).select("a", "b", r("spearman"), r("ci_low"), r("ci_high"), "n", r("p", 5), r("p_adj", 5))


KENDALL_SQL = """WITH r AS (SELECT o_totalprice AS x, o_custkey AS y FROM orders), v AS (SELECT count(*) AS n FROM r),
 pairs AS (SELECT count(*) FILTER ((a.x < b.x AND a.y < b.y)) AS concordant, count(*) FILTER (a.x < b.x AND a.y > b.y) AS discordant FROM r a, r b WHERE a.x < b.x),
 tx AS (SELECT sum(k * (k - 1) / 2) AS t FROM (SELECT count(*) AS k FROM r GROUP BY x)), ty AS (SELECT sum(k * (k - 1) / 2) AS t FROM (SELECT count(*) AS k FROM r GROUP BY y))
SELECT 'o_totalprice' AS a, 'o_custkey' AS b, n, CAST(concordant AS BIGINT) AS concordant, CAST(discordant AS BIGINT) AS discordant,
 round((concordant - discordant) / sqrt((n * (n - 1) / 2 - tx.t) * (n * (n - 1) / 2 - ty.t)), 8) + 0.0 AS kendall FROM pairs, v, tx, ty"""


@query("kendall", KENDALL_SQL)
def kendall(t):
    return depend.kendall(t.orders, "o_totalprice", "o_custkey").select("a", "b", "n", F.col("concordant").cast("bigint").alias("concordant"), F.col("discordant").cast("bigint").alias("discordant"), rnd(F.col("kendall"), 8).alias("kendall"))


@query("kendall_test")
def kendall_test(t):
    k = depend.kendall(t.lineitem, "l_quantity", "l_discount")
    return k.select("a", "b", "n", rnd(F.col("kendall")).alias("kendall"), rnd(F.col("z"), 4).alias("z"), rnd(F.col("p")).alias("p"))


@query("correlation_ratios", union_sql([
    f"""SELECT '{g}' AS category, '{y}' AS "column", round((SELECT sum(n * pow(m - (SELECT avg({y}) FROM lineitem), 2)) FROM (SELECT count(*) AS n, avg({y}) AS m FROM lineitem GROUP BY {g})) / (SELECT sum(pow({y} - (SELECT avg({y}) FROM lineitem), 2)) FROM lineitem), 8) + 0.0 AS eta2"""
    for g in ("l_returnflag", "l_linenumber") for y in ("l_quantity", "l_extendedprice")]))
def correlation_ratios(t):
    return depend.correlation_ratios(t.lineitem, ["l_quantity", "l_extendedprice"], {c: F.col(c).cast("string") for c in ("l_returnflag", "l_linenumber")}).select(
        "category", "column", rnd(F.col("eta2"), 8).alias("eta2"))


MIX = {"l_quantity": "numeric", "l_discount": "ordinal", "l_returnflag": "nominal", "l_linestatus": "nominal", "l_shipdate": "datetime"}
MIX_BINS = f"""(SELECT l_quantity, l_discount, l_returnflag, l_linestatus, CAST({q.right_closed_bin('l_quantity', 'e')} AS VARCHAR) AS d_l_quantity, CAST(l_discount AS VARCHAR) AS d_l_discount,
 l_returnflag AS d_l_returnflag, l_linestatus AS d_l_linestatus, strftime(l_shipdate, '%Y-%m') AS d_l_shipdate FROM lineitem, (SELECT {q.quantile_edges('l_quantity', 'lineitem', 10)} AS e))"""


def _cells_sql(a, b):
    return f"SELECT d_{a} AS x, d_{b} AS y, count(*) AS k, sum(count(*)) OVER (PARTITION BY d_{a}) AS na, sum(count(*)) OVER (PARTITION BY d_{b}) AS nb, sum(count(*)) OVER () AS n FROM m GROUP BY 1, 2"


def _matrix_sql():
    parts = []
    for a, b in combinations(MIX, 2):
        num = [c for c in (a, b) if MIX[c] in ("numeric", "ordinal")]
        cat = [c for c in (a, b) if c not in num]
        nmi = (f"(SELECT sum(k / n * ln(k * n / (na * nb))) / sqrt((SELECT -sum(c / n2 * ln(c / n2)) FROM (SELECT count(*) AS c, (SELECT count(*) FROM m) AS n2 FROM m GROUP BY d_{a})) * "
               f"(SELECT -sum(c / n2 * ln(c / n2)) FROM (SELECT count(*) AS c, (SELECT count(*) FROM m) AS n2 FROM m GROUP BY d_{b}))) FROM ({_cells_sql(a, b)}))")
        pear = f"(SELECT corr({a}, {b}) FROM m)" if len(num) == 2 else "NULL"
        spear = (f"(SELECT corr(ra, rb) FROM (SELECT {q.average_rank(a)} AS ra, {q.average_rank(b)} AS rb FROM m))" if len(num) == 2 else "NULL")
        eta = "NULL"
        if len(num) == 1:
            y, g = num[0], cat[0]
            eta = f"(SELECT sum(n * pow(mm - (SELECT avg({y}) FROM m), 2)) / (SELECT sum(pow({y} - (SELECT avg({y}) FROM m), 2)) FROM m) FROM (SELECT count(*) AS n, avg({y}) AS mm FROM m GROUP BY d_{g}))"
        v = (f"(SELECT sqrt(max(n) * (sum(k * k / (na * nb)) - 1) / (max(n) * (least(count(DISTINCT x), count(DISTINCT y)) - 1))) FROM ({_cells_sql(a, b)}))" if len(cat) == 2 else "NULL")
        parts.append(f"SELECT '{a}' AS a, '{b}' AS b, round({nmi}, 6) + 0.0 AS nmi, round({pear}, 6) + 0.0 AS pearson, round({spear}, 6) + 0.0 AS spearman, round({eta}, 6) + 0.0 AS eta2, round({v}, 6) + 0.0 AS cramers_v")
    return f"WITH m AS {MIX_BINS} " + union_sql(parts)


@query("dependency_matrix", _matrix_sql())
def dependency_matrix(t):
    m = depend.dependency_matrix(t.lineitem, MIX)
    return m.select("a", "b", *[rnd(F.col(c)).alias(c) for c in ("nmi", "pearson", "spearman", "eta2", "cramers_v")])


@query("strong_pairs", f"""WITH f AS {FD_FRAME}, m AS (SELECT nation AS d_nation, n_name AS d_n_name, r_name AS d_r_name, segment AS d_segment FROM f)
SELECT * FROM (""" + union_sql([
    f"""SELECT '{a}' AS a, '{b}' AS b, round((SELECT sqrt(max(n) * (sum(k * k / (na * nb)) - 1) / (max(n) * (least(count(DISTINCT x), count(DISTINCT y)) - 1))) FROM ({_cells_sql(a, b)})), 6) AS cramers_v"""
    for a, b in combinations(("nation", "n_name", "r_name", "segment"), 2)]) + ") WHERE cramers_v >= 0.8")
def strong_pairs(t):
    m = depend.dependency_matrix(fd_frame(t), {c: "nominal" for c in ("nation", "n_name", "r_name", "segment")})
    return depend.strong_pairs(m).select("a", "b", F.round("cramers_v", 6).alias("cramers_v"))


PART_COLS = ["l_quantity", "l_extendedprice", "l_discount"]
MIXED = "(SELECT l_quantity, l_extendedprice + 1000 * l_quantity AS l_extendedprice, l_discount + l_quantity / 1000 AS l_discount, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END + l_quantity * l_discount AS y FROM lineitem)"


def mixed(t):
    return t.lineitem.select("l_quantity", (F.col("l_extendedprice") + 1000 * F.col("l_quantity")).alias("l_extendedprice"),
                             (F.col("l_discount") + F.col("l_quantity") / 1000).alias("l_discount"),
                             (F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0) + F.col("l_quantity") * F.col("l_discount")).alias("y"))


MIXED_RANKS = "(SELECT " + ", ".join(f"{q.average_rank(c)} AS {c}" for c in PART_COLS) + f" FROM {MIXED})"


@query("partial_spearman", union_sql([
    f"SELECT '{PART_COLS[i]}' AS a, '{PART_COLS[j]}' AS b, round({q.partial(i, j, tuple(k for k in range(3) if k not in (i, j)))}, 6) + 0.0 AS partial_spearman FROM {q.corr_cte(MIXED_RANKS, PART_COLS)}"
    for i, j in combinations(range(3), 2)]))
def partial_spearman(t):
    return depend.partial_spearman(mixed(t), PART_COLS).select("a", "b", rnd(F.col("partial_spearman")).alias("partial_spearman"))


@query("variance_inflation", union_sql([
    f"""SELECT '{PART_COLS[i]}' AS "column", round(1 / (1 - {q.r_squared(i, [k for k in range(3) if k != i])}), 4) AS vif FROM {q.corr_cte(MIXED, PART_COLS)}""" for i in range(3)]))
def variance_inflation(t):
    return depend.variance_inflation(mixed(t), PART_COLS).select("column", F.round("vif", 4).alias("vif"))


def _interaction(a, b):
    cols = [a, b, f"{a} * {b}", "y"]
    return (f"SELECT '{a}' AS a, '{b}' AS b, {q.r_squared(3, [0, 1, 2])} - {q.r_squared(3, [0, 1])} AS d, {q.r_squared(3, [0, 1, 2])} AS full_r2, n FROM {q.corr_cte(MIXED, cols)}")


@query("interactions", f"""WITH i AS ({union_sql([_interaction(a, b) for a, b in combinations(PART_COLS, 2)])})
SELECT a, b, round(d, 6) + 0.0 AS delta_r2, round(d / ((1 - full_r2) / (n - 4)), 1) + 0.0 AS f FROM i""")
def interactions(t):
    return depend.interactions(mixed(t), PART_COLS, "y").select("a", "b", rnd(F.col("delta_r2")).alias("delta_r2"), rnd(F.col("f"), 1).alias("f"))


# ----------------------------------------------------------------- geometry of the numeric space

@query("space_dimensions")
def space_dimensions(t):
    df = t.lineitem.select(*LINE_NUM, (F.col("l_quantity") * 2 + F.col("l_tax")).alias("copy"))
    return geometry.space(df, [*LINE_NUM, "copy"])


@query("space_two_columns", f"""WITH c AS (SELECT count(*) AS n, corr(l_quantity, l_extendedprice + 1000 * l_quantity) AS r FROM lineitem)
SELECT n AS n_rows, CAST(2 AS BIGINT) AS near_rank, round((1 + abs(r)) / 2, 6) AS first_share, round(4.0 / (pow(1 + abs(r), 2) + pow(1 - abs(r), 2)), 6) AS participation_ratio, round(sqrt((1 + abs(r)) / (1 - abs(r))), 4) AS condition_number FROM c""")
def space_two_columns(t):
    s = geometry.space(mixed(t), ["l_quantity", "l_extendedprice"])
    return s.select("n_rows", "near_rank", F.round(F.col("explained")[0], 6).alias("first_share"), F.round("participation_ratio", 6).alias("participation_ratio"),
                    F.round("condition_number", 4).alias("condition_number"))


@query("intrinsic_dimension")
def intrinsic_dimension(t):
    return geometry.two_nearest_dimension(t.lineitem, LINE_NUM, ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"])


@query("principal_components", """WITH c AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(e) AS me, stddev_pop(e) AS se, corr(l_quantity, e) AS r FROM (SELECT l_quantity, l_extendedprice + 1000 * l_quantity AS e FROM lineitem))
SELECT count(*) AS n, round(var_pop(((l_quantity - mq) / sq + (l_extendedprice + 1000 * l_quantity - me) / se) / sqrt(2)), 6) AS var1, round(max(1 + r), 6) AS eigen1, round(max((1 + r) / 2), 6) AS explained1 FROM lineitem, c""")
def principal_components(t):
    scores, shares = geometry.principal_components(mixed(t), ["l_quantity", "l_extendedprice"], 2)
    first = scores.agg(F.count(F.lit(1)).alias("n"), F.var_pop("pc1").alias("v"))
    return first.select("n", F.round("v", 6).alias("var1"), F.round(F.lit(2 * shares[0]), 6).alias("eigen1"), F.round(F.lit(float(shares[0])), 6).alias("explained1"))
