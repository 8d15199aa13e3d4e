"""Hypothesis tests, effect sizes, corrections, inference and drift queries."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from specula.catalog import query
from specula.catalog import sqltext as q
from specula.catalog.profiles import dependent_gaps, union_sql
from specula.functions.effects import benjamini_hochberg, holm
from specula.operators import drift, hypothesis, inference
from specula.plans.longform import contingency, rnd
from specula.plans.resample import MODULUS, poisson_limits

VALUES = ["l_quantity", "l_extendedprice"]
r = lambda c, d=6: rnd(F.col(c), d).alias(c)


def moments_sql(groups, values, table="lineitem"):
    return union_sql([f"SELECT '{g}' AS group_col, '{y}' AS value_col, CAST({g} AS VARCHAR) AS level, count({y}) AS n, avg({y}) AS m, var_samp({y}) AS v FROM {table} GROUP BY 3"
                      for g in groups for y in values])


def pairs_sql(cte="m", extra=""):
    return (f"SELECT x.group_col, x.value_col, x.level AS a, y.level AS b, x.n AS n1, y.n AS n2, x.m AS m1, y.m AS m2, x.v AS v1, y.v AS v2{extra} "
            f"FROM {cte} x JOIN {cte} y ON x.group_col = y.group_col AND x.value_col = y.value_col AND x.level < y.level")


WELCH = f"""SELECT *, (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS t, pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)) AS df,
 (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) AS d FROM ({pairs_sql()})"""
HEDGES = "d * (1 - 3.0 / (4 * (n1 + n2) - 9))"
HEDGES_SE = "sqrt((n1 + n2) / (n1 * n2) + d * d / (2 * (n1 + n2)))"


@query("group_moments", f"WITH m AS ({moments_sql(['l_linestatus', 'l_returnflag'], VALUES)}) SELECT group_col, value_col, level, n, round(m, 4) AS m, round(v, 3) AS v FROM m")
def group_moments(t):
    return hypothesis.group_moments(t.lineitem, ["l_linestatus", "l_returnflag"], VALUES).select("group_col", "value_col", "level", "n", F.round("m", 4).alias("m"), F.round("v", 3).alias("v"))


@query("welch_t", f"""WITH m AS ({moments_sql(['l_linestatus', 'l_returnflag'], VALUES)}), w AS ({WELCH})
SELECT group_col, value_col, a, b, n1, n2, round(t, 5) + 0.0 AS t, round(df, 2) AS df, round({HEDGES}, 6) + 0.0 AS hedges_g, round({HEDGES} - 1.96 * {HEDGES_SE}, 6) + 0.0 AS ci_low,
 round({HEDGES} + 1.96 * {HEDGES_SE}, 6) + 0.0 AS ci_high, round({q.p_t('t', 'df')}, 5) + 0.0 AS p FROM w""")
def welch_t(t):
    return hypothesis.welch_t(hypothesis.group_moments(t.lineitem, ["l_linestatus", "l_returnflag"], VALUES)).select(
        "group_col", "value_col", "a", "b", "n1", "n2", r("t", 5), r("df", 2), r("hedges_g"), r("ci_low"), r("ci_high"), r("p", 5))


GROUPS3 = ["l_returnflag", "l_linenumber"]
ONE_WAY = """c AS (SELECT group_col, value_col, sum(n * m) / sum(n) AS g, sum(n / v) AS sw, sum(n / v * m) / sum(n / v) AS wm FROM m GROUP BY 1, 2),
s AS (SELECT m.group_col, m.value_col, count(*) AS k, CAST(sum(n) AS BIGINT) AS n, sum(n * pow(m - g, 2)) AS ssb, sum((n - 1) * v) AS ssw, sum(n / v * pow(m - wm, 2)) AS wss,
 sum(pow(1 - n / v / sw, 2) / (n - 1)) AS lam FROM m JOIN c ON m.group_col = c.group_col AND m.value_col = c.value_col GROUP BY 1, 2),
o AS (SELECT *, ssb / (k - 1) / (ssw / (n - k)) AS classic_f, wss / (k - 1) / (1 + 2.0 * (k - 2) / (k * k - 1) * lam) AS welch_f, (k * k - 1) / (3 * lam) AS df2, ssb / (ssb + ssw) AS eta2,
 greatest(0.0, (ssb - (k - 1) * ssw / (n - k)) / (ssb + ssw + ssw / (n - k))) AS omega2 FROM s)"""


@query("one_way_anova", f"""WITH m AS ({moments_sql(GROUPS3, VALUES)}), {ONE_WAY}
SELECT group_col, value_col, k, n, round(classic_f, 5) AS classic_f, round(welch_f, 5) AS welch_f, round(df2, 1) AS df2, round(eta2, 8) AS eta2, round(omega2, 8) + 0.0 AS omega2,
 round({q.p_f('classic_f', '(k - 1)', '(n - k)')}, 5) AS classic_p, round({q.p_f('welch_f', '(k - 1)', 'df2')}, 5) AS welch_p FROM o""")
def one_way_anova(t):
    return hypothesis.one_way(hypothesis.group_moments(t.lineitem, GROUPS3, VALUES)).select(
        "group_col", "value_col", "k", "n", r("classic_f", 5), r("welch_f", 5), r("df2", 1), r("eta2", 8), r("omega2", 8), r("classic_p", 5), r("welch_p", 5))


@query("games_howell", f"""WITH m AS ({moments_sql(GROUPS3, VALUES)}), w AS ({WELCH})
SELECT group_col, value_col, a, b, round(t, 5) + 0.0 AS t, round(df, 2) AS df, round({HEDGES}, 6) + 0.0 AS hedges_g FROM w""")
def games_howell(t):
    return hypothesis.games_howell(hypothesis.group_moments(t.lineitem, GROUPS3, VALUES)).select("group_col", "value_col", "a", "b", r("t", 5), r("df", 2), r("hedges_g"))


@query("games_howell_p")
def games_howell_p(t):
    return hypothesis.games_howell(hypothesis.group_moments(t.lineitem, GROUPS3, VALUES)).select("group_col", "value_col", "a", "b", r("p", 5))


# ----------------------------------------------------------------- ranks

def ranks_sql(groups, values, table="lineitem"):
    return union_sql([f"SELECT '{g}' AS group_col, '{y}' AS value_col, CAST({g} AS VARCHAR) AS level, {y} AS value, {q.average_rank(y)} AS rk, count(*) OVER (PARTITION BY {y}) AS tie FROM {table} WHERE {g} IS NOT NULL AND {y} IS NOT NULL"
                      for g in groups for y in values])


RANK_SUMS = """s AS (SELECT group_col, value_col, level, count(*) AS n, sum(rk) AS r FROM x GROUP BY 1, 2, 3), z AS (SELECT group_col, value_col, count(*) AS total, sum(tie * tie - 1) AS ties FROM x GROUP BY 1, 2)"""


@query("rank_sums", f"""WITH x AS ({ranks_sql(GROUPS3, VALUES)}), {RANK_SUMS} SELECT s.group_col, s.value_col, level, s.n, CAST(r AS DOUBLE) AS r, total, CAST(ties AS DOUBLE) AS ties FROM s JOIN z USING (group_col, value_col)""")
def rank_sums(t):
    levels = hypothesis.levels_of(t.lineitem, GROUPS3)
    return hypothesis.rank_sums(hypothesis.rank_cells(t.lineitem, levels, VALUES), levels).select("group_col", "value_col", "level", "n", "r", "total", "ties")


@query("kruskal_wallis", f"""WITH x AS ({ranks_sql(GROUPS3, VALUES)}), {RANK_SUMS}, h AS (SELECT s.group_col, s.value_col, count(*) AS k, max(total) AS n,
 (12.0 / (max(total) * (max(total) + 1.0)) * sum(r * r / s.n) - 3 * (max(total) + 1)) / (1 - max(ties) / (pow(max(total), 3) - max(total))) AS h FROM s JOIN z USING (group_col, value_col) GROUP BY 1, 2)
SELECT group_col, value_col, k, n, round(h, 4) AS h, round(greatest(0.0, (h - k + 1) / (n - k)), 8) + 0.0 AS epsilon2, round({q.p_chi2('h', '(k - 1)')}, 5) AS p FROM h""")
def kruskal_wallis(t):
    levels = hypothesis.levels_of(t.lineitem, GROUPS3)
    k = hypothesis.kruskal(hypothesis.rank_sums(hypothesis.rank_cells(t.lineitem, levels, VALUES), levels))
    return k.select("group_col", "value_col", "k", "n", r("h", 4), r("epsilon2", 8), r("p", 5))


@query("dunn", f"""WITH x AS ({ranks_sql(GROUPS3, VALUES)}), {RANK_SUMS}, d AS (SELECT a.group_col, a.value_col, a.level AS a, b.level AS b, a.n AS n1, b.n AS n2,
 (a.r / a.n - b.r / b.n) / sqrt((total * (total + 1.0) / 12 - ties / (12.0 * (total - 1))) * (1.0 / a.n + 1.0 / b.n)) AS z FROM s a JOIN s b ON a.group_col = b.group_col AND a.value_col = b.value_col AND a.level < b.level
 JOIN z ON z.group_col = a.group_col AND z.value_col = a.value_col) SELECT group_col, value_col, a, b, n1, n2, round(z, 5) + 0.0 AS z, round({q.p_normal('z')}, 5) AS p FROM d""")
def dunn(t):
    levels = hypothesis.levels_of(t.lineitem, GROUPS3)
    d = hypothesis.dunn(hypothesis.rank_sums(hypothesis.rank_cells(t.lineitem, levels, VALUES), levels))
    return d.select("group_col", "value_col", "a", "b", "n1", "n2", r("z", 5), r("p", 5))


def mw_sql(g, y, a, b, table="lineitem"):
    return f"""SELECT '{g}' AS group_col, '{y}' AS value_col, '{a}' AS a, '{b}' AS b, n1, n2, u, {q.p_normal('z')} AS p, z FROM (SELECT *, greatest(0.0, (greatest(u, n1 * n2 - u) - n1 * n2 / 2.0 - 0.5) / sqrt(n1 * n2 / 12.0 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1.0))))) AS z FROM (
 SELECT count(*) FILTER (l = '{a}') AS n1, count(*) FILTER (l = '{b}') AS n2, sum(CASE WHEN l = '{a}' THEN rk ELSE 0 END) - count(*) FILTER (l = '{a}') * (count(*) FILTER (l = '{a}') + 1) / 2.0 AS u, sum(tie * tie - 1) AS ties
 FROM (SELECT CAST({g} AS VARCHAR) AS l, {q.average_rank(y)} AS rk, count(*) OVER (PARTITION BY {y}) AS tie FROM {table} WHERE CAST({g} AS VARCHAR) IN ('{a}', '{b}') AND {y} IS NOT NULL)))"""


MW_PAIRS = [("l_returnflag", y, a, b) for y in VALUES for a, b in combinations("ANR", 2)] + [("l_linestatus", y, "F", "O") for y in VALUES]


@query("mann_whitney", f"""SELECT group_col, value_col, a, b, n1, n2, CAST(u AS DOUBLE) AS u, round(z, 5) + 0.0 AS z, round(p, 5) AS p, round(2 * u / (n1 * n2) - 1, 8) + 0.0 AS rank_biserial FROM ({union_sql([mw_sql(*x) for x in MW_PAIRS])})""")
def mann_whitney(t):
    levels = hypothesis.levels_of(t.lineitem, ["l_returnflag", "l_linestatus"])
    m = hypothesis.mann_whitney_pairs(hypothesis.rank_cells(t.lineitem, levels, VALUES, pairs=True), levels)
    return m.select("group_col", "value_col", "a", "b", "n1", "n2", "u", r("z", 5), r("p", 5), r("rank_biserial", 8))


@query("group_medians", union_sql([f"SELECT '{g}' AS group_col, '{y}' AS value_col, CAST({g} AS VARCHAR) AS level, round(median({y}), 6) AS median FROM lineitem GROUP BY 3" for g in GROUPS3 for y in VALUES]))
def group_medians(t):
    levels = hypothesis.levels_of(t.lineitem, GROUPS3)
    return hypothesis.level_medians(hypothesis.ranked_sides(t.lineitem, levels, VALUES), levels).select("group_col", "value_col", "level", r("median"))


def _levene_moments():
    return union_sql([f"SELECT '{g}' AS group_col, '{y}' AS value_col, level, count(*) AS n, avg(d) AS m, var_samp(d) AS v FROM (SELECT CAST({g} AS VARCHAR) AS level, abs({y} - median({y}) OVER (PARTITION BY {g})) AS d FROM lineitem) GROUP BY 3"
                      for g in GROUPS3 for y in VALUES])


@query("levene", f"WITH m AS ({_levene_moments()}), {ONE_WAY} SELECT group_col, value_col, k, n, round(classic_f, 5) AS levene_f, round({q.p_f('classic_f', '(k - 1)', '(n - k)')}, 5) AS levene_p FROM o")
def levene(t):
    levels = hypothesis.levels_of(t.lineitem, GROUPS3)
    return hypothesis.levene(hypothesis.ranked_sides(t.lineitem, levels, VALUES), levels).select("group_col", "value_col", "k", "n", r("levene_f", 5), r("levene_p", 5))


# ----------------------------------------------------------------- contingency

def chi_sql(pairs, table):
    parts = []
    for a, b in pairs:
        parts.append(f"""SELECT '{a}' AS a, '{b}' AS b, count(DISTINCT x) AS r, count(DISTINCT y) AS c, CAST(max(n) AS BIGINT) AS n, max(n) * (sum(k * k / (na * nb)) - 1) AS chi2, min(na) * min(nb) / max(n) AS min_expected
 FROM (SELECT x, y, count(*) AS k, sum(count(*)) OVER (PARTITION BY x) AS na, sum(count(*)) OVER (PARTITION BY y) AS nb, sum(count(*)) OVER () AS n
 FROM (SELECT coalesce(CAST({a} AS VARCHAR), '<null>') AS x, coalesce(CAST({b} AS VARCHAR), '<null>') AS y FROM {table}) GROUP BY 1, 2)""")
    return union_sql(parts)


CRAMER = "least(1.0, sqrt(greatest(0.0, chi2 / n - (r - 1.0) * (c - 1) / (n - 1)) / greatest(1e-12, least(r - pow(r - 1, 2) / (n - 1), c - pow(c - 1, 2) / (n - 1)) - 1)))"
CHI_PAIRS = list(combinations(["l_returnflag", "l_linestatus", "l_linenumber"], 2))


@query("chi_square", f"""SELECT a, b, r AS rows, c AS columns, n, round(chi2, 5) + 0.0 AS chi2, round({q.p_chi2('chi2', '((r - 1) * (c - 1))')}, 5) AS p, round({CRAMER}, 6) + 0.0 AS v, round(min_expected, 4) AS min_expected FROM ({chi_sql(CHI_PAIRS, 'lineitem')})""")
def chi_square(t):
    c = hypothesis.chi_square_from_cells(contingency(t.lineitem, CHI_PAIRS))
    return c.select("a", "b", "rows", "columns", "n", r("chi2", 5), r("p", 5), r("v"), r("min_expected", 4))


FISHER_FRAME = "(SELECT c_custkey % 400 = 3 AS rare, c_acctbal < -900 AS debt FROM customer)"


@query("fisher_exact", f"""WITH k AS (SELECT count(*) FILTER (NOT rare AND NOT debt) AS a, count(*) FILTER (NOT rare) AS r1, count(*) FILTER (NOT debt) AS c1, count(*) AS n FROM {FISHER_FRAME}),
x AS (SELECT k.*, unnest(range(greatest(0, r1 + c1 - n), least(r1, c1) + 1)) AS x FROM k),
p AS (SELECT x, a, exp(lgamma(c1 + 1) - lgamma(x + 1) - lgamma(c1 - x + 1) + lgamma(n - c1 + 1) - lgamma(r1 - x + 1) - lgamma(n - c1 - r1 + x + 1) - lgamma(n + 1) + lgamma(r1 + 1) + lgamma(n - r1 + 1)) AS p FROM x)
SELECT 'debt' AS a, 'rare' AS b, 'fisher' AS used, round(sum(p) FILTER (p <= (SELECT p FROM p WHERE x = a) * (1 + 1e-7)), 6) AS p FROM p""")
def fisher_exact(t):
    df = t.customer.select((F.col("c_custkey") % 400 == 3).alias("rare"), (F.col("c_acctbal") < -900).alias("debt"))
    return hypothesis.chi_square_from_cells(contingency(df, [("debt", "rare")]), exact=True).select("a", "b", "used", r("p"))


PROP = """SELECT count(*) FILTER (f) AS n1, count(*) FILTER (NOT f) AS n2, avg(CASE WHEN f THEN y END) AS p1, avg(CASE WHEN NOT f THEN y END) AS p2, avg(y) AS p,
 sum(CASE WHEN f THEN y ELSE 0 END) AS x1, sum(CASE WHEN NOT f THEN y ELSE 0 END) AS x2 FROM (SELECT o_orderdate < TIMESTAMP '1998-01-01' AS f, CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0 ELSE 0.0 END AS y FROM orders)"""
SE = "sqrt(p1 * (1 - p1) / n1 + p2 * (1 - p2) / n2)"
OR = "(x1 * (n2 - x2) / (x2 * (n1 - x1)))"
OR_SE = "1.96 * sqrt(1 / x1 + 1 / (n1 - x1) + 1 / x2 + 1 / (n2 - x2))"


def urgent(t):
    return t.orders.select("*", (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("urgent"))



def early():
    return F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp")


@query("two_proportions", f"""WITH k AS ({PROP}), s AS (SELECT *, (p1 - p2) / sqrt(p * (1 - p) * (1.0 / n1 + 1.0 / n2)) AS z FROM k)
SELECT n1, n2, round(p1, 6) AS rate1, round(p2, 6) AS rate2, round(p1 - p2, 6) + 0.0 AS difference, round(p1 - p2 - 1.96 * {SE}, 6) + 0.0 AS ci_low, round(p1 - p2 + 1.96 * {SE}, 6) + 0.0 AS ci_high, round(z, 5) + 0.0 AS z,
 round({OR}, 6) AS odds_ratio, round(exp(ln({OR}) - {OR_SE}), 6) AS or_low, round(exp(ln({OR}) + {OR_SE}), 6) AS or_high, round({q.p_normal('z')}, 5) AS p FROM s""")
def two_proportions(t):
    x = hypothesis.two_proportions(urgent(t), "urgent", early())
    return x.select("n1", "n2", *[r(c) for c in ("rate1", "rate2", "difference", "ci_low", "ci_high")], r("z", 5), r("odds_ratio"), r("or_low"), r("or_high"), r("p", 5))


# ----------------------------------------------------------------- distributions of two parts

SIDES = "(SELECT *, o_orderdate < TIMESTAMP '1998-01-01' AS f, o_totalprice + CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 0 ELSE o_custkey * 50 END AS moved FROM orders)"


def shifted(t):
    return t.orders.withColumn("moved", F.col("o_totalprice") + F.when(early(), 0).otherwise(F.col("o_custkey") * 50))


def ks_sql(c):
    return f"""SELECT '{c}' AS "column", max(n1) AS n1, max(n2) AS n2, max(abs(f1 - f2)) AS ks_d, sum(abs(f1 - f2) * coalesce(nxt - v, 0)) AS wasserstein FROM (
 SELECT v, n1, n2, sum(a) OVER w / n1 AS f1, sum(b) OVER w / n2 AS f2, lead(v) OVER (ORDER BY v) AS nxt FROM (SELECT {c} AS v, count(*) FILTER (f) AS a, count(*) FILTER (NOT f) AS b,
 (SELECT count(*) FROM {SIDES} WHERE f) AS n1, (SELECT count(*) FROM {SIDES} WHERE NOT f) AS n2 FROM {SIDES} GROUP BY 1) WINDOW w AS (ORDER BY v))"""


def psi_sql(c):
    e = f"(SELECT list_sort(list_distinct(quantile_cont({c}, [{', '.join(str(i / 10) for i in range(11))}]))) AS e FROM {SIDES} WHERE f)"
    return f"""SELECT '{c}' AS "column", sum((greatest(a, 1e-6) - greatest(x, 1e-6)) * ln(greatest(a, 1e-6) / greatest(x, 1e-6))) AS psi FROM (
 SELECT least(len(list_filter(e[2:len(e) - 1], lambda y: y <= {c})), len(e) - 2) AS bin, count(*) FILTER (f) / (SELECT count(*) FROM {SIDES} WHERE f) AS x, count(*) FILTER (NOT f) / (SELECT count(*) FROM {SIDES} WHERE NOT f) AS a FROM {SIDES}, {e} GROUP BY 1)"""


DRIFT_NUM = ["o_totalprice", "moved", "o_custkey"]


@query("numeric_drift", f"""WITH k AS ({union_sql([ks_sql(c) for c in DRIFT_NUM])}), p AS ({union_sql([psi_sql(c) for c in DRIFT_NUM])})
SELECT k."column", n1, n2, round(ks_d, 6) AS ks_d, round({q.p_ks('ks_d', 'n1', 'n2')}, 5) AS p, round(wasserstein, 2) AS wasserstein, round(psi, 6) + 0.0 AS psi FROM k JOIN p ON k."column" = p."column" """)
def numeric_drift(t):
    d = drift.numeric_drift(shifted(t), DRIFT_NUM, early())
    return d.select("column", "n1", "n2", r("ks_d"), r("p", 5), r("wasserstein", 2), r("psi"))


def psi_cat_sql(c, table=SIDES):
    return f"""SELECT '{c}' AS "column", sum((a - x) * ln(a / x)) AS psi FROM (SELECT greatest(count(*) FILTER (f) / (SELECT count(*) FROM {table} WHERE f), 1e-6) AS x,
 greatest(count(*) FILTER (NOT f) / (SELECT count(*) FROM {table} WHERE NOT f), 1e-6) AS a FROM {table} GROUP BY coalesce(CAST({c} AS VARCHAR), '<null>'))"""


DRIFT_NOM = ["o_orderstatus", "o_orderpriority"]


@query("nominal_drift", f"""WITH k AS ({chi_sql([('f', c) for c in DRIFT_NOM], SIDES)}), p AS ({union_sql([psi_cat_sql(c) for c in DRIFT_NOM])})
SELECT b AS "column", n, round(chi2, 5) AS chi2, round({q.p_chi2('chi2', '((r - 1) * (c - 1))')}, 5) AS p, round({CRAMER}, 6) + 0.0 AS cramers_v, round(min_expected, 4) AS min_expected, round(psi, 8) + 0.0 AS psi FROM k JOIN p ON k.b = p."column" """)
def nominal_drift(t):
    d = drift.nominal_drift(t.orders, DRIFT_NOM, early())
    return d.select("column", "n", r("chi2", 5), r("p", 5), r("cramers_v"), r("min_expected", 4), r("psi", 8))


@query("drift_report", f"""WITH k AS ({union_sql([ks_sql(c) for c in DRIFT_NUM])}), p AS ({union_sql([psi_sql(c) for c in DRIFT_NUM] + [psi_cat_sql(c) for c in DRIFT_NOM])}), x AS ({chi_sql([('f', c) for c in DRIFT_NOM], SIDES)}),
a AS (SELECT "column", 'ks+psi' AS measure, ks_d AS statistic, {q.p_ks('ks_d', 'n1', 'n2')} AS p FROM k UNION ALL SELECT b, 'chi2+psi', chi2, {q.p_chi2('chi2', '((r - 1) * (c - 1))')} FROM x),
o AS (SELECT *, row_number() OVER (ORDER BY p, "column") AS i, count(*) OVER () AS m FROM a)
SELECT o."column", measure, round(statistic, 5) AS statistic, round(o.p, 5) AS p, round(psi, 6) + 0.0 AS psi, psi > 0.25 AS drifted, round(least(1.0, min(o.p * m / i) OVER (ORDER BY i DESC)), 5) AS p_adj FROM o JOIN p ON o."column" = p."column" """)
def drift_report(t):
    d = drift.drift_report(shifted(t), DRIFT_NUM, DRIFT_NOM, early())
    return d.select("column", "measure", r("statistic", 5), r("p", 5), r("psi"), "drifted", r("p_adj", 5))


@query("label_rate_drift", f"WITH k AS ({PROP}) SELECT round(p1, 6) AS first_rate, round(p2, 6) AS rest_rate, round(p1 - p2, 6) + 0.0 AS difference, round(p1 - p2 - 1.96 * {SE}, 6) + 0.0 AS ci_low, round(p1 - p2 + 1.96 * {SE}, 6) + 0.0 AS ci_high FROM k")
def label_rate_drift(t):
    return drift.label_rate_drift(urgent(t), "urgent", early()).select(*[r(c) for c in ("first_rate", "rest_rate", "difference", "ci_low", "ci_high")])


# ----------------------------------------------------------------- corrections

PVALUES = f"WITH m AS ({moments_sql(GROUPS3, VALUES)}), {ONE_WAY}, pv AS (SELECT group_col, value_col, {q.p_f('classic_f', '(k - 1)', '(n - k)')} AS p FROM o)"


@query("benjamini_hochberg", PVALUES + """, i AS (SELECT *, row_number() OVER (ORDER BY p, group_col, value_col) AS i, count(*) OVER () AS m FROM pv)
SELECT group_col, value_col, round(p, 5) AS p, round(least(1.0, min(p * m / i) OVER (ORDER BY i DESC)), 5) AS p_adj FROM i""")
def bh(t):
    rows = hypothesis.one_way(hypothesis.group_moments(t.lineitem, GROUPS3, VALUES)).select("group_col", "value_col", F.col("classic_p").alias("p"))
    return benjamini_hochberg(rows, order=["group_col", "value_col"]).select("group_col", "value_col", r("p", 5), r("p_adj", 5))


@query("holm", PVALUES + """, i AS (SELECT *, row_number() OVER (PARTITION BY group_col ORDER BY p, value_col) AS i, count(*) OVER (PARTITION BY group_col) AS m FROM pv)
SELECT group_col, value_col, round(p, 5) AS p, round(least(1.0, max(p * (m - i + 1)) OVER (PARTITION BY group_col ORDER BY i)), 5) AS p_holm FROM i""")
def holm_query(t):
    rows = hypothesis.one_way(hypothesis.group_moments(t.lineitem, GROUPS3, VALUES)).select("group_col", "value_col", F.col("classic_p").alias("p"))
    return holm(rows, family=["group_col"], order=["value_col"]).select("group_col", "value_col", r("p", 5), r("p_holm", 5))


# ----------------------------------------------------------------- further tests

@query("normality_large", """WITH g AS (SELECT l_linestatus AS level, count(*) AS n, skewness(l_quantity) AS s, kurtosis_pop(l_quantity) AS k FROM lineitem GROUP BY 1),
a AS (SELECT level, n, s * (n - 2) / sqrt(n * (n - 1.0)) AS g1, k AS g2, CAST(n AS DOUBLE) AS d FROM g),
b AS (SELECT *, g1 * sqrt((d + 1) * (d + 3) / (6 * (d - 2))) AS y, -1 + sqrt(2 * (3 * (d * d + 27 * d - 70) * (d + 1) * (d + 3) / ((d - 2) * (d + 5) * (d + 7) * (d + 9)) - 1)) AS w2,
 (g2 + 3 - 3 * (d - 1) / (d + 1)) / sqrt(24 * d * (d - 2) * (d - 3) / ((d + 1) * (d + 1) * (d + 3) * (d + 5))) AS x, 6 * (d * d - 5 * d + 2) / ((d + 7) * (d + 9)) * sqrt(6 * (d + 3) * (d + 5) / (d * (d - 2) * (d - 3))) AS q FROM a),
c AS (SELECT *, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) AS z1, 6 + 8 / q * (2 / q + sqrt(1 + 4 / (q * q))) AS A FROM b),
e AS (SELECT *, 1 + x * sqrt(2 / (A - 4)) AS den FROM c)
SELECT 'l_linestatus' AS group_col, level, n, 'dagostino' AS test, round(z1 * z1 + pow((1 - 2 / (9 * A) - sign(den) * pow((1 - 2 / A) / abs(den), 1.0 / 3)) / sqrt(2 / (9 * A)), 2), 2) AS statistic FROM e WHERE n > 1000""")
def normality_large(t):
    return hypothesis.normality(t.lineitem, ["l_linestatus"], ["l_quantity"], small=1000).select("group_col", "level", "n", "test", r("statistic", 2))


@query("normality_small")
def normality_small(t):
    c = t.customer.select(F.concat(F.lit("g"), (F.col("c_custkey") % 40).cast("string")).alias("g"), "c_acctbal")
    return hypothesis.normality(c, ["g"], ["c_acctbal"]).select("level", "n", "test", r("statistic"), r("p"))


PAIRED = "(SELECT l_extendedprice * l_discount AS a, l_extendedprice * l_tax AS b FROM lineitem)"


def paired(t):
    return t.lineitem.select((F.col("l_extendedprice") * F.col("l_discount")).alias("a"), (F.col("l_extendedprice") * F.col("l_tax")).alias("b"))


@query("paired_t", f"""WITH k AS (SELECT count(*) AS n, avg(a - b) AS mean, stddev_samp(a - b) AS sd FROM {PAIRED}) SELECT n, round(mean, 4) AS mean, round(sd, 4) AS sd, round(mean / (sd / sqrt(n)), 4) AS t, round(mean / sd, 6) AS dz,
 round({q.p_t('mean / (sd / sqrt(n))', '(n - 1)')}, 6) + 0.0 AS p FROM k""")
def paired_t(t):
    return hypothesis.paired_t(paired(t), "a", "b").select("n", r("mean", 4), r("sd", 4), r("t", 4), r("dz"), r("p"))


@query("wilcoxon_signed_rank", f"""WITH d AS (SELECT l_discount * 100 - l_tax * 100 AS d FROM lineitem WHERE l_discount * 100 <> l_tax * 100), x AS (SELECT d, {q.average_rank('abs(d)')} AS rk, count(*) OVER (PARTITION BY abs(d)) AS tie FROM d),
s AS (SELECT count(*) AS n, sum(CASE WHEN d > 0 THEN rk ELSE 0 END) AS wp, sum(CASE WHEN d < 0 THEN rk ELSE 0 END) AS wm, sum(tie * tie - 1) AS ties FROM x)
SELECT n, CAST(wp AS DOUBLE) AS w_plus, CAST(wm AS DOUBLE) AS w_minus, round((least(wp, wm) - n * (n + 1) / 4.0) / sqrt(n * (n + 1.0) * (2 * n + 1) / 24 - ties / 48.0), 4) AS z FROM s""")
def wilcoxon(t):
    df = t.lineitem.select((F.col("l_discount") * 100).alias("a"), (F.col("l_tax") * 100).alias("b"))
    return hypothesis.wilcoxon_signed_rank(df, "a", "b").select("n", "w_plus", "w_minus", r("z", 4))


def drawn_sql(first: int, reps: int) -> str:
    """A row of ``x`` (y, g) for every order and repetition, with its draw u."""
    part = lambda start: f"CAST('0x' || substr(md5(o_orderkey || ':7'), {start}, 8) AS BIGINT) % {MODULUS}"
    return (f"x AS (SELECT CAST(o_totalprice AS DOUBLE) AS y, o_orderstatus = 'F' AS g, {part(1)} AS a, {part(9)} AS b FROM orders), "
            f"e AS (SELECT y, g, rep, (a + b * rep) % {MODULUS} AS u FROM x, range({first}, {reps + 1}) t(rep))")


@query("permutation_test", f"""WITH {drawn_sql(0, 200)}, k AS (SELECT avg(CAST(g AS INT)) * {MODULUS} AS share FROM x), l AS (SELECT rep, y, CASE WHEN rep = 0 THEN g ELSE u < share END AS side FROM e, k),
d AS (SELECT rep, avg(y) FILTER (WHERE side) - avg(y) FILTER (WHERE NOT side) AS d FROM l GROUP BY rep), o AS (SELECT d AS observed FROM d WHERE rep = 0)
SELECT round(max(observed), 4) AS observed, count(d) AS reps, round((1 + count(*) FILTER (WHERE abs(d) >= abs(observed))) / (1.0 + count(d)), 4) AS p FROM d, o WHERE rep > 0""")
def permutation_test(t):
    p = hypothesis.permutation_test(t.orders, "o_totalprice", F.col("o_orderstatus") == "F", "o_orderkey")
    return p.select(r("observed", 4), "reps", r("p", 4))


@query("bootstrap_interval", f"""WITH {drawn_sql(1, 2000)}, w AS (SELECT rep, y, {' + '.join(f'CAST(u >= {x} AS INT)' for x in poisson_limits())} AS w FROM e),
d AS (SELECT rep, sum(w * y) / sum(w) AS stat FROM w GROUP BY rep)
SELECT 'o_totalprice' AS "column", count(stat) AS reps, round(quantile_cont(stat, 0.025), 2) AS ci_low, round(quantile_cont(stat, 0.5), 2) AS centre, round(quantile_cont(stat, 0.975), 2) AS ci_high FROM d""")
def bootstrap(t):
    return hypothesis.bootstrap_interval(t.orders, "o_totalprice", "o_orderkey").select("column", "reps", r("ci_low", 2), r("centre", 2), r("ci_high", 2))


@query("conditional_mutual_information", """WITH c AS (SELECT l_returnflag AS x, l_linestatus AS y, l_linenumber AS z, count(*) AS n FROM lineitem GROUP BY 1, 2, 3), t AS (SELECT sum(n) AS t FROM c)
SELECT 'l_returnflag' AS x, 'l_linestatus' AS y, 'l_linenumber' AS z, CAST(max(t) AS BIGINT) AS n, round(sum(n / t * ln(n * nz / (nxz * nyz))), 8) + 0.0 AS cmi FROM (
 SELECT n, sum(n) OVER (PARTITION BY z) AS nz, sum(n) OVER (PARTITION BY x, z) AS nxz, sum(n) OVER (PARTITION BY y, z) AS nyz FROM c), t""")
def cmi(t):
    return hypothesis.conditional_mutual_information(t.lineitem, "l_returnflag", "l_linestatus", "l_linenumber").select("x", "y", "z", "n", r("cmi", 8))


# ----------------------------------------------------------------- inference

INF_G = ["o_orderstatus", "o_orderpriority", "odd"]
INF_Y = ["o_totalprice", "o_custkey"]
INF_T = "(SELECT *, o_orderkey % 2 AS odd FROM orders)"


@query("numeric_by_nominal", f"""WITH m AS ({moments_sql(INF_G, INF_Y, INF_T)}), {ONE_WAY}, w AS ({WELCH}),
a AS (SELECT group_col, value_col, 'welch-anova' AS test, welch_f AS statistic, {q.p_f('welch_f', '(k - 1)', 'df2')} AS p, 'omega_squared' AS effect_name, omega2 AS effect FROM o WHERE k > 2
 UNION ALL SELECT group_col, value_col, 'welch-t', t, {q.p_t('t', 'df')}, 'hedges_g', {HEDGES} FROM w WHERE group_col = 'odd'),
i AS (SELECT *, row_number() OVER (ORDER BY p, group_col, value_col) AS i, count(*) OVER () AS m FROM a)
SELECT group_col, value_col, test, round(statistic, 5) + 0.0 AS statistic, effect_name, round(effect, 6) + 0.0 AS effect, round(p, 5) AS p, round(least(1.0, min(p * m / i) OVER (ORDER BY i DESC)), 5) AS p_adj FROM i""")
def numeric_by_nominal(t):
    x = inference.numeric_by_nominal(t.orders.withColumn("odd", F.col("o_orderkey") % 2), INF_G, INF_Y)
    return x.select("group_col", "value_col", "test", r("statistic", 5), "effect_name", r("effect"), r("p", 5), r("p_adj", 5))


@query("numeric_by_nominal_small_groups")
def numeric_by_nominal_small(t):
    c = t.customer.select(F.when(F.col("c_custkey") % 100 == 3, "few").otherwise(F.when(F.col("c_custkey") % 3 == 0, "a").otherwise("b")).alias("g"),
                          F.exp(F.col("c_acctbal") / 2000).alias("y"), "c_acctbal")
    x = inference.numeric_by_nominal(c, ["g"], ["y", "c_acctbal"])
    return x.select("group_col", "value_col", "test", r("statistic", 4), r("p", 5), "norm_ok", "small_groups", r("levene_p", 5))


@query("contrasts", f"""WITH m AS ({moments_sql(['o_orderstatus', 'o_orderpriority'], ['o_totalprice'], 'orders')}), w AS ({WELCH})
SELECT group_col, value_col, a, b, 'games-howell' AS test, round(t, 5) + 0.0 AS statistic, round({HEDGES}, 6) + 0.0 AS effect FROM w""")
def contrasts(t):
    c = inference.contrasts(t.orders, ["o_orderstatus", "o_orderpriority"], ["o_totalprice"])
    return c.select("group_col", "value_col", "a", "b", "test", r("statistic", 5), r("effect"))


NN_PAIRS = list(combinations(["o_orderstatus", "o_orderpriority", "odd"], 2))


@query("nominal_by_nominal", f"""WITH k AS ({chi_sql(NN_PAIRS, INF_T)}), p AS (SELECT *, {q.p_chi2('chi2', '((r - 1) * (c - 1))')} AS p FROM k), i AS (SELECT *, row_number() OVER (ORDER BY p, a, b) AS i, count(*) OVER () AS m FROM p)
SELECT a, b, n, round(chi2, 5) + 0.0 AS chi2, round(p, 5) AS p, round({CRAMER}, 6) + 0.0 AS v, round(least(1.0, min(p * m / i) OVER (ORDER BY i DESC)), 5) AS p_adj FROM i""")
def nominal_by_nominal(t):
    x = inference.nominal_by_nominal(t.orders.withColumn("odd", F.col("o_orderkey") % 2), INF_G)
    return x.select("a", "b", "n", r("chi2", 5), r("p", 5), r("v"), r("p_adj", 5))


@query("label_balance", """WITH c AS (SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1), t AS (SELECT sum(n) AS t, min(n) AS lo, max(n) AS hi FROM c)
SELECT value, n, round(n / t, 6) AS share, round(lo / t, 6) AS minority_share, round(hi / t, 6) AS baseline_accuracy FROM c, t ORDER BY n DESC, value LIMIT 12""")
def label_balance(t):
    return inference.label_balance(t.orders, "o_orderpriority").select("value", "n", *[F.round(c, 6).alias(c) for c in ("share", "minority_share", "baseline_accuracy")])
