"""De-duplication and the split. A split assigns parts by thresholds; only one by levels joins rows, with the table of these."""

from __future__ import annotations

from decimal import ROUND_HALF_EVEN, ROUND_HALF_UP, Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specula.operators.quality import near_duplicates, short_key
from specula.operators.shaping.recipe import Shaped, Step
from specula.plans.ordered import order_statistics, spread_lookup
from specula.session import settle

CELL = 10_000


def dedupe(state: Shaped, step: Step) -> dict:
    """Keep the first or last row of equal keys along the row id, as one mergeable aggregate."""
    on, keep = step.params.get("on", "all"), step.params.get("keep", "first")
    if step.params.get("tolerances"):
        near = near_duplicates(state.df, step.params["tolerances"], state.row_id)
        state.df = state.df.join(near.select(F.col("row_id").alias(state.row_id)), state.row_id, "left_anti")
        return {"tolerances": step.params["tolerances"]}
    keys = [c for c in state.columns if c != state.row_id] if on == "all" else ([on] if isinstance(on, str) else list(on))
    rest = [c for c in state.df.columns if c not in (state.row_id, "_part")]
    pick = F.min if keep == "first" else F.max
    grouped = (state.df.groupBy("_part", *short_key(state.df, keys))
               .agg(pick(F.struct(state.row_id, *rest)).alias("_row")))
    order = state.df.columns
    state.df = grouped.select("_part", "_row.*").select(*order)
    return {"on": on, "keep": keep}


def seeded(seed: int, key: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def hash_thresholds(rows: DataFrame, draw: Column, level: Column, cuts: dict[str, list[int]]) -> dict[tuple[str, int], str]:
    """{(level, k): the k-th smallest draw of the level}, 1-based.

    Draws are hex digests. Counting by two more digits narrows every wanted rank to a small
    cell; only such cells are ordered. Each pass is one small aggregation.
    """
    base = rows.select(level.cast("string").alias("level"), draw.alias("h"))
    open_ranks = {(lv, k): ("", k) for lv, ks in cuts.items() for k in ks if k > 0}
    ready: dict[tuple[str, int], tuple[str, int]] = {}
    depth = 0
    while open_ranks:
        cells = sorted({(lv, prefix) for (lv, _), (prefix, _) in open_ranks.items()})
        table = rows.sparkSession.createDataFrame(cells, "level string, prefix string")
        held = base.withColumn("prefix", F.substring("h", 1, depth)).join(F.broadcast(table), ["level", "prefix"], "left_semi")
        counts: dict[tuple[str, str], list[tuple[str, int]]] = {}
        for r in held.groupBy("level", "prefix", F.substring("h", depth + 1, 2).alias("d")).agg(F.count(F.lit(1)).alias("n")).collect():
            counts.setdefault((r["level"], r["prefix"]), []).append((r["d"], r["n"]))
        nxt = {}
        for key, (prefix, k) in open_ranks.items():
            for d, n in sorted(counts[(key[0], prefix)]):
                if k <= n:
                    (ready if n <= CELL else nxt)[key] = (prefix + d, k)
                    break
                k -= n
        open_ranks, depth = nxt, depth + 2
    if not ready:
        return {}
    spots = rows.sparkSession.createDataFrame(
        [(lv, prefix, len(prefix), k, rank) for (lv, rank), (prefix, k) in ready.items()],
        "level string, prefix string, width int, k int, rank long")
    near = base.join(F.broadcast(spots), (base["level"] == spots["level"]) & F.expr("substring(h, 1, width) = prefix"))
    order = Window.partitionBy(spots["level"], "prefix", "rank").orderBy("h")
    found = near.withColumn("r", F.row_number().over(order)).filter("r = k").select(spots["level"], "rank", "h")
    return {(r["level"], r["rank"]): r["h"] for r in found.collect()}


HALVES = {"even": ROUND_HALF_EVEN, "up": ROUND_HALF_UP}


def _sizes(n: int, test: float, valid: float, halves: str = "even") -> tuple[int, int]:
    """Rows of the two parts; a half goes to the even number, or up as SQL's ``round`` has it."""
    return tuple(int((Decimal(str(share)) * n).quantize(Decimal(1), HALVES[halves])) for share in (test, valid))


def _by_draw(rows: DataFrame, draw: Column, test: float, valid: float, halves: str = "even") -> Column:
    """The part of each row: its draw against two thresholds of the whole table."""
    first, second = _sizes(rows.count(), test, valid, halves)
    found = hash_thresholds(rows, draw, F.lit("all"), {"all": [first, first + second]})
    limits = [F.lit(found.get(("all", k), "")) for k in (first, first + second)]
    return F.when(draw <= limits[0], "test").when(draw <= limits[1], "valid").otherwise("train")


def level_thresholds(rows: DataFrame, test: float, valid: float, most: int = CELL, halves: str = "even") -> DataFrame:
    """(level, n, test_to, valid_to) from (level, h): the largest draws of each level's parts, empty for no row.

    Any number of levels of any size: a round counts every open cell of a level (draws with one
    prefix) by two more digits, turns each wanted rank into a cell of these and keeps only the rows
    of such cells, 1/128 of them. When no cell has more than ``most`` rows, ranks are read off
    within the cells. Counts combine before the shuffle, so a hot level is 256 rows of a task.
    """
    names = ("test", "valid")
    cells = rows.groupBy("level", F.substring("h", 1, 2).alias("d")).agg(F.count(F.lit(1)).alias("rows"))
    of_level = Window.partitionBy("level")  # 256 cells at most
    n = F.sum("rows").over(of_level)
    upto = F.sum("rows").over(of_level.orderBy("d")) - F.col("rows")
    whole = {"even": F.bround, "up": F.round}[halves]
    first, second = (whole(F.lit(Decimal(str(share))) * F.col("n").cast("decimal(19,0)")).cast("long") for share in (test, valid))
    wanted = {"test": first, "valid": first + second}
    placed = cells.select("level", "d", "rows", n.alias("n"), upto.alias("before"))

    def within(column: str, rank: Column) -> Column:
        """The one cell that holds the rank: (prefix, rank within it, rows)."""
        return F.max(F.when((F.col("before") < rank) & (rank <= F.col("before") + F.col("rows")),
                            F.struct("d", (rank - F.col("before")).alias("k"), "rows"))).alias(column)

    spots = settle(placed.groupBy("level").agg(F.max("n").alias("n"), *[within(c, wanted[c]) for c in names]))
    total, depth = spots.agg(F.sum("n")).first()[0] or 0, 2
    while True:
        largest = spots.agg(F.greatest(*[F.max(F.coalesce(F.col(f"{c}.rows"), F.lit(0))) for c in names])).first()[0] or 0
        marked = spread_lookup(rows.select("level", "h"), spots.withColumn("total_n", F.lit(total)), ["level"], list(names), "n")
        at = F.substring("h", 1, depth)
        inside = F.array_distinct(F.array_compact(F.array(*[F.when(at == F.col(f"{c}.d"), F.col(f"{c}.d")) for c in names])))
        rows = settle(marked.filter(F.size(inside) > 0).select("level", "h"))
        if largest <= most or depth >= 32:
            break
        cells = rows.groupBy("level", F.substring("h", 1, depth).alias("p"), F.substring("h", 1, depth + 2).alias("d")).agg(F.count(F.lit(1)).alias("rows"))
        order = Window.partitionBy("level", "p").orderBy("d")
        held = cells.select("level", "p", "d", "rows", (F.sum("rows").over(order) - F.col("rows")).alias("before"))
        finer = held.join(spots.select("level", "n", *[F.col(c).alias(f"old_{c}") for c in names]), "level")
        here = lambda c: F.when(F.col("p") == F.col(f"old_{c}.d"), F.col(f"old_{c}.k"))
        narrowed = finer.groupBy("level").agg(*[within(c, here(c)) for c in names])
        spots = settle(spots.select("level", "n").join(narrowed, "level", "left"))
        depth += 2
    ordered = rows.withColumn("p", F.substring("h", 1, depth)).withColumn("r", F.row_number().over(Window.partitionBy("level", "p").orderBy("h")))
    ranked = ordered.join(spots, "level")
    ends = ranked.groupBy("level").agg(*[F.max(F.when((F.col("p") == F.col(f"{c}.d")) & (F.col("r") == F.col(f"{c}.k")), F.col("h"))).alias(f"{c}_to")
                                         for c in names])
    return spots.select("level", "n").join(ends, "level", "left").select("level", "n", *[F.coalesce(f"{c}_to", F.lit("")).alias(f"{c}_to") for c in names])


def _by_level(df: DataFrame, draw: Column, level: Column, test: float, valid: float, halves: str) -> DataFrame:
    """``df`` with ``_part``: each row's draw against the thresholds of its level, from a joined table."""
    rows = df.withColumns({"level_of_row": level, "draw_of_row": draw})
    table = level_thresholds(rows.select(F.col("level_of_row").alias("level"), F.col("draw_of_row").alias("h")), test, valid, halves=halves)
    total = table.agg(F.sum("n")).first()[0] or 0
    limits = table.select(F.col("level").alias("level_of_row"), F.col("n").alias("rows_of_level"), F.col("test_to").alias("_test_to"),
                          F.col("valid_to").alias("_valid_to"))
    got = spread_lookup(rows, limits.withColumn("total_n", F.lit(total)), ["level_of_row"], ["_test_to", "_valid_to"], "rows_of_level")
    part = F.when(F.col("draw_of_row") <= F.col("_test_to"), "test").when(F.col("draw_of_row") <= F.col("_valid_to"), "valid").otherwise("train")
    return got.withColumn("_part", part).select(*[c for c in df.columns if c != "_part"], "_part")


def split(state: Shaped, step: Step) -> dict:
    p = step.params
    kind, test, valid = p.get("kind", "random"), float(p.get("test", 0.2)), float(p.get("valid", 0.0))
    halves = p.get("halves", "even")
    df = state.df
    if kind == "random":
        part = _by_draw(df, seeded(state.seed, F.col(state.row_id)), test, valid, halves)
    elif kind == "stratified":
        by = p.get("by") or state.label
        _need(df, by, step)
        level = F.coalesce(F.col(by).cast("string"), F.lit("<null>"))
        df = _by_level(df, seeded(state.seed, F.col(state.row_id)), level, test, valid, halves)
        part = F.col("_part")
    elif kind == "group":
        by = p["by"]
        _need(df, by, step)
        key = F.coalesce(F.col(by).cast("string"), F.lit("<null>"))
        keys = df.select(key.alias("_key")).distinct()
        found = _by_draw(keys, seeded(state.seed, F.col("_key")), test, valid, halves)
        df = df.withColumn("_key", key)
        part = found
    elif kind == "cutoff":
        _need(df, p["time_column"], step)
        part = F.when(F.col(p["time_column"]) >= F.lit(p["cutoff"]).cast("timestamp"), "test").otherwise("train")
    elif kind == "time":
        _need(df, p["time_column"], step)
        part = _time_part(state, p["time_column"], test, valid, halves)
    else:
        raise ValueError(f"unknown split {kind!r}")
    state.df = df.withColumn("_part", part).drop("_key")
    state.split = kind
    return {"kind": kind, "test": test, "valid": valid}


def _need(df: DataFrame, column: str | None, step: Step) -> None:
    if column not in df.columns:
        raise ValueError(f"{step.id}: the split needs an existing column, not {column!r}")


def _time_part(state: Shaped, column: str, test: float, valid: float, halves: str = "even") -> Column:
    """Rows along (time, row id): the last are test, those before them valid; no time counts as last."""
    at = F.coalesce(F.unix_micros(F.col(column).cast("timestamp")).cast("double"), F.lit(9.0e18))
    rows = state.df.select(at.alias("at"), F.col(state.row_id).alias("id"))
    whole = dict(rows.dtypes)["id"] in ("tinyint", "smallint", "int", "bigint")
    ends: dict[int, tuple] = {}

    def wanted(total: int) -> set[int]:
        n_test, n_valid = _sizes(total, test, valid, halves)
        ends.update({total - n_test: (), total - n_test - n_valid: ()})
        return set(ends)

    totals, found = order_statistics(rows, ["at"], wanted)
    n_test, n_valid = _sizes(totals["at"], test, valid, halves)

    def from_rank(rank: int) -> Column:
        """Whether a row's position is at or after the rank."""
        if rank >= totals["at"]:
            return F.lit(False)
        value, before = found[("at", rank)]
        tied = rows.filter(F.col("at") == value)
        return (at > value) | ((at == value) & from_tie(tied, rank - before))

    def from_tie(tied, rank: int) -> Column:
        """The same among rows of one time: whole ids in their order, exact beyond 2**53; other ids by their digest."""
        mine = F.col(state.row_id)
        if not whole:
            draw = F.md5(mine.cast("string"))
            last = hash_thresholds(tied.select(F.md5(F.col("id").cast("string")).alias("id")), F.col("id"), F.lit("all"), {"all": [rank]}).get(("all", rank), "")
            return draw > last
        parts = lambda c: (F.shiftright(c.cast("bigint"), 26).cast("double"), c.cast("bigint").bitwiseAND(F.lit((1 << 26) - 1)).cast("double"))
        high, low = parts(F.col("id"))
        split = tied.select(high.alias("high"), low.alias("low"))
        _, highs = order_statistics(split, ["high"], lambda n: {rank})
        top, above = highs[("high", rank)]
        _, lows = order_statistics(split.filter(F.col("high") == top), ["low"], lambda n: {rank - above})
        return (parts(mine)[0] > top) | ((parts(mine)[0] == top) & (parts(mine)[1] >= lows[("low", rank - above)][0]))

    return (F.when(from_rank(totals["at"] - n_test), "test")
            .when(from_rank(totals["at"] - n_test - n_valid) if n_valid else F.lit(False), "valid").otherwise("train"))


OPERATIONS = {"dedupe": dedupe, "split": split}
