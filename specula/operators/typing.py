"""Column census, semantic types, roles, and detection of time and coordinate columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from specula.plans.ordered import bucket_of, cut_points, previous_value, slices_for

SHORT = 64

# Name patterns that mark identifier-like and postal-like columns.
ID_NAME = r"(^|_)(id|key|uuid|code)$"
POSTAL_NAME = r"(zip|postal|cap|plz)"
# Column names that mark coordinates.
LAT_NAMES = ("lat", "latitude", "y_lat")
LON_NAMES = ("lon", "lng", "long", "longitude")

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def kind_of(field: T.StructField) -> str:
    if isinstance(field.dataType, NUMERIC_TYPES):
        return "numeric"
    if isinstance(field.dataType, T.BooleanType):
        return "boolean"
    if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    return "string"


def plain_columns(df: DataFrame) -> list[str]:
    nested = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, nested)]


def _text(field: T.StructField) -> Column:
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        c = F.when(~F.isnan(c), c)
    return c.cast("string")


def level_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, value, n, length, tokens, spaced): one shuffle for every column.

    Values longer than 64 characters travel as a digest, with their measures beside it, so
    texts are never shuffled whole.
    """
    columns = columns or plain_columns(df)
    wide = df.select(*[_text(df.schema[c]).alias(c) for c in columns])
    long = wide.unpivot([], columns, "column", "value")
    is_long = F.length("value") > SHORT
    key = F.when(is_long, F.concat(F.lit("sha256:"), F.sha2("value", 256))).otherwise(F.col("value"))
    tokens = lambda v: F.when(F.trim(v) == "", F.lit(0)).otherwise(F.size(F.split(F.trim(v), r"\s+")))
    grouped = (long.select("column", key.alias("key"),
                           F.when(is_long, F.length("value")).alias("length"),
                           F.when(is_long, tokens(F.col("value"))).alias("tokens"),
                           F.when(is_long, F.col("value").rlike(r"\s")).alias("spaced"))
               .groupBy("column", "key")
               .agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("length"),
                    F.max("tokens").alias("tokens"), F.max("spaced").alias("spaced")))
    return grouped.select("column", F.col("key").alias("value"), "n",
                          F.coalesce("length", F.length("key")).alias("length"),
                          F.coalesce("tokens", tokens(F.col("key"))).alias("tokens"),
                          F.coalesce("spaced", F.col("key").rlike(r"\s")).alias("spaced"))


def census(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per column: rows, missing, distinct, dominant share, entropy, text measures."""
    columns = columns or plain_columns(df)
    counts = level_counts(df, columns)
    n, value = F.col("n"), F.col("value")
    known = F.when(value.isNotNull(), n)
    share = lambda test: F.sum(F.when(test, n).otherwise(F.when(value.isNotNull(), F.lit(0))))
    number = F.expr("try_cast(value AS double)")
    kinds = F.create_map(*[F.lit(x) for c in columns for x in (c, kind_of(df.schema[c]))])
    types = F.create_map(*[F.lit(x) for c in columns for x in (c, df.schema[c].dataType.simpleString())])
    agg = counts.groupBy("column").agg(
        F.sum("n").alias("rows"), F.sum(F.when(value.isNull(), n).otherwise(0)).alias("missing"),
        F.count("value").alias("nunique"), F.max(known).alias("dominant"),
        F.sum(known * F.log2(known.cast("double"))).alias("nlogn"), F.sum(known).alias("known"),
        F.sum(known * F.col("length")).alias("len_sum"), F.max("length").alias("max_len"),
        F.sum(known * F.col("tokens")).alias("token_sum"),
        share(F.col("spaced")).alias("spaced_rows"),
        share(F.col("length") <= SHORT).alias("short_rows"),
        share((F.col("length") <= SHORT) & F.expr("try_cast(value AS timestamp) IS NOT NULL")).alias("date_rows"),
        share((F.col("length") <= SHORT) & number.isNotNull() & ~F.isnan(number)).alias("number_rows"),
        share(number == F.round(number)).alias("whole_rows"),
        F.bool_and(F.when(value.isNotNull(), F.lower("value").isin("0", "1", "true", "false"))).alias("flags"))
    div = lambda c: F.col(c) / F.greatest(F.col("known"), F.lit(1))
    return agg.select(
        "column", types[F.col("column")].alias("dtype"), kinds[F.col("column")].alias("kind"),
        "rows", "missing", F.coalesce(F.col("known"), F.lit(0)).alias("known"), "nunique",
        (100.0 * F.col("missing") / F.col("rows")).alias("missing_pct"),
        div("dominant").alias("dominant_share"), div("nunique").alias("cardinality_ratio"),
        (F.log2(F.col("known").cast("double")) - div("nlogn")).alias("entropy_bits"),
        div("len_sum").alias("avg_len"), "max_len", div("token_sum").alias("avg_tokens"),
        div("spaced_rows").alias("spaced_share"), div("date_rows").alias("date_share"),
        div("number_rows").alias("number_share"),
        (F.col("whole_rows") == F.col("known")).alias("whole"), F.col("flags"))


def semantic_types(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The census with a semantic type, name hint, role and light type per column."""
    return classify(census(df, columns))


def classify(counted: DataFrame) -> DataFrame:
    nun, ratio, kind = F.col("nunique"), F.col("cardinality_ratio"), F.col("kind")
    numeric = (F.when(F.col("whole") & (ratio > 0.98) & (F.col("rows") > 20), "id")
               .when(F.col("whole") & (nun <= 20), "ordinal").otherwise("numeric"))
    text = (F.when((F.col("date_share") > 0.9) & (nun > 2), "datetime")
            .when((ratio > 0.98) & (F.col("rows") > 20) & (F.col("avg_len") < 40), "id")
            .when((F.col("avg_len") > 30) | ((ratio > 0.5) & (F.col("spaced_share") > 0.5)), "text")
            .otherwise("nominal"))
    semantic = (F.when(nun <= 1, "constant")
                .when((kind == "boolean") | ((nun == 2) & F.col("flags")), "boolean")
                .when(kind == "datetime", "datetime").when(kind == "numeric", numeric).otherwise(text))
    name = F.lower("column")
    hint = F.when(name.rlike(ID_NAME), "identifier-like").when(name.rlike(POSTAL_NAME), "postal-like")
    role = F.when(nun == F.col("rows"), "identity").when(nun <= 1, "constant").otherwise("dimension")
    light = (F.when(kind != "string", kind)
             .when(nun <= F.greatest(F.lit(20.0), 0.02 * F.col("rows")), "nominal").otherwise("text"))
    return counted.select("*", semantic.alias("semantic_type"), hint.alias("name_hint"),
                          role.alias("role"), light.alias("light_type"))


def typing_of(df: DataFrame, columns: list[str] | None = None) -> dict[str, dict]:
    """The typing table on the driver: one entry per column."""
    return {r["column"]: r.asDict() for r in semantic_types(df, columns).collect()}


def top_values(df: DataFrame, columns: list[str], k: int = 8) -> DataFrame:
    """The k most frequent values per column, ties by value: each partition keeps its own k first."""
    counts = level_counts(df, columns).filter(F.col("value").isNotNull())
    order = [F.col("n").desc(), F.col("value")]
    spread = Window.partitionBy("column", F.pmod(F.hash("value"), F.lit(64))).orderBy(*order)
    local = counts.withColumn("_r", F.row_number().over(spread)).filter(F.col("_r") <= k)
    return (local.withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy(*order)))
            .filter(F.col("rank") <= k).select("column", "rank", "value", "n"))


def numeric_projection(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Numeric, ordinal and boolean columns as doubles; booleans become 0/1."""
    def one(c: str) -> Column:
        if types[c] == "boolean":
            s = F.lower(F.col(c).cast("string"))
            return F.when(s.isin("true", "1"), 1.0).when(s.isin("false", "0"), 0.0).alias(c)
        return F.expr(f"try_cast(`{c}` AS double)").alias(c)
    return df.select(*[one(c) for c, t in types.items() if t in ("numeric", "ordinal", "boolean")])


def constant_columns(df: DataFrame, tolerance: float = 0.0, columns: list[str] | None = None) -> DataFrame:
    """Columns whose most frequent value holds at least 1 - tolerance of the known rows."""
    return (census(df, columns).filter((F.col("nunique") <= 1) | (F.col("dominant_share") >= 1 - tolerance))
            .select("column", "nunique", "dominant_share"))


def xsd_kinds(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The literal kind each column takes when rows become triples."""
    columns = columns or plain_columns(df)
    shares = df.agg(*[F.avg(F.when(F.col(c).isNotNull(), F.col(c).cast("string").rlike(p).cast("int"))).alias(f"{k}{i}")
                      for i, c in enumerate(columns)
                      for k, p in (("d", r"^\d{4}-\d{2}-\d{2}$"), ("t", r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"))])
    facts = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(df.schema[c].dataType.simpleString()).alias("dtype"),
                               F.coalesce(F.col(f"d{i}"), F.lit(0.0)).alias("date_share"),
                               F.coalesce(F.col(f"t{i}"), F.lit(0.0)).alias("stamp_share"))
                      for i, c in enumerate(columns)])
    kind = (F.when(F.col("dtype").isin("tinyint", "smallint", "int", "bigint"), "integer")
            .when(F.col("dtype").isin("float", "double") | F.col("dtype").startswith("decimal"), "decimal")
            .when(F.col("dtype") == "boolean", "boolean").when(F.col("dtype") == "date", "date")
            .when(F.col("dtype").startswith("timestamp"), "dateTime")
            .when(F.col("date_share") > 0.9, "date").when(F.col("stamp_share") > 0.9, "dateTime")
            .otherwise("string"))
    return shares.select(F.inline(facts)).select("column", kind.alias("xsd_kind"))


def instant_gaps(df: DataFrame, column: str) -> DataFrame:
    """(seconds, n): how often each distance between consecutive distinct instants occurs."""
    micros = F.unix_micros(F.col(column).cast("timestamp")).cast("double").alias("at")
    points = df.select(micros).filter(F.col("at").isNotNull())
    cuts = cut_points(points, ["at"])["at"]
    distinct = points.distinct().withColumn("bucket", bucket_of(F.col("at"), cuts, slices_for(df)))
    stepped = previous_value(distinct, [], "at").filter(F.col("prev_at").isNotNull())
    return (stepped.groupBy(((F.col("at") - F.col("prev_at")) / 1e6).alias("seconds"))
            .agg(F.count(F.lit(1)).alias("n")))


def time_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Columns that hold instants: parsed rows, span, modal interval and regularity; best first."""
    columns = columns or [f.name for f in df.schema.fields if kind_of(f) in ("datetime", "string")]
    iso, slash = r"^\d{4}-\d{2}-\d{2}", r"^\d{2}/\d{2}/\d{4}"
    exprs = {}
    for c in columns:
        if kind_of(df.schema[c]) == "datetime":
            exprs[c] = (F.lit(1.0), F.col(c).cast("timestamp"))
        else:
            s = F.col(c)
            exprs[c] = (F.greatest(F.avg(s.rlike(iso).cast("int")), F.avg(s.rlike(slash).cast("int"))),
                        F.coalesce(F.expr(f"try_cast(`{c}` AS timestamp)"),
                                   F.try_to_timestamp(s, F.lit("dd/MM/yyyy"))))
    row = df.agg(F.count(F.lit(1)).alias("n"),
                 *[e.alias(f"{k}{i}") for i, c in enumerate(columns) for k, e in (
                     ("m", F.max(exprs[c][0]) if kind_of(df.schema[c]) == "datetime" else exprs[c][0]),
                     ("p", F.count(exprs[c][1])))]).first()
    out = None
    for i, c in enumerate(columns):
        if not row[f"m{i}"] or row[f"m{i}"] <= 0.9 or row[f"p{i}"] < max(10, 0.5 * row["n"]):
            continue
        parsed = df.select(exprs[c][1].alias("t"))
        gaps = instant_gaps(parsed, "t")
        modal = gaps.agg(F.max_by(F.struct("seconds", "n"), F.struct("n", -F.col("seconds"))).alias("mode"),
                         F.sum("n").alias("steps"))
        span = parsed.agg(F.count("t").alias("parsed"), F.min("t").alias("first"), F.max("t").alias("last"))
        one = span.join(F.broadcast(modal), F.lit(True), "left").select(
            F.lit(c).alias("column"), "parsed", "first", "last", F.col("mode.seconds").alias("modal_seconds"),
            F.coalesce(F.col("mode.n") / F.col("steps") > 0.9, F.lit(False)).alias("regular"))
        out = one if out is None else out.union(one)
    if out is None:
        schema = "column string, parsed long, first timestamp, last timestamp, modal_seconds double, regular boolean"
        return df.sparkSession.createDataFrame([], schema)
    return out.orderBy(F.col("parsed").desc(), "column")


def coordinate_columns(df: DataFrame) -> DataFrame:
    """Latitude and longitude columns by name and range, or text that looks like WKT."""
    facts, found = [], []
    for f in df.schema.fields:
        n, kind = f.name.lower(), kind_of(f)
        if kind == "numeric" and (n in LAT_NAMES or "latitude" in n or n.endswith("_lat")):
            found.append((f.name, "lat", F.avg(F.coalesce(F.col(f.name).between(-90, 90), F.lit(False)).cast("int")), 0.95))
        elif kind == "numeric" and (n in LON_NAMES or "longitude" in n or n.endswith("_lon")):
            found.append((f.name, "lon", F.avg(F.coalesce(F.col(f.name).between(-180, 180), F.lit(False)).cast("int")), 0.95))
        elif kind == "string":
            found.append((f.name, "wkt", F.avg(F.col(f.name).rlike(r"^\s*(POINT|POLYGON|LINESTRING|MULTI)").cast("int")), 0.9))
    shares = df.agg(*[e.alias(f"s{i}") for i, (_, _, e, _) in enumerate(found)])
    for i, (c, k, _, least) in enumerate(found):
        facts.append(F.struct(F.lit(c).alias("column"), F.lit(k).alias("kind"), F.col(f"s{i}").alias("share"),
                              F.lit(least).alias("least")))
    return (shares.select(F.inline(F.array(*facts))).filter(F.col("share") > F.col("least"))
            .select("column", "kind", "share"))
