"""Read tables by extension and write one dataset per part."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read_table(spark: SparkSession, path: str, fmt: str | None = None, sep: str | None = None,
               schema: StructType | None = None) -> DataFrame:
    """csv, txt, tsv, json (one array per file), jsonl or parquet.

    Give ``schema`` for repeated reads of delimited text: it saves the inference pass.
    """
    fmt = fmt or path.rstrip("/").rsplit(".", 1)[-1].lower()
    if fmt in ("csv", "txt", "tsv"):
        reader = spark.read.option("header", True).option("sep", sep or ("\t" if fmt == "tsv" else ","))
        return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    if fmt == "parquet":
        return spark.read.parquet(path)
    if fmt in ("json", "jsonl"):
        reader = spark.read.option("multiLine", fmt == "json")
        return (reader.schema(schema) if schema else reader).json(path)
    raise ValueError(f"unsupported format {fmt!r}")


def write_table(df: DataFrame, path: str, fmt: str, mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode)
    if fmt in ("csv", "txt", "tsv"):
        writer.option("header", True).option("sep", "\t" if fmt == "tsv" else ",").csv(path)
    elif fmt in ("json", "jsonl"):
        writer.json(path)
    else:
        writer.parquet(path)


def write_parts(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One directory per part under ``path`` in a single job."""
    df.write.partitionBy("_part").format(fmt).option("header", True).save(path)


def scratch(spark: SparkSession) -> str:
    """A new folder under the session's checkpoint folder; a local one only where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    import uuid
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def round_trip(df: DataFrame, fmt: str) -> DataFrame:
    """Write the table in a format and read it back (one JSON object per line reads either way)."""
    path = scratch(df.sparkSession)
    write_table(df, path, fmt)
    return read_table(df.sparkSession, path, "jsonl" if fmt == "json" else fmt, schema=df.schema if fmt in ("csv", "jsonl") else None)


def written_parts(df: DataFrame, fmt: str = "parquet") -> DataFrame:
    path = scratch(df.sparkSession)
    write_parts(df, path, fmt)
    return df.sparkSession.read.parquet(path)
