"""Rows as statements: every row an individual, every column a property."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specula.operators.typing import xsd_kinds


def rows_to_triples(df: DataFrame, table: str, row_id: str, links: dict[str, str] | None = None) -> DataFrame:
    """(s, p, o, kind) over the whole table; nulls say nothing.

    ``links`` maps a column to the table its values point into: these become object facts.
    """
    links = links or {}
    kinds = {r["column"]: r["xsd_kind"] for r in xsd_kinds(df).collect()}
    columns = [c for c in df.columns if c != row_id]
    facts = [F.struct(F.lit("type").alias("p"), F.lit(table).alias("o"), F.lit("class").alias("kind"))]
    for c in columns:
        if c in links:
            facts.append(F.struct(F.lit(c).alias("p"), F.concat(F.lit(f"{links[c]}/"), F.col(c).cast("string")).alias("o"),
                                  F.lit("object").alias("kind")))
        else:
            facts.append(F.struct(F.lit(c).alias("p"), F.col(c).cast("string").alias("o"), F.lit(kinds[c]).alias("kind")))
    subject = F.concat(F.lit(f"{table}/"), F.col(row_id).cast("string"))
    return df.select(subject.alias("s"), F.inline(F.array(*facts))).filter("o IS NOT NULL")


def _iri(name):
    """A name between angle brackets; characters that may not stand there are percent-encoded."""
    for c in '% <>"{}|^`\\\n\r\t':
        name = F.replace(name, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return F.concat(F.lit("<"), name, F.lit(">"))


def statement_lines(triples: DataFrame) -> DataFrame:
    """One N-Triples-like line per statement, for ``write.text``."""
    escaped = F.col("o")
    for plain, code in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = F.replace(escaped, F.lit(plain), F.lit(code))
    quoted = F.concat(F.lit('"'), escaped, F.lit('"'))
    value = (F.when(F.col("kind").isin("class", "object"), _iri(F.col("o")))
             .when(F.col("kind") == "string", quoted)
             .otherwise(F.concat(quoted, F.lit("^^<xsd:"), "kind", F.lit(">"))))
    prop = F.when(F.col("kind") == "class", F.lit("rdf:type")).otherwise(F.col("p"))
    return triples.select(F.concat(_iri(F.col("s")), F.lit(" "), _iri(prop), F.lit(" "), value, F.lit(" .")).alias("line"))
