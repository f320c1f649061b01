"""First-wins duplicates, by aggregates: no state, and hot keys combine before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import fingerprint, generalise
from ..functions.text import parser_file_name


def first_wins(df: DataFrame, keys: list[str], order: str = "seq", counted: str = "n_rows") -> DataFrame:
    """The row with the smallest ``order`` of each key, and how many rows the key has."""
    row = F.min_by(F.struct(*[f"`{c}`" for c in df.columns]), F.col(order)).alias("_row")
    return df.groupBy(*[f"`{k}`" for k in keys]).agg(row, F.count(F.lit(1)).alias(counted)).select("_row.*", counted)


def structured_keys(records: DataFrame) -> DataFrame:
    """Adds the duplicate key of a record: file, code, fingerprints of type and first line.

    Fingerprints cost dozens of substitutions each: records alike in type and first line are
    one row before they are computed (see ``dedup_structured``).
    """
    kind = fingerprint(F.col("type"))
    first = F.when(F.col("description") == "", kind).otherwise(fingerprint(F.col("first_line")))
    return records.withColumn("key_file", parser_file_name(F.col("source_name"))).withColumn("key_type", kind).withColumn("key_text", first)


def dedup_structured(records: DataFrame) -> DataFrame:
    """Records of new keys, masked: logfile, date, time, severity, type, description, seq, n_rows.

    ``n_rows`` counts the records of the key; those beyond the first are skipped duplicates.
    """
    exact = ["key_file", "code", "type", "first_line", "_plain"]
    rows = records.withColumn("key_file", parser_file_name(F.col("source_name"))).withColumn("_plain", F.col("description") == "")
    kept = ["source_name", "date", "time", "severity", "description", "seq"]
    rows = rows.groupBy(*exact).agg(F.min_by(F.struct(*kept), F.col("seq")).alias("_r"), F.count(F.lit(1)).alias("_n")).select(*exact, "_r.*", "_n")
    rows = structured_keys(rows)
    rows = rows.groupBy("key_file", "code", "key_type", "key_text").agg(F.min_by(F.struct(*kept, "type"), F.col("seq")).alias("_r"), F.sum("_n").alias("n_rows")).select("_r.*", "n_rows")
    return rows.select(
        F.col("source_name").alias("logfile"), "date", "time", "severity", generalise(F.col("type")).alias("type"), generalise(F.col("description")).alias("description"), "seq", "n_rows"
    )


def dedup_keywords(found: DataFrame, per: Column | None = None) -> DataFrame:
    """Keyword lines with new masked text: logfile, severity, text, seq, n_rows. ``per`` resets the memory (one per input)."""
    rows = found.withColumn("_scope", per if per is not None else F.lit(0))
    rows = rows.groupBy("_scope", "text").agg(F.min_by(F.struct("source_name", "severity", "seq"), F.col("seq")).alias("_r"), F.count(F.lit(1)).alias("_n"))
    rows = rows.select("_scope", generalise(F.col("text")).alias("text"), "_r.*", "_n")
    rows = rows.groupBy("_scope", "text").agg(F.min_by(F.struct("source_name", "severity", "seq"), F.col("seq")).alias("_r"), F.sum("_n").alias("n_rows"))
    return rows.select(F.col("_r.source_name").alias("logfile"), "_r.severity", "text", "_r.seq", "n_rows")


def skipped(deduped: DataFrame) -> DataFrame:
    """One row: candidates, kept, skipped."""
    total = F.coalesce(F.sum("n_rows"), F.lit(0)).cast("long")
    return deduped.agg(total.alias("candidates"), F.count(F.lit(1)).alias("kept"), (total - F.count(F.lit(1))).alias("skipped"))


def append_new(existing: DataFrame, new: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """Rows of ``new`` whose key is not in ``existing``, the first of each. Spark broadcasts the keys while they are small."""
    fresh = first_wins(new, keys, order).drop("n_rows")
    known = existing.select(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)]).distinct()
    on = None
    for i, k in enumerate(keys):
        same = F.col(f"`{k}`").eqNullSafe(F.col(f"_k{i}"))
        on = same if on is None else on & same
    return fresh.join(known, on, "left_anti")
