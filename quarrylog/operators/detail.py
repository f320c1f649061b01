"""Detail rows: the columns of the written tables, derived from deduplicated records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import base_name, categorise, clean_of, count_of, log_category, log_folder, report_file_name, shorten_paths
from ..schemas import DATABASE_KEY, DETAIL_COLUMNS, KEYWORD_COLUMNS
from .dedup import first_wins

Transform = Callable[[DataFrame], DataFrame]


def detail_columns(records: DataFrame, category: bool = True, transform: Transform | None = None) -> DataFrame:
    """Detail columns and ``seq``, one row a record. ``transform`` may rewrite folder, type and description before the category is found."""
    path = F.col("logfile")
    rows = records.select(
        log_category(path).alias("Log-Kategorie"),
        log_folder(path).alias("Ordner"),
        report_file_name(path).alias("Logfile-Gruppe"),
        base_name(path).alias("Dateiname-Original"),
        count_of(F.col("description")).alias("Anzahl"),
        F.col("date").alias("Datum"),
        F.col("time").alias("Zeit"),
        F.col("severity").alias("Severity"),
        F.col("type").alias("Type/Source"),
        shorten_paths(clean_of(F.col("description"))).alias("Description"),
        "seq",
    )
    if transform:
        rows = transform(rows)
    rows = rows.withColumn("Fehler-Kategorie", categorise(F.col("Description"), F.col("`Type/Source`")))
    return rows.select(*[f"`{c}`" for c in DETAIL_COLUMNS if category or c != "Fehler-Kategorie"], "seq")


def detail_rows(records: DataFrame, category: bool = True, transform: Transform | None = None) -> DataFrame:
    """Detail rows without those that repeat severity, type and description, whatever their file."""
    rows = detail_columns(records, category, transform).withColumnRenamed("Type/Source", "_type")
    rows = first_wins(rows, ["Severity", "_type", "Description"]).drop("n_rows").withColumnRenamed("_type", "Type/Source")
    return rows


def keyword_detail_rows(found: DataFrame, category: bool = True) -> DataFrame:
    path = F.col("logfile")
    rows = found.select(
        log_category(path).alias("Log-Kategorie"),
        log_folder(path).alias("Ordner"),
        base_name(path).alias("Dateiname"),
        categorise(F.col("text")).alias("Fehler-Kategorie"),
        F.col("severity").alias("Severity"),
        F.col("text").alias("Eintragstext"),
        "seq",
    )
    return rows.select(*[f"`{c}`" for c in KEYWORD_COLUMNS if category or c != "Fehler-Kategorie"], "seq")


def as_structured(found: DataFrame) -> DataFrame:
    """Keyword records as structured ones, so that summaries and statistics take both."""
    empty = F.lit("")
    return found.select("logfile", empty.alias("date"), empty.alias("time"), "severity", empty.alias("type"), F.col("text").alias("description"), "seq")


def database_rows(existing: DataFrame, records: DataFrame, transform: Transform | None = None) -> DataFrame:
    """Existing rows unchanged, then those of new keys, with ``_ord`` (0 existing, 1 new) and their order: ``_row`` of existing, ``seq`` of new.

    Both sides must have the same columns; a missing category column is filled with ''.
    """
    missing = [k for k in DATABASE_KEY if k not in existing.columns]
    if missing:
        raise ValueError(f"database lacks {', '.join(missing)}")
    fresh = detail_rows(records, True, transform)
    key = ["Severity", "_type", "Description"]
    old = existing.withColumnRenamed("Type/Source", "_type")
    known = old.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]).distinct()
    on = F.col("Severity").eqNullSafe(F.col("_k0")) & F.col("_type").eqNullSafe(F.col("_k1")) & F.col("Description").eqNullSafe(F.col("_k2"))
    fresh = fresh.withColumnRenamed("Type/Source", "_type").join(known, on, "left_anti").withColumnRenamed("_type", "Type/Source")
    order = fresh.schema["seq"].dataType

    def filled(df: DataFrame, old: bool) -> DataFrame:
        columns = [F.col(f"`{c}`").cast("string").alias(c) if c in df.columns else F.lit("").alias(c) for c in DETAIL_COLUMNS]
        place = F.monotonically_increasing_id() if old else F.lit(None).cast("long")
        return df.select(*columns, F.lit(0 if old else 1).alias("_ord"), place.alias("_row"), F.lit(None).cast(order).alias("seq") if old else F.col("seq"))

    return filled(existing, True).unionByName(filled(fresh, False))


def append_counts(combined: DataFrame) -> DataFrame:
    """One row: new and total rows of ``database_rows``."""
    return combined.agg(F.coalesce(F.sum("_ord"), F.lit(0)).cast("long").alias("new_rows"), F.count(F.lit(1)).alias("total_rows"))


def validate_database(database: DataFrame) -> DataFrame:
    """One row: rows and distinct keys; raises if a key column is missing."""
    missing = [k for k in DATABASE_KEY if k not in database.columns]
    if missing:
        raise ValueError(f"database lacks {', '.join(missing)}")
    keys = database.groupBy(*[f"`{k}`" for k in DATABASE_KEY]).agg(F.count(F.lit(1)).alias("n"))
    return keys.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"))
