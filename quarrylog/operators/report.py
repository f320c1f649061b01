"""Grouped summary, statistics and frequency reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import categorise, clean_of, count_of, percent, report_file_name, short_type


def with_report_columns(records: DataFrame) -> DataFrame:
    """Adds what reports group by: count, clean description, file group, categories and short types of raw and clean texts."""
    d, t = F.col("description"), F.col("type")
    rows = records.withColumn("cnt", count_of(d)).withColumn("clean", clean_of(d)).withColumn("file_group", report_file_name(F.col("logfile")))
    rows = rows.withColumn("category", categorise(d, t)).withColumn("short_type", short_type(d))
    return rows.withColumn("clean_category", categorise(F.col("clean"), t)).withColumn("clean_short_type", short_type(F.col("clean")))


def summary(rows: DataFrame) -> DataFrame:
    """A row for each category and short type: category, short_type, n_unique, n_total, severity, first_seen, last_seen, n_files, top_files, example, first_seq.

    Counts by file come first, so that a group of any size is only its files when it meets.
    """
    group = ["category", "short_type"]
    occurrence = F.concat_ws(" ", "date", "time")
    by_file = rows.groupBy(*group, "file_group").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("cnt").alias("total"),
        F.min("seq").alias("first_seq"),
        F.max(F.struct("seq", F.col("severity"), occurrence.alias("o"))).alias("last"),
        F.min(F.struct("seq", occurrence.alias("o"))).alias("first"),
        F.min(F.when(F.col("clean") != "", F.struct("seq", "clean"))).alias("example"),
    )
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("total"), "first_seq"))
    label = F.concat("file_group", F.lit(" ("), F.col("total").cast("string"), F.lit(")"))
    by_file = by_file.withColumn("rank", rank).withColumn("label", F.when(F.col("rank") <= 3, F.struct("rank", label.alias("l"))))
    out = by_file.groupBy(*group).agg(
        F.sum("n").alias("n_unique"),
        F.sum("total").alias("n_total"),
        F.max("last").alias("last"),
        F.min("first").alias("first"),
        F.count(F.lit(1)).alias("n_files"),
        F.array_sort(F.collect_list("label")).alias("labels"),
        F.min("example").alias("example"),
    )
    return out.select(
        *group, "n_unique", "n_total", F.col("last.severity").alias("severity"), F.col("first.o").alias("first_seen"), F.col("last.o").alias("last_seen"), "n_files",
        F.substring(F.array_join(F.transform("labels", lambda x: x["l"]), ", "), 1, 150).alias("top_files"),
        F.substring(F.coalesce("example.clean", F.lit("")), 1, 200).alias("example"),
        F.col("first.seq").alias("first_seq"),
    )


def by_total(summary_rows: DataFrame) -> DataFrame:
    return summary_rows.orderBy(F.desc("n_total"), "first_seq")


def statistics(rows: DataFrame) -> DataFrame:
    """Weighted counts by category, severity, file group and short type in one pass: kind, value, n, first_seq.

    Categories and short types are those of the clean description.
    """
    named = rows.select(F.col("clean_category").alias("category"), F.upper("severity").alias("severity"), "file_group", F.col("clean_short_type").alias("short_type"), "cnt", "seq")
    kinds = ["category", "severity", "file_group", "short_type"]
    out = named.groupingSets([[F.col(k)] for k in kinds], *kinds).agg(F.sum("cnt").alias("n"), F.min("seq").alias("first_seq"), F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 7, "category").when(F.col("g") == 11, "severity").when(F.col("g") == 13, "file_group").otherwise("short_type")
    return out.select(kind.alias("kind"), F.coalesce(*kinds).alias("value"), "n", "first_seq")


def totals(rows: DataFrame) -> DataFrame:
    """One row: records, occurrences and file groups."""
    return rows.agg(F.count(F.lit(1)).alias("n_records"), F.coalesce(F.sum("cnt"), F.lit(0)).cast("long").alias("n_occurrences"), F.countDistinct("file_group").alias("n_files"))


def shares(stats: DataFrame) -> DataFrame:
    """Statistics with their share of all occurrences in percent; kinds have the same total."""
    total = stats.where("kind = 'category'").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    return stats.crossJoin(F.broadcast(total)).withColumn("share", percent(F.col("n"), F.col("total"))).drop("total")


def top(stats: DataFrame, kind: str, n: int = 10) -> DataFrame:
    """The ``n`` largest of a kind, ties in order of appearance."""
    return stats.where(F.col("kind") == kind).orderBy(F.desc("n"), "first_seq").limit(n).select("value", "n")


def frequency(detail: DataFrame) -> DataFrame:
    """Detail rows by type: source, n, first_seq."""
    return detail.groupBy(F.col("`Type/Source`").alias("source")).agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))


def top_sources(detail: DataFrame, n: int = 10) -> DataFrame:
    """The most frequent types, cut to 70 characters for display."""
    shown = F.when(F.length("source") > 70, F.concat(F.substring("source", 1, 70), F.lit("..."))).otherwise(F.col("source"))
    return frequency(detail).orderBy(F.desc("n"), "first_seq").limit(n).select(shown.alias("source"), "n")


def reduction(detail: DataFrame) -> DataFrame:
    """One row: rows, distinct types, how many rows grouping by type would save, and in percent (0 without rows)."""
    out = frequency(detail).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_rows"), F.count(F.lit(1)).alias("n_sources"))
    saved = F.col("n_rows") - F.col("n_sources")
    return out.withColumn("n_saved", saved).withColumn("saved_share", percent(saved, F.col("n_rows")))
