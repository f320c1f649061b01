"""One query for each operator, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as t
from .functions.rules import FINGERPRINT, GENERALISE, Rule, apply_rules, fingerprint, generalise
from .functions.sql import register
from .operators import dedup, detail, parse, report
from .plans.synthetic import event_lines, event_messages, keyword_lines
from .schemas import KEPT_CODES

Query = Callable[[SparkSession, str], DataFrame]


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_messages(spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id IS NOT NULL"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.parse_records(event_lines(spark, sf_dir), ("source_name", "block"))


def _deduped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.dedup_structured(_records(spark, sf_dir))


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.with_report_columns(_deduped(spark, sf_dir))


def _headers(layout: int) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return parse.parse_headers(event_lines(spark, sf_dir)).where(F.col("layout") == layout).drop("layout")

    return query


def _rules(rules: list[Rule]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _messages(spark, sf_dir).select("event_id", *(apply_rules(F.col("message"), [r]).alias(f"r{k}") for k, r in enumerate(rules, 1)))

    return query


def severity_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.parse_headers(event_lines(spark, sf_dir)).where(F.col("code").isin(KEPT_CODES)).groupBy("code", "severity").agg(F.count(F.lit(1)).alias("n"))


def generalize_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", generalise(F.col("url")).alias("masked"))


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("source_name")
    paths = _messages(spark, sf_dir).groupBy("source_name").agg(F.count(F.lit(1)).alias("n"))
    return paths.select(p, t.base_name(p).alias("base"), t.parser_file_name(p).alias("parser_file"), t.report_file_name(p).alias("report_file"), t.log_category(p).alias("category"), t.log_folder(p).alias("folder"), "n")


def categorize(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("message")
    return _messages(spark, sf_dir).select("event_id", t.categorise(m, F.col("type")).alias("category"), t.categorise(generalise(m)).alias("masked_category"))


def _halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of the log's first half, and all records as the new side."""
    rows = _deduped(spark, sf_dir).drop("n_rows")
    half = rows.agg((F.max("seq") / 2).alias("_half"))
    old = detail.detail_rows(rows.join(F.broadcast(half), F.col("seq") <= F.col("_half")).drop("_half")).drop("seq")
    return detail.database_rows(old, rows)


def database_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _halves(spark, sf_dir).withColumnRenamed("_ord", "ord").drop("seq", "_row")


def text_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.md5(generalise(F.col("text")).cast("binary")).alias("masked"))
    return masked.groupBy("masked").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n_rows"))


def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered SQL functions, called from SQL."""
    register(spark)
    return spark.sql(
        "SELECT event_id, generalise_paths(message) AS masked, error_fingerprint(message) AS print, error_category(message, type) AS category, error_short_type(message) AS short_type, occurrence_count(message) AS cnt FROM {m}",
        m=_messages(spark, sf_dir),
    )


def frequency_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.reduction(detail.detail_rows(_deduped(spark, sf_dir).drop("n_rows"))).withColumn("saved_share", F.round("saved_share", 6))


QUERIES: dict[str, Query] = {
    "parse_headers_fmt1": _headers(1),
    "parse_headers_fmt2": _headers(2),
    "parse_headers_fmt3": _headers(3),
    "severity_names": severity_names,
    "assemble_multiline": _records,
    "keyword_severity": lambda s, d: parse.parse_keywords(keyword_lines(s, d)).select("seq", "severity", "text"),
    "keyword_dedup": lambda s, d: dedup.dedup_keywords(parse.parse_keywords(keyword_lines(s, d))),
    "generalize_paths": lambda s, d: _messages(s, d).select("event_id", generalise(F.col("message")).alias("masked")),
    "generalize_urls": generalize_urls,
    "generalize_rules": _rules(GENERALISE),
    "fingerprint": lambda s, d: _messages(s, d).select("event_id", fingerprint(F.col("message")).alias("print")),
    "fingerprint_rules": _rules(FINGERPRINT),
    "dedup_structured": _deduped,
    "skipped_counts": lambda s, d: dedup.skipped(_deduped(s, d)),
    "file_names": file_names,
    "detail_rows": lambda s, d: detail.detail_rows(_deduped(s, d).drop("n_rows")),
    "keyword_detail_rows": lambda s, d: detail.keyword_detail_rows(dedup.dedup_keywords(parse.parse_keywords(keyword_lines(s, d)))),
    "shorten_paths": lambda s, d: _messages(s, d).select("event_id", t.shorten_paths(F.col("message")).alias("short")),
    "categorize": categorize,
    "short_type": lambda s, d: _messages(s, d).select("event_id", t.short_type(F.col("message")).alias("short_type")),
    "count_prefix": lambda s, d: _messages(s, d).select("event_id", t.count_of(F.col("message")).alias("cnt"), t.clean_of(F.col("message")).alias("clean")),
    "summary_grouped": lambda s, d: report.summary(_report(s, d)),
    "summary_top3": lambda s, d: report.summary(_report(s, d)).select("category", "short_type", "n_files", "top_files"),
    "stats_grouping_sets": lambda s, d: report.statistics(_report(s, d)),
    "stats_totals": lambda s, d: report.totals(_report(s, d)),
    "top_logfile_groups": lambda s, d: report.top(report.statistics(_report(s, d)), "file_group"),
    "top_short_types": lambda s, d: report.top(report.statistics(_report(s, d)), "short_type"),
    "percent_share": lambda s, d: report.shares(report.statistics(_report(s, d))).select("kind", "value", "n", F.round("share", 6).alias("share")),
    "frequency_report": frequency_report,
    "top_sources": lambda s, d: report.top_sources(detail.detail_rows(_deduped(s, d).drop("n_rows"))),
    "database_append": database_append,
    "append_counts": lambda s, d: detail.append_counts(_halves(s, d)),
    "database_validate": lambda s, d: detail.validate_database(detail.detail_columns(_deduped(s, d).drop("n_rows"))),
    "text_exact_dedup": text_exact_dedup,
    "sql_functions": sql_functions,
}
