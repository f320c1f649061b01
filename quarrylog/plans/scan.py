"""The three entry points: structured scan, keyword scan, cumulative database."""

from __future__ import annotations

import logging
import threading
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import anonymise, dedup, detail, parse, report
from ..schemas import DETAIL_COLUMNS
from ..sources import archive, tables

log = logging.getLogger("quarrylog")


class Cancelled(Exception):
    """The run was asked to stop; nothing was written after that."""


@dataclass
class Options:
    """What to read and to write.

    ``progress`` gets messages while the run goes on; ``cancelled`` is asked now and then, and
    once it returns true the running job is stopped and ``Cancelled`` raised. ``transform`` may
    rewrite detail rows; ``anonymise`` sets the library's own. ``distributed`` writes detail rows
    as a folder of part files, so that no row passes the driver.
    """

    inputs: list[str]
    stem: str | None = None
    keyword: bool = False
    database: str | None = None
    detail: bool = True
    summary: bool = True
    statistics: bool = True
    category: bool = True
    per_input: bool = False
    transform: detail.Transform | None = None
    anonymise: bool = False
    distributed: bool = False
    progress: Callable[[str], None] | None = None
    cancelled: Callable[[], bool] | None = None


@dataclass
class Result:
    records: DataFrame
    errors: DataFrame
    counts: dict[str, int]
    files: dict[str, str] = field(default_factory=dict)


SCOPE = ("input_ord", "class_ord", "source_name", "member_ord", "block")


def structured_records(spark: SparkSession, inputs: list[str]) -> tuple[DataFrame, DataFrame]:
    """Deduplicated structured records of all inputs, and what could not be read."""
    rows = archive.read_logs(spark, inputs)
    return dedup.dedup_structured(parse.parse_records(archive.lines_of(rows), SCOPE)), archive.errors_of(rows)


def keyword_records(spark: SparkSession, inputs: list[str], per_input: bool = False) -> tuple[DataFrame, DataFrame]:
    rows = archive.read_logs(spark, inputs, (".txt",))
    found = parse.parse_keywords(archive.lines_of(rows))
    return dedup.dedup_keywords(found, F.col("seq.input_ord") if per_input else None), archive.errors_of(rows)


@contextmanager
def _stoppable(spark: SparkSession, cancelled: Callable[[], bool] | None):
    """Stops this thread's jobs once ``cancelled`` says so."""
    if not cancelled:
        yield
        return
    if cancelled():
        raise Cancelled
    group, over, stopped = f"quarrylog-{uuid.uuid4().hex}", threading.Event(), threading.Event()

    def watch() -> None:
        while not over.wait(0.5):
            if cancelled():
                stopped.set()
                spark.sparkContext.cancelJobGroup(group)

    spark.sparkContext.setJobGroup(group, "quarrylog scan", interruptOnCancel=True)
    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        yield
    except Exception as e:
        if stopped.is_set():
            raise Cancelled from e
        raise
    finally:
        over.set()
        watcher.join()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    if stopped.is_set() or cancelled():
        raise Cancelled


def _outputs(options: Options) -> dict[str, str]:
    stem = options.database.removesuffix(".csv") if options.database else options.stem or tables.default_stem()
    paths = tables.output_paths(stem)
    if options.database:
        paths["database"] = options.database
    if options.distributed:
        paths["detail"] = f"{stem}_detail"
    return paths


def run(spark: SparkSession, options: Options) -> Result:
    """Scans, deduplicates once, and writes the asked-for products.

    Nothing is written unless the scan succeeds, and nothing is scanned unless the outputs' folder
    can be written to. What could not be read is learned from the scan that finds the records (from
    a second one if there are none).
    """
    if not options.inputs:
        raise ValueError("no input given")
    if options.keyword and options.database:
        raise ValueError("the cumulative database takes structured records only")
    say = options.progress or (lambda message: None)
    paths = _outputs(options)
    tables.probe(paths.values())
    rows = archive.read_logs(spark, options.inputs, (".txt",) if options.keyword else (".log", ".txt"))
    seen = Observation()
    begins = F.col("line_no").isNull() & F.col("error").isNull()
    unread = F.when(F.col("error").isNotNull(), F.struct("input_ord", "source_name", "member_ord", "error"))
    archived = F.col("source_name").contains(".zip/")
    notes = [F.collect_list(unread).alias("errors"), F.count(F.when(begins, 1)).alias("files_read"), F.count(F.when(begins & archived, 1)).alias("members_read")]
    lines = archive.lines_of(rows.observe(seen, *notes))
    if options.keyword:
        records = dedup.dedup_keywords(parse.parse_keywords(lines), F.col("seq.input_ord") if options.per_input else None)
    else:
        records = dedup.dedup_structured(parse.parse_records(lines, SCOPE))
    records = records.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for top in options.inputs:
            say(f"reading {top}")
        with _stoppable(spark, options.cancelled):
            counts = dedup.skipped(records).first().asDict()
        # Where no line is a record the plan turns out empty, and what was observed goes with it.
        found = seen.get if counts["candidates"] else rows.agg(*notes).first().asDict()
        errors = sorted({tuple(e) for e in found["errors"]})
        for e in errors:
            say(f"not read: {e[1]}: {e[3]}")
        say(f"{found['files_read']} files read, {found['members_read']} of them in archives")
        say(f"{counts['kept']} records, {counts['skipped']} duplicates skipped")
        log.info("%(kept)s records, %(skipped)s duplicates skipped", counts)
        unreadable = spark.createDataFrame(errors, "input_ord int, source_name string, member_ord int, error string")
        result = Result(records, unreadable, counts)
        _write(spark, options, records, paths, result, say)
    except BaseException:
        records.unpersist()
        raise
    return result


def _write(spark: SparkSession, options: Options, records: DataFrame, paths: dict[str, str], result: Result, say: Callable[[str], None]) -> None:
    counts = result.counts
    transform = options.transform
    if options.anonymise:
        own = options.transform
        transform = lambda rows: anonymise.anonymise(own(rows) if own else rows, ["Ordner", "Type/Source", "Description"])
        columns = detail.detail_columns(detail.as_structured(records) if options.keyword else records, False)
        counts |= anonymise.counts(columns, ["Ordner", "Type/Source", "Description"])

    def written(kind: str) -> None:
        result.files[kind] = paths[kind]
        say(f"written: {paths[kind]}")

    structured = detail.as_structured(records) if options.keyword else records
    if options.database:
        combined = detail.database_rows(tables.read_database(spark, options.database), records, transform).persist(StorageLevel.MEMORY_AND_DISK)
        counts |= detail.append_counts(combined).first().asDict()
        ordered = combined.orderBy("_ord", "_row", "seq").select(*[f"`{c}`" for c in DETAIL_COLUMNS])
        tables.write_table(ordered, options.database)
        written("database")
        combined.unpersist()
    elif options.detail:
        if options.keyword:
            rows = detail.keyword_detail_rows(records, options.category)
            rows = anonymise.anonymise(rows, ["Ordner", "Eintragstext"]) if options.anonymise else rows
        else:
            rows = detail.detail_rows(records, options.category, transform)
        if options.distributed:
            tables.write_distributed(rows.orderBy("seq").drop("seq"), paths["detail"])
            counts["detail_rows"] = tables.read_table(spark, paths["detail"]).count()
        else:
            counts["detail_rows"] = tables.write_table(rows.orderBy("seq").drop("seq"), paths["detail"])
        written("detail")
    if options.summary or options.statistics:
        rows = report.with_report_columns(structured)
        if options.summary:
            tables.write_summary(report.summary(rows), paths["summary"])
            written("summary")
        if options.statistics:
            text = tables.render_statistics(report.totals(rows), report.shares(report.statistics(rows)))
            tables.write_text(text, paths["statistics"])
            written("statistics")
