"""CSV tables: the cumulative database and written detail tables, and the single-file products."""

from __future__ import annotations

import csv
import json
import os
import tempfile
from collections.abc import Iterable
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import DETAIL_COLUMNS, SUMMARY_COLUMNS


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A headed CSV of strings, byte order mark or not, with quoted line ends; empty fields are ''. Fails if it can't be read."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', quote='"', encoding="UTF-8", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return df.na.fill("")


def read_database(spark: SparkSession, path: str) -> DataFrame:
    """The database's rows; an absent file is an empty database."""
    if not os.path.exists(path):
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in DETAIL_COLUMNS))
    return read_table(spark, path)


def write_table(rows: DataFrame, path: str, columns: list[str] | None = None) -> int:
    """One CSV file in the rows' order: UTF-8 with byte order mark, CRLF, minimal quotes. Rows stream through the driver one partition at a time; the file replaces the old one when whole."""
    columns = columns or rows.columns
    values = (list(r) for r in rows.select(*[f"`{c}`" for c in columns]).toLocalIterator(prefetchPartitions=True))
    return _write(path, columns, values)


def _write(path: str, columns: list[str], values: Iterable[list]) -> int:
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=target.parent, suffix=".part")
    n = 0
    try:
        with os.fdopen(handle, "w", encoding="utf-8-sig", newline="") as f:
            writer = csv.writer(f)
            writer.writerow(columns)
            for v in values:
                writer.writerow(["" if x is None else x for x in v])
                n += 1
        os.replace(temporary, target)
    except BaseException:
        os.unlink(temporary)
        raise
    return n


def probe(paths: Iterable[str]) -> None:
    """Raises unless files can be made where each path will be, before any work is done for them."""
    for folder in {Path(p).parent for p in paths}:
        folder.mkdir(parents=True, exist_ok=True)
        handle, name = tempfile.mkstemp(dir=folder, suffix=".part")
        os.close(handle)
        os.unlink(name)


def write_distributed(rows: DataFrame, path: str) -> None:
    """Many part files with the same quoting, for tables too large for one file."""
    rows.write.mode("overwrite").csv(path, header=True, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def create_database(path: str) -> None:
    _write(path, DETAIL_COLUMNS, [])


def write_summary(summary: DataFrame, path: str) -> int:
    names = ["category", "short_type", "n_unique", "n_total", "severity", "first_seen", "last_seen", "n_files", "top_files", "example"]
    ordered = summary.orderBy(F.desc("n_total"), "first_seq").select(*[F.col(a).alias(b) for a, b in zip(names, SUMMARY_COLUMNS[:4] + ["_severity"] + SUMMARY_COLUMNS[5:], strict=True)])
    return write_table(ordered.withColumnRenamed("_severity", "Severity"), path, SUMMARY_COLUMNS)


def output_paths(stem: str) -> dict[str, str]:
    return {"detail": f"{stem}_detail.csv", "summary": f"{stem}_summary.csv", "statistics": f"{stem}_statistics.txt"}


def default_stem(now: datetime | None = None) -> str:
    return f"logparser_results_{(now or datetime.now()).strftime('%Y%m%d_%H%M%S')}"


def render_statistics(totals: DataFrame, shares: DataFrame, now: datetime | None = None) -> str:
    """The statistics text. The driver gets one row of totals, the few categories and severities, and two lists of ten."""
    t = totals.first()
    of = lambda kind: shares.where(F.col("kind") == kind).orderBy(F.desc("n"), "first_seq")
    # The report's lines and widths.
    wide, thin = "=" * 80, "-" * 80
    out = [wide, "LOG ANALYSE STATISTIK", wide, f"Generiert: {(now or datetime.now()).strftime('%Y-%m-%d %H:%M:%S')}", "", f"Unique Fehlereinträge: {t.n_records:,}", f"Gesamt-Vorkommen (inkl. Counts): {t.n_occurrences:,}", f"Unique Logfile-Gruppen: {t.n_files}"]
    for title, kind, width, limit in (("FEHLER NACH KATEGORIE", "category", 20, None), ("FEHLER NACH SEVERITY", "severity", 20, None), ("TOP 10 BETROFFENE LOGFILE-GRUPPEN", "file_group", 40, 10), ("TOP 10 HÄUFIGSTE FEHLERTYPEN", "short_type", 0, 10)):
        rows = of(kind)
        rows = (rows.limit(limit) if limit else rows).collect()
        out += ["", thin, title, thin]
        out += [f"{r.value:{width}s}: {r.n:6,} ({r.share:5.1f}%)" if width else f"{r.n:6,} ({r.share:5.1f}%) - {r.value}" for r in rows]
    return "\n".join([*out, "", wide]) + "\n"


def write_text(text: str, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(text, encoding="utf-8")


def load_settings(path: str) -> dict:
    """Known settings of a JSON file; paths that no longer exist are ignored, as is an unreadable file."""
    try:
        found = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return {}
    keep = {k: found[k] for k in ("database_file", "use_database_mode", "custom_temp_dir") if k in found}
    return {k: v for k, v in keep.items() if k == "use_database_mode" or v and os.path.exists(v)}


def save_settings(path: str, settings: dict) -> None:
    write_text(json.dumps(settings, indent=2), path)
