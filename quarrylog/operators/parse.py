"""Lines to records: header classification, multi-line assembly, keyword detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import java
from ..functions.text import keyword_severity, right_strip, severity_name, strip
from ..schemas import KEPT_CODES

# The three header layouts (date, time, severity, type) and the continuation prefix.
HEADERS = [
    r"^(\d{2}\.\d{2}\.\d{4})\s+(\d{2}:\d{2}:\d{2})\s+([VIWFCE])\s+(.+)$",
    r"^(\d{4}-\d{2}-\d{2})\s+(\d{2}:\d{2}:\d{2}\.\d{3})\s+\[(INFO|ERROR|WARN|WARNING|FATAL|CRITICAL)\]\s+(.+)$",
    r"^(\w{3}\s+\d{2}\.\w{3}\.\s+)(\d{2}:\d{2}:\d{2}\.\d{3})\s+(INFO|ERROR|WARN|WARNING|FATAL|CRITICAL)\s+(.+)$",
]
CONTINUATION = r"^(\t|    )"


def header_format(line: Column) -> Column:
    """1, 2 or 3: the first layout that the right-stripped line has; else 0."""
    out = F.when(line.rlike(java(HEADERS[0])), 1)
    for k, pattern in enumerate(HEADERS[1:], 2):
        out = out.when(line.rlike(java(pattern)), k)
    return out.otherwise(0)


def header_field(line: Column, layout: Column, group: int) -> Column:
    out = F.when(layout == 1, F.regexp_extract(line, java(HEADERS[0]), group))
    for k, pattern in enumerate(HEADERS[1:], 2):
        out = out.when(layout == k, F.regexp_extract(line, java(pattern), group))
    return out


def parse_headers(lines: DataFrame) -> DataFrame:
    """Header lines of (source_name, seq, line) as (source_name, seq, layout, date, time, code, severity, type), dropped severities included."""
    r = lines.withColumn("_r", right_strip(F.col("line"))).withColumn("layout", header_format(F.col("_r"))).where("layout > 0")
    field = lambda g: header_field(F.col("_r"), F.col("layout"), g)
    return r.select("source_name", "seq", "layout", field(1).alias("date"), field(2).alias("time"), field(3).alias("code"), severity_name(field(3)).alias("severity"), strip(field(4)).alias("type"))


def parse_records(lines: DataFrame, scope: tuple[str, ...] = ("source_name",)) -> DataFrame:
    """Records of kept severities with their continuation lines.

    ``lines``: (source_name, seq, line) and the columns of ``scope``, within which ``seq`` orders
    lines. A scope may be any run of lines that begins with a line which continues no other, so
    sources cut large files into blocks (``source_name``, ``block``) and no task holds a file.
    Gives source_name, seq (the header's), layout, date, time, code, severity, type, first_line
    ('' without a continuation) and description.
    """
    rows = lines.withColumn("_r", right_strip(F.col("line"))).withColumn("_f", header_format(F.col("_r")))
    rows = rows.withColumn("_c", F.col("_r").rlike(CONTINUATION))
    so_far = Window.partitionBy(*scope).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_rec", F.sum((F.col("_f") > 0).cast("int")).over(so_far)).where("_rec > 0")
    in_record = Window.partitionBy(*scope, "_rec").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ended = F.sum(((F.col("_f") == 0) & ~F.col("_c")).cast("int")).over(in_record)
    rows = rows.withColumn("_end", ended).where("_end = 0")
    header, more = F.col("_f") > 0, F.col("_f") == 0
    text = F.when(more, F.struct("seq", strip(F.col("_r")).alias("t")))
    group = list(dict.fromkeys([*scope, "source_name", "_rec"]))
    out = rows.groupBy(*group).agg(
        F.min(F.when(header, F.col("seq"))).alias("seq"),
        F.max(F.when(header, F.col("_f"))).alias("layout"),
        F.max(F.when(header, F.col("_r"))).alias("_h"),
        F.array_sort(F.collect_list(text)).alias("_t"),
    )
    field = lambda g: header_field(F.col("_h"), F.col("layout"), g)
    out = out.withColumn("code", field(3)).where(F.col("code").isin(KEPT_CODES))
    return out.select(
        "source_name", "seq", "layout", field(1).alias("date"), field(2).alias("time"), "code", severity_name(F.col("code")).alias("severity"), strip(field(4)).alias("type"),
        F.coalesce(F.get("_t", F.lit(0))["t"], F.lit("")).alias("first_line"),
        F.array_join(F.transform("_t", lambda x: x["t"]), "\n").alias("description"),
    )


def parse_keywords(lines: DataFrame) -> DataFrame:
    """Lines that hold a severity keyword: (source_name, seq, severity, text), stripped."""
    rows = lines.withColumn("text", strip(F.col("line"))).where("text != ''")
    rows = rows.withColumn("severity", keyword_severity(F.col("text"))).where(F.col("severity").isNotNull())
    return rows.select(*[c for c in lines.columns if c not in ("line", "severity", "text")], "severity", "text")
