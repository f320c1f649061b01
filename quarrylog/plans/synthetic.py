"""Log lines made from the ``events`` table, in Spark and, for the oracle, in DuckDB's SQL.

Each event gives a header line in its file's layout and up to two more lines. Messages come
from templates that reach every masking rule.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import quoted

BLOCK_EVENTS = 4096
#: Placeholders: name to an expression that both engines read.
FIELDS = {"id": "event_id", "user": "user_id", "a": "event_id % 7", "b": "event_id % 253", "c": "1000 + event_id % 9000", "long": "20250930000000 + event_id"}
PATHS = [
    "rx_logs/day1/playback-27103.log", "rx_logs/day1/playback-27103-1.log", "rx_logs/day2/playback-27103-WRITEABLE.log", "data/sub/control-7.txt",
    "hub_logs/a/b/engine-12.log", "misc/render-3-2.log", "data/sub/io.txt", "station.log", "data/unit-9.txt",
]
MESSAGES = [
    r"loading 'D:\media\clip_{id}.mp4' failed: opening file 'D:\media\clip_{id}.mp4' failed",
    r"loading '<?>\\10.1.1.{b}\share\film {id}.mov' failed: opening file '\\10.1.1.{b}\share\film {id}.mov' failed",
    r"transferring file from 'D:\a\{id}.log' to '<bundling>D:\a\{id}.log' failed: copying failed ({a})",
    r"error while enumerating Data/set{a}/* : The network path was not found. ({a})",
    r"decoding 'Data/img{id}.jpg' failed: Invalid data found when processing input",
    r"create_directories: The system cannot find the path specified.: 'Content/{id}'",
    r"directory_iterator::directory_iterator: access is denied: 'X:/tmp/{id}'",
    r"authenticating on '\\10.0.0.{b}\c$' failed: login failed for user {user}",
    r"updating render task failed: importing texture {id} failed",
    r"encoding frame failed: codec error {a}",
    r"assertion 'referenced_{id}' failed in graph::node_{user}",
    r"loading module 'mod{user}' failed: linking shared object failed",
    r"invalid projection matrix (LRTB: {a}, -1.5, 0, 2 / Z-NF: 0.{a}, 5e+13)",
    r"automatically reloaded texture 'T:/tex/{id}.png' disappeared",
    r"display sync timed out (10.1.2.{b} / Output {a})",
    r"peer 10.1.1.{b}:27{b} lost on port {c}",
    r"srv://10.1.1.{b}/S/f{id}.pfm not found",
    r"cannot open file srv://name{a}/x/{id}.pfm now",
    r"mapping_id: {id} on Output {a} device {user} of screen_id: {c}",
    r"SHM/path{a}/file_{id}.pfm end of file",
    r"hash 0123456789abcdef0123456789abcdef and number {long}{long} seen",
    r"clip_{long} is stale, backup_{c}_{a} kept",
    r"see http://h{a}.example/a/{id} for C:\temp\x{id} went bad",
    r"//10.1.1.{b}/share{a}/file at 2025-09-{c}: file exists",
    r"/var/run/{id}/socket and data/in/{id} vanished, thread exit",
    r"similar warp_{id}_{a} at host:{c} value {id}00000000",
    r"connection to 'node{a}' closed",
    r"End of file",
    r"system time changed by {c} ms",
    r"unit hello {a}",
]
PREFIXES = ["", "", "", r"7x ", r"12x similar to ", ""]
TYPES = ["Engine.Loader", "Media.Decode(10.1.1.{b})", "Net.Session '{a}'", r"Io: C:\srv\job_{id}.txt", "Core"]
EVENT_LEVELS = {"error": ("E", "ERROR"), "purchase": ("W", "WARN"), "signup": ("F", "FATAL"), "view": ("I", "INFO"), "click": ("V", "DEBUG")}
KEYWORD_TAILS = ["Error: ", "fatal condition, ", "warning ", "errors seen ", "CRITICAL fault in ", "note "]


def _column(template: str) -> Column:
    parts = [F.expr(f"CAST({FIELDS[p[1:-1]]} AS STRING)") if re.fullmatch(r"\{\w+\}", p) else F.lit(p) for p in re.split(r"(\{\w+\})", template) if p]
    return F.concat(*parts) if parts else F.lit("")


def _sql(template: str) -> str:
    return " || ".join(f"CAST({FIELDS[p[1:-1]]} AS VARCHAR)" if re.fullmatch(r"\{\w+\}", p) else quoted(p) for p in re.split(r"(\{\w+\})", template) if p) or "''"


def _case(value: str, templates: list[str]) -> Column:
    out = None
    for k, t in enumerate(templates):
        hit = F.expr(value) == k
        out = F.when(hit, _column(t)) if out is None else out.when(hit, _column(t))
    return out


def _case_sql(value: str, templates: list[str]) -> str:
    return f"CASE {value} " + " ".join(f"WHEN {k} THEN {_sql(t)}" for k, t in enumerate(templates)) + " END"


MESSAGE_OF, TYPE_OF, PREFIX_OF, PATH_OF = f"event_id % {len(MESSAGES)}", f"event_id % {len(TYPES)}", f"(event_id + user_id) % {len(PREFIXES)}", f"user_id % {len(PATHS)}"
SHAPE_OF, LAYOUT_OF, TAIL_OF = "(event_id + 3 * user_id) % 6", f"user_id % {len(PATHS)} % 3", f"(event_id + user_id) % {len(KEYWORD_TAILS)}"


def _level(k: int) -> Column:
    out = None
    for name, codes in EVENT_LEVELS.items():
        hit = F.col("event_type") == name
        out = F.when(hit, codes[k]) if out is None else out.when(hit, codes[k])
    return out


def event_messages(events: DataFrame) -> DataFrame:
    """(event_id, source_name, type, message) of each event."""
    message = F.concat(_case(PREFIX_OF, PREFIXES), _case(MESSAGE_OF, MESSAGES))
    return events.select("event_id", "user_id", "ts", "event_type", _case(PATH_OF, PATHS).alias("source_name"), _case(TYPE_OF, TYPES).alias("type"), message.alias("message"))


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_name, block, seq, line): four places an event, of which its shape fills one to three.

    An event's first line continues no other, so a block of events is a scope of its own.
    """
    rows = event_messages(spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id IS NOT NULL"))
    layout, shape = F.expr(LAYOUT_OF), F.expr(SHAPE_OF)
    header = (
        F.when(layout == 0, F.concat(F.date_format("ts", "dd.MM.yyyy HH:mm:ss"), F.lit("\t"), _level(0), F.lit("\t"), F.col("type"), F.lit("  ")))
        .when(layout == 1, F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS"), F.lit(" ["), _level(1), F.lit("] "), F.col("type")))
        .otherwise(F.concat(F.date_format("ts", "EEE dd.MMM.  HH:mm:ss.SSS"), F.lit(" "), _level(1), F.lit(" "), F.col("message")))
    )
    second = F.when(shape.isin(1, 2, 5), F.concat(F.when(shape == 2, F.lit("    ")).otherwise(F.lit("\t")), F.col("message"), F.lit(" "))).when(shape == 3, F.lit("plain line"))
    third = F.when(shape == 3, F.concat(F.lit("\torphan "), F.col("message"))).when(shape == 5, F.concat(F.lit("    at step "), F.col("event_id").cast("string"))).when(shape == 4, F.lit("   "))
    places = F.array(*(F.struct(F.lit(k).alias("k"), x.alias("line")) for k, x in enumerate((header, second, third))))
    out = rows.select("source_name", "event_id", F.explode(F.filter(places, lambda p: p["line"].isNotNull())).alias("p"))
    return out.select("source_name", F.floor(F.col("event_id") / BLOCK_EVENTS).alias("block"), (F.col("event_id") * 4 + F.col("p.k")).alias("seq"), "p.line")


def keyword_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_messages(spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id IS NOT NULL"))
    return rows.select("source_name", F.col("event_id").alias("seq"), F.concat(F.lit("  "), _case(TAIL_OF, KEYWORD_TAILS), F.col("message")).alias("line"))


_LEVEL_SQL = [f"CASE event_type {' '.join(f'WHEN {quoted(n)} THEN {quoted(c[k])}' for n, c in EVENT_LEVELS.items())} END" for k in (0, 1)]
MESSAGES_CTE = f"msg AS (SELECT event_id, user_id, ts, event_type, {_case_sql(PATH_OF, PATHS)} AS source_name, {_case_sql(TYPE_OF, TYPES)} AS type, {_case_sql(PREFIX_OF, PREFIXES)} || {_case_sql(MESSAGE_OF, MESSAGES)} AS message FROM events WHERE event_id IS NOT NULL)"
LINES_CTE = f"""{MESSAGES_CTE}, parts AS (
  SELECT source_name, event_id,
    CASE {LAYOUT_OF} WHEN 0 THEN strftime(ts, '%d.%m.%Y %H:%M:%S') || chr(9) || {_LEVEL_SQL[0]} || chr(9) || type || '  '
      WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S.%g') || ' [' || {_LEVEL_SQL[1]} || '] ' || type
      ELSE strftime(ts, '%a %d.%b.  %H:%M:%S.%g') || ' ' || {_LEVEL_SQL[1]} || ' ' || message END AS l0,
    CASE WHEN {SHAPE_OF} IN (1, 5) THEN chr(9) || message || ' ' WHEN {SHAPE_OF} = 2 THEN '    ' || message || ' ' WHEN {SHAPE_OF} = 3 THEN 'plain line' END AS l1,
    CASE WHEN {SHAPE_OF} = 3 THEN chr(9) || 'orphan ' || message WHEN {SHAPE_OF} = 5 THEN '    at step ' || CAST(event_id AS VARCHAR) WHEN {SHAPE_OF} = 4 THEN '   ' END AS l2 FROM msg
), lines AS (
  SELECT source_name, event_id * 4 AS seq, l0 AS line FROM parts UNION ALL SELECT source_name, event_id * 4 + 1, l1 FROM parts WHERE l1 IS NOT NULL UNION ALL SELECT source_name, event_id * 4 + 2, l2 FROM parts WHERE l2 IS NOT NULL
)"""
KEYWORD_CTE = f"{MESSAGES_CTE}, klines AS (SELECT source_name, event_id AS seq, '  ' || {_case_sql(TAIL_OF, KEYWORD_TAILS)} || message AS line FROM msg)"
