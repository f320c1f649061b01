"""Scalar functions on columns: file names, counts, categories, short types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import KEYWORD_LEVELS, SEVERITY_NAMES
from .rules import SHORTEN, Rule, apply_rules, java

# The classifier's patterns by category, in order.
CATEGORIES = {
    "Netzwerk": ["connection.*closed", "network.*path.*not.*found", "network.*error", "timeout", "connection.*refused", "connection.*reset", "authenticating.*failed", r"smb\d+.*failed", r"\\\\[\d\.]+\\"],
    "Datei": ["file.*not.*found", "transferring.*file.*failed", "copying.*failed", "file.*handle", "end.*of.*file", "cannot.*open.*file", "permission.*denied", "file.*exists"],
    "System": ["i/o.*operation.*aborted", "thread.*exit", "application.*request", "memory.*error", "access.*violation", "null.*reference"],
    "Authentifizierung": ["authenticating", "authentication.*failed", "login.*failed", "unauthorized", "access.*denied", "permission"],
    "Media": ["encoding.*failed", "decoding.*failed", "invalid.*data.*processing.*input", "software.*scaling.*failed", "codec.*error", "frame.*failed"],
    "Modul": ["loading.*module.*failed", "module.*not.*found", "linking.*shared.*object.*failed", "dll.*not.*found"],
    "Zeitbezogen": ["system.*time.*changed", "timestamp", "timeout"],
}
OTHER = "Sonstige"
#: A path part that holds one of these names the log category.
CATEGORY_PARTS = ["log", "rx", "pixera"]
#: Suffixes of split log files, for duplicate keys and for reports.
PARSER_SUFFIX = [Rule(r"-(?:\d{1,2}|WRITEABLE)(\.(?:log|txt))$", "$1")]
REPORT_SUFFIX = [Rule(r"-\d+\.log$", ".log"), Rule(r"-WRITEABLE\.log$", ".log")]
COUNT = r"^(\d+)x\s+(.+)$"
SHORT_TYPE = [Rule(r"^\d+x\s+", ""), Rule(r"^similar to\s+", "")]


def strip(text: Column) -> Column:
    """Without white space (Unicode) at both ends."""
    return F.regexp_replace(text, r"(?Ud)^\s+|\s+\z", "")


def right_strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?Ud)\s+\z", "")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parser_file_name(path: Column) -> Column:
    """Base name without a split suffix, as duplicate keys use it."""
    return apply_rules(base_name(path), PARSER_SUFFIX)


def report_file_name(path: Column) -> Column:
    """Base name without a split suffix, as reports group it."""
    return apply_rules(base_name(path), REPORT_SUFFIX)


def _counted(description: Column) -> Column:
    return description.rlike(java(COUNT))


def count_of(description: Column) -> Column:
    """N of ``Nx text``, else 1; null beyond 63 bits."""
    return F.when(_counted(description), F.regexp_extract(description, java(COUNT), 1).try_cast("bigint")).otherwise(F.lit(1).cast("bigint"))


def clean_of(description: Column) -> Column:
    """The text of ``Nx text`` without quotes at its ends, else all."""
    return F.when(_counted(description), F.btrim(F.regexp_extract(description, java(COUNT), 2), F.lit("'\""))).otherwise(description)


def shorten_paths(description: Column) -> Column:
    return apply_rules(description, SHORTEN)


def _parts(path: Column) -> tuple[Column, Column]:
    """Parts of a path, and the 1-based place of the first that names a category (0: none)."""
    parts = F.split(path, "/")
    named = F.transform(parts, lambda p: F.lower(p).rlike("|".join(CATEGORY_PARTS)))
    return parts, F.array_position(named, F.lit(True))


def log_category(path: Column) -> Column:
    """The first path part that names a category, the file's name included; else the parent's name."""
    parts, at = _parts(path)
    parent = F.when(F.size(parts) > 1, F.element_at(parts, F.when(F.size(parts) > 1, F.lit(-2)).otherwise(F.lit(-1)))).otherwise(F.lit(""))
    return F.when(at > 0, F.element_at(parts, F.greatest(at, F.lit(1)).cast("int"))).otherwise(parent)


def log_folder(path: Column) -> Column:
    """What lies between category and file; without a category the whole parent path."""
    parts, at = _parts(path)
    size = F.size(parts)
    between = F.array_join(F.slice(parts, (at + 1).cast("int"), F.greatest(F.lit(0), size - at - 1).cast("int")), "/")
    parent = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.lit(0), size - 1)), "/")
    return F.when(at > 0, between).otherwise(parent)


def categorise(message: Column, type_: Column | None = None) -> Column:
    """First category, in order, one of whose patterns is in the lower-cased type and message."""
    text = F.lower(F.concat(F.coalesce(type_, F.lit("")) if type_ is not None else F.lit(""), F.lit(" "), message))
    out = None
    for name, patterns in CATEGORIES.items():
        hit = text.rlike(java("|".join(patterns)))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(OTHER)


def short_type(description: Column) -> Column:
    """Text before the first colon, or the first 50 characters, without count and ``similar to``; 50 at most."""
    head = F.when(F.instr(description, ":") > 0, F.split_part(description, F.lit(":"), F.lit(1))).otherwise(F.substring(description, 1, 50))
    short = apply_rules(strip(head), SHORT_TYPE)
    return F.when(F.length(short) <= 50, short).otherwise(F.concat(F.substring(short, 1, 47), F.lit("...")))


def keyword_severity(line: Column) -> Column:
    """The first of the keyword levels that is a whole word of the line, or null."""
    lower, out = F.lower(line), None
    for level in KEYWORD_LEVELS:
        hit = lower.rlike(java(rf"\b{level}\b"))
        out = F.when(hit, level) if out is None else out.when(hit, level)
    return out


def severity_name(code: Column) -> Column:
    names = F.create_map(*(F.lit(x) for pair in SEVERITY_NAMES.items() for x in pair))
    return F.coalesce(names[code], code)


def percent(part: Column, total: Column) -> Column:
    return F.when(total > 0, part / total * 100).otherwise(F.lit(0.0))
