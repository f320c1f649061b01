"""The scalar functions as temporary SQL functions, whose bodies Spark inlines into plans."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..schemas import KEYWORD_LEVELS
from .rules import FINGERPRINT, GENERALISE, Rule, java
from .text import CATEGORIES, COUNT, OTHER, PARSER_SUFFIX, REPORT_SUFFIX, SHORT_TYPE


def _lit(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _fold(rules: list[Rule], text: str = "x") -> str:
    for r in rules:
        text = f"regexp_replace({text}, {_lit(java(r.pattern, r.ignore_case))}, {_lit(r.replacement)})"
    return text


def _bodies() -> dict[str, tuple[str, str, str]]:
    base = "element_at(split(x, '/'), -1)"
    counted, group = f"x RLIKE {_lit(java(COUNT))}", f"regexp_extract(x, {_lit(java(COUNT))}, %d)"
    cases = " ".join(f"WHEN lower(concat(t, ' ', x)) RLIKE {_lit(java('|'.join(p)))} THEN {_lit(c)}" for c, p in CATEGORIES.items())
    words = " ".join(f"WHEN lower(x) RLIKE {_lit(java(rf'\b{w}\b'))} THEN {_lit(w)}" for w in KEYWORD_LEVELS)
    strip = r"'(?Ud)^\\s+|\\s+\\z'"
    head = f"regexp_replace(CASE WHEN instr(x, ':') > 0 THEN split_part(x, ':', 1) ELSE substring(x, 1, 50) END, {strip}, '')"
    short = _fold(SHORT_TYPE, head)
    return {
        "generalise_paths": ("x STRING", "STRING", _fold(GENERALISE)),
        "error_fingerprint": ("x STRING", "STRING", _fold(FINGERPRINT)),
        "parser_file_name": ("x STRING", "STRING", _fold(PARSER_SUFFIX, base)),
        "report_file_name": ("x STRING", "STRING", _fold(REPORT_SUFFIX, base)),
        "occurrence_count": ("x STRING", "BIGINT", f"CASE WHEN {counted} THEN try_cast({group % 1} AS BIGINT) ELSE 1 END"),
        "clean_description": ("x STRING", "STRING", f"CASE WHEN {counted} THEN btrim({group % 2}, '\\'\"') ELSE x END"),
        "error_category": ("x STRING, t STRING", "STRING", f"CASE {cases} ELSE {_lit(OTHER)} END"),
        "error_short_type": ("x STRING", "STRING", f"CASE WHEN length({short}) <= 50 THEN {short} ELSE concat(substring({short}, 1, 47), '...') END"),
        "keyword_severity": ("x STRING", "STRING", f"CASE {words} END"),
    }


def register(spark: SparkSession) -> list[str]:
    """Creates the functions in this session and returns their names."""
    for name, (arguments, result, body) in _bodies().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
    return list(_bodies())
