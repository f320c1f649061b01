"""DuckDB SQL for the engine's queries, built from the same rules and patterns."""

from __future__ import annotations

from .functions.rules import FINGERPRINT, GENERALISE, SHORTEN, Rule, quoted, rules_sql
from .functions.text import CATEGORIES, CATEGORY_PARTS, COUNT, OTHER, PARSER_SUFFIX, REPORT_SUFFIX, SHORT_TYPE
from .operators.parse import HEADERS
from .plans.synthetic import KEYWORD_CTE, LINES_CTE, MESSAGES_CTE
from .schemas import KEPT_CODES, KEYWORD_LEVELS, SEVERITY_NAMES


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def base_name(x: str) -> str:
    return f"string_split({x}, '/')[-1]"


def parser_file(x: str) -> str:
    return rules_sql(base_name(x), PARSER_SUFFIX)


def report_file(x: str) -> str:
    return rules_sql(base_name(x), REPORT_SUFFIX)


def generalise(x: str) -> str:
    return rules_sql(x, GENERALISE)


def fingerprint(x: str) -> str:
    return rules_sql(x, FINGERPRINT)


def shorten(x: str) -> str:
    return rules_sql(x, SHORTEN)


def count_of(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, {quoted(COUNT)}) THEN TRY_CAST(regexp_extract({x}, {quoted(COUNT)}, 1) AS BIGINT) ELSE 1 END"


def clean_of(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, {quoted(COUNT)}) THEN trim(regexp_extract({x}, {quoted(COUNT)}, 2), '''\"') ELSE {x} END"


def category(message: str, kind: str = "''") -> str:
    text = f"lower({kind} || ' ' || {message})"
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, {quoted('|'.join(p))}) THEN {quoted(c)}" for c, p in CATEGORIES.items()) + f" ELSE {quoted(OTHER)} END"


def short_type(x: str) -> str:
    head = f"CASE WHEN instr({x}, ':') > 0 THEN split_part({x}, ':', 1) ELSE substr({x}, 1, 50) END"
    short = rules_sql(strip(head), SHORT_TYPE)
    return f"CASE WHEN length({short}) <= 50 THEN {short} ELSE substr({short}, 1, 47) || '...' END"


def severity_name(x: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {quoted(a)} THEN {quoted(b)}" for a, b in SEVERITY_NAMES.items()) + f" ELSE {x} END"


def keyword(x: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({x}), {quoted(rf'\b{w}\b')}) THEN {quoted(w)}" for w in KEYWORD_LEVELS) + " END"


def _place(x: str) -> str:
    test = " OR ".join(f"contains(lower(p), {quoted(w)})" for w in CATEGORY_PARTS)
    return f"list_position(list_transform(string_split({x}, '/'), lambda p: {test}), true)"


def log_category(x: str) -> str:
    return f"CASE WHEN {_place(x)} > 0 THEN string_split({x}, '/')[{_place(x)}] WHEN len(string_split({x}, '/')) > 1 THEN string_split({x}, '/')[-2] ELSE '' END"


def log_folder(x: str) -> str:
    parts = f"string_split({x}, '/')"
    return f"CASE WHEN {_place(x)} > 0 THEN array_to_string(list_slice({parts}, {_place(x)} + 1, len({parts}) - 1), '/') ELSE array_to_string(list_slice({parts}, 1, len({parts}) - 1), '/') END"


def _field(g: int, header: str = "r", layout: str = "layout") -> str:
    return f"CASE {layout} " + " ".join(f"WHEN {k} THEN regexp_extract({header}, {quoted(p)}, {g})" for k, p in enumerate(HEADERS, 1)) + " END"


_LAYOUT = "CASE " + " ".join(f"WHEN regexp_matches(r, {quoted(p)}) THEN {k}" for k, p in enumerate(HEADERS, 1)) + " ELSE 0 END"

HEADERS_CTE = rf"""{LINES_CTE}, stripped AS (SELECT source_name, seq, regexp_replace(line, '\s+$', '') AS r FROM lines),
hdr AS (SELECT *, {_LAYOUT} AS layout FROM stripped)"""
KEPT = ", ".join(map(quoted, KEPT_CODES))
RECORDS_CTE = rf"""{HEADERS_CTE}, asm AS (
  SELECT *, sum(CASE WHEN layout > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY source_name ORDER BY seq) AS rec FROM hdr
), isl AS (
  SELECT *, sum(CASE WHEN layout = 0 AND NOT (starts_with(r, chr(9)) OR starts_with(r, '    ')) THEN 1 ELSE 0 END) OVER (PARTITION BY source_name, rec ORDER BY seq) AS brk FROM asm WHERE rec > 0
), cand AS (
  SELECT source_name, rec, min(seq) FILTER (WHERE layout > 0) AS seq, max(r) FILTER (WHERE layout > 0) AS r, max(layout) AS layout,
    coalesce(string_agg({strip('r')}, chr(10) ORDER BY seq) FILTER (WHERE layout = 0), '') AS description, coalesce(arg_min({strip('r')}, seq) FILTER (WHERE layout = 0), '') AS first_line
  FROM isl WHERE brk = 0 GROUP BY source_name, rec
), records AS (
  SELECT source_name, seq, layout, {_field(1)} AS date, {_field(2)} AS time, {_field(3)} AS code, {severity_name(_field(3))} AS severity, {strip(_field(4))} AS type, first_line, description FROM cand WHERE {_field(3)} IN ({KEPT})
)"""
DEDUP_CTE = f"""{RECORDS_CTE}, printed AS (
  SELECT *, {parser_file('source_name')} AS key_file, {fingerprint('type')} AS key_type, {fingerprint('first_line')} AS key_line FROM records
), keyed AS (SELECT *, CASE WHEN description = '' THEN key_type ELSE key_line END AS key_text FROM printed),
ranked AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY key_file, code, key_type, key_text) AS n_rows FROM keyed WINDOW w AS (PARTITION BY key_file, code, key_type, key_text ORDER BY seq)),
deduped AS (SELECT source_name AS logfile, date, time, severity, {generalise('type')} AS type, {generalise('description')} AS description, seq, n_rows FROM ranked WHERE rn = 1)"""
KEYWORDS_CTE = f"""{KEYWORD_CTE}, kstripped AS (SELECT source_name, seq, {strip('line')} AS text FROM klines),
kfound AS (SELECT source_name, seq, {keyword('text')} AS severity, text FROM kstripped WHERE text <> '' AND {keyword('text')} IS NOT NULL),
kmasked AS (SELECT source_name, seq, severity, {generalise('text')} AS text FROM kfound),
kdeduped AS (SELECT arg_min(source_name, seq) AS logfile, arg_min(severity, seq) AS severity, text, min(seq) AS seq, count(*) AS n_rows FROM kmasked GROUP BY text)"""


def _detail(source: str) -> str:
    return f"""SELECT {log_category('logfile')} AS "Log-Kategorie", {log_folder('logfile')} AS "Ordner", {report_file('logfile')} AS "Logfile-Gruppe", {base_name('logfile')} AS "Dateiname-Original",
    {count_of('description')} AS "Anzahl", date AS "Datum", time AS "Zeit", severity AS "Severity", type AS "Type/Source", {shorten(clean_of('description'))} AS "Description", seq FROM {source}"""


DETAIL_CTE = f"""{DEDUP_CTE}, dcols AS ({_detail('deduped')}), dcat AS (SELECT *, {category('"Description"', '"Type/Source"')} AS "Fehler-Kategorie" FROM dcols),
drank AS (SELECT *, row_number() OVER (PARTITION BY "Severity", "Type/Source", "Description" ORDER BY seq) AS rn FROM dcat),
detail AS (SELECT * EXCLUDE (rn) FROM drank WHERE rn = 1)"""
REPORT_CTE = f"""{DEDUP_CTE}, rows_ AS (SELECT *, {count_of('description')} AS cnt, {clean_of('description')} AS clean, {report_file('logfile')} AS file_group FROM deduped),
rep AS (SELECT *, {category('description', 'type')} AS category, {short_type('description')} AS short_type, {category('clean', 'type')} AS clean_category, {short_type('clean')} AS clean_short_type FROM rows_)"""
SUMMARY_CTE = f"""{REPORT_CTE}, per_file AS (SELECT category, short_type, file_group, sum(cnt) AS total, min(seq) AS first_seq FROM rep GROUP BY ALL),
ranked_files AS (SELECT *, row_number() OVER (PARTITION BY category, short_type ORDER BY total DESC, first_seq) AS rank FROM per_file),
tops AS (SELECT category, short_type, count(*) AS n_files, substr(string_agg(file_group || ' (' || CAST(total AS VARCHAR) || ')', ', ' ORDER BY rank) FILTER (WHERE rank <= 3), 1, 150) AS top_files FROM ranked_files GROUP BY ALL),
grouped AS (SELECT category, short_type, count(*) AS n_unique, sum(cnt) AS n_total, arg_max(severity, seq) AS severity, arg_min(date || ' ' || time, seq) AS first_seen, arg_max(date || ' ' || time, seq) AS last_seen,
  substr(coalesce(arg_min(clean, seq) FILTER (WHERE clean <> ''), ''), 1, 200) AS example, min(seq) AS first_seq FROM rep GROUP BY category, short_type),
summary AS (SELECT g.*, n_files, top_files FROM grouped g JOIN tops t ON g.category = t.category AND g.short_type = t.short_type)"""
STATS_CTE = f"""{REPORT_CTE}, stats AS (
  SELECT 'category' AS kind, clean_category AS value, sum(cnt) AS n, min(seq) AS first_seq FROM rep GROUP BY 2 UNION ALL SELECT 'severity', upper(severity), sum(cnt), min(seq) FROM rep GROUP BY 2
  UNION ALL SELECT 'file_group', file_group, sum(cnt), min(seq) FROM rep GROUP BY 2 UNION ALL SELECT 'short_type', clean_short_type, sum(cnt), min(seq) FROM rep GROUP BY 2)"""
#: The table of the log's first half, and all records as the new side.
DATABASE_CTE = f"""{DEDUP_CTE}, halves AS (SELECT * FROM deduped),
oldc AS ({_detail('(SELECT * FROM halves WHERE seq <= (SELECT max(seq) / 2 FROM halves))')}), newc AS ({_detail('halves')}),
oldr AS (SELECT *, row_number() OVER (PARTITION BY "Severity", "Type/Source", "Description" ORDER BY seq) AS rn FROM oldc), old AS (SELECT * EXCLUDE (rn) FROM oldr WHERE rn = 1),
newr AS (SELECT *, row_number() OVER (PARTITION BY "Severity", "Type/Source", "Description" ORDER BY seq) AS rn FROM newc), fresh AS (SELECT * EXCLUDE (rn) FROM newr WHERE rn = 1 AND ("Severity", "Type/Source", "Description") NOT IN (SELECT ("Severity", "Type/Source", "Description") FROM old)),
combined AS (SELECT *, 0 AS ord FROM old UNION ALL SELECT *, 1 AS ord FROM fresh)"""


def _headers(k: int) -> str:
    return f"WITH {HEADERS_CTE} SELECT source_name, seq, {_field(1)} AS date, {_field(2)} AS time, {_field(3)} AS code, {severity_name(_field(3))} AS severity, {strip(_field(4))} AS type FROM hdr WHERE layout = {k}"


_DETAIL_LIST = '"Log-Kategorie", "Ordner", "Logfile-Gruppe", "Dateiname-Original", "Anzahl", "Fehler-Kategorie", "Datum", "Zeit", "Severity", "Type/Source", "Description"'


def one_rule(rules: list[Rule]) -> str:
    return f"WITH {MESSAGES_CTE} SELECT event_id, " + ", ".join(f"{rules_sql('message', [r])} AS r{k}" for k, r in enumerate(rules, 1)) + " FROM msg"


ORACLE_SQL: dict[str, str] = {
    "parse_headers_fmt1": _headers(1),
    "parse_headers_fmt2": _headers(2),
    "parse_headers_fmt3": _headers(3),
    "severity_names": f"WITH {HEADERS_CTE} SELECT {_field(3)} AS code, {severity_name(_field(3))} AS severity, count(*) AS n FROM hdr WHERE layout > 0 AND {_field(3)} IN ({KEPT}) GROUP BY 1, 2",
    "assemble_multiline": f"WITH {RECORDS_CTE} SELECT source_name, seq, layout, date, time, code, severity, type, first_line, description FROM records",
    "keyword_severity": f"WITH {KEYWORDS_CTE} SELECT seq, severity, text FROM kfound",
    "keyword_dedup": f"WITH {KEYWORDS_CTE} SELECT logfile, severity, text, seq, n_rows FROM kdeduped",
    "generalize_paths": f"WITH {MESSAGES_CTE} SELECT event_id, {generalise('message')} AS masked FROM msg",
    "generalize_urls": f"SELECT page_id, {generalise('url')} AS masked FROM pages",
    "generalize_rules": one_rule(GENERALISE),
    "fingerprint": f"WITH {MESSAGES_CTE} SELECT event_id, {fingerprint('message')} AS print FROM msg",
    "fingerprint_rules": one_rule(FINGERPRINT),
    "dedup_structured": f"WITH {DEDUP_CTE} SELECT logfile, date, time, severity, type, description, seq, n_rows FROM deduped",
    "skipped_counts": f"WITH {DEDUP_CTE} SELECT CAST(sum(n_rows) AS BIGINT) AS candidates, count(*) AS kept, CAST(sum(n_rows) - count(*) AS BIGINT) AS skipped FROM deduped",
    "file_names": f"WITH {MESSAGES_CTE} SELECT source_name, {base_name('source_name')} AS base, {parser_file('source_name')} AS parser_file, {report_file('source_name')} AS report_file, {log_category('source_name')} AS category, {log_folder('source_name')} AS folder, count(*) AS n FROM msg GROUP BY source_name",
    "detail_rows": f"WITH {DETAIL_CTE} SELECT {_DETAIL_LIST}, seq FROM detail",
    "keyword_detail_rows": f"""WITH {KEYWORDS_CTE} SELECT {log_category('logfile')} AS "Log-Kategorie", {log_folder('logfile')} AS "Ordner", {base_name('logfile')} AS "Dateiname", {category('text')} AS "Fehler-Kategorie", severity AS "Severity", text AS "Eintragstext", seq FROM kdeduped""",
    "shorten_paths": f"WITH {MESSAGES_CTE} SELECT event_id, {shorten('message')} AS short FROM msg",
    "categorize": f"WITH {MESSAGES_CTE} SELECT event_id, {category('message', 'type')} AS category, {category(generalise('message'))} AS masked_category FROM msg",
    "short_type": f"WITH {MESSAGES_CTE} SELECT event_id, {short_type('message')} AS short_type FROM msg",
    "count_prefix": f"WITH {MESSAGES_CTE} SELECT event_id, {count_of('message')} AS cnt, {clean_of('message')} AS clean FROM msg",
    "summary_grouped": f"WITH {SUMMARY_CTE} SELECT category, short_type, n_unique, CAST(n_total AS BIGINT) AS n_total, severity, first_seen, last_seen, n_files, top_files, example, first_seq FROM summary",
    "summary_top3": f"WITH {SUMMARY_CTE} SELECT category, short_type, n_files, top_files FROM summary",
    "stats_grouping_sets": f"WITH {STATS_CTE} SELECT kind, value, CAST(n AS BIGINT) AS n, first_seq FROM stats",
    "stats_totals": f"WITH {REPORT_CTE} SELECT count(*) AS n_records, CAST(sum(cnt) AS BIGINT) AS n_occurrences, count(DISTINCT file_group) AS n_files FROM rep",
    "top_logfile_groups": f"WITH {STATS_CTE} SELECT value, CAST(n AS BIGINT) AS n FROM stats WHERE kind = 'file_group' ORDER BY n DESC, first_seq LIMIT 10",
    "top_short_types": f"WITH {STATS_CTE} SELECT value, CAST(n AS BIGINT) AS n FROM stats WHERE kind = 'short_type' ORDER BY n DESC, first_seq LIMIT 10",
    "percent_share": f"WITH {STATS_CTE} SELECT kind, value, CAST(n AS BIGINT) AS n, round(n / (SELECT sum(n) FROM stats WHERE kind = 'category') * 100, 6) AS share FROM stats",
    "frequency_report": f"""WITH {DETAIL_CTE}, f AS (SELECT "Type/Source" AS source, count(*) AS n FROM detail GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_sources, CAST(sum(n) - count(*) AS BIGINT) AS n_saved, round((sum(n) - count(*)) / sum(n) * 100, 6) AS saved_share FROM f""",
    "top_sources": f"""WITH {DETAIL_CTE}, f AS (SELECT "Type/Source" AS source, count(*) AS n, min(seq) AS first_seq FROM detail GROUP BY 1) SELECT CASE WHEN length(source) > 70 THEN substr(source, 1, 70) || '...' ELSE source END AS source, n FROM f ORDER BY n DESC, first_seq LIMIT 10""",
    "database_append": f"""WITH {DATABASE_CTE} SELECT ord, "Log-Kategorie", "Ordner", "Logfile-Gruppe", "Dateiname-Original", CAST("Anzahl" AS VARCHAR) AS "Anzahl", {category('"Description"', '"Type/Source"')} AS "Fehler-Kategorie", "Datum", "Zeit", "Severity", "Type/Source", "Description" FROM combined""",
    "append_counts": f"WITH {DATABASE_CTE} SELECT CAST(sum(ord) AS BIGINT) AS new_rows, count(*) AS total_rows FROM combined",
    "database_validate": f"""WITH {DETAIL_CTE} SELECT count(*) AS n_rows, count(DISTINCT ("Severity", "Type/Source", "Description")) AS n_keys FROM dcat""",
    "sql_functions": f"WITH {MESSAGES_CTE} SELECT event_id, {generalise('message')} AS masked, {fingerprint('message')} AS print, {category('message', 'type')} AS category, {short_type('message')} AS short_type, {count_of('message')} AS cnt FROM msg",
    "text_exact_dedup": f"WITH g AS (SELECT doc_id, {generalise('text')} AS masked FROM documents) SELECT min(doc_id) AS doc_id, md5(masked) AS masked, count(*) AS n_rows FROM g GROUP BY masked",
}
