"""Record schemas and vocabularies."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


LINE = T.StructType([*_strings("source_name"), T.StructField("seq", T.LongType()), *_strings("line")])
STRUCTURED = T.StructType([*_strings("logfile", "date", "time", "severity", "type", "description"), T.StructField("seq", T.LongType())])
KEYWORD = T.StructType([*_strings("logfile", "severity", "text"), T.StructField("seq", T.LongType())])

# Column names of the written tables, severity codes and levels.
DETAIL_COLUMNS = ["Log-Kategorie", "Ordner", "Logfile-Gruppe", "Dateiname-Original", "Anzahl", "Fehler-Kategorie", "Datum", "Zeit", "Severity", "Type/Source", "Description"]
KEYWORD_COLUMNS = ["Log-Kategorie", "Ordner", "Dateiname", "Fehler-Kategorie", "Severity", "Eintragstext"]
SUMMARY_COLUMNS = ["Fehler-Kategorie", "Fehlertyp", "Unique Einträge", "Gesamt-Vorkommen", "Severity", "Erste Occurrence", "Letzte Occurrence", "Betroffene Logfiles", "Top Logfiles (Count)", "Beispiel-Beschreibung"]
DATABASE_KEY = ["Severity", "Type/Source", "Description"]
SEVERITY_NAMES = {
    "V": "verbose", "I": "info", "E": "error", "W": "warning", "F": "fatal", "C": "critical",
    "INFO": "info", "ERROR": "error", "WARN": "warning", "WARNING": "warning", "FATAL": "fatal", "CRITICAL": "critical",
}
KEPT_CODES = ["E", "W", "F", "C", "ERROR", "WARN", "WARNING", "FATAL", "CRITICAL"]
KEYWORD_LEVELS = ["error", "fatal", "critical", "warning"]

DETAIL = T.StructType([T.StructField(n, T.LongType() if n == "Anzahl" else T.StringType()) for n in DETAIL_COLUMNS])
