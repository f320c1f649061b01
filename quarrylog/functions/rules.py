"""Ordered substitution rules, and their application as one expression."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Rule(NamedTuple):
    """A substitution of all matches. ``$1`` in the replacement is the first group."""

    pattern: str
    replacement: str
    ignore_case: bool = False


# The rules of the path generaliser, in order.
GENERALISE = [
    Rule(r"""<\?>[A-Za-z]:[/\\][^'"\s]*""", "<URL_PATH>"),
    Rule(r"""<\?>\\\\[^'"\s]+""", "<URL_PATH>"),
    Rule(r"""\\\\[\d.]+\\[^'"\s]*""", "<UNC_PATH>"),
    Rule(r"""\\\\[A-Za-z0-9\-_.]+\\[^'"\s]*""", "<UNC_PATH>"),
    Rule(r"""srv://[\d.]+/[^\s'"]*""", "<SRV_PATH>"),
    Rule(r"""[A-Za-z]:[/\\][^'"\s]*""", "<DRIVE_PATH>"),
    Rule(r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(:\d+)?", "<IP>"),
    Rule(r"\b\d{16,}\b", "<FILE_ID>"),
    Rule(r"\b[a-f0-9]{32,}\b", "<HASH>"),
    Rule(r"_\d{12}", "_<TIMESTAMP>"),
    Rule(r"_\d{14}", "_<TIMESTAMP>"),
    Rule(r"""<URL_PATH>\s+[^'"]*""", "<URL_PATH>"),
    Rule(r"""<DRIVE_PATH>\s+[^'"]*""", "<DRIVE_PATH>"),
    Rule(r"""<UNC_PATH>\s+[^'"]*""", "<UNC_PATH>"),
    Rule(r"""//<IP>/[^\s:'"]*""", "//<IP>/<SHARE_PATH>"),
    Rule(r"\b[A-Z]{2,}/[\w/._-]+\.\w+", "<REL_PATH>"),
    Rule(r"(\w+_id):\s*\d+", "$1: <ID>"),
    Rule(r"\bOutput\s+\d+", "Output <NUM>"),
    Rule(r"\bdevice\s+\d+", "device <NUM>"),
    Rule(r"\bport\s+\d+", "port <NUM>"),
    Rule(r"LRTB:\s*[\d.\-,\s]+", "LRTB: <COORDS>"),
    Rule(r"Z-NF:\s*[\d.\-,\se+]+", "Z-NF: <COORDS>"),
]

# The rules of the duplicate fingerprint, in order.
FINGERPRINT = [
    Rule(r"^\d+\s*x\s+", "", True),
    Rule(r"""^similar\s+to\s+["'](.+)["']$""", "$1", True),
    Rule(r"^'(.*)'$", "$1"),
    Rule(r'^"(.*)"$', "$1"),
    Rule(r"transferring file from '[^']+' to '[^']+' failed: .+", "transferring file from '<SOURCE>' to '<DEST>' failed: <ERROR>", True),
    Rule(r"loading '<\?>[^']+' failed: opening file '[^']+' failed", "loading '<FILE>' failed: opening file '<FILE>' failed", True),
    Rule(r"error while enumerating [^:]+\s*:\s*.+", "error while enumerating <PATH> : <ERROR>", True),
    Rule(r"decoding '[^']+' failed.*", "decoding '<FILE>' failed: <ERROR>", True),
    Rule(r"""create_directories:\s*.+:\s*["'][^"']+["']""", "create_directories: <ERROR>", True),
    Rule(r"""directory_iterator::directory_iterator:\s*.+:\s*["'][^"']+["']""", "directory_iterator: <ERROR>", True),
    Rule(r"authenticating on '[^']+' failed:\s*.+", "authenticating on '<PATH>' failed: <ERROR>", True),
    Rule(r"updating render task failed:\s*.+", "updating render task failed: <ERROR>", True),
    Rule(r"encoding frame failed:\s*.+", "encoding frame failed: <ERROR>", True),
    Rule(r"assertion '[^']+' failed in .+", "assertion failed in <LOCATION>", True),
    Rule(r"loading module '[^']+' failed:\s*.+", "loading module failed: <ERROR>", True),
    Rule(r"invalid projection matrix \(LRTB:.*?Z-NF:.*?\)", "invalid projection matrix", True),
    Rule(r"automatically reloaded texture '[^']+' disappeared", "automatically reloaded texture disappeared", True),
    Rule(r"display sync timed out \([^)]+\)", "display sync timed out", True),
    Rule(r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "<IP>"),
    Rule(r"[\w_-]+\d+[\w_-]*\.(mov|mp4|avi|mkv|pfm|png|jpg|jpeg|fbx|obj|log|txt)", "<FILE>", True),
    Rule(r"[\w_-]+\.(mov|mp4|avi|mkv|pfm|png|jpg|jpeg|fbx|obj|log|txt)", "<FILE>", True),
    Rule(r"""\\\\[^\\]+\\[^\\]+(?:\\[^\\'"]+)*""", "<UNC_PATH>"),
    Rule(r"""[A-Z]:[\\/](?:[^\\/'"\s]+[\\/])*[^\\/'"\s]*""", "<WIN_PATH>"),
    Rule(r"""srv://[^\s'"]+""", "<SRV_URL>"),
    Rule(r"""(?:^|[\s'"])/(?:[^/\s'"]+/)*[^/\s'"]+""", "<UNIX_PATH>"),
    Rule(r"""(?:^|[\s'"])[\w_-]+(?:/[\w_.-]+)+""", "<REL_PATH>"),
    Rule(r"_\d+(?:_\d+)*", "_<NUM>"),
    Rule(r"\d{4}[-_]\d{2}[-_]\d{2}[-_]?\d{0,6}", "<TIMESTAMP>"),
    Rule(r"\d{8,}", "<LONGNUM>"),
    Rule(r":\d{4,5}\b", ":<PORT>"),
    Rule(r"\b\d{4,}\b", "<NUM>"),
]

# Shortening of long paths in descriptions.
SHORTEN = [
    Rule(r"[A-Z]:\\[^\\]+\\[^\\]+\\(?:[^\\]+\\)*", "..\\\\"),
    Rule(r"\\\\\\\\[^\\]+\\\\[^\\]+\\\\(?:[^\\]+\\\\)*", "\\\\\\\\...\\\\"),
]


_ENDINGS = (".mov", ".mp4", ".avi", ".mkv", ".pfm", ".png", ".jpg", ".jpeg", ".fbx", ".obj", ".log", ".txt")
#: Strings of which any match of a rule holds one (in lower case where case is ignored): others are not searched.
_PARTS = [
    (GENERALISE, {0: ("<?>",), 1: ("<?>",), 2: ("\\\\",), 3: ("\\\\",), 4: ("srv://",), 5: (":\\", ":/"), 6: (".",), 9: ("_",), 10: ("_",), 11: ("<URL_PATH>",), 12: ("<DRIVE_PATH>",), 13: ("<UNC_PATH>",), 14: ("//<IP>/",), 15: ("/",), 16: ("_id",), 17: ("Output",), 18: ("device",), 19: ("port",), 20: ("LRTB:",), 21: ("Z-NF:",)}),
    (FINGERPRINT, {1: ("similar",), 4: ("transferring file",), 5: ("loading '<?>",), 6: ("error while",), 7: ("decoding '",), 8: ("create_directories:",), 9: ("directory_iterator::",), 10: ("authenticating on",), 11: ("updating render",), 12: ("encoding frame",), 13: ("assertion '",), 14: ("loading module",), 15: ("invalid projection",), 16: ("automatically",), 17: ("display sync",), 18: (".",), 19: _ENDINGS, 20: _ENDINGS, 21: ("\\\\",), 22: (":\\", ":/"), 23: ("srv://",), 24: ("/",), 25: ("/",), 26: ("_",), 29: (":",)}),
]
NEEDED = {rules[k].pattern: parts for rules, by_place in _PARTS for k, parts in by_place.items()}


def java(pattern: str, ignore_case: bool = False) -> str:
    """A pattern with Unicode classes, line feed as the only line end, and Unicode case folding if asked for."""
    return ("(?iUd)" if ignore_case else "(?Ud)") + pattern


def apply_rules(text: Column, rules: list[Rule]) -> Column:
    """All substitutions in turn, as one nested expression."""
    for rule in rules:
        replaced = lambda x, rule=rule: F.regexp_replace(x, java(rule.pattern, rule.ignore_case), rule.replacement.replace("\\", "\\\\"))
        needs = NEEDED.get(rule.pattern)
        text = _guarded(text, needs, rule.ignore_case, replaced) if needs else replaced(text)
    return text


def _guarded(text: Column, needs: tuple[str, ...], ignore_case: bool, replaced: Callable[[Column], Column]) -> Column:
    """``replaced`` for texts that hold one of the needed strings, others as they are; the text is evaluated once.

    Letters beyond ASCII may fold to ASCII ones, so a text with any is not passed over where case is ignored.
    """

    def chosen(x: Column) -> Column:
        searched = F.lower(x) if ignore_case else x
        may = F.octet_length(x) != F.char_length(x) if ignore_case else F.lit(False)
        for part in needs:
            may = may | F.contains(searched, F.lit(part))
        return F.when(may, replaced(x)).otherwise(x)

    return F.get(F.transform(F.array(text), chosen), F.lit(0))


def generalise(text: Column) -> Column:
    """Masks paths, addresses, ids and coordinates of a stored text."""
    return apply_rules(text, GENERALISE)


def fingerprint(text: Column) -> Column:
    """What a text has in common with its duplicates; only for keys."""
    return apply_rules(text, FINGERPRINT)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rules_sql(text: str, rules: list[Rule]) -> str:
    """The same substitutions in DuckDB's SQL."""
    for rule in rules:
        replacement = re.sub(r"\$(\d)", r"\\\1", rule.replacement.replace("\\", "\\\\"))
        text = f"regexp_replace({text}, {quoted(rule.pattern)}, {quoted(replacement)}, {quoted('gi' if rule.ignore_case else 'g')})"
    return text
