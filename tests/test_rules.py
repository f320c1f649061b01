"""Masking, fingerprints and the other scalar functions, by tables of inputs and expected values."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quarrylog.functions import text as t
from quarrylog.functions.rules import fingerprint, generalise
from quarrylog.functions.sql import register

MASKED = [
    (r"open 'D:\a\b.mp4' bad", "open '<DRIVE_PATH>' bad"),
    (r"open D:\a\b.mp4 went bad", "open <DRIVE_PATH>"),
    ("see http://h.example/a", "see htt<DRIVE_PATH>"),
    (r"'\\10.1.1.1\s\f.mov' gone", "'<UNC_PATH>' gone"),
    (r"'\\host-a\s\f.mov' gone", "'<UNC_PATH>' gone"),
    ("'srv://10.1.1.1/S/f.pfm' gone", "'<SRV_PATH>' gone"),
    ("'srv://name/S/f.pfm' gone", "'sr<DRIVE_PATH>' gone"),
    ("peer 10.1.1.1:27102 lost", "peer <IP> lost"),
    ("clip_20250930120255", "clip_<TIMESTAMP>55"),
    ("clip_202509301202", "clip_<TIMESTAMP>"),
    ("screen_id: 12 on Output 3", "screen_id: <ID> on Output <NUM>"),
    (r"'<?>\\10.0.0.1\x\y.mov'", "'<URL_PATH>'"),
    (r"'<?>D:\x y\z.mov'", "'<URL_PATH>'"),
    ("n 1234567890123456 m", "n <FILE_ID> m"),
    ("n 1234567890123456_1234567890123456 m", "n 1234567890123456_<TIMESTAMP>3456 m"),
    ("h 0123456789abcdef0123456789abcdef", "h <HASH>"),
    ("//10.0.0.7/share/x: gone", "//<IP>/<SHARE_PATH>: gone"),
    ("SHM/a_1/b.pfm gone", "<REL_PATH> gone"),
    ("device 7, port 99", "device <NUM>, port <NUM>"),
    ("(LRTB: 0, 1.5, -2, 0 / Z-NF: 10, 5e+13)", "(LRTB: <COORDS>/ Z-NF: <COORDS>)"),
    ("LRTB: -nan", "LRTB: <COORDS>nan"),
    ("two\nC:\\a tail\nmore 'q'", "two\n<DRIVE_PATH>'q'"),
    ("", ""),
]
PRINTS = [
    ("7x similar to 'display sync timed out (10.1.1.1 / Output 2)'", "display sync timed out"),
    ("9x End of file", "End of file"),
    ("4x similar to something", "similar to something"),
    ("12 X abc", "abc"),
    ("'quoted'", "quoted"),
    ('"quoted"', "quoted"),
    ("transferring file from 'a' to 'b' failed: copying (1)", "transferring file from '<SOURCE>' to '<DEST>' failed: <ERROR>"),
    ("Loading '<?>a' failed: opening file 'b' failed", "loading '<FILE>' failed: opening file '<FILE>' failed"),
    ("error while enumerating Data/x* : not found (53)", "error while enumerating <PATH> : <ERROR>"),
    ("decoding 'x.jpg' failed", "decoding '<FILE>' failed: <ERROR>"),
    ("create_directories: no path.: 'C/x'", "create_directories: <ERROR>"),
    ("directory_iterator::directory_iterator: denied: \"x\"", "directory_iterator: <ERROR>"),
    ("authenticating on 'x' failed: y", "authenticating on '<PATH>' failed: <ERROR>"),
    ("updating render task failed: z", "updating render task failed: <ERROR>"),
    ("encoding frame failed: z", "encoding frame failed: <ERROR>"),
    ("assertion 'x' failed in a::b", "assertion failed in <LOCATION>"),
    ("loading module 'x' failed: y", "loading module failed: <ERROR>"),
    ("invalid projection matrix (LRTB: -nan(ind) / Z-NF: 1)", "invalid projection matrix"),
    ("automatically reloaded texture 'x' disappeared", "automatically reloaded texture disappeared"),
    ("at 10.0.0.1 now", "at <IP> now"),
    ("lost GH_5760X1416_2025.mov now", "lost <FILE> now"),
    ("lost abc.PNG now", "lost <FILE> now"),
    ("in C:/a/b/c now", "in <WIN_PATH> now"),
    ("at srv://x/y now", "at <SRV_URL> now"),
    ("in /var/x/y now", "in<UNIX_PATH> now"),
    ("in data/x now", "in<REL_PATH> now"),
    ("warp_12345_67", "warp_<NUM>"),
    ("on 2025-09-30 it", "on <TIMESTAMP> it"),
    ("n 123456789", "n <LONGNUM>"),
    ("host:27102", "host:<PORT>"),
    ("code 4711 x", "code <NUM> x"),
]


def apply(spark, values, *columns):
    rows = [(k, *(v if isinstance(v, tuple) else (v,))) for k, v in enumerate(values)]
    width = len(rows[0]) - 1
    df = spark.createDataFrame(rows, "k int, " + ", ".join(f"x{i} string" for i in range(width)))
    return [tuple(r)[1:] for r in df.select("k", *columns).orderBy("k").collect()]


def test_generalise(spark):
    assert [x for (x,) in apply(spark, [a for a, _ in MASKED], generalise(F.col("x0")))] == [b for _, b in MASKED]


def test_fingerprint(spark):
    assert [x for (x,) in apply(spark, [a for a, _ in PRINTS], fingerprint(F.col("x0")))] == [b for _, b in PRINTS]


def test_file_names(spark):
    x = F.col("x0")
    got = apply(spark, ["p-27103-1.log", "a/p-27103.log", "p-7-WRITEABLE.txt", "p-1.txt", "p-1-WRITEABLE.log"], t.parser_file_name(x), t.report_file_name(x))
    assert got == [("p-27103.log", "p-27103.log"), ("p-27103.log", "p.log"), ("p-7.txt", "p-7-WRITEABLE.txt"), ("p.txt", "p-1.txt"), ("p-1.log", "p-1.log")]


def test_paths(spark):
    x = F.col("x0")
    got = apply(spark, ["rx_logs/day1/p.log", "data/p.log", "data/sub/p.txt", "p.txt", "a/My_LOGS/b/c/x.txt"], t.log_category(x), t.log_folder(x))
    assert got == [("rx_logs", "day1"), ("p.log", ""), ("sub", "data/sub"), ("", ""), ("My_LOGS", "b/c")]


def test_counts(spark):
    x = F.col("x0")
    got = apply(spark, ["7x 'End of file'", "7x a\nb", "plain", "7X a", "99999999999999999999x a"], t.count_of(x), t.clean_of(x))
    assert got == [(7, "End of file"), (1, "7x a\nb"), (1, "plain"), (1, "7X a"), (None, "a")]


def test_short_types(spark):
    long = "w" * 60
    got = apply(spark, ["7x 'End of file'", "alpha beta: gamma", long, long + ": x", "3x similar to q", ""], t.short_type(F.col("x0")))
    assert [g for (g,) in got] == ["'End of file'", "alpha beta", "w" * 50, "w" * 47 + "...", "q", ""]


def test_categories(spark):
    got = apply(spark, [("read timeout", ""), ("the file handle is stale", ""), ("x_<TIMESTAMP>", ""), ("hello", ""), ("permission\ndenied", ""), ("x", "CODEC Error")], t.categorise(F.col("x0"), F.col("x1")))
    assert [g for (g,) in got] == ["Netzwerk", "Datei", "Zeitbezogen", "Sonstige", "Authentifizierung", "Media"]


def test_keyword_severity(spark):
    got = apply(spark, ["Warning: fatal ERROR", "errors found", "warn", "error_x", "a FATAL b", "critical, warning"], t.keyword_severity(F.col("x0")))
    assert [g for (g,) in got] == ["error", None, None, None, "fatal", "critical"]


def test_shorten(spark):
    got = apply(spark, ["at D:\\a\\b\\c\\d.txt", "at D:\\a\\d.txt", "at \\\\\\\\srv\\\\sh\\\\f.txt"], t.shorten_paths(F.col("x0")))
    assert [g for (g,) in got] == ["at ..\\\\d.txt", "at D:\\a\\d.txt", "at \\\\\\\\...\\\\f.txt"]


@pytest.mark.parametrize(("name", "value", "want"), [("generalise_paths", r"open 'D:\a\b' x", "open '<DRIVE_PATH>' x"), ("error_short_type", "a: b", "a"), ("occurrence_count", "3x y", 3), ("clean_description", "3x 'y'", "y"), ("report_file_name", "a/p-1.log", "p.log"), ("parser_file_name", "a/p-1.log", "p.log"), ("keyword_severity", "an error", "error"), ("error_fingerprint", "code 4711", "code <NUM>")])
def test_sql_functions(spark, name, value, want):
    register(spark)
    assert spark.sql(f"SELECT {name}(:x)", args={"x": value}).first()[0] == want
