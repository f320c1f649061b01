"""File trees from end to end: parsing, duplicates, archives, products, the cumulative database."""

from __future__ import annotations

import zipfile

import pytest
from pyspark.sql import functions as F

from quarrylog.operators import anonymise, dedup, parse
from quarrylog.plans import scan
from quarrylog.schemas import DETAIL_COLUMNS, SUMMARY_COLUMNS
from quarrylog.sources import archive, tables

E2 = "2024-01-02 03:04:05.678 [ERROR] {}\n"


def tree(top, files):
    for name, content in files.items():
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(top)


def kept(spark, *tops):
    records, errors = scan.structured_records(spark, list(tops))
    return records.orderBy("seq").collect(), errors.collect()


def test_same_error_in_two_files(spark, tmp_path):
    same = E2.format("Net.Read") + "not indented\n"
    rows, _ = kept(spark, tree(tmp_path, {"rx-a.txt": same, "px-a.txt": same}))
    assert [(r.logfile, r.description, r.n_rows) for r in rows] == [("px-a.txt", "", 1), ("rx-a.txt", "", 1)]


@pytest.mark.parametrize("names", [("play-27103-1.log", "play-27103-2.log"), ("play-27103-WRITEABLE.log", "play-27103.log")])
def test_split_files(spark, tmp_path, names):
    rows, _ = kept(spark, tree(tmp_path, dict.fromkeys(names, E2.format("Net.Read"))))
    assert [r.n_rows for r in rows] == [2]


def test_different_errors(spark, tmp_path):
    rows, _ = kept(spark, tree(tmp_path, {"rx-a.txt": E2.format("One"), "px-a.txt": E2.format("Two")}))
    assert {r.type for r in rows} == {"One", "Two"}


def test_layout_3(spark, tmp_path):
    line = "Mon 01.Jan.  10:00:00.{0}00 ERROR peer 10.0.0.{0}:2710{0} lost {0}000 times\n"
    content = "".join(line.format(k) for k in (1, 2, 3))
    rows, _ = kept(spark, tree(tmp_path, {"util-27110.log": content, "util-27110-1.log": content, "play-27103.log": content}))
    assert [(r.n_rows, r.date) for r in rows] == [(3, "Mon 01.Jan.  "), (6, "Mon 01.Jan.  ")]


ASSEMBLY = "01.02.2024 08:00:00\tE\tMod.Alpha\n\tfirst detail\n    second detail\nplain line ends the record\n\torphan, ignored\n01.02.2024 08:00:01\tI\tMod.Beta\n\tbelongs to a dropped severity, ignored\n01.02.2024 08:00:02\tW\tMod.Gamma\n"


def test_assembly(spark, tmp_path):
    rows, _ = kept(spark, tree(tmp_path, {"a.log": "﻿" + ASSEMBLY}))
    assert [(r.severity, r.type, r.description) for r in rows] == [("error", "Mod.Alpha", "first detail\nsecond detail"), ("warning", "Mod.Gamma", "")]


def test_blocks_do_not_matter(spark, tmp_path, monkeypatch):
    top = tree(tmp_path, {"a.log": ASSEMBLY * 5})
    one = [r.asDict() for r in kept(spark, top)[0]]
    rows = archive.lines_of(archive.read_logs(spark, [top]))
    cut = F.sum(F.col("line").rlike("^[^\t ]").cast("int")).over(__import__("pyspark").sql.Window.partitionBy("source_name").orderBy("seq"))
    many = dedup.dedup_structured(parse.parse_records(rows.withColumn("block", cut.cast("long")), ("source_name", "block")))
    assert [r.asDict() for r in many.orderBy("seq").collect()] == one


def test_archives_and_errors(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        for k, name in enumerate(("d/x.log", "d/x.txt", "d/x.LOG", "d/x.csv")):
            z.writestr(name, E2.format(f"M{k}"))
    tree(tmp_path, {"bad.zip": b"PK no archive", "good.log": E2.format("Good")})
    rows, errors = kept(spark, str(tmp_path))
    assert [r.logfile for r in rows] == ["good.log", "b.zip/d/x.log", "b.zip/d/x.txt"]
    assert [e.source_name for e in errors] == ["bad.zip"]


def test_invalid_bytes_and_line_ends(spark, tmp_path):
    rows, _ = kept(spark, tree(tmp_path, {"a.log": b"2024-01-02 03:04:05.678 [ERROR] a\xffb\r\n\tmore\r2024-01-02 03:04:05.678 [FATAL] c"}))
    assert [(r.type, r.description) for r in rows] == [("ab", "more"), ("c", "")]


def test_missing_directory(spark, tmp_path):
    with pytest.raises(Exception, match="no such directory"):
        archive.read_logs(spark, [str(tmp_path / "none")]).count()


def test_empty_directory(spark, tmp_path):
    result = scan.run(spark, scan.Options([str(tmp_path)], stem=str(tmp_path / "out/r")))
    assert result.counts["candidates"] == 0 and set(result.files) == {"detail", "summary", "statistics"}


def test_single_file(spark, tmp_path):
    top = tree(tmp_path, {"a.log": E2.format("One"), "b.log": E2.format("Two")})
    assert len(kept(spark, f"{top}/a.log")[0]) == 1


def test_keywords(spark, tmp_path):
    top = tree(tmp_path, {"a.txt": "  Error at C:\\x\\1 \n\nfine\n", "b.txt": "Error at D:\\y\\2\n", "c.log": "Error in log\n"})
    records, _ = scan.keyword_records(spark, [top])
    assert [(r.logfile, r.severity, r.text, r.n_rows) for r in records.collect()] == [("a.txt", "error", "Error at <DRIVE_PATH>", 2)]
    twice, _ = scan.keyword_records(spark, [top, top], per_input=True)
    assert sorted(r.n_rows for r in twice.collect()) == [2, 2]
    result = scan.run(spark, scan.Options([top], stem=str(tmp_path / "out/k"), keyword=True))
    assert result.counts == {"candidates": 2, "kept": 1, "skipped": 1, "detail_rows": 1}


def test_products(spark, tmp_path):
    content = "01.02.2024 08:00:00\tE\tNet\n\t7x 'End of file, \"x\"'\n\tmore\n01.02.2024 08:00:01\tW\tNet\n\t3x 'read timeout'\n"
    result = scan.run(spark, scan.Options([tree(tmp_path / "in", {"rx_logs/day/p-1.log": content})], stem=str(tmp_path / "out/r")))
    raw = (tmp_path / "out/r_detail.csv").read_bytes()
    assert raw.startswith(b"\xef\xbb\xbf") and b"\r\n" in raw
    rows = tables.read_table(spark, result.files["detail"])
    assert rows.columns == DETAIL_COLUMNS
    assert [tuple(r)[:5] + (r.Description,) for r in rows.collect()] == [("rx_logs", "day", "p.log", "p-1.log", "1", "7x 'End of file, \"x\"'\nmore"), ("rx_logs", "day", "p.log", "p-1.log", "3", "read timeout")]
    found = tables.read_table(spark, result.files["summary"])
    assert found.columns == SUMMARY_COLUMNS
    assert [(r["Fehler-Kategorie"], r["Gesamt-Vorkommen"], r["Top Logfiles (Count)"]) for r in found.collect()] == [("Netzwerk", "3", "p.log (3)"), ("Datei", "1", "p.log (1)")]
    text = (tmp_path / "out/r_statistics.txt").read_text(encoding="utf-8")
    assert "Gesamt-Vorkommen (inkl. Counts): 4\n" in text and "Netzwerk            :      3 ( 75.0%)" in text and "     3 ( 75.0%) - read timeout" in text


def test_database(spark, tmp_path):
    db = str(tmp_path / "db.csv")
    lines = [E2.format(f"T{k}") for k in range(5)]
    one = tree(tmp_path / "one", {"a.log": "".join(lines[:3])})
    two = tree(tmp_path / "two", {"a.log": lines[0] + lines[3] + lines[4]})
    counts = [scan.run(spark, scan.Options([d], database=db)).counts for d in (one, two, two)]
    assert [(c["new_rows"], c["total_rows"]) for c in counts] == [(3, 3), (2, 5), (0, 5)]
    assert [r["Type/Source"] for r in tables.read_table(spark, db).collect()] == ["T0", "T1", "T2", "T3", "T4"]


def test_new_database_and_validation(spark, tmp_path):
    from quarrylog.operators.detail import validate_database

    tables.create_database(str(tmp_path / "n.csv"))
    df = tables.read_database(spark, str(tmp_path / "n.csv"))
    assert df.columns == DETAIL_COLUMNS and tuple(validate_database(df).first()) == (0, 0)
    with pytest.raises(ValueError, match="Description"):
        validate_database(df.drop("Description"))


def test_distributed_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([('a "b" \\ c', " x ", ""), ("l1\nl2", "y", "z")], "p string, q string, r string")
    tables.write_distributed(df, str(tmp_path / "d"))
    assert sorted(map(tuple, tables.read_table(spark, str(tmp_path / "d")).collect())) == sorted(map(tuple, df.collect()))


def test_settings(tmp_path):
    p = str(tmp_path / "s.json")
    tables.save_settings(p, {"database_file": str(tmp_path / "gone"), "use_database_mode": True, "custom_temp_dir": str(tmp_path)})
    assert tables.load_settings(p) == {"use_database_mode": True, "custom_temp_dir": str(tmp_path)}
    assert tables.load_settings(str(tmp_path / "none")) == {}


def test_anonymise(spark):
    df = spark.createDataFrame([(1, "at 192.168.7.9 and \\\\srvA\\data\\x", "t 192.168.7.8"), (2, "at 192.168.7.8", "t")], "seq long, Description string, `Type/Source` string")
    got = anonymise.anonymise(df, ["Description", "Type/Source"]).orderBy("seq").collect()
    assert got[0]["Type/Source"] == "t 10.0.0.1" and got[0].Description == "at 10.0.0.2 and \\\\server_1\\share_1\\x" and got[1].Description == "at 10.0.0.1"


def test_counts_add_up(spark):
    from quarrylog.queries import _deduped, _records

    sf = "/root/testdata/sf0.001"
    c = dedup.skipped(_deduped(spark, sf)).first()
    assert c.kept + c.skipped == c.candidates == _records(spark, sf).count()


def test_partitioning_does_not_matter(spark):
    from quarrylog.plans.synthetic import event_lines

    lines = event_lines(spark, "/root/testdata/sf0.001")
    a, b = (sorted(map(tuple, dedup.dedup_structured(parse.parse_records(x)).collect())) for x in (lines, lines.repartition(13)))
    assert a == b


def test_stream(spark, tmp_path):
    from quarrylog.streaming.append import start

    source = tmp_path / "in"
    lines = lambda k: [("a.log", k * 10, f"2024-01-02 03:04:05.678 [ERROR] T{k}"), ("a.log", k * 10 + 1, "\tdetail"), ("a.log", k * 10 + 2, "2024-01-02 03:04:05.678 [ERROR] same")]
    schema = "source_name string, seq long, line string"
    for k in (1, 2):
        spark.createDataFrame(lines(k), schema).coalesce(1).write.mode("append").json(str(source))
        q = start(spark.readStream.schema(schema).json(str(source)), str(tmp_path / "t"), str(tmp_path / "c"))
        q.awaitTermination(60)
    assert sorted(r["Type/Source"] for r in spark.read.parquet(str(tmp_path / "t")).collect()) == ["T1", "T2", "same"]


@pytest.mark.parametrize("split", [1, 7, 64, 1000, 1 << 20])
def test_splits_do_not_matter(spark, tmp_path, split):
    """Ranges of any size give the same lines in the same blocks' order, and the same records, whatever ends the lines."""
    content = ("﻿" + ASSEMBLY * 3).replace("Gamma\n", "Gamma\r\n").replace("Beta\n", "Beta\r").encode() + b"\n\n2024-01-02 03:04:05.678 [ERROR] caf\xc3\xa9 \xff\n\n\tlast"
    top = tree(tmp_path, {"a.log": content, "b.txt": b"", "c.log": b"\tgoes on\n    and on", "d.txt": "x\r\n\r\ny"})
    rows = archive.read_logs(spark, [top], split=split)
    plain = [(r.source_name, r.line) for r in archive.lines_of(rows).orderBy("seq").collect()]
    text = content.decode("utf-8", "ignore").removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
    assert [x for n, x in plain if n == "a.log"] == text.split("\n")
    assert [x for n, x in plain if n == "c.log"] == ["\tgoes on", "    and on"] and [x for n, x in plain if n == "d.txt"] == ["x", "", "y"]
    records = dedup.dedup_structured(parse.parse_records(archive.lines_of(rows), scan.SCOPE)).orderBy("seq").collect()
    assert [(r.type, r.description, r.n_rows) for r in records] == [("Mod.Alpha", "first detail\nsecond detail", 3), ("Mod.Gamma", "", 3), ("café", "", 1)]


def test_uri_of_a_file_system(spark, tmp_path):
    top = tree(tmp_path, {"d/a.log": E2.format("One"), "b.log": E2.format("Two")})
    assert [r.logfile for r in kept(spark, f"file://{top}")[0]] == ["b.log", "d/a.log"]
    from quarrylog.sources.archive import _listed, _opened

    alone, found = _listed(top)
    assert not alone and sorted(n for _, n, _ in found) == ["b.log", "d/a.log"]
    with _opened(found[0][0]) as f:
        assert f.read(4) == b"2024"


def test_errors_of_the_same_scan(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("x.log", E2.format("M"))
    top = tree(tmp_path, {"bad.zip": b"PK no archive", "good.log": E2.format("Good")})
    said = []
    result = scan.run(spark, scan.Options([top], stem=str(tmp_path / "out/r"), progress=said.append))
    assert [e.source_name for e in result.errors.collect()] == ["bad.zip"]
    assert said[0] == f"reading {top}" and "2 files read, 1 of them in archives" in said and any("bad.zip" in x for x in said)
    assert [x for x in said if x.startswith("written")] == [f"written: {p}" for p in result.files.values()]


def test_cancelled_run_writes_nothing(spark, tmp_path):
    top = tree(tmp_path, {"a.log": E2.format("One")})
    with pytest.raises(scan.Cancelled):
        scan.run(spark, scan.Options([top], stem=str(tmp_path / "out/r"), cancelled=lambda: True))
    asked = []
    with pytest.raises(scan.Cancelled):  # while it runs
        scan.run(spark, scan.Options([top], stem=str(tmp_path / "out/r"), cancelled=lambda: asked.append(1) or len(asked) > 1))
    assert not list((tmp_path / "out").iterdir())
    assert scan.run(spark, scan.Options([top], stem=str(tmp_path / "out/r"), cancelled=lambda: False)).counts["kept"] == 1


def test_outputs_are_probed_first(spark, tmp_path):
    (tmp_path / "file").write_text("x")
    top = tree(tmp_path / "in", {"a.log": E2.format("One")})
    said = []
    with pytest.raises(OSError):
        scan.run(spark, scan.Options([top], stem=str(tmp_path / "file/r"), progress=said.append))
    assert not said


def test_anonymised_products(spark, tmp_path):
    content = E2.format("peer \\\\srvA\\data lost") + "\tread from \\\\srvB\\data timed out\n" + E2.format("peer \\\\srvB\\more lost")
    result = scan.run(spark, scan.Options([tree(tmp_path / "in", {"a.log": content})], stem=str(tmp_path / "out/r"), anonymise=True, distributed=True))
    rows = tables.read_table(spark, result.files["detail"]).collect()
    assert result.counts["detail_rows"] == len(rows) == 2
    text = " ".join(r["Type/Source"] + r.Description for r in rows)
    assert "srvA" not in text and "srvB" not in text
    assert set(result.counts) >= {"anonymised_address", "anonymised_server", "anonymised_share"}


def test_guards_change_nothing(spark):
    """Rules applied with guards give what each rule in turn gives without, also where case folds from beyond ASCII."""
    from quarrylog.functions import rules

    texts = ["7x ſimilar to 'x'", "\u212amov a1.\u212akv b2.MKV", "ENCODING frame failed: ü", "Encoding Frame failed: x", "see 'd:/x/y' and \\\\s\\t\\u", "_20240101120000 a_id: 7 Output 3", None, "", "srv://10.0.0.1/s/f.mov port 77 LRTB: 1.0, 2 Z-NF: 3e+4"]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    for chosen in (rules.GENERALISE, rules.FINGERPRINT, rules.SHORTEN):
        plain = F.col("t")
        for r in chosen:
            plain = F.regexp_replace(plain, rules.java(r.pattern, r.ignore_case), r.replacement.replace("\\", "\\\\"))
        assert df.select(rules.apply_rules(F.col("t"), chosen).alias("x")).collect() == df.select(plain.alias("x")).collect()
