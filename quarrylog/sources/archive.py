"""Log files and ZIP archives as lines, read by executors in Arrow batches.

``spark.read.format("logarchive")`` lists files below its paths on the driver. A plain file is
cut into ranges of ``splitBytes``; a range begins at the first line that continues no other, at
or after its first byte, and reads on to where the next one begins, so any size of the ranges
gives the same lines. An archive is one partition, its members read in archive order. Lines
come in blocks that begin at lines which continue no other, so that later windows never hold
a whole file. Invalid bytes are dropped. Paths may be URIs of any file system that pyarrow knows.
"""

from __future__ import annotations

import os
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "input_ord int, class_ord int, source_name string, member_ord int, block long, line_no long, line string, error string"
#: Lines in a block, and in an Arrow batch, about; bytes of a range; bytes that are read at once.
BLOCK_LINES, BATCH_LINES, SPLIT, READ = 100_000, 8192, 64 << 20, 1 << 22
# Where archive members' lines end, beyond line feed and carriage return.
MEMBER_BREAKS = "\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
CONTINUES = (b"\t", b"    ")


class FilePartition(InputPartition):
    def __init__(self, input_ord: int, class_ord: int, path: str, name: str, start: int = 0, stop: int | None = None):
        super().__init__(f"{path}:{start}")
        self.input_ord, self.class_ord, self.path, self.name, self.start, self.stop = input_ord, class_ord, path, name, start, stop


def _listed(top: str) -> tuple[bool, list[tuple[str, str, int]]]:
    """Whether a path is a file itself, and (path, name, size) of all files in it."""
    top = top.removeprefix("file://")
    if "://" not in top:
        if not os.path.exists(top):
            raise ValueError(f"no such directory: {top}")
        if os.path.isfile(top):
            return True, [(top, os.path.basename(top), os.path.getsize(top))]
        found = [os.path.join(d, f) for d, _, files in os.walk(top) for f in files]
        return False, [(p, os.path.relpath(p, top), os.path.getsize(p)) for p in found if os.path.exists(p)]
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(top)
    info = system.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise ValueError(f"no such directory: {top}")
    if info.type == fs.FileType.File:
        return True, [(top, info.base_name, info.size)]
    files = [x for x in system.get_file_info(fs.FileSelector(root, recursive=True)) if x.type == fs.FileType.File]
    whole = lambda p: top.rstrip("/") + p.removeprefix(root.rstrip("/"))
    return False, [(whole(x.path), x.path.removeprefix(root.rstrip("/")).lstrip("/"), x.size) for x in files]


def _opened(path: str):
    if "://" not in path:
        return open(path, "rb")
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path)
    return system.open_input_file(place)


def _lines(stream, offset: int) -> Iterator[tuple[int, bytes]]:
    """(offset of its first byte, line without its end) of a binary stream that stands at ``offset``."""
    rest, done = b"", False
    while not done:
        data = stream.read(READ)
        done = not data
        parts = (rest + data).splitlines(keepends=True)
        # A last line may go on, and a line feed may follow a carriage return.
        rest = b"" if done or not parts or parts[-1].endswith(b"\n") else parts.pop()
        for part in parts:
            yield offset, part.rstrip(b"\r\n") if part.endswith((b"\r\n", b"\n", b"\r")) else part
            offset += len(part)


def _range(stream, start: int, stop: int | None) -> Iterator[tuple[int, bytes]]:
    """The lines of a range. Lines that continue one before ``start`` belong to the range before."""
    stream.seek(max(0, start - 1))
    lines = _lines(stream, max(0, start - 1))
    if start:
        next(lines, None)
    begun = not start
    for at, line in lines:
        goes_on = line.startswith(CONTINUES)
        if stop is not None and at >= stop and not goes_on:
            return
        begun = begun or not goes_on
        if begun:
            yield at, line


def _decoded(line: bytes, first: bool, member: bool) -> list[str]:
    text = line.decode("utf-8", "ignore")
    if first:
        text = text.removeprefix("\ufeff")
    return (text.splitlines() or [""]) if member and any(c in text for c in MEMBER_BREAKS) else [text]


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = [p for p in options.get("paths", options.get("path", "")).split("\n") if p]
        self.suffixes = tuple(options.get("suffixes", ".log,.txt").split(","))
        self.split = int(options.get("splitbytes", options.get("splitBytes", SPLIT)))
        if not self.paths:
            raise ValueError("no path given")

    def partitions(self) -> list[InputPartition]:
        """Ranges of files in order of input, class (each suffix in turn, archives last), path and place."""
        out = []
        classes = [*self.suffixes, ".zip"]
        for k, top in enumerate(self.paths):
            alone, found = _listed(top)
            for path, name, size in found:
                for c, suffix in enumerate(classes):
                    if path.endswith(suffix) or suffix == ".zip" and alone and self._is_zip(path):
                        starts = range(0, max(1, size), self.split) if c < len(self.suffixes) else [0]
                        out += [FilePartition(k, c, path, name, a, a + self.split if a + self.split < size and c < len(self.suffixes) else None) for a in starts]
                        break
        return sorted(out, key=lambda p: (p.input_ord, p.class_ord, p.path, p.start)) or [FilePartition(-1, -1, "", "")]

    @staticmethod
    def _is_zip(path: str) -> bool:
        with _opened(path) as f:
            return zipfile.is_zipfile(f)

    def read(self, partition: FilePartition) -> Iterator:
        p = partition
        if not p.path:
            return
        if p.class_ord < len(self.suffixes):
            yield from self._file(p, p.name, 0, lambda: _opened(p.path), False)
            return
        try:
            with _opened(p.path) as f, zipfile.ZipFile(f) as z:
                for k, member in enumerate(z.infolist()):
                    if member.filename.endswith(self.suffixes):
                        yield from self._file(p, f"{os.path.basename(p.path)}/{member.filename}", k, lambda m=member: z.open(m), True)
        except Exception as e:  # one bad archive never ends the scan
            yield self._batch(p, p.name, 0, [0], [None], [None], f"{type(e).__name__}: {e}")

    def _file(self, p: FilePartition, name: str, member: int, opened, is_member: bool) -> Iterator:
        """Blocks are named by the place of their first line, lines by theirs: bytes in a plain file, lines in an archive."""
        if not p.start:
            yield self._batch(p, name, member, [0], [None], [None])  # a row for the file itself
        block, held = p.start, 0
        blocks: list[int] = []
        places: list[int] = []
        texts: list[str] = []
        try:
            with opened() as f:
                k = 0
                for at, raw in _lines(f, 0) if is_member else _range(f, p.start, p.stop):
                    for text in _decoded(raw, at == 0, is_member):
                        place = k if is_member else at
                        k += 1
                        if held >= BLOCK_LINES and not text.startswith(("\t", "    ")):
                            block, held = place, 0
                        held += 1
                        blocks.append(block)
                        places.append(place)
                        texts.append(text)
                    if len(texts) >= BATCH_LINES:
                        yield self._batch(p, name, member, blocks, places, texts)
                        blocks, places, texts = [], [], []
            if texts:
                yield self._batch(p, name, member, blocks, places, texts)
        except Exception as e:
            if texts:
                yield self._batch(p, name, member, blocks, places, texts)
            yield self._batch(p, name, member, [block], [None], [None], f"{type(e).__name__}: {e}")

    @staticmethod
    def _batch(p: FilePartition, name: str, member: int, blocks: list, places: list, texts: list, error: str | None = None):
        import pyarrow as pa

        n = len(texts)
        columns = [pa.array([p.input_ord] * n, pa.int32()), pa.array([p.class_ord] * n, pa.int32()), pa.array([name] * n, pa.string()), pa.array([member] * n, pa.int32()), pa.array(blocks, pa.int64()), pa.array(places, pa.int64()), pa.array(texts, pa.string()), pa.array([error] * n, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["input_ord", "class_ord", "source_name", "member_ord", "block", "line_no", "line", "error"])


class LogArchive(DataSource):
    """The ``logarchive`` format. Options: paths (one a line), suffixes and splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "logarchive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options)


def read_logs(spark: SparkSession, paths: list[str], suffixes: tuple[str, ...] = (".log", ".txt"), split: int = SPLIT) -> DataFrame:
    """All rows of the source: lines, and (line_no null) a row for each file or archive member and errors of those that could not be read."""
    from pyspark.sql import functions as F

    spark.dataSource.register(LogArchive)
    rows = spark.read.format("logarchive").option("paths", "\n".join(paths)).option("suffixes", ",".join(suffixes)).option("splitBytes", str(split)).load()
    order = F.struct("input_ord", "class_ord", "source_name", "member_ord", "line_no")
    return rows.withColumn("seq", order)


def lines_of(rows: DataFrame) -> DataFrame:
    return rows.where("line_no IS NOT NULL").drop("error")


def errors_of(rows: DataFrame) -> DataFrame:
    return rows.where("error IS NOT NULL").select("input_ord", "source_name", "member_ord", "error")
