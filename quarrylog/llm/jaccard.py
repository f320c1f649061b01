"""Operator 10: n-gram Jaccard join, by rare-first prefix filtering.

A document is the set of its distinct 5-word shingles, as 64-bit hashes. Documents with one
set form a class, and classes are joined: two sets of Jaccard similarity >= 0.8 share an
n-gram among the first ``n - ceil(0.8 n) + 1`` of each in any fixed order of all n-grams.
The order is rare first, by a sketch of all shingle counts, so that common passages stay
out of the prefixes. Candidates share a prefix n-gram and pass the length filter (sizes
within 0.8 of each other) and the positional filter (what is left after the shared n-gram
can still suffice). A suffix filter bounds what two sets share by the numbers of elements
that they have in each of 128 ranges of the hash order; it needs 256 bytes a set and leaves
few pairs but links. At last the whole sets decide, once per pair.

What counts is the components of the links, so a long list of classes with a common prefix
n-gram is not expanded into all its pairs. Short lists give all pairs, long ones at first
those with the next and with the smallest member. Once these links have made components,
another round links neighbours of different components, in another order for each list,
and the last round gives the pairs that are still open, between members of
different components, all of them: no link between components is lost. Lists are salted by
their estimated length. In the last round a long list is cut into tiles, by the sizes of sets
and by hashes: each takes a bounded number of the list's rows and of those outside the list's
largest component, whose members need not meet.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, discard, hash_words, column_bytes, find_words, materialize, mix64, slices
from .components import merge_components

WORDS, NUM, DEN = 5, 80, 100
#: Bits of the sketch of shingle counts, and of its parts as they travel.
BITS, CHUNK = 22, 1 << 16
_COUNTS = ("<u1", "<u2", "<u4", "<u8")
#: Lists up to this length give all pairs at once. Rows of a list in one part, about: where rows meet
#: neighbours (the first rounds), and on each side of a tile, where all meet all (the last).
SHORT, PART, SIDE = 4, 250, 1000
#: Growth of the sizes of sets from one band to the next, a little above what the length filter allows.
BAND = 1.26
#: Leading bits of a cid that flags tell apart, at least and at most; about 16 flags for each cid between.
_LEAST, _MOST = 16, 26
#: Ranges of the suffix filter; rounds between the first and the last, and how far a row looks in them.
RANGES, ROUNDS, REACH = 128, 1, 16

_P = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(column, seed: int = 0) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted distinct shingle hashes of each row of an Arrow string column."""
    raw, offsets = column_bytes(column)
    starts, ends, counts = find_words(raw, offsets)
    w = hash_words(raw, starts, ends)
    w = mix64(w + np.uint64(seed) * _P) if seed else w
    row = np.concatenate([[0], np.cumsum(counts)])
    acc, short = w, {}
    for j in range(1, WORDS):
        few = np.flatnonzero(counts == j)
        if len(few):
            short |= dict(zip(few.tolist(), mix64(acc[row[few]] + np.uint64(j)), strict=True))
        acc = mix64(acc[:-1] * _P + w[j:]) if len(acc) > 1 else acc[:0]
    out = []
    for k, n in enumerate(counts.tolist()):
        if n >= WORDS:
            s = np.sort(acc[row[k] : row[k] + n - WORDS + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        else:
            out.append(np.array([short[k]], dtype=np.uint64) if n else np.zeros(0, dtype=np.uint64))
    return out, counts


def fingerprints(s: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit fingerprints of a set, signed."""
    with np.errstate(over="ignore"):
        one, two = mix64(s ^ _P).sum(dtype=np.uint64), mix64(s + _P).sum(dtype=np.uint64)
        pair = mix64(np.array([one + np.uint64(len(s)), two], dtype=np.uint64))
    return tuple(pair.view(np.int64).tolist())


def _signatures(docs: DataFrame, seed: int) -> DataFrame:
    """One pass over all texts: a row a document (kind 0), and each partition's counts of shingles by hash (kind 1)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        counts = np.zeros(1 << BITS, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                sets, _ = shingle_sets(part["text"], seed)
                whole = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
                slot, times = np.unique((whole >> np.uint64(64 - BITS)).astype(np.int32), return_counts=True)
                counts[slot] += times
                prints = [fingerprints(s) for s in sets]
                m = len(sets)
                row = np.repeat(np.arange(m), [len(s) for s in sets])
                ranges = np.bincount(row * RANGES + (whole >> np.uint64(57)).astype(np.int64), minlength=m * RANGES).reshape(m, RANGES)
                ranges = [r.tobytes() for r in np.minimum(ranges, 65535).astype("<u2")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([0] * m, pa.int32()), part["doc_id"].cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([a for a, _ in prints], pa.int64()), pa.array([b for _, b in prints], pa.int64()), pa.nulls(m, pa.int32()), pa.array(ranges, pa.binary())],
                    names=["kind", "doc_id", "n", "cid", "check", "chunk", "payload"],
                )
        if counts.any():
            part_id = TaskContext.get().partitionId()
            # The narrowest type that holds all of a chunk.
            parts = (counts[k : k + CHUNK] for k in range(0, len(counts), CHUNK))
            chunks = [zlib.compress(c.astype(next(t for t in _COUNTS if c.max() <= np.iinfo(t).max)).tobytes(), 1) for c in parts]
            m = len(chunks)
            yield pa.RecordBatch.from_arrays(
                [pa.array([1] * m, pa.int32()), pa.array([part_id] * m, pa.int64()), *[pa.nulls(m, pa.int64())] * 3, pa.array(range(m), pa.int32()), pa.array(chunks, pa.binary())],
                names=["kind", "doc_id", "n", "cid", "check", "chunk", "payload"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "kind int, doc_id long, n long, cid long, check long, chunk int, payload binary")


def _sketch(parts: DataFrame) -> np.ndarray:
    """Sum of all partitions' counts, in a tree of two levels; the driver gets 2^BITS numbers."""

    def add(table):
        import pyarrow as pa

        total = np.zeros(CHUNK, dtype=np.uint64)
        for x in table["payload"].to_pylist():
            x = zlib.decompress(x)
            total += np.frombuffer(x, dtype=f"<u{len(x) // CHUNK}")
        return pa.table({"chunk": pa.array([table["chunk"][0].as_py()], pa.int32()), "payload": pa.array([zlib.compress(total.astype("<u8").tobytes(), 1)], pa.binary())})

    wide = max(1, int(parts.select(F.max("doc_id")).first()[0] or 0) + 1)
    groups = max(1, int(wide**0.5))
    half = parts.groupBy("chunk", (F.col("doc_id") % groups).alias("g")).applyInArrow(add, "chunk int, payload binary")
    rows = half.groupBy("chunk").applyInArrow(add, "chunk int, payload binary").collect()
    out = np.zeros(1 << BITS, dtype=np.uint32)
    for r in rows:
        out[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.minimum(np.frombuffer(zlib.decompress(bytes(r.payload)), dtype="<u8"), 0xFFFFFFFF)
    return out


def prefix_length(n: int) -> int:
    return n - -(-NUM * n // DEN) + 1


def _prefixes(docs: DataFrame, seed: int, sketch) -> DataFrame:
    """(token, cid, n, pos, salt): the prefix of each class; salt is -1 for lists that are not split. A class may come from several partitions."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counts = sketch.value
        usual = int(counts.mean()) * 4
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch, "text"):
                tokens, cids, sizes, places = [], [], [], []
                for s in shingle_sets(part["text"], seed)[0]:
                    n = len(s)
                    if not n or (cid := fingerprints(s)[0]) in seen:
                        continue
                    seen.add(cid)
                    p = prefix_length(n)
                    often = counts[(s >> np.uint64(64 - BITS)).astype(np.int64)]
                    if p < n:
                        first = np.argpartition(often, p - 1)[:p]
                        limit = often[first].max()
                        first = np.flatnonzero(often <= limit)
                        s, often = s[first], often[first]
                    order = np.lexsort((s, often))[:p]
                    tokens.append(s[order])
                    cids.append(np.full(p, cid, dtype=np.int64))
                    sizes.append(np.full(p, n, dtype=np.int64))
                    places.append(np.arange(1, p + 1, dtype=np.int64))
                if tokens:
                    token, cid = np.concatenate(tokens), np.concatenate(cids)
                    expected = counts[(token >> np.uint64(64 - BITS)).astype(np.int64)].astype(np.int64)
                    split = np.where(expected > usual + PART, (expected - usual) // PART + 1, 1)
                    salt = np.where(split > 1, (cid.view(np.uint64) % split.astype(np.uint64)).astype(np.int64), -1)
                    yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(cid), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(places)), pa.array(salt.astype(np.int32))], names=["token", "cid", "n", "pos", "salt"])

    return docs.select("text").mapInArrow(run, "token long, cid long, n long, pos long, salt int")


def may_link(n1, p1, n2, p2):
    """Length and positional filters, for a shared n-gram at 1-based places p1 and p2."""
    lengths = (DEN * n1 >= NUM * n2) & (DEN * n2 >= NUM * n1)
    best = 1 + np.minimum(n1 - p1, n2 - p2)
    return lengths & ((DEN + NUM) * best >= NUM * (n1 + n2))


def _columns(batches: Iterator, names: tuple[str, ...]) -> list[np.ndarray]:
    """All rows of a partition, by column. Partitions are sized for that (see ``_partitions``)."""
    parts = [[column_bytes(b[x])[0].view("<u2").reshape(-1, RANGES) if x == "ranges" else np.asarray(b[x]) for x in names] for b in batches]
    return [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros((0, RANGES) if x == "ranges" else 0, dtype=np.int64) for x in names]


def may_share(x: np.ndarray, n1: np.ndarray, y: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """Suffix filter: whether sets with these numbers of elements by range can be links. A full counter bounds nothing."""
    full = (x == 65535).any(axis=1) | (y == 65535).any(axis=1)
    return full | ((DEN + NUM) * np.minimum(x, y).sum(axis=1, dtype=np.int64) >= NUM * (n1 + n2))


def _pairs_batch(a: np.ndarray, b: np.ndarray):
    """Distinct unordered pairs as an Arrow batch of kind 0."""
    import pyarrow as pa

    lo, hi = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((hi, lo))
    lo, hi = lo[order], hi[order]
    new = np.ones(len(lo), dtype=bool)
    new[1:] = (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
    lo, hi = lo[new & (lo != hi)], hi[new & (lo != hi)]
    m = len(lo)
    return pa.RecordBatch.from_arrays([pa.array(np.zeros(m, dtype=np.int32)), pa.array(lo), pa.array(hi), *[pa.nulls(m, pa.int64())] * 2], names=["kind", "a", "b", "n", "pos"])


_PAIRS = "kind int, a long, b long, n long, pos long"


def _first_round(rows: DataFrame, partitions: int) -> DataFrame:
    """Pairs (kind 0: a, b) of short lists, and of long ones those with the next and the first; rows of long and split lists (kind 1: a = token, b = cid, n, pos)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        token, cid, n, pos, salt = _columns(batches, ("token", "cid", "n", "pos", "salt"))
        order = np.argsort(token, kind="stable")
        t = token[order]
        again = np.zeros(len(t), dtype=bool)
        again[1:] = t[1:] == t[:-1]
        twice = again.copy()
        twice[:-1] |= again[1:]
        rows_ = order[twice | (salt[order] >= 0)]
        token, cid, n, pos, salt = (x[rows_] for x in (token, cid, n, pos, salt))
        order = np.lexsort((cid, n, salt, token))
        token, cid, n, pos, salt = (x[order] for x in (token, cid, n, pos, salt))
        if not len(token):
            return
        same = (token[1:] == token[:-1]) & (salt[1:] == salt[:-1])
        keep = np.concatenate([[True], ~(same & (cid[1:] == cid[:-1]))])
        token, cid, n, pos, salt = (x[keep] for x in (token, cid, n, pos, salt))
        begins = np.concatenate([[True], (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])])
        first = np.flatnonzero(begins)
        length = np.diff(np.concatenate([first, [len(token)]]))
        head, size = np.repeat(first, length), np.repeat(length, length)
        i = np.arange(len(token))
        left, right = [], []
        for d in range(1, SHORT):
            j = i[(i - head >= d) & ((size <= SHORT) | (d == 1))]
            ok = may_link(n[j - d], pos[j - d], n[j], pos[j])
            left.append(j[ok] - d)
            right.append(j[ok])
        j = i[(size > SHORT) & (i - head > 1)]
        ok = may_link(n[head[j]], pos[head[j]], n[j], pos[j])
        left.append(head[j[ok]])
        right.append(j[ok])
        yield _pairs_batch(cid[np.concatenate(left)], cid[np.concatenate(right)])
        open_ = (size > SHORT) | (salt >= 0)
        m = int(open_.sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(m, dtype=np.int32)), pa.array(token[open_]), pa.array(cid[open_]), pa.array(n[open_]), pa.array(pos[open_])], names=["kind", "a", "b", "n", "pos"])

    return rows.repartition(partitions, "token", "salt").mapInArrow(run, _PAIRS)


def _open_lists(rows: DataFrame, comps: DataFrame, name: str) -> DataFrame:
    """Rows (token, cid, n, pos, comp) of lists that hold more than one component, with the list's length and its largest component.

    What is known of the lists is written first: Spark broadcasts it while it is small, and can
    split a hot list's rows in the join beyond.
    """
    labels = comps.select(F.col("node").alias("_v"), F.col("component").alias("_c"))
    rows = rows.join(labels, F.col("cid") == F.col("_v"), "left").withColumn("comp", F.coalesce("_c", "cid")).drop("_v", "_c")
    rows = materialize(rows, "jaccard-labelled")
    by = rows.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("c"))
    by = by.groupBy("token").agg(F.count(F.lit(1)).alias("k"), F.max(F.struct("c", "comp"))["comp"].alias("major"), F.sum("c").alias("total")).where("k > 1")
    by = materialize(by.select(F.col("token").alias("_t"), "major", "total"), "jaccard-by-list")
    out = materialize(rows.join(by, F.col("token") == F.col("_t")).drop("_t"), name)
    discard(rows, by)
    return out


def _next_round(rows: DataFrame, partitions: int, step: int) -> DataFrame:
    """Of each row of a list, the first row of another component among the next ones that may be a link; in an order of the list's and the round's own."""

    def run(batches: Iterator) -> Iterator:
        token, salt, cid, n, pos, comp, ranges = _columns(batches, ("token", "salt", "cid", "n", "pos", "comp", "ranges"))
        key = mix64(mix64(token.view(np.uint64) + np.uint64(step)) ^ cid.view(np.uint64))
        order = np.lexsort((key, salt, token))
        left, right = [], []
        free = np.ones(len(order), dtype=bool)
        for d in range(1, min(REACH, len(order) - 1) + 1):
            at = np.flatnonzero(free[:-d])
            a, b = order[at], order[at + d]
            ok = (token[a] == token[b]) & (salt[a] == salt[b]) & (comp[a] != comp[b]) & may_link(n[a], pos[a], n[b], pos[b])
            at, a, b = at[ok], a[ok], b[ok]
            ok = may_share(ranges[a], n[a], ranges[b], n[b])
            free[at[ok]] = False
            left.append(cid[a[ok]])
            right.append(cid[b[ok]])
        if left:
            yield _pairs_batch(np.concatenate(left), np.concatenate(right))

    salted = rows.withColumn("salt", F.pmod(F.xxhash64("cid", F.lit(step)), F.ceil(F.col("total") / PART)))
    return salted.select("token", "salt", "cid", "n", "pos", "comp", "ranges").repartition(partitions, "token", "salt").mapInArrow(run, _PAIRS)


def _tiles(rows: DataFrame) -> DataFrame:
    """Adds ``copies``: the tiles (salt) of its list that a row goes to, and its role there.

    A list of up to SIDE rows is one tile, where each row is its own (role 0) and, outside the
    largest component, a probe as well (role 1). The rows of a longer list fall into bands of set
    size, so that links lie in one band or in two next to each other, and those of a band into
    parts of about SIDE rows. A tile takes one part's own rows (role 0) and one part of the probes
    (role 2) of a band that may hold links of theirs: no task gets more of a list, however long.
    """
    minor = F.col("comp") != F.col("major")
    short = F.array(F.struct(F.lit(0).cast("long").alias("salt"), F.when(minor, 1).otherwise(0).alias("role")))
    banded = rows.where(F.col("total") > SIDE).withColumn("band", F.floor(F.log("n") / math.log(BAND)))
    sizes = banded.groupBy("token", "band").agg(F.ceil(F.count(F.lit(1)) / SIDE).alias("own"), F.ceil(F.count_if(minor) / SIDE).alias("probes"))
    near = F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("_b")
    # At most three bands for each row, of as many parts as a list's length asks for.
    around = sizes.select(F.col("token").alias("_t"), near, F.struct("band", "own", "probes").alias("s")).groupBy("_t", "_b").agg(F.collect_list("s").alias("around"))
    banded = banded.join(around, (F.col("token") == F.col("_t")) & (F.col("band") == F.col("_b"))).drop("_t", "_b")
    at_home = lambda kind: F.filter("around", lambda s: s["band"] == F.col("band"))[0][kind]
    i, j = F.pmod(F.xxhash64("cid"), at_home("own")), F.pmod(F.xxhash64("cid", F.lit(1)), F.greatest(at_home("probes"), F.lit(1)))
    count = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    tile = lambda *place, role: F.struct(F.xxhash64(*place).alias("salt"), F.lit(role).alias("role"))
    own = F.flatten(F.transform(F.filter("around", lambda s: s["probes"] > 0), lambda s: F.transform(count(s["probes"]), lambda k: tile(F.col("band"), i, s["band"], k, role=0))))
    probe = F.flatten(F.transform("around", lambda s: F.transform(count(s["own"]), lambda k: tile(s["band"], k, F.col("band"), j, role=2))))
    long = F.when(minor, F.concat(own, probe)).otherwise(own)
    columns = ["token", "cid", "n", "pos", "comp", minor.alias("minor")]
    return rows.where(F.col("total") <= SIDE).select(*columns, short.alias("copies")).union(banded.select(*columns, long.alias("copies")).where(F.size("copies") > 0))


def _last_round(rows: DataFrame, partitions: int) -> DataFrame:
    """All pairs of different components that may be links, by the tiles of ``_tiles``; pairs within a list's largest component are none."""

    def run(batches: Iterator) -> Iterator:
        token, salt, cid, n, pos, comp, minor, role, ranges = _columns(batches, ("token", "salt", "cid", "n", "pos", "comp", "minor", "role", "ranges"))
        order = np.lexsort((role, salt, token))
        token, salt, cid, n, pos, comp, minor, role, ranges = (x[order] for x in (token, salt, cid, n, pos, comp, minor, role, ranges))
        if not len(token):
            return
        begins = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])]))
        ends = np.concatenate([begins[1:], [len(token)]])
        left, right, held = [], [], 0
        for a, z in zip(begins.tolist(), ends.tolist(), strict=True):
            first, m = a + int(np.searchsorted(role[a:z], 1)), a + int(np.searchsorted(role[a:z], 2))
            own = slice(a, m)
            for lo in range(first, z if m > a else first, 64):
                q = np.arange(lo, min(z, lo + 64))
                # Two rows outside the largest component meet twice: once is enough.
                once = (minor[own] == 0)[None] | (cid[q, None] > cid[None, own])
                ok = may_link(n[q, None], pos[q, None], n[None, own], pos[None, own]) & (comp[q, None] != comp[None, own]) & once
                x, y = np.nonzero(ok)
                x, y = q[x], a + y
                for k in range(0, len(x), 1 << 15):
                    i, j = x[k : k + (1 << 15)], y[k : k + (1 << 15)]
                    ok = may_share(ranges[i], n[i], ranges[j], n[j])
                    left.append(cid[i[ok]])
                    right.append(cid[j[ok]])
                    held += len(left[-1])
                if held > 1 << 20:
                    yield _pairs_batch(np.concatenate(left), np.concatenate(right))
                    left, right, held = [], [], 0
        if left:
            yield _pairs_batch(np.concatenate(left), np.concatenate(right))

    dealt = rows.withColumn("copy", F.explode("copies"))
    dealt = dealt.select("token", "copy.salt", "cid", "n", "pos", "comp", F.col("minor").cast("int").alias("minor"), "copy.role", "ranges")
    return dealt.repartition(partitions, "token", "salt").mapInArrow(run, _PAIRS)


def _sharing(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The distinct pairs that pass the suffix filter."""

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            a, b, n1, n2 = (np.asarray(batch[x]) for x in ("a", "b", "n1", "n2"))
            x, y = (column_bytes(batch[x])[0].view("<u2").reshape(-1, RANGES) for x in ("x", "y"))
            ok = may_share(x, n1, y, n2)
            yield _pairs_batch(a[ok], b[ok]).select(["a", "b"])

    side = lambda k, n, h: classes.select(F.col("cid").alias(f"_{k}"), F.col("n").alias(n), F.col("ranges").alias(h))
    joined = pairs.select("a", "b").distinct().join(side("a", "n1", "x"), F.col("a") == F.col("_a")).join(side("b", "n2", "y"), F.col("b") == F.col("_b"))
    return joined.select("a", "b", "n1", "n2", "x", "y").mapInArrow(run, "a long, b long")


class Presence:
    """Flags for the leading bits of all cids of a table, as 64-bit words; the driver gets 2^20 words at most.

    Where they are too few to tell cids apart, more sets travel than are asked for: all of them at most.
    """

    def __init__(self, cids: DataFrame, count: int):
        self.bits = min(_MOST, max(_LEAST, (16 * count).bit_length()))
        slot = F.shiftrightunsigned("cid", 64 - self.bits)
        rows = cids.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("k")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("m")).toArrow()
        self.words = np.zeros(1 << (self.bits - 6), dtype=np.uint64)
        self.words[np.asarray(rows["k"])] = np.asarray(rows["m"]).view(np.uint64)

    def __call__(self, cids: np.ndarray) -> np.ndarray:
        slot = cids.view(np.uint64) >> np.uint64(64 - self.bits)
        return (self.words[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("cid")).union(pairs.select(F.col("b").alias("cid")))


def _sets(docs: DataFrame, seed: int, flags: Presence) -> DataFrame:
    """(cid, elements) of classes whose cid's leading bits are flagged."""
    present = docs.sparkSession.sparkContext.broadcast(flags)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        wanted, seen = present.value, set()
        for batch in batches:
            for part in slices(batch, "text"):
                found = [s for s in shingle_sets(part["text"], seed)[0] if len(s)]
                every = np.array([fingerprints(s)[0] for s in found], dtype=np.int64)
                cids, sets = [], []
                for s, cid, asked in zip(found, every.tolist(), wanted(every).tolist(), strict=True):
                    if asked and cid not in seen:
                        seen.add(cid)
                        cids.append(cid)
                        sets.append(s.tobytes())
                if cids:
                    yield pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), pa.array(sets, pa.binary())], names=["cid", "elements"])

    return docs.select("text").mapInArrow(run, "cid long, elements binary").groupBy("cid").agg(F.first("elements").alias("elements"))


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether 100 times the intersection is at least 80 times the union, of sorted distinct arrays."""
    need = -(-NUM * (len(x) + len(y)) // (DEN + NUM))
    if min(len(x), len(y)) < need:
        return False
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum()) >= need


def _asked(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The sets that pairs ask for, and few others."""
    present = sets.sparkSession.sparkContext.broadcast(Presence(_ends(pairs), 2 * pairs.count()))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            yield batch.filter(pa.array(present.value(np.asarray(batch["cid"]))))

    return sets.mapInArrow(run, "cid long, elements binary")


def _verify(pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """The pairs (a, b) that are links."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            a, b = batch["a"].to_pylist(), batch["b"].to_pylist()
            good = [linked(np.frombuffer(x.as_py(), dtype=np.uint64), np.frombuffer(y.as_py(), dtype=np.uint64)) for x, y in zip(batch["x"], batch["y"], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([v for v, ok in zip(a, good, strict=True) if ok], pa.int64()), pa.array([v for v, ok in zip(b, good, strict=True) if ok], pa.int64())], names=["a", "b"])

    x, y = sets.select(F.col("cid").alias("_a"), F.col("elements").alias("x")), sets.select(F.col("cid").alias("_b"), F.col("elements").alias("y"))
    joined = pairs.join(x, F.col("a") == F.col("_a")).join(y, F.col("b") == F.col("_b")).select("a", "b", "x", "y")
    return materialize(joined.mapInArrow(run, "a long, b long"), f"{name}-links")


def _partitions(spark: SparkSession, rows: int, most: int = 1 << 20) -> int:
    """So many that a partition has about ``most`` rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // most))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, n_shingles, component_id (smallest doc_id that links reach).

    Null and empty texts, and those without words, have no shingles and no links. A text of
    fewer than five words is one shingle. Equal sets are linked. Null ids are not smallest,
    unless all are null. A repeated row is a document of its own. Other columns are not read.
    """
    spark = docs.sparkSession
    for seed in range(8):
        found = materialize(_signatures(docs, seed), "jaccard-signatures")
        rows = found.where("kind = 0").select("doc_id", "n", "cid", "check", F.col("payload").alias("ranges"))
        classes = rows.where("n > 0").groupBy("cid").agg(F.min("doc_id").alias("least"), F.min("n").alias("n"), F.max("n").alias("_n"), F.min("check").alias("_c"), F.max("check").alias("_d"), F.first("ranges").alias("ranges"))
        classes = materialize(classes, "jaccard-classes")
        if classes.where("n != _n OR _c != _d").isEmpty():
            break  # else two sets have one fingerprint: other hashes
    sketch = spark.sparkContext.broadcast(_sketch(found.where("kind = 1")))
    total = classes.agg(F.sum(F.floor(F.col("n") / 5) + 1)).first()[0] or 0
    first = materialize(_first_round(_prefixes(docs, seed, sketch), _partitions(spark, total)), "jaccard-first")
    lists = first.where("kind = 1").select(F.col("a").alias("token"), F.col("b").alias("cid"), "n", "pos")
    pairs = materialize(_sharing(first.where("kind = 0"), classes), "jaccard-sharing")
    links = _verify(pairs, _sets(docs, seed, Presence(_ends(pairs), 2 * pairs.count())), "jaccard-first")
    ranges = classes.select(F.col("cid").alias("_x"), "ranges")
    comps, sets = merge_components(None, links), None
    discard(pairs)
    before = first  # where the lists are kept
    for step in range(1, ROUNDS + 2):
        open_ = _open_lists(lists, comps, f"jaccard-{step}-lists")
        discard(before)
        count = open_.count()
        if not count:
            break
        last = step > ROUNDS
        if last:
            before, open_ = open_, materialize(_tiles(open_), "jaccard-tiles")
            discard(before)
            count = open_.agg(F.sum(F.size("copies"))).first()[0] or 0
        partitions = _partitions(spark, count, 1 << 17)
        if sets is None:  # once, for all that may still link
            sets = materialize(_sets(docs, seed, Presence(open_.select("cid"), count)), "jaccard-sets")
        full = open_.join(ranges, F.col("cid") == F.col("_x")).drop("_x")  # the wide rows travel once a round
        pairs = _last_round(full, partitions) if last else _next_round(full, partitions, step)
        pairs = materialize(pairs.select("a", "b").distinct(), f"jaccard-{step}-pairs")
        comps = merge_components(comps, _verify(pairs, _asked(sets, pairs), f"jaccard-{step}"))
        discard(pairs)
        before, lists = open_, open_.select("token", "cid", "n", "pos")
    comps = comps.select(F.col("node").alias("_v"), "component")
    labelled = classes.join(comps, F.col("cid") == F.col("_v"), "left").select("cid", "least", F.coalesce("component", "cid").alias("comp"))
    smallest = labelled.groupBy("comp").agg(F.min("least").alias("component_id")).withColumnRenamed("comp", "_k")
    by_class = labelled.join(smallest, F.col("comp") == F.col("_k")).select(F.col("cid").alias("_x"), "component_id")
    out = rows.where("n > 0").join(by_class, F.col("cid") == F.col("_x")).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.union(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_one_each(docs: DataFrame) -> DataFrame:
    """The documents with one of each component left, that of the smallest doc_id; all columns unchanged.

    Documents without words all stay. Repeated rows count as one; rows of one doc_id with
    different texts stay or go together.
    """
    from pyspark.sql import Window

    names = docs.columns
    kept = jaccard_components(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_jac_d")).distinct()
    out = docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_jac_d")))
    alike = Window.partitionBy("_jac_d", F.xxhash64("text")).orderBy(F.length("text"))
    wordless = ~F.coalesce(F.col("text"), F.lit("")).rlike(WORD)
    return out.withColumn("_jac_r", F.row_number().over(alike)).where((F.col("_jac_r") == 1) | wordless).select(*[f"`{c}`" for c in names])


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words
), sized AS (SELECT doc_id, s, len(s) AS n FROM sets
), inv AS (SELECT doc_id, n, unnest(s) AS g FROM sized
), shared AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM inv a JOIN inv b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), one AS (SELECT a, b FROM shared WHERE 100 * c >= 80 * (na + nb - c)
), links AS (SELECT a, b FROM one UNION ALL SELECT b, a FROM one
), reach AS (
  SELECT a AS doc_id, a AS other FROM links UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a
), least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1)
SELECT s.doc_id, s.n AS n_shingles, coalesce(l.component_id, s.doc_id) AS component_id FROM sized s LEFT JOIN least l ON s.doc_id = l.doc_id
"""
