"""Operator 3: minimax contiguous partition of atomic groups into shards.

Equal texts form a group that no cut divides. Groups lie in the order of a 64-bit hash of
their text. The smallest capacity for which a greedy walk fills no more than the given
shards is found by binary search, and the cuts fall where that walk puts them.

The search never sees all groups. It starts from a histogram of the hash range (2^12 bins)
and knows the walk's position after each shard within bounds. Where the bounds do not settle
whether a capacity is feasible, bins are divided further until the answer is exact: first
those so heavy that a large group may hide in them, then those that the first cuts may fall
into (whether a large group still fits into a shard must be known before anything after it).
A round gives the driver ``ROUND`` rows at most, and divides 2^8 times at most.
A group larger than an even share of what is left gets a shard of its own first (there are
fewer of these than shards), since no cut could make its shard smaller.
"""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

FIRST_BITS, MORE_BITS = 12, 8
#: Rows of a round's histogram at most; a bin is heavy above 1 / (HEAVY * shards) of all bytes.
ROUND, HEAVY = 1 << 16, 32


def text_size(text: Column) -> Column:
    """UTF-8 bytes plus 1; a null text has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


class _Bins:
    """Ranges of the hash order that hold all groups: (first hash, bits, bytes, whether it is one group), with no gap that holds any."""

    def __init__(self, rows: list[tuple[int, int, int, bool]]):
        self.rows = sorted(rows)
        self.ends, self.before = [], []
        total = 0
        for _, _, size, _ in self.rows:
            self.before.append(total)
            total += size
            self.ends.append(total)
        self.total = total

    def walk(self, capacity: int, shards: int) -> list[tuple[int, int]]:
        """Bounds of the position after each shard. Inside a range that is not one group a cut may lie anywhere."""
        low = high = 0
        out = []
        for _ in range(shards):
            low = self.boundary(low + capacity)
            k = bisect.bisect_right(self.ends, high + capacity)
            reach = high + capacity
            if k < len(self.rows) and self.rows[k][3]:
                reach = self.before[k]  # a single group: it fits whole or not at all
            high = min(self.total, max(reach, low))
            out.append((low, high))
        return out

    def boundary(self, position: int) -> int:
        k = bisect.bisect_right(self.ends, position)
        return self.ends[k - 1] if k else 0

    def inside(self, low: int, high: int) -> list[int]:
        """Unsettled ranges that a position between low and high may lie in."""
        first, last = bisect.bisect_left(self.ends, low), bisect.bisect_right(self.before, high)
        return [k for k in range(first, min(last, len(self.rows))) if not self.rows[k][3]]


def _search(bins: _Bins, shards: int) -> tuple[int, int]:
    """(largest capacity known infeasible, smallest known feasible)."""
    # One shard: the total.
    lo, hi = -(-bins.total // shards) - 1, bins.total
    low, high = lo, hi
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if bins.walk(mid, shards)[-1][0] >= bins.total:
            hi = mid
        else:
            lo = mid
    feasible, lo, hi = hi, low, high
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if bins.walk(mid, shards)[-1][1] < bins.total:
            lo = mid
        else:
            hi = mid
    return lo, feasible


def _histogram(groups: DataFrame, key: Column, bits: int) -> list[tuple[int, int, int, bool]]:
    """Ranges of 2^(64 - bits) hashes with bytes; one that holds a single group is settled."""
    width = 64 - bits
    rows = groups.groupBy(F.shiftright(key, width).alias("b")).agg(F.sum("bytes").alias("s"), F.count(F.lit(1)).alias("n")).collect()
    return [(r.b << width, bits, r.s, r.n == 1) for r in rows]


def _within(key: Column, bins: _Bins, chosen: list[int]) -> Column:
    """Whether a hash lies in one of the chosen ranges. Neighbours count as one, and the tree of conditions is balanced."""
    runs: list[list[int]] = []
    for k in chosen:
        first, bits, *_ = bins.rows[k]
        last = first + (1 << (64 - bits)) - 1
        if runs and runs[-1][1] + 1 == first:
            runs[-1][1] = last
        else:
            runs.append([first, last])
    terms = [key.between(a, z) for a, z in runs]
    while len(terms) > 1:
        terms = [a | b for a, b in zip(terms[::2], terms[1::2])] + (terms[-1:] if len(terms) % 2 else [])  # noqa: B905
    return terms[0]


def _unsure(bins: _Bins, shards: int, infeasible: int, feasible: int) -> list[int]:
    """The ranges to divide next; none if the cuts are exact."""
    narrow, wide = bins.walk(infeasible + 1, shards), bins.walk(feasible, shards)
    spans = [(a, b) for (a, _), (_, b) in zip(narrow, wide, strict=True)]
    if feasible == infeasible + 1 and all(a == b for a, b in spans):
        return []
    heavy = [k for k, r in enumerate(bins.rows) if not r[3] and r[2] * HEAVY * shards > bins.total]
    if heavy:
        return heavy  # fewer than HEAVY * shards
    out: set[int] = set()
    for a, b in spans:
        more = bins.inside(a, b)
        if out and len(out) + len(more) > ROUND >> 3:
            break
        out.update(more[: ROUND >> 3])
    return sorted(out)


def cut_points(groups: DataFrame, shards: int) -> list[int]:
    """Hashes at which shards 1, 2, ... begin. ``groups``: (h, bytes), one row a group."""
    if shards <= 1:
        return []
    key = F.col("h")
    bins = _Bins(_histogram(groups, key, FIRST_BITS))
    while True:
        infeasible, feasible = _search(bins, shards)
        chosen = _unsure(bins, shards, infeasible, feasible)
        if not chosen:
            break
        # All ranges of a width are divided together, the widest first.
        bits = min(bins.rows[k][1] for k in chosen)
        chosen = [k for k in chosen if bins.rows[k][1] == bits]
        more = max(1, min(MORE_BITS, (ROUND // len(chosen)).bit_length() - 1, 64 - bits))
        parts = _histogram(groups.where(_within(key, bins, chosen)), key, bits + more)
        gone = set(chosen)
        bins = _Bins([r for k, r in enumerate(bins.rows) if k not in gone] + parts)
    out = []
    for low, _ in bins.walk(feasible, shards)[:-1]:
        k = bisect.bisect_left(bins.ends, low)
        k = k + 1 if low else 0
        out.append(bins.rows[k][0] if k < len(bins.rows) else None)
    return [x for x in out if x is not None]


def _slots(rows: DataFrame, shards: int, per_bucket: int = 4096) -> DataFrame:
    """Adds slot: 0, 1, ... within each shard. Buckets by a hash of the row keep a shard from being one task."""
    total = rows.count()
    buckets = max(1, -(-total // (per_bucket * max(1, shards))))
    rows = rows.withColumn("_b", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(buckets)))
    counts = rows.groupBy("shard", "_b").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy("shard").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("shard").alias("_s"), F.col("_b").alias("_c"), F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    within = Window.partitionBy("shard", "_b").orderBy(F.col("doc_id").asc_nulls_first(), "size", "text_crc32")
    rows = rows.withColumn("_k", F.row_number().over(within) - 1)
    rows = rows.join(counts, (F.col("shard") == F.col("_s")) & (F.col("_b") == F.col("_c")))
    return rows.withColumn("slot", (F.col("_before") + F.col("_k")).cast("long")).drop("_b", "_s", "_c", "_before", "_k")


def assign_shards(docs: DataFrame, shards: int = 8) -> DataFrame:
    """A row for each document: doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    Null text: size 1, no crc, in a group with other null texts. Equal texts share a shard,
    however many; shards may stay empty if there are fewer groups. An empty table gives no
    rows. Other columns are not read. Reruns agree.
    """
    text = F.col("text")
    rows = docs.select("doc_id", text_size(text).alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), F.xxhash64(text).alias("h"))
    rows = materialize(rows, "shard-rows")
    groups = rows.groupBy("h").agg(F.sum("size").alias("bytes"))
    groups = materialize(groups, "shard-groups")
    largest = [(r.bytes, r.h) for r in groups.orderBy(F.desc("bytes"), "h").limit(shards).collect()]
    left, own = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0], []
    for size, h in largest:
        if len(own) + 1 >= shards or size * (shards - len(own)) < left:
            break
        own.append(h)
        left -= size
    rest = groups.where(~F.col("h").isin(own)) if own else groups
    cuts = cut_points(rest, shards - len(own))
    shard = F.lit(len(own))
    for k, cut in enumerate(cuts):
        shard = F.when(F.col("h") >= cut, len(own) + k + 1).otherwise(shard)
    for k, h in enumerate(own):
        shard = F.when(F.col("h") == h, k).otherwise(shard)
    out = _slots(rows.withColumn("shard", shard.cast("int")), shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
