"""Operator 1: mixing sources to target weights, by pivotal dependent rounding.

Every document has an expected number of copies, its source's rate. The whole part is
certain; the rest is a probability that must become 0 or 1. Documents meet in pairs: mass
(words) moves from one to the other, in a random direction that keeps both expectations,
until one of the two is settled; the other goes on with what is left. A pair's expected
words never change, so a source ends within one document of its target. Blocks of about
``BLOCK`` documents settle all but one member each; these residuals form the blocks of the
next level, down to one residual a source: a reduction tree of depth log(documents).

Everything is DataFrame functions. A hot source is many blocks, so no task holds a source.
The table of sources (one row each, pre-aggregated) passes through one window for ranks
and water level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize

#: Documents in a block of the reduction tree, about.
BLOCK = 64
#: Rows alike that come from one array, at most.
RUN = 1 << 16
WEIGHTS = (5.0, 2.0, 1.0)
_UNIT = "array<struct<i:int,up:int>>"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, weights=WEIGHTS, share: float = 1.5, ceiling: float = 2.0) -> DataFrame:
    """Adds weight and target to (source, source_size, ...), one row a source.

    Sources by code point, null last, weigh ``weights``, repeating. They share ``share``
    times all sizes; a target stops at ``ceiling`` times its source's size, and the excess
    is reshared by weight until none is above. That is a water level: sources ordered by
    ceiling per weight fill up in turn, and the level is the first that the next one's
    ceiling stands above. Without any words all targets are 0.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = totals.withColumn("_k", F.row_number().over(in_order) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_k") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("_cap", F.lit(float(ceiling)) * F.col("source_size"))
    by_cap = Window.orderBy(F.col("_cap") / F.col("weight"), "_k")
    everyone = Window.orderBy(F.col("_cap") / F.col("weight"), "_k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = F.coalesce(F.sum("_cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    pool = F.lit(float(share)) * F.sum("source_size").over(everyone)
    ranked = ranked.withColumn("_level", (pool - filled) / rest)
    open_ = F.when(F.col("_level") * F.col("weight") < F.col("_cap"), F.struct(F.row_number().over(by_cap), F.col("_level").alias("v")))
    ranked = ranked.withColumn("_open", open_)
    level = F.min("_open").over(everyone)["v"]
    target = F.least(F.col("_cap"), F.coalesce(level * F.col("weight"), F.col("_cap")))
    return ranked.withColumn("target", target).drop("_k", "_cap", "_level", "_open")


def _unit_random(*parts: Column) -> Column:
    """In [0, 1), the same on every run."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / float(1 << 53)


def _settle(units: Column, level: int) -> Column:
    """Pivotal rounding along an array of units: struct(i, p: the one that is left, picks: who is settled, and how)."""
    flat = F.transform(units, lambda u, i: F.struct(i.alias("i"), u["p"].alias("p"), u["size"].cast("double").alias("m"), u["h"].alias("h")))
    zero = F.struct(F.lit(-1).alias("i"), F.lit(0.0).alias("p"), F.lit(0.0).alias("m"), F.array().cast(_UNIT).alias("picks"))

    def meet(a: Column, x: Column) -> Column:
        up = F.least((1 - a["p"]) * a["m"], x["p"] * x["m"])
        down = F.least(a["p"] * a["m"], (1 - x["p"]) * x["m"])
        rise = _unit_random(x["h"], a["i"], F.lit(level)) * (up + down) < down
        # Whose probability reaches 0 or 1 first, if mass goes to a (rise) or from a.
        a_done = F.when(rise, (1 - a["p"]) * a["m"] <= x["p"] * x["m"]).otherwise(a["p"] * a["m"] <= (1 - x["p"]) * x["m"])
        a_p = F.when(rise, a["p"] + up / a["m"]).otherwise(a["p"] - down / a["m"])
        x_p = F.when(rise, x["p"] - up / x["m"]).otherwise(x["p"] + down / x["m"])
        unit = lambda p: F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))
        pick = lambda i, up_: F.struct(i.alias("i"), up_.cast("int").alias("up"))
        settled = F.when(a_done, F.struct(x["i"].alias("i"), unit(x_p).alias("p"), x["m"].alias("m"), F.concat(a["picks"], F.array(pick(a["i"], rise))).alias("picks"))).otherwise(
            F.struct(a["i"].alias("i"), unit(a_p).alias("p"), a["m"].alias("m"), F.concat(a["picks"], F.array(pick(x["i"], ~rise))).alias("picks"))
        )
        return F.when(a["i"] < 0, F.struct(x["i"].alias("i"), x["p"].alias("p"), x["m"].alias("m"), a["picks"].alias("picks"))).otherwise(settled)

    return F.aggregate(flat, zero, meet, lambda a: F.struct(a["i"].alias("i"), a["p"].alias("p"), a["picks"].alias("picks")))


def plan_mix(items: DataFrame, weights=WEIGHTS, share: float = 1.5, ceiling: float = 2.0, block: int = BLOCK) -> DataFrame:
    """(doc_id, source, size) to (doc_id, source, size, source_size, target, n, total): n rows alike take ``total`` copies together.

    Equal rows are counted before they meet, so that a repeated row is one unit. Units whose
    rate is whole, and those without words, take their whole part. Nulls are values like others.
    """
    units = items.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n"))
    units = materialize(units, "mix-items")
    totals = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count(F.lit(1)).alias("_units"))
    targets = materialize(source_targets(totals, weights, share, ceiling), "mix-targets")
    largest = targets.agg(F.max("_units")).first()[0]
    if largest is None:
        return units.withColumns({"source_size": F.lit(0).cast("long"), "target": F.lit(0.0), "total": F.lit(0).cast("long")})
    # One row a source: Spark broadcasts it while it is small, and joins by key beyond.
    t = targets.withColumnRenamed("source", "_s")
    units = units.join(t, F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "weight")
    expected = F.when(F.col("source_size") > 0, F.col("n") * F.col("target") / F.col("source_size")).otherwise(0.0)
    units = units.withColumn("_e", expected).withColumn("base", F.floor(F.col("_e") + 1e-9).cast("long"))
    units = units.withColumn("p", F.greatest(F.lit(0.0), F.col("_e") - F.col("base"))).withColumn("h", F.xxhash64("doc_id", "size"))
    open_ = (F.col("size") > 0) & (F.col("p") > 1e-9)
    columns = ["doc_id", "source", "size", "n", "source_size", "target"]
    done = [units.where(~open_).select(*columns, F.col("base").alias("total"))]
    level, blocks = 0, max(1, -(-largest // block))
    keep = ("h", "doc_id", "size", "n", "base", "p", "source_size", "target")
    grp = F.pmod("h", F.ceil(F.col("_units") / block))
    state = units.where(open_).select("source", grp.cast("long").alias("grp"), F.struct(*keep).alias("unit"))
    while True:
        gathered = state.groupBy("source", "grp").agg(F.sort_array(F.collect_list("unit")).alias("units"))
        gathered = materialize(gathered.withColumn("s", _settle(F.col("units"), level)), "mix-level")
        picks = gathered.select("source", "units", F.explode("s.picks").alias("k")).select("source", F.col("units")[F.col("k.i")].alias("u"), F.col("k.up").alias("up"))
        done.append(picks.select(F.col("u.doc_id"), "source", F.col("u.size"), F.col("u.n"), F.col("u.source_size"), F.col("u.target"), (F.col("u.base") + F.col("up")).alias("total")))
        left = gathered.select("source", "grp", F.col("units")[F.col("s.i")].alias("u"), F.col("s.p").alias("p")).select("source", "grp", F.col("u").withField("p", F.col("p")).alias("unit"))
        level += 1
        if blocks <= 1:
            break
        blocks = -(-blocks // block)
        state = left.withColumn("grp", F.floor(F.col("grp") / block).cast("long"))
    # One residual a source: a last draw with its own probability.
    draw = (_unit_random(F.col("unit.h"), F.lit(-1)) < F.col("unit.p")).cast("long")
    done.append(left.select(F.col("unit.doc_id"), "source", F.col("unit.size"), F.col("unit.n"), F.col("unit.source_size"), F.col("unit.target"), (F.col("unit.base") + draw).alias("total")))
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def mix_sizes(items: DataFrame, **options) -> DataFrame:
    """A row for each row of (doc_id, source, size): with source_size, target, copies and taken (copies times size).

    Reruns agree, as all chance comes from hashes of the rows.
    """
    plan = plan_mix(items, **options)
    # Rows alike are told apart in two steps, so that no array grows with their number.
    plan = plan.withColumn("_q", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RUN))))
    plan = plan.withColumn("_r", F.explode(F.sequence(F.col("_q") * RUN, F.least(F.col("n"), (F.col("_q") + 1) * RUN) - 1)))
    copies = F.floor(F.col("total") / F.col("n")) + (F.col("_r") < F.col("total") % F.col("n")).cast("long")
    return plan.select("doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """Documents as the mix has them: each as many times as it is taken, columns unchanged.

    ``docs`` needs doc_id, text and source. Rows alike in doc_id, source and size share their
    copies out among themselves in turn. Extra columns stay; helper names start with ``_mix_``.
    """
    names = docs.columns
    sized = docs.withColumn("_mix_size", word_count(F.col("text")))
    plan = plan_mix(sized.select("doc_id", "source", F.col("_mix_size").alias("size")), **options)
    plan = plan.where("total > 0").select(F.col("doc_id").alias("_mix_d"), F.col("source").alias("_mix_s"), F.col("size").alias("_mix_z"), F.col("n").alias("_mix_n"), F.col("total").alias("_mix_t"))
    same = F.col("doc_id").eqNullSafe(F.col("_mix_d")) & F.col("source").eqNullSafe(F.col("_mix_s")) & (F.col("_mix_size") == F.col("_mix_z"))
    taken = sized.join(plan, same)
    alike = Window.partitionBy("_mix_d", "_mix_s", "_mix_z").orderBy("text")
    taken = taken.withColumn("_mix_r", F.row_number().over(alike) - 1)
    copies = F.floor(F.col("_mix_t") / F.col("_mix_n")) + (F.col("_mix_r") < F.col("_mix_t") % F.col("_mix_n")).cast("long")
    taken = taken.withColumn("_mix_c", copies).where("_mix_c > 0")
    return taken.withColumn("_mix_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_mix_c")))).select(*[f"`{c}`" for c in names])
