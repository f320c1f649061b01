"""Connected components by hooking and pointer jumping, all in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Rows of a written part, at least: later rounds have few rows, which many tasks would only slow down.
ROWS = 1 << 17


def _few(df: DataFrame, rows: int, name: str) -> DataFrame:
    return materialize(df.coalesce(max(1, -(-rows // ROWS))), name)


def connected_components(edges: DataFrame, jumps: int = 3) -> DataFrame:
    """(a, b) to (node, component): each node that has an edge, with the smallest node that it reaches.

    Each round every node hooks onto its smallest smaller neighbour, hooks are followed a few
    steps, and edges move to where their ends now are; those within one node vanish. A path's
    length shrinks by 1 + jumps a round, so rounds grow with the logarithm of the diameter. The
    maps of all rounds together lead a node to its component. Nothing is collected.
    """
    edges = edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("lo < hi").distinct()
    edges = materialize(edges, "cc-edges")
    n = edges.count()
    nodes = edges.select(F.col("lo").alias("node")).union(edges.select(F.col("hi").alias("node"))).distinct()
    size, maps = 2 * n, []
    while n:
        hook = _few(edges.groupBy("hi").agg(F.min("lo").alias("to")), n, "cc-hook")
        on = hook.select(F.col("hi").alias("_h"), F.col("to").alias("_t"))
        for _ in range(jumps):
            hook = hook.join(on, F.col("to") == F.col("_h"), "left").select("hi", F.coalesce("_t", "to").alias("to"))
        hook = _few(hook, n, "cc-hook")
        maps.append(hook)
        for end in ("lo", "hi"):
            on = hook.select(F.col("hi").alias("_h"), F.col("to").alias("_t"))
            edges = edges.join(on, F.col(end) == F.col("_h"), "left").withColumn(end, F.coalesce("_t", end)).drop("_h", "_t")
        edges = edges.select(F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi")).where("lo < hi").distinct()
        edges = _few(edges, n, "cc-edges")
        n = edges.count()
    nodes = nodes.withColumn("component", F.col("node"))
    for hook in maps:
        on = hook.select(F.col("hi").alias("_h"), F.col("to").alias("_t"))
        nodes = nodes.join(on, F.col("component") == F.col("_h"), "left").withColumn("component", F.coalesce("_t", "component")).drop("_h", "_t")
    return _few(nodes, size, "cc-nodes")


def merge_components(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, component) after more links (a, b). Old components count as single nodes, so only what is new is walked."""
    if labels is None:
        return connected_components(links)
    known = labels.count()
    ends = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).distinct()
    labels = labels.union(ends.join(labels.select(F.col("node").alias("_n")), F.col("node") == F.col("_n"), "left_anti").select("node", F.col("node").alias("component")))
    side = lambda k: labels.select(F.col("node").alias(f"_{k}"), F.col("component").alias(f"c{k}"))
    edges = links.join(side("a"), F.col("a") == F.col("_a")).join(side("b"), F.col("b") == F.col("_b"))
    found = connected_components(edges.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select(F.col("node").alias("_n"), F.col("component").alias("_c"))
    labels = labels.join(found, F.col("component") == F.col("_n"), "left").select("node", F.coalesce("_c", "component").alias("component"))
    return _few(labels, known + 2 * links.count(), "cc-labels")
