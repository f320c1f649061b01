"""Optional anonymising of detail rows: addresses, servers and shares become numbered names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ADDRESS = r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"
#: What is replaced, by kind: pattern with the name as a group, and the new name's prefix.
KINDS = {"address": (rf"({ADDRESS})", "10.0.0."), "server": (r"\\\\([A-Za-z][A-Za-z0-9_-]*)", "server_"), "share": (r"\\\\[^\\\s]+\\([^\\\s'\"]+)", "share_")}


def token_map(rows: DataFrame, columns: list[str], order: str = "seq") -> DataFrame:
    """(kind, token, alias): distinct names numbered in the order in which they are first seen.

    The ranks need one ordering of all distinct names; they are aggregated first, and only
    they pass the window.
    """
    found = None
    for kind, (pattern, prefix) in KINDS.items():
        for c in columns:
            one = rows.select(F.lit(kind).alias("kind"), F.lit(prefix).alias("prefix"), F.explode(F.regexp_extract_all(F.col(f"`{c}`"), F.lit(pattern), F.lit(1))).alias("token"), order)
            found = one if found is None else found.union(one)
    names = found.groupBy("kind", "prefix", "token").agg(F.min(order).alias("o"))
    rank = F.row_number().over(Window.partitionBy("kind").orderBy("o", "token"))
    return names.select("kind", "token", F.concat("prefix", rank.cast("string")).alias("alias"))


def counts(rows: DataFrame, columns: list[str]) -> dict[str, int]:
    """How many distinct names of each kind would be replaced."""
    found = token_map(rows, columns).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    return {f"anonymised_{k}": 0 for k in KINDS} | {f"anonymised_{r.kind}": r.n for r in found.collect()}


def anonymise(rows: DataFrame, columns: list[str], key: str = "seq") -> DataFrame:
    """``rows`` with the names in ``columns`` replaced. ``key`` identifies and orders rows.

    Each text's own names are joined to the map and folded in; the map is never collected.
    """
    names = token_map(rows, columns, key)
    out = rows
    for c in columns:
        text = F.col(f"`{c}`")
        tokens = None
        for kind, (pattern, _) in KINDS.items():
            one = rows.select(F.col(key).alias("_k"), F.lit(kind).alias("_kind"), F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))).alias("_t"))
            tokens = one if tokens is None else tokens.union(one)
        own = tokens.join(names, (F.col("_kind") == F.col("kind")) & (F.col("_t") == F.col("token")))
        own = own.groupBy("_k").agg(F.array_sort(F.collect_list(F.struct((-F.length("token")).alias("n"), "token", "alias"))).alias("_m"))
        replaced: Column = F.aggregate(F.coalesce("_m", F.array().cast("array<struct<n:int,token:string,alias:string>>")), text, lambda s, m: F.replace(s, m["token"], m["alias"]))
        columns_now = out.columns
        out = out.join(own, F.col(key) == F.col("_k"), "left").withColumn(c, replaced).select(*[f"`{x}`" for x in columns_now])
    return out
