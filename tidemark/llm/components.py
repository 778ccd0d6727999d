"""Connected components over an edge table, without bringing edges to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import discard, materialize


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Edges ``(a, b)`` of one integer type -> ``(node, root)``, one row per node that has an edge; root is the
    component's smallest node.

    Alternates the large-star and small-star steps until the edge set stops changing. Each step is a
    pre-aggregated minimum per node and one equi join, so a node with very many neighbours is split by
    adaptive skew handling rather than gathered. Each round's edges are written to the shared folder and the
    round before it is deleted. Null ends and loops are ignored; an empty table gives an empty table.
    """
    spark = edges.sparkSession
    old: list[str] = []
    now: list[str] = []
    a, b = F.greatest("a", "b"), F.least("a", "b")
    e = materialize(edges.where("a <> b").select(a.alias("u"), b.alias("v")).distinct(), "edges", now)
    mark = _mark(e)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = large.unionByName(e.join(least, "u").where("m <> u").select("u", F.col("m").alias("v"))).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("x"), "m").unionByName(down.select(F.col("u").alias("x"), "m"))
        old, now = now, []
        e = materialize(small.where("x <> m").select(F.col("x").alias("u"), F.col("m").alias("v")).distinct(), "edges", now)
        last, mark = mark, _mark(e)
        discard(spark, old)
        if mark == last:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _mark(e: DataFrame) -> tuple:
    r = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
    return r[0], r[1], r[2]
