"""Connected components of an edge table, as Spark joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` -> ``(id, component)``: the smallest id reachable.

    Alternating large-star and small-star rounds: every node links its larger
    (then its smaller) neighbours to its smallest one, until the edges no
    longer change; then each node hangs directly on its component's smallest
    id. The number of edges never grows and each round's table is written by
    checkpoint(), so a lost executor costs one round. A hub's edges meet only
    in a partial aggregate and in a join that Spark can split.
    """
    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("a", "b").union(e.select("b", "a")) if large else e
        # Here a's neighbours: all of them, or the smaller ones (a > b).
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        linked = both.join(low, "a")
        if large:
            out = linked.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
                low.select("a", F.col("m").alias("b")))
        return (out.filter(F.col("a") != F.col("b"))
                .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def state(e: DataFrame):
        r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        return r.n, r.h

    e = (edges.filter(F.col("a") != F.col("b"))
         .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint())
    last = state(e)
    while last[0]:
        e = star(star(e, True), False).checkpoint()
        now = state(e)
        if now == last:
            break
        last = now
    return (e.select(F.col("a").alias("id"), F.col("b").alias("component"))
            .union(e.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct())
