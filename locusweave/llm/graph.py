"""Connected components of large graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from locusweave.llm.common import materialize, spread_join


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long). Returns node, root: the least node that can be reached, for each node that has an edge.

    Large-star and small-star steps in turn, until the edges stay as they are; a node's edges meet in one group only
    as (neighbour) numbers, those of nodes with very many edges are joined by broadcast, and every step keeps at most
    as many edges as there were. Each round is one written table, which is counted as it is written."""

    def written(x: DataFrame, name: str) -> tuple[DataFrame, tuple]:
        seen = Observation()
        out = materialize(x.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")), name)
        return out, (seen.get["n"], seen.get["sum"])

    e, now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while now[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = spread_join(both, least, "u", both, total=2 * now[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(small_least, "u")
        new = star.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small_least.select("u", F.col("m").alias("v"))).distinct()
        old = now
        e, now = written(new, "star")
        if old == now:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
