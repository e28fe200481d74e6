"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, shared_dir, written


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 40) - 1))).alias("h")).first()
    return r.n, r.h


def components(edges: DataFrame) -> DataFrame:
    """node, root: of each node on an edge (u, v), the smallest node that it can reach.

    Each round is two grouped minima, which are partial before their shuffle,
    and two equi-joins. Minima and edges are written to the shared folder: so
    the joins deal out both sides anew, which adaptive execution may split
    where a node is hot, lineage stays short, and a lost executor costs no more
    than a round. Edges with a null
    end are left out. The returned table is read from that folder.
    """
    spark, where = edges.sparkSession, shared_dir(edges.sparkSession)
    now = edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, state, old = written(now, f"{where}/0"), None, None
    for i in count(1):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")), f"{where}/{i}-least")
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        large = written(large, f"{where}/{i}-large")
        smallest = written(large.groupBy("u").agg(F.min("v").alias("m")), f"{where}/{i}-smallest")
        small = large.join(smallest, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = small.unionByName(smallest.select("u", F.col("m").alias("v"))).distinct()
        after = written(after, f"{where}/{i}")
        for done in [f"{where}/{i}-{x}" for x in ("least", "large", "smallest")] + [old] * bool(old):
            dropped(spark, done)
        old, now = f"{where}/{i - 1}", after
        if (new := _state(after)) == state:
            break
        state = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
