"""Connected components of an edge table by alternating star contraction.

Large-star and small-star steps (Kiveris et al., "Connected Components in
MapReduce and Beyond", 2014).  Each round is a few joins and map-side combined
minima on the edges.  No vertex's neighbourhood is held as a list; in the join of
the edges with the minima those of a hub are one key, which Spark's adaptive
skew join splits.  Each round is written to the shared folder, and the one before
it is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import remove, written

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31)))).first()
    return tuple(row)


def connected_components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` for every vertex of ``edges(u, v)``; component is the least id.

    Vertices without edges do not appear; self-loops and nulls are ignored, and
    an empty edge table gives an empty result.
    """
    now, path = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    seen = _mark(now)
    for _ in range(MAX_ROUNDS):
        if seen[0] == 0:
            break
        before = path
        now, path = written(_small_star(_large_star(now)), "cc")
        mark = _mark(now)
        remove(now.sparkSession, before)
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("connected components did not settle")
    roots = now.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
