"""Connected components by alternating star contractions over written tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import save


def _mark(e: DataFrame) -> tuple[int, int]:
    r = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"] or 0


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    return both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, folder: str, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the undirected edges (u, v); component: the smallest node reachable.

    Each round is two grouped minima and two joins over at most as many edges as
    nodes have links; it is written to the shared folder, so lineage stays short.
    Self-loops keep their node. Nulls are left out.
    """
    spark = edges.sparkSession
    own = f"{folder}/stars-{uuid.uuid4().hex[:12]}"

    clean = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u is not null and v is not null")
    e = save(clean.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{own}/0")
    loops = clean.where("u = v").select("u").distinct()
    mark, path = _mark(e), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for k in range(1, max_rounds + 1):
        if not mark[0]:
            break
        e = save(_small_star(_large_star(e)), f"{own}/{k}")
        before, mark = mark, _mark(e)
        gone = path(f"{own}/{k - 1}")
        gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)
        if mark == before:
            break
    else:
        raise RuntimeError("components didn't settle")
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(stars.select("component", "component")).union(loops.select("u", "u")).groupBy("node").agg(F.min("component").alias("component"))
