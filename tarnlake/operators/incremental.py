"""Snapshots and incremental maintenance: everything is a join on keys, written as a new snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def snapshot_diff(old: DataFrame, new: DataFrame, key: str = "path", digest: str = "hash") -> DataFrame:
    """(key, status): changed (new or another hash) or deleted."""
    o, n = old.select(F.col(key), F.col(digest).alias("o")), new.select(F.col(key), F.col(digest).alias("n"), F.lit(True).alias("there"))
    j = o.withColumn("was", F.lit(True)).join(n, key, "full_outer")
    status = F.when(F.col("there").isNull(), "deleted").when(F.col("was").isNull() | ~F.col("o").eqNullSafe(F.col("n")), "changed")
    return j.select(key, status.alias("status")).where("status is not null")


def apply_changes(old: DataFrame, new_rows: DataFrame, changed: DataFrame, key: str = "path") -> DataFrame:
    """old without the changed keys, and their new rows."""
    return old.join(changed.select(key).distinct(), key, "left_anti").unionByName(new_rows.join(changed.select(key).distinct(), key, "left_semi"))


def cascade_delete(files: DataFrame, symbols: DataFrame, refs: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    g = gone.select("path").distinct()
    kept = symbols.join(g, "path", "left_anti")
    lost = symbols.join(g, "path", "left_semi").select(F.col("id").alias("src_symbol_id"))
    return files.join(g, "path", "left_anti"), kept, refs.join(lost, "src_symbol_id", "left_anti")


def keep_latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))).where("rn = 1").drop("rn")


def purge_orphans(vectors: DataFrame, symbols: DataFrame) -> DataFrame:
    return vectors.join(symbols.select("id"), "id", "left_semi")


def to_embed(symbols: DataFrame, vectors: DataFrame) -> DataFrame:
    """Symbols without a vector of their present body hash."""
    v = vectors.select("id", F.col("body_hash").alias("has"))
    return symbols.join(v, "id", "left").where(~F.col("has").eqNullSafe(F.col("body_hash")) | F.col("has").isNull()).drop("has")


def cache_misses(texts: DataFrame, cache: DataFrame, text: str = "text") -> DataFrame:
    """Distinct texts (by key v1:sha256) that the cache lacks."""
    keyed = texts.select(F.concat(F.lit("v1:"), F.sha2(text, 256)).alias("key"), text).dropDuplicates(["key"])
    return keyed.join(cache.select("key"), "key", "left_anti")
