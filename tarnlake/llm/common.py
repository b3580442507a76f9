"""Shared folder, written tables and small helpers of the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REPO = str(Path(__file__).resolve().parents[2])
#: Words between blanks: everything but space and \t \n \v \f \r.
BLANK = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def workers_find_package(spark: SparkSession) -> None:
    """Python workers import this package from where the driver has it, unless it is deployed to them."""
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if REPO not in parts:
        env["PYTHONPATH"] = os.pathsep.join([REPO, *parts])


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Set to a temporary one only in local mode and where it is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if where is None:
        if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tarnlake-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a written table: what follows never recomputes what came before, even if executors are lost.

    The shuffle files of the statement go when the table is complete: whatever
    comes later reads the table, so nothing can ask for them again.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    back = spark.read.schema(df.schema).parquet(path)
    back._tarnlake_folder = path
    return back


def drop_folder(spark: SparkSession, path: str) -> None:
    """Removes a folder under the shared one that nothing reads any more."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_written(*tables: DataFrame) -> None:
    """Removes tables that written() returned and nothing reads any more."""
    for df in tables:
        drop_folder(df.sparkSession, df._tarnlake_folder)


def fresh(taken: list[str], name: str) -> str:
    """name, with underscores before it until no column has it (names are compared without case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def shuffle_width(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def lower_az(c: Column) -> Column:
    """A-Z alone become lower case."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bounded_sample(df: DataFrame, by: list[str], bound: int) -> DataFrame:
    """At most bound rows of df, those whose columns `by` hash lowest. Only hashes are sorted; rows that share the last hash are alike."""
    h = F.xxhash64(*by)
    last = df.select(h.alias("h")).orderBy("h").limit(bound).agg(F.max("h")).first()[0]
    return df.where("false") if last is None else df.where(h <= last).limit(bound)
