"""Tables of the driver bound to the engine's relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), "text", "lang", "doc_id")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contents(spark, sf_dir).select("path", "lang", F.octet_length("text").cast("long").alias("size_bytes"), F.sha2("text", 256).alias("hash"), "doc_id")


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_brand"))
    parent = F.when(F.col("p_partkey") % 3 == 0, F.col("p_partkey") - 1)
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("path"), name.alias("name"), F.concat("p_type", F.lit("::"), name).alias("qualified_name"), F.col("p_type").alias("kind"),
        F.lit(None).cast("string").alias("signature"), parent.alias("parent_id"), F.col("p_partkey").alias("byte_start"), F.col("p_size").alias("line_start"),
    )


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive lines of an order: the part of a line refers to the name of the next line's part."""
    line = read(spark, sf_dir, "lineitem")
    order = [c for c in line.columns if c != "l_orderkey"]
    nxt = line.withColumn("next_part", F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy(*order)))
    names = symbols(spark, sf_dir).select(F.col("id").alias("next_part"), F.col("name").alias("ident"))
    return nxt.where("next_part is not null").select(F.col("l_partkey").alias("src_symbol_id"), "next_part").join(names, "next_part").select("src_symbol_id", "ident")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", "ts", F.col("event_type").alias("tool"), "user_id", F.col("props").alias("key"), F.round(F.col("value") * 1000).cast("long").alias("micros"), F.to_date("ts").alias("day"))
