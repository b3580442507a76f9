"""Mixing sources along a time-varying curriculum, in DataFrame functions alone.

Training time runs from 0 to 1. A source's weight at time t is its base weight
times 1 + slope * (2t - 1): the integral over [0, 1] is the base weight whatever
the slope, so targets follow base weights, and the cumulative demand up to t is
target * (t + slope * (t^2 - t)). A source's documents, in the order of a hash
and repeated in epochs, fill that demand; each copy's place in the source's
stream is inverted through the demand to a training position, and documents are
range-sorted by position.

Targets: all sizes are shared by weight; a target stops at ``cap`` times its
source's size and the excess is reshared, which is a water level: sources are
sorted by cap per weight and the level is found from running sums. Running sums
inside a source go over hash buckets first (one small row each), then within a
bucket, so that no source is sorted in one task.

Defined cases: null text has size 0; null source is a source of its own and
sorts last; documents of size 0 are taken once and add no words; ties of the hash fall to id, size and text hash,
and repeated rows are each taken as their place says; an empty table, or one
without words, gives targets of 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import new_path, shuffle_width

WEIGHTS, CAP, BUCKETS = (5, 2, 1), 3, 1024
SLOPES = (-0.5, 0.0, 0.5)  #: by the source's number, repeating: early, even, late


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP, slopes=SLOPES) -> DataFrame:
    """sizes: (source, source_size), one row each -> with weight, slope and target. One row a source: windows over all of it are small."""
    k = len(weights)
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    number = F.row_number().over(by_name) - 1
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(number, F.lit(len(values))) + 1).cast("int"))
    s = sizes.withColumns({"weight": pick([int(w) for w in weights]).cast("long"), "slope": pick([float(x) for x in slopes])})
    every = Window.partitionBy()
    full = Window.orderBy((F.lit(cap) * F.col("source_size") / F.col("weight")).asc(), F.col("source").isNull(), "source")
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({
        "total": F.sum("source_size").over(every), "all_weight": F.sum("weight").over(every),
        "full_words": F.coalesce(F.sum(F.lit(cap) * F.col("source_size")).over(before), F.lit(0)), "full_weight": F.coalesce(F.sum("weight").over(before), F.lit(0)),
    })
    # In the order of cap per weight the first source that the rest's level doesn't fill sets the level.
    level = (F.col("total") - F.col("full_words")), (F.col("all_weight") - F.col("full_weight"))
    fits = level[0] * F.col("weight") <= F.lit(cap) * F.col("source_size") * level[1]
    s = s.withColumn("open", F.min(F.when(fits, F.struct((F.lit(cap) * F.col("source_size") / F.col("weight")).alias("at"), F.col("source").isNull().alias("last"), F.col("source").alias("name"), level[0].alias("words"), level[1].alias("weight")))).over(every))
    shared = (F.col("open.words") * F.col("weight")).cast("double") / F.col("open.weight").cast("double")
    # Sources before the open one are over their cap at this level, those after it are under.
    target = F.coalesce(F.least(shared, (F.lit(cap) * F.col("source_size")).cast("double")), F.lit(0.0))
    return s.select("source", "source_size", "weight", "slope", target.alias("target"))


def assign(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, slopes=SLOPES, key: str = "doc_id", text: str = "text", source: str = "source", buckets: int = BUCKETS) -> DataFrame:
    """One row for each row of docs: key, source, size, source_size, target, place (words before it in its source), copies, taken, slope."""
    spark = docs.sparkSession
    narrow = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), size_of(F.col(text)).alias("size"), F.xxhash64(text).alias("tie"))
    folder = new_path(spark, "sizes")
    narrow.withColumn("hash", F.md5(F.coalesce(F.col("key").cast("string"), F.lit("")))).write.parquet(folder)
    d = spark.read.parquet(folder).withColumn("bucket", F.conv(F.substring("hash", 1, 8), 16, 10).cast("long") * buckets / 4294967296)
    d = d.withColumn("bucket", F.floor("bucket").cast("int"))
    sums = d.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    starts = sums.withColumn("start", F.sum("words").over(Window.partitionBy("source").orderBy("bucket")) - F.col("words"))
    goal = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, cap, slopes)
    plan = starts.select(F.col("source").alias("s"), F.col("bucket").alias("b"), "start").join(goal.withColumnRenamed("source", "s2"), F.col("s").eqNullSafe(F.col("s2"))).drop("s2", "words")
    inside = Window.partitionBy("source", "bucket").orderBy("hash", "key", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    d = d.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).withColumn("place", F.col("start") + F.col("ahead"))
    # Copy e is at place + e * source_size and is taken if its middle lies before the target.
    room = F.col("target") - F.col("place") - F.col("size") / 2.0
    copies = F.when(F.col("size") == 0, F.lit(1)).when(room < 0, F.lit(0)).otherwise(F.least(F.lit(cap), (F.floor(room / F.col("source_size")) + 1))).cast("long")
    return d.withColumn("copies", copies).select("key", "source", "size", "source_size", "target", "slope", "place", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def position(place: Column, target: Column, slope: Column) -> Column:
    """Training time at which the cumulative demand target * (t + slope * (t^2 - t)) reaches the place."""
    u = F.least(F.lit(1.0), F.when(target > 0, place / target).otherwise(F.lit(0.0)))
    a, b = slope, 1.0 - slope
    return F.when(a == 0, u).otherwise(2.0 * u / (b + F.sqrt(F.greatest(F.lit(0.0), b * b + 4.0 * a * u))))


def placed(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, slopes=SLOPES, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """assign() with the training position of each copy (positions; none for no copy), range-sorted by the first; documents without copies come last."""
    at = lambda e: position(F.col("place") + e * F.col("source_size") + F.col("size") / 2.0, F.col("target"), F.col("slope"))
    every = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1), at)).otherwise(F.array().cast("array<double>"))
    order = [F.get("positions", 0).asc_nulls_last(), F.col("key")]
    return assign(docs, weights, cap, slopes, key, text, source).withColumn("positions", every).repartitionByRange(shuffle_width(docs.sparkSession), *order).sortWithinPartitions(*order)


def stream(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, slopes=SLOPES, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row for each copy: key, source, size, epoch, position, range-sorted by position."""
    a = assign(docs, weights, cap, slopes, key, text, source).where("copies > 0")
    rows = a.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    rows = rows.withColumn("position", position(F.col("place") + F.col("epoch") * F.col("source_size") + F.col("size") / 2.0, F.col("target"), F.col("slope")))
    rows = rows.select(F.col("key").alias(key), "source", "size", "epoch", "position")
    return rows.repartitionByRange(shuffle_width(docs.sparkSession), "position", key).sortWithinPartitions("position", key, "epoch")
