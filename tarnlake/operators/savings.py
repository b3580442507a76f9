"""Usage analytics: counters, rollups, registries and sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def saved(response: Column, *baselines: Column) -> Column:
    total = F.lit(0)
    for b in baselines:
        total = total + F.coalesce(b, F.lit(0))
    return F.greatest(F.lit(0), total - response)


def by_tool(calls: DataFrame, tool: str = "tool", micros: str = "micros") -> DataFrame:
    return calls.groupBy(tool).agg(F.count(F.lit(1)).alias("calls"), F.sum(micros).alias("micros"), F.round(F.coalesce(F.avg(micros), F.lit(0.0)), 6).alias("avg_micros"))


def daily(rollups: DataFrame, start: str, end: str) -> DataFrame:
    """Per-day sums with the saving clamped on each day."""
    d = rollups.where(F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    g = d.groupBy("day").agg(F.sum("calls").alias("calls"), F.sum("response").alias("response"), F.sum("baseline").alias("baseline"))
    return g.withColumn("saved", saved(F.col("response"), F.col("baseline")))


def totals(series: DataFrame) -> DataFrame:
    """Sums of the daily clamped values."""
    return series.agg(F.sum("calls").alias("calls"), F.sum("response").alias("response"), F.sum("saved").alias("saved"))


def latency_saved(tools: DataFrame, baselines: DataFrame, tool: str = "tool") -> DataFrame:
    """Per tool max(0, baseline * calls - latency) in microseconds. baselines: a literal table of tools."""
    return tools.join(F.broadcast(baselines), tool, "left").select(tool, F.greatest(F.lit(0), F.coalesce("baseline_ms", F.lit(0)) * F.col("calls") * 1000 - F.col("micros")).cast("long").alias("saved_micros"))


def max_merge(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Largest value of every counter: associative, commutative, idempotent."""
    every = old.unionByName(new)
    return every.groupBy(*keys).agg(*[F.max(c).alias(c) for c in every.columns if c not in keys])


def first_n(rows: DataFrame, user: str, item: str, ts: str, limit: int) -> DataFrame:
    """The first `limit` distinct items of each user."""
    seen = rows.groupBy(user, item).agg(F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"))
    return seen.withColumn("rn", F.row_number().over(Window.partitionBy(user).orderBy("first_seen", item))).where(F.col("rn") <= limit)


def latest(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("rn = 1").drop("rn")


def credit_once(calls: DataFrame, keys: list[str], ts: str = "ts", hours: int = 24) -> DataFrame:
    """credited: the key wasn't seen in the hours before; a repeat refreshes the clock."""
    gap = F.col(ts).cast("timestamp").cast("double") - F.lag(ts).over(Window.partitionBy(*keys).orderBy(ts)).cast("timestamp").cast("double")
    return calls.withColumn("credited", F.coalesce(gap > hours * 3600, F.lit(True)))


def sample_one_in(calls: DataFrame, order: str, key: str, n: int = 64) -> DataFrame:
    """The 1st, n+1st, ... call of each key by order. Calls are numbered within hours and hours by running counts, so that a key is never sorted in one task."""
    hour = F.date_trunc("hour", F.col(order))
    ahead = calls.groupBy(F.col(key).alias("k"), hour.alias("h")).agg(F.count(F.lit(1)).alias("n"))
    ahead = ahead.withColumn("ahead", F.sum("n").over(Window.partitionBy("k").orderBy("h")) - F.col("n")).drop("n")
    own = calls.withColumn("h", hour).withColumn("own", F.row_number().over(Window.partitionBy(key, "h").orderBy(order)))
    return own.join(ahead, (F.col(key) == F.col("k")) & (own["h"] == ahead["h"])).where((F.col("ahead") + F.col("own")) % n == 1).select(*[own[c] for c in calls.columns])


def nth(rows: DataFrame, group: str, value: str, place: Column, name: str) -> DataFrame:
    """The value at a 1-based place (an expression over n) of each sorted group. Equal values are counted before anything is sorted."""
    c = rows.groupBy(group, value).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(group)
    r = c.select(group, value, "c", F.sum("c").over(w.orderBy(value)).alias("upto"), F.sum("c").over(w).alias("n"))
    return r.where((F.col("upto") >= place) & (F.col("upto") - F.col("c") < place)).select(group, F.col(value).alias(name))


def sessions(events: DataFrame, key: str, ts: str, seconds: float) -> DataFrame:
    """Debounce: (key, start, n) of bursts whose gaps stay under `seconds`."""
    w = Window.partitionBy(key).orderBy(ts)
    t = F.col(ts).cast("timestamp").cast("double")
    s = events.select(key, ts, t.alias("t")).withColumn("new", F.coalesce((F.col("t") - F.lag("t").over(w) >= seconds).cast("int"), F.lit(1)))
    s = s.withColumn("burst", F.sum("new").over(w))
    return s.groupBy(key, "burst").agg(F.min(ts).alias("start"), F.count(F.lit(1)).alias("n")).drop("burst")


def expiry_sweep(keys: DataFrame, now: str, limit: int = 500) -> DataFrame:
    """Users among the first `limit` expired paid keys who have no live paid key left."""
    paid = keys.where("tier <> 'free'")
    gone = paid.where(F.col("expires") < F.lit(now).cast("timestamp")).orderBy("expires", "key_id").limit(limit)
    live = paid.where(F.col("expires") >= F.lit(now).cast("timestamp")).select("user_id").distinct()
    return gone.select("user_id").distinct().join(live, "user_id", "left_anti")


def loc_estimate(contents: DataFrame, sample: int = 200, path: str = "path", text: str = "text") -> DataFrame:
    """(files, estimated_loc): newlines of the first `sample` files by path, scaled to all files. The sample is the feature."""
    newlines = F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit("")))
    first = contents.select(path, newlines.alias("n")).orderBy(path).limit(sample).agg(F.sum("n").alias("s"), F.count(F.lit(1)).alias("c"))
    return contents.agg(F.count(F.lit(1)).alias("files")).crossJoin(first).select("files", F.coalesce(F.floor(F.col("s") / F.col("c") * F.col("files")), F.lit(0)).cast("long").alias("estimated_loc"))
