"""Accounts: pushed rollups, registries, keys, subscriptions and the reports over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .savings import first_n, latest, saved

#: tier, repositories, files, lines, days of history; no bound is null.
TIERS = (("free", 1, 250, 10_000, 0), ("pro", 10, 5_000, 200_000, 30), ("team", 25, 50_000, 4_000_000, 90), ("enterprise", 1_000, None, None, 365))
MAX_SAFE = 2**53 - 1


def tier_limits(spark) -> DataFrame:
    return spark.createDataFrame(list(TIERS), "tier string, max_repos long, max_files long, max_loc long, max_days long")


def days_allowed(tier: Column, asked: Column) -> Column:
    """Days of history: what is asked for, at most the tier's; without a number the tier's."""
    cap = F.lit(0)
    for name, *_, days in TIERS:
        cap = F.when(F.lower(tier) == name, days).otherwise(cap)
    return F.when(asked.isNull() | (asked < 0), cap).otherwise(F.least(asked, cap)).cast("long")


def over_limits(repos: DataFrame, limits: DataFrame) -> DataFrame:
    """repos (tier, n_repos, files, loc) with the first limit each is over: repos, files, loc or null."""
    j = repos.join(F.broadcast(limits), "tier", "left")  # one row a tier
    return j.withColumn("over", F.when(F.col("n_repos") > F.col("max_repos"), "repos").when(F.col("files") > F.col("max_files"), "files").when(F.col("loc") > F.col("max_loc"), "loc")).drop("max_repos", "max_files", "max_loc", "max_days")


def validated(rows: DataFrame, counters: list[str], day: str = "day", fingerprint: str = "fingerprint") -> DataFrame:
    """rows with reason, null where the row is good: a day as YYYY-MM-DD, counters that are safe integers of 0 or more, 64 hex digits where there is a fingerprint."""
    reason = F.when(~F.coalesce(F.col(day).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False)) | F.try_to_timestamp(F.col(day), F.lit("yyyy-MM-dd")).isNull(), "day")
    for c in counters:
        reason = reason.when(F.col(c).isNull() | (F.col(c) < 0) | (F.col(c) > MAX_SAFE), c)
    reason = reason.when(F.col(fingerprint).isNotNull() & ~F.col(fingerprint).rlike("^[0-9a-fA-F]{64}$"), "fingerprint")
    return rows.withColumn("reason", reason)


def repositories(repos: DataFrame, keys: DataFrame, users: DataFrame, limits: DataFrame) -> DataFrame:
    """(user_id, fingerprint, rank, tier, max_repos): repositories of a user, newest first; the tier is that of the latest key not revoked, else the user's."""
    live = latest(keys.where("revoked_at is null"), "user_id", F.col("created_at").desc(), F.col("key_id").desc()).select("user_id", F.col("tier").alias("key_tier"))
    u = users.select("user_id", F.col("tier").alias("own")).join(live, "user_id", "left").select("user_id", F.coalesce("key_tier", "own").alias("tier")).join(F.broadcast(limits.select("tier", "max_repos")), "tier", "left")
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("last_seen").desc(), "fingerprint"))
    return repos.withColumn("rank", rank).join(u, "user_id").select("user_id", "fingerprint", "rank", "tier", "max_repos")


def latest_paid(subscriptions: DataFrame) -> DataFrame:
    """The newest active paid subscription of each user."""
    return latest(subscriptions.where("tier <> 'free' and status = 'active'"), "user_id", F.col("created_at").desc(), F.col("subscription_id").desc())


def claim_slots(held: DataFrame, claims: DataFrame) -> DataFrame:
    """Claims that win: the first of each user who holds no open subscription."""
    free = claims.join(held.where("status in ('created', 'active')").select("user_id").distinct(), "user_id", "left_anti")
    return latest(free, "user_id", F.col("claimed_at").asc(), F.col("claim_id").asc())


def upsert_users(users: DataFrame, logins: DataFrame, key: str = "login_id") -> DataFrame:
    """Users with the name and mail of their latest login; new ones are added; what a login leaves empty stays."""
    new = latest(logins, key, F.col("at").desc(), F.col("name").desc()).select(key, F.col("name").alias("new_name"), F.col("email").alias("new_email"))
    j = users.join(new, key, "full_outer")
    return j.select(key, F.coalesce("new_name", "name").alias("name"), F.coalesce("new_email", "email").alias("email"))


def delete_accounts(tables: dict[str, DataFrame], users: DataFrame, key: str = "user_id", through: dict[str, tuple[str, str]] | None = None) -> dict[str, DataFrame]:
    """Every table without the users' rows. through: tables that hang on another one's key, as name -> (parent table, key)."""
    gone = users.select(key).distinct()
    out = {n: t.join(gone, key, "left_anti") for n, t in tables.items() if n not in (through or {})}
    for n, (parent, on) in (through or {}).items():
        lost = tables[parent].join(gone, key, "left_semi").select(on).distinct()
        out[n] = tables[n].join(lost, on, "left_anti")
    return out


def client_day(tools: DataFrame, baselines: DataFrame) -> DataFrame:
    """One row of all tools' counters, tokens saved (clamped once) and time saved (clamped for each tool). tools: tool, calls, response, static_tokens, measured_tokens, micros."""
    j = tools.join(F.broadcast(baselines.select("tool", "latency_ms")), "tool", "left")  # a literal table of tools
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("calls", "response", "static_tokens", "measured_tokens", "micros")]
    late = F.greatest(F.lit(0), F.coalesce("latency_ms", F.lit(0)) * F.col("calls") * 1000 - F.col("micros"))
    return j.agg(*sums, F.coalesce(F.sum(late), F.lit(0)).cast("long").alias("latency_saved")).withColumn("tokens_saved", saved(F.col("response"), F.col("static_tokens"), F.col("measured_tokens")))


def savings_report(tools: DataFrame, ratio: float = 1.0) -> DataFrame:
    """(tool, calls, response, baseline, saved, avg_ms) for each tool and in a last row `total`; responses are corrected by the ratio before they are subtracted."""
    def rows(t: DataFrame, total: bool) -> DataFrame:
        fixed = F.floor(F.col("response") * F.lit(ratio)).cast("long")
        ms = F.lit(None).cast("double") if total else F.round(F.coalesce(F.try_divide(F.col("micros").cast("double"), F.col("calls") * 1000.0), F.lit(0.0)), 2)
        return t.select("tool", "calls", fixed.alias("response"), (F.col("static_tokens") + F.col("measured_tokens")).alias("baseline"), saved(fixed, F.col("static_tokens"), F.col("measured_tokens")).alias("saved"), ms.alias("avg_ms"))

    every = tools.agg(*[F.sum(c).alias(c) for c in ("calls", "response", "static_tokens", "measured_tokens", "micros")]).withColumn("tool", F.lit("total"))
    return rows(tools.where("calls > 0"), False).unionByName(rows(every, True))


def savings_table(tools: DataFrame, baselines: DataFrame) -> DataFrame:
    """(tool, calls, baseline, saved, avg_ms, time_saved_ms): whole milliseconds for each tool, then summed; the total's tokens are clamped once."""
    j = tools.join(F.broadcast(baselines.select("tool", "latency_ms")), "tool", "left")
    base = F.col("static_tokens") + F.col("measured_tokens")
    time = F.floor(F.greatest(F.lit(0), F.coalesce("latency_ms", F.lit(0)) * F.col("calls") * 1000 - F.col("micros")) / 1000).cast("long")
    avg = F.round(F.coalesce(F.try_divide(F.col("micros").cast("double"), F.col("calls") * 1000.0), F.lit(0.0)), 2)
    each = j.select("tool", "calls", "response", base.alias("baseline"), F.col("micros"), time.alias("time_saved_ms"))
    total = each.agg(*[F.sum(c).alias(c) for c in ("calls", "response", "baseline", "micros", "time_saved_ms")]).withColumn("tool", F.lit("total"))
    return each.unionByName(total).select("tool", "calls", "baseline", F.greatest(F.lit(0), F.col("baseline") - F.col("response")).cast("long").alias("saved"), avg.alias("avg_ms"), "time_saved_ms")


def saved_cost(tokens: Column, price: Column) -> Column:
    """Price of saved tokens by the million; null without a price or a saving."""
    return F.when(price.isNotNull() & (tokens > 0), tokens / 1e6 * price)


def with_all(tools: DataFrame, counters: list[str]) -> DataFrame:
    """Counters of each tool and of all tools (tool null) in one pass."""
    return tools.rollup("tool").agg(*[F.sum(c).alias(c) for c in counters])


def reset_counters(tools: DataFrame, version: str, tokens: list[str]) -> DataFrame:
    """Token counters that another encoder version counted start again at 0; calls and times stay."""
    old = ~F.col("version").eqNullSafe(F.lit(version))
    return tools.withColumns({c: F.when(old, F.lit(0)).otherwise(F.col(c)) for c in tokens} | {"version": F.lit(version)})


def registered(seen: DataFrame, limits: DataFrame, users: DataFrame) -> DataFrame:
    """The first repositories of each user up to the tier's limit."""
    most = users.join(F.broadcast(limits.select("tier", "max_repos")), "tier").select("user_id", "max_repos")
    first = first_n(seen, "user_id", "fingerprint", "ts", MAX_SAFE)
    return first.join(most, "user_id").where(F.col("rn") <= F.col("max_repos")).select("user_id", "fingerprint", "rn")


def event_gate(events: DataFrame, applied: DataFrame, terminal: tuple[str, ...] = ("cancelled", "completed", "expired")) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): each event id once, by its first arrival; an event of a subscription in a terminal state, or without one, is a dead letter with its reason. applied: (subscription_id, status)."""
    once = latest(events, "event_id", F.col("at").asc(), F.col("payload").asc())
    j = once.join(applied.select("subscription_id", "status"), "subscription_id", "left")
    judged = j.withColumn("reason", F.when(F.col("subscription_id").isNull() | F.col("status").isNull(), "unknown").when(F.col("status").isin(*terminal), "terminal"))
    return judged.where("reason is null").drop("reason", "status"), judged.where("reason is not null").drop("status")
