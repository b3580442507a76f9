"""Token accounting: counts, what the same answer would cost by reading files, and baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import capped_tokens, estimate_tokens, word_match
from . import search

#: tool, median tokens, low, high, milliseconds of the read-and-grep way.
STATIC = (
    ("code_outline", 0, 0, 0, 200), ("code_skeleton", 0, 0, 0, 200), ("code_read_symbol", 0, 0, 0, 250), ("code_find_symbol", 27534, 19494, 52240, 800),
    ("code_find_refs", 5979, 1665, 38276, 600), ("code_find_strings", 0, 0, 0, 400), ("code_search", 0, 0, 0, 500), ("code_multi_find", 0, 0, 0, 1000),
    ("code_list", 0, 0, 0, 2000), ("code_repo_map", 33549, 32517, 34487, 5000), ("code_path", 12219, 8543, 12327, 2000), ("code_callers", 15711, 5764, 50099, 800),
    ("code_callees", 15711, 5764, 50099, 800), ("code_context", 0, 0, 0, 1500), ("code_impact", 14960, 7837, 14960, 3000), ("code_subsystems", 39706, 38674, 40644, 4000),
    ("code_subsystem", 26151, 26151, 26151, 1500), ("code_stats", 0, 0, 0, 0), ("code_reindex", 0, 0, 0, 0), ("code_savings", 0, 0, 0, 0),
)
DEFINING = r"^[ \t]*(?:fn |struct |class |def |func |pub fn |pub struct )([\p{L}\p{N}_]{3,})"


def static_baselines(spark) -> DataFrame:
    return spark.createDataFrame(list(STATIC), "tool string, tokens long, low long, high long, latency_ms long")


def local_baselines(static: DataFrame, local: DataFrame) -> DataFrame:
    """(tool, tokens): the local value where there is one; tools that are measured call by call (static 0) stay 0."""
    both = static.select("tool", F.col("tokens").alias("s")).join(local.select("tool", F.col("tokens").alias("l")), "tool", "full_outer")
    return both.select("tool", F.when(F.col("s") == 0, F.lit(0)).otherwise(F.coalesce("l", "s", F.lit(0))).cast("long").alias("tokens"))


def count_tokens(texts: DataFrame, text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """texts with n_tokens: by the tokenizer file (a vocabulary of the tokenizers library), else by the estimate. Null has none."""
    if tokenizer is None:
        return texts.withColumn("n_tokens", F.coalesce(estimate_tokens(F.col(text)), F.lit(0)).cast("long"))
    import pandas as pd

    @F.pandas_udf("long")
    def counted(batches: pd.Series) -> pd.Series:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(tokenizer)
        return pd.Series([len(e.ids) for e in t.encode_batch([x or "" for x in batches], add_special_tokens=False)])

    return texts.withColumn("n_tokens", counted(F.col(text)))


def file_baseline(files: DataFrame, text: str = "text", cap: int = 32 * 1024, largest: int = 1 << 20) -> DataFrame:
    """files with read_tokens, what reading the file costs; null above the size cap."""
    return files.withColumn("read_tokens", F.when(F.octet_length(text) <= largest, capped_tokens(F.col(text), cap)))


def sample_identifiers(contents: DataFrame, n_files: int = 20, n_lines: int = 200, most: int = 9) -> DataFrame:
    """(place, ident): the first identifiers after definition keywords, in the first files by path. The limits are the feature."""
    first = contents.select("path", "text").orderBy("path").limit(n_files)
    found = search.lines(first).where(F.col("line") <= n_lines).withColumn("ident", F.regexp_extract("content", DEFINING, 1)).where("ident <> ''")
    each = found.groupBy("ident").agg(F.min(F.struct("path", "line")).alias("at"))
    return each.orderBy("at").limit(most).select(F.row_number().over(Window.orderBy("at")).alias("place"), "ident")


def grep(contents: DataFrame, idents: list[str]) -> DataFrame:
    """(ident, path, bytes): size of the `path:line:text` lines that a word-bounded search prints for each file."""
    ls = search.lines(contents, where=_any_of(F.col("text"), idents))
    size = F.octet_length(F.concat("path", F.lit(":"), F.col("line").cast("string"), F.lit(":"), "content")) + 1
    flags = F.array(*[F.when(word_match(F.col("content"), i), F.lit(i)) for i in idents])
    hits = ls.select("path", size.cast("long").alias("size"), F.explode(F.filter(flags, lambda x: x.isNotNull())).alias("ident"))
    return hits.groupBy("ident", "path").agg(F.sum("size").alias("bytes"))


def _any_of(text: Column, idents: list[str]) -> Column:
    out = F.lit(False)
    for i in idents:
        out = out | text.contains(i)
    return out


def alternatives(contents: DataFrame, idents: list[str], reads: int = 2) -> DataFrame:
    """(tool, ident, tokens): what finding by reading would cost, by tool: grep; grep and the first files hit; three greps and one over tests; listings and reads."""
    spark = contents.sparkSession
    asked = spark.createDataFrame([(i,) for i in idents], "ident string")
    g = grep(contents, idents)
    cost = contents.select("path", estimate_tokens(F.col("text")).alias("read"))
    total = g.groupBy("ident").agg(F.ceil(F.sum("bytes") / 4).cast("long").alias("grep"), F.ceil(F.coalesce(F.sum(F.when(F.lower("path").contains("test"), F.col("bytes"))), F.lit(0)) / 4).cast("long").alias("tests"))
    hit = g.withColumn("rn", F.row_number().over(Window.partitionBy("ident").orderBy("path"))).where(F.col("rn") <= reads).join(cost, "path")
    read = hit.groupBy("ident").agg(F.sum("read").alias("two"), F.sum(F.when(F.col("rn") == 1, F.col("read"))).alias("one"))
    k = asked.join(total, "ident", "left").join(read, "ident", "left").na.fill(0)
    per = F.array(*[F.struct(F.lit(t).alias("tool"), c.cast("long").alias("tokens")) for t, c in (
        ("code_find_refs", F.col("grep")), ("code_find_symbol", F.col("grep") + F.col("two")), ("code_callers", F.col("grep") + F.col("one")),
        ("code_callees", F.col("grep") + F.col("one")), ("code_impact", 3 * F.col("grep") + F.col("tests")),
    )])
    each = k.select("ident", F.explode(per).alias("x")).select("x.tool", "ident", "x.tokens")
    return each.unionByName(listings(contents, cost))


def listings(contents: DataFrame, cost: DataFrame) -> DataFrame:
    """The tools that read the first files: a map of all paths and five files, ten for subsystems, and the first directory with four."""
    first = cost.orderBy("path").limit(10)
    ranked = first.withColumn("rn", F.row_number().over(Window.orderBy("path")))
    reads = ranked.agg(F.sum(F.when(F.col("rn") <= 5, F.col("read"))).alias("five"), F.sum("read").alias("ten"))
    home = F.regexp_replace("path", "/[^/]*$", "")
    whole = cost.agg(F.ceil(F.sum(F.octet_length("path") + 1) / 4).cast("long").alias("map"), F.min_by(home, "path").alias("home"))
    inside = cost.withColumn("home", home).join(F.broadcast(whole.select("home")), "home")
    near = inside.orderBy("path").limit(4).agg(F.sum("read").alias("four"))
    size = inside.agg(F.ceil(F.sum(F.octet_length("path") + 1) / 4).cast("long").alias("dir"))
    one = whole.crossJoin(reads).crossJoin(near).crossJoin(size).na.fill(0)  # one row each
    per = F.array(*[F.struct(F.lit(t).alias("tool"), c.cast("long").alias("tokens")) for t, c in (("code_repo_map", F.col("map") + F.col("five")), ("code_subsystems", F.col("map") + F.col("ten")), ("code_subsystem", F.col("dir") + F.col("four")))])
    return one.select(F.explode(per).alias("x")).select("x.tool", F.lit(None).cast("string").alias("ident"), "x.tokens")


def calibrated(costs: DataFrame) -> DataFrame:
    """(tool, tokens): the upper median of each tool's costs."""
    from .savings import nth

    return nth(costs, "tool", "tokens", F.floor(F.col("n") / 2) + 1, "tokens")


def correction(samples: DataFrame) -> DataFrame:
    """One row (ratio): counted over estimated tokens of the samples, 1.0 without any."""
    return samples.agg(F.coalesce(F.try_divide(F.sum("counted").cast("double"), F.sum("estimated").cast("double")), F.lit(1.0)).alias("ratio"))


def stale(stored: Column, current: Column, drift: float = 0.25) -> Column:
    """Whether the number of files moved by over a quarter since a calibration; one of no files, or none, is stale."""
    s = F.coalesce(stored, F.lit(0)).cast("double")
    return (s == 0) | (F.abs(current - s) / s > drift)


def divergence(rows: DataFrame, most: float = 0.15) -> DataFrame:
    """rows (tool, measured, static) with divergence and passes."""
    d = F.abs(F.col("measured") - F.col("static")) / F.col("static")
    return rows.withColumn("divergence", d).withColumn("passes", F.coalesce(F.col("divergence") < most, F.lit(False)))


def gate(rows: DataFrame, least: int = 5) -> DataFrame:
    """One row (passing, tools, ok): at least `least` tools must pass."""
    return divergence(rows).agg(F.count_if(F.col("passes")).alias("passing"), F.count(F.lit(1)).alias("tools")).withColumn("ok", F.col("passing") >= least)
