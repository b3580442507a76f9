"""URL filtering by association rules that FP-growth mines from labelled URLs.

A URL is a set of tokens (all host suffixes, all host labels and their parts
between hyphens, the first host label, all path segments by depth, query keys).
Tokens that occur in the same labelled URLs are one class. FP-growth runs over
the labelled sets of classes with the label as an item; rules of any length that
at least LEAST labelled URLs and a share SUPPORT of them bear out, and
whose consequent is a label stay if their confidence is high enough and no rule
with one class less does as well. A class stands for each of its tokens: a rule
with two of them is one that a rule with one less does as well as. A kept rule
is posted under the tokens of its rarest class; a URL's tokens are joined with
the postings and the whole antecedent is verified. The surest matching rule gives the verdict. Listed host
and path rules come first: the longest that fits wins.

Defined cases: null urls and urls without ``://`` have an empty host and path
and no tokens; without rules the verdict is allow; repeated urls are matched
once; labels without a url and unlabelled urls teach nothing; an empty table
gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, lower_az, written

SUPPORT, CONFIDENCE, LEAST, MAX_LISTED = 0.005, 0.7, 3, 1000  #: LEAST: labelled urls that a rule needs at least, whatever their share
_LABEL = "label="


@dataclass(frozen=True)
class Listed:
    verdict: str
    rule: str  #: host/path prefix

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.rule.partition("/")[2]


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty without ://"""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = url.substr(F.instr(url, "://") + 3, F.length(url))
    return F.when(has, lower_az(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))).otherwise(""), F.when(has, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)).otherwise("")


def tokens(url: Column) -> Column:
    """Distinct tokens of a url; none without ://"""
    host, path = parts(url)
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    n = F.size(labels)
    suffixes = F.transform(labels, lambda _, i: F.concat(F.lit("host:"), F.array_join(F.slice(labels, i + 1, n - i), ".")))
    cut = F.flatten(F.transform(labels, lambda x: F.when(F.contains(x, F.lit("-")), F.filter(F.split(x, "-"), lambda y: y != "")).otherwise(F.array().cast("array<string>"))))
    named = F.concat(F.transform(labels, lambda x: F.concat(F.lit("label:"), x)), F.transform(cut, lambda x: F.concat(F.lit("part:"), x)))
    segments = F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), lambda s, i: F.concat(F.lit("path"), i + 1, F.lit(":"), F.regexp_replace(lower_az(s), r"[0-9]+", "0")))
    query = F.transform(F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#]+)"), 1), lambda k: F.concat(F.lit("query:"), lower_az(k)))
    scheme = F.array(F.concat(F.lit("scheme:"), lower_az(F.substring_index(url, "://", 1))))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(suffixes, named, F.transform(F.slice(labels, 1, 1), lambda x: F.concat(F.lit("first:"), x)), segments, query, scheme)))


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, least: int = LEAST) -> DataFrame:
    """(rule_id, antecedent, verdict, confidence, support, rarest) mined from labelled (url, verdict). antecedent: the classes' tokens; rarest: those of one class."""
    sets = written(labelled.where("url is not null and verdict is not null").select(F.monotonically_increasing_id().alias("row"), tokens(F.col("url")).alias("items"), "verdict"), "sets")
    single = sets.select("row", F.explode("items").alias("token"))
    n = sets.count()
    least = max(least, math.ceil(support * n))
    seen = single.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("row").cast("decimal(38,0)")).alias("rows"))
    classes = written(seen.where(F.col("n") >= least).groupBy("n", "rows").agg(F.sort_array(F.collect_list("token")).alias("members"), F.min("token").alias("class")), "classes")
    found = single.join(classes.select("class", F.explode("members").alias("token")), "token").groupBy("row").agg(F.collect_set("class").alias("found"))
    baskets = written(sets.select("row", "verdict").join(found, "row", "left").select(F.concat(F.coalesce("found", F.array().cast("array<string>")), F.array(F.concat(F.lit(_LABEL), "verdict"))).alias("items")), "baskets")
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / max(n, 1)), minConfidence=confidence).fit(baskets)
    rules = model.associationRules.where(F.element_at("consequent", 1).startswith(_LABEL) & ~F.exists("antecedent", lambda x: x.startswith(_LABEL)))
    rules = written(rules.select(F.array_sort("antecedent").alias("antecedent"), F.substring_index(F.element_at("consequent", 1), "=", -1).alias("verdict"), "confidence", "support"), "rules")
    less = rules.where(F.size("antecedent") > 1).select("antecedent", "verdict", "confidence", F.explode("antecedent").alias("out")).select("antecedent", "verdict", "confidence", F.filter("antecedent", lambda x: x != F.col("out")).alias("shorter"))
    known = rules.select(F.col("antecedent").alias("shorter"), F.col("verdict").alias("v"), F.col("confidence").alias("c"))
    covered = less.join(known, "shorter").where("v = verdict and c >= confidence").select("antecedent", "verdict").distinct()
    kept = rules.join(covered, ["antecedent", "verdict"], "left_anti").withColumn("rule_id", F.xxhash64("antecedent", "verdict"))
    each = kept.select("rule_id", F.explode("antecedent").alias("class")).join(classes, "class")
    whole = each.groupBy("rule_id").agg(F.collect_list("members").alias("antecedent"), F.min_by("members", F.struct("n", "class")).alias("rarest"))
    return written(kept.drop("antecedent").join(whole, "rule_id").select("rule_id", "antecedent", "verdict", "confidence", "support", "rarest"), "kept")


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, mined verdict, confidence) of distinct urls that a rule fits. Postings meet only urls with a token of the rule's rarest class."""
    sets = urls.where("url is not null").select("url").distinct().withColumn("items", tokens(F.col("url")))
    posted = rules.withColumn("rarest", F.explode("rarest"))
    hits = sets.select("url", "items", F.explode("items").alias("rarest")).join(posted, "rarest").where(F.forall("antecedent", lambda c: F.arrays_overlap(c, F.col("items"))))
    best = F.max_by("verdict", F.struct("confidence", "support", F.col("verdict") == "allow"))
    return hits.groupBy("url").agg(best.alias("mined"), F.max("confidence").alias("confidence"))


def judge(pages: DataFrame, listed: list[Listed], labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """pages with host, path, rule, mined, confidence and verdict; columns of pages with these names give way."""
    if len(listed) > MAX_LISTED:
        raise ValueError(f"over {MAX_LISTED} listed rules")
    pages = pages.drop("host", "path", "rule", "mined", "confidence", "verdict")
    asked = fresh(pages.columns, "asked_url")
    mined = match(pages, mine(labelled, support, confidence)).select(F.col("url").alias(asked), "mined", "confidence")
    host, path = parts(F.col("url"))
    p = pages.withColumns({"host": host, "path": path})
    rule, said = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(listed, key=lambda r: (len(r.rule), r.rule)):  # the longest is asked first
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        rule, said = F.when(fits, F.lit(r.rule)).otherwise(rule), F.when(fits, F.lit(r.verdict)).otherwise(said)
    p = p.join(mined, F.col("url") == F.col(asked), "left").drop(asked)
    return p.withColumns({"rule": rule, "verdict": F.coalesce(said, "mined", F.lit("allow"))})
