"""Quality rules as a short-circuit cascade, in DataFrame functions alone.

Statistics of a text are columns. Base rules come first and are fixed. The other
rules are ordered on a sample of bounded size: each rule's cost is timed and the
share of rows that it rejects counted; rules go by rejections per cost, highest
first. The cascade is one CASE expression, so a row is judged up to the first
rule that rejects it. The order changes the work, never the verdict.

Repeated windows are found inside the row: hashes of all 8-word windows, a
distinct count for the common case of none, and only where some repeat a sort
of (hash, place) whose equal neighbours mark the covered words.

Defined cases: null and empty texts have no words, all statistics 0, and fail
the base rules; n_dup_lines counts lines with a word equal to an earlier line,
blanks included in the comparison; repeated rows are each judged; an empty table
gives no rows; rules that a sample can't tell apart keep the order given. A
column of docs that has a name which ``judge`` returns gives way to it; ``keep``
returns the columns of docs as they were, whatever their names.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, bounded_sample

SAMPLE = 2000  #: rows that costs and rejections are estimated on
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """rejects: SQL over the text and its cheap statistics, true where the row goes."""

    name: str
    rejects: str


RULES = (
    Rule("symbols", "n_symbols > 0.25 * n_words"),
    Rule("dup_lines", "n_dup_lines > 0.5 * n_lines"),
    Rule("capitals", "n_upper > 0.4 * (n_upper + n_lower)"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 14 * n_words"),
    Rule("exclamation", "n_marks > 0.3 * n_words"),
    Rule("letters", "n_upper + n_lower < 0.4 * word_chars"),
)

_HAS_WORD = r"[^\x20\x09-\x0D]"


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with word, line and window statistics as columns _s.* added; no shuffle."""
    t = F.coalesce(F.col(text), F.lit(""))
    without = lambda chars: (F.length(t) - F.length(F.translate(t, chars, ""))).cast("long")
    one = docs.withColumns({"_w": F.split(F.btrim(t, F.lit(" \t\n\x0b\x0c\r")), BLANK), "_l": F.filter(F.split(t, "\n"), lambda x: x.rlike(_HAS_WORD))})
    empty = F.get("_w", F.lit(0)) == ""
    two = one.withColumns({
        "_q": F.struct(
            F.when(empty, F.lit(0)).otherwise(F.size("_w")).cast("long").alias("n_words"),
            F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
            without("#*$%&|<>").alias("n_symbols"),
            (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
            F.size("_l").cast("long").alias("n_lines"),
        ),
        "_h": F.when(F.size("_w") >= WINDOW, F.transform("_w", lambda w: F.xxhash64(w))).otherwise(F.array().cast("array<bigint>")),
    }).drop("_w", "_l")
    # From here on only longs travel: hashes of 2, 4 and 8 words from those of 1, 2 and 4.
    pair = lambda h, by: F.zip_with(h, F.slice(h, by + 1, F.greatest(F.size(h), F.lit(1))), lambda a, b: F.xxhash64(a, b))
    three = two
    for by in (1, 2, 4):
        three = three.withColumn("_h", pair(F.col("_h"), by))
    three = three.withColumn("_h", F.slice("_h", 1, F.greatest(F.size("_h") - (WINDOW - 1), F.lit(0))))
    three = three.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("_h")
    same = lambda s, i: F.coalesce(F.get("_s", i)["h"] == s["h"], F.lit(False))
    four = three.withColumn("_p", F.when(F.col("_s").isNotNull(), F.sort_array(F.transform(F.filter("_s", lambda s, i: same(s, i - 1) | same(s, i + 1)), lambda s: s["i"])))).drop("_s")
    steps = F.zip_with("_p", F.slice("_p", 2, F.greatest(F.size("_p"), F.lit(1))), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    repeats = F.coalesce(F.when(F.col("_p").isNotNull(), F.aggregate(steps, F.lit(0), lambda a, x: a + x)), F.lit(0)).cast("long")
    return four.withColumn("_q", F.struct(F.col("_q.*"), repeats.alias("n_repeat_words"))).drop("_p")


def _bind(rule: Rule, text: str) -> Column:
    """The rule's condition with its statistics put in, so that a CASE reaches them only when it must."""
    sql = rule.rejects
    t = f"coalesce(`{text}`, '')"
    for name, pattern in (("n_upper", r"\\p{Lu}+"), ("n_lower", r"[\\p{L}&&[^\\p{Lu}]]+"), ("n_marks", "!+")):
        sql = sql.replace(name, f"(length({t}) - length(regexp_replace({t}, '{pattern}', '')))")
    for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words"):
        sql = sql.replace(name, f"_q.{name}")
    return F.coalesce(F.expr(sql), F.lit(False))


BASE = (Rule("too_short", "n_words < 20"), Rule("repeats", "100 * n_repeat_words > 30 * n_words"))


def order_rules(docs: DataFrame, rules=RULES, text: str = "text", bound: int = SAMPLE) -> list[Rule]:
    """rules by rejections per cost on at most bound rows, those whose texts hash lowest."""
    if not rules:
        return []
    sample = statistics(bounded_sample(docs.select(text), [text], bound), text).persist()

    def timed(condition: Column) -> float:
        """Of three runs the shortest: the first one compiles, and any may be disturbed."""
        took = []
        for _ in range(3):
            began = time.perf_counter()
            sample.agg(F.count_if(condition)).first()
            took.append(time.perf_counter() - began)
        return min(took)

    try:
        n = sample.count()
        if not n:
            return list(rules)
        rejected = sample.agg(*[F.count_if(_bind(r, text)).alias(r.name) for r in rules]).first()
        empty = timed(F.lit(False))  # what a job takes that judges nothing
        cost = {r.name: max(1e-3, timed(_bind(r, text)) - empty) for r in rules}
    finally:
        sample.unpersist()
    return sorted(rules, key=lambda r: -rejected[r.name] / cost[r.name])


def judge(docs: DataFrame, rules=RULES, text: str = "text", bound: int = SAMPLE, base=BASE) -> DataFrame:
    """docs with _q (statistics), base_failed, rejected_by (null: none) and kept."""
    ordered = order_rules(docs, rules, text, bound)
    d = statistics(docs, text)
    failed = F.lit(False)
    for r in base:
        failed = failed | _bind(r, text)
    verdict = F.when(F.col("base_failed"), F.lit("base"))
    for r in ordered:
        verdict = verdict.when(_bind(r, text), F.lit(r.name))
    return d.withColumn("base_failed", failed).withColumn("rejected_by", verdict).withColumn("kept", F.col("rejected_by").isNull())


def keep(docs: DataFrame, rules=RULES, text: str = "text", bound: int = SAMPLE) -> DataFrame:
    """The rows of docs that pass, with the columns of docs.

    The row mark stops the optimizer from pushing the condition through the
    projections that make the statistics: it would write each into the next and
    compute them again and again.
    """
    own = [f"c{k}" for k in range(len(docs.columns))]
    judged = judge(docs.toDF(*own), rules, own[docs.columns.index(text)], bound).withColumn("_row", F.monotonically_increasing_id())
    return judged.where(F.col("kept") & (F.col("_row") >= 0)).select(*own).toDF(*docs.columns)
