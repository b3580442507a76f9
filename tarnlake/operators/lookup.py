"""Symbol lookup and file views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lower_ascii
from ..session import cut


def exact(symbols: DataFrame, name: str, limit: int | None = None) -> DataFrame:
    hits = symbols.where(lower_ascii(F.col("name")) == lower_ascii(F.lit(name)))
    return hits if limit is None else hits.orderBy("path", "byte_start", "id").limit(limit)


def resolve(symbols: DataFrame, wanted: DataFrame) -> DataFrame:
    """(wanted, id, tier): all rows of the first tier that has any; exact and caseless qualified name, then name."""
    # Files of repeating names are far smaller than their rows, so a size guessed from them would send all symbols through the driver.
    w = wanted.select("wanted", lower_ascii(F.col("wanted")).alias("lw")).distinct().hint("merge")
    s = symbols.select("id", "name", "qualified_name")
    by_q, by_n = s.withColumn("lw", lower_ascii(F.col("qualified_name"))), s.withColumn("lw", lower_ascii(F.col("name")))
    q = by_q.join(w, "lw").select("wanted", "id", F.when(F.col("qualified_name") == F.col("wanted"), 1).otherwise(2).alias("tier"))
    n = by_n.join(w, "lw").select("wanted", "id", F.when(F.col("name") == F.col("wanted"), 3).otherwise(4).alias("tier"))
    every = q.unionByName(n)
    first = every.groupBy("wanted").agg(F.min("tier").alias("tier"))
    return every.join(first.hint("merge"), ["wanted", "tier"]).select("wanted", "id", "tier").distinct()


def file_summaries(files: DataFrame, symbols: DataFrame, top: int = 3) -> DataFrame:
    """path, n_symbols and the first top-level "kind name" entries by position."""
    entry = F.when(F.col("parent_id").isNull(), F.struct("byte_start", F.concat_ws(" ", "kind", "name").alias("e")))
    s = symbols.groupBy("path").agg(F.count("id").alias("n_symbols"), F.slice(F.array_sort(F.collect_list(entry)), 1, top).alias("tops"))
    out = files.select("path").join(s, "path", "left")
    return out.select("path", F.coalesce("n_symbols", F.lit(0)).alias("n_symbols"), F.coalesce(F.array_join(F.transform("tops", lambda x: x["e"]), ", "), F.lit("")).alias("tops"))


def outline(symbols: DataFrame) -> DataFrame:
    """One row for each top-level symbol with its children in order, as text "kind name"."""
    child = symbols.where("parent_id is not null").groupBy(F.col("parent_id").alias("pid")).agg(F.array_sort(F.collect_list(F.struct("byte_start", "id", F.concat_ws(" ", "kind", "name").alias("e")))).alias("c"))
    top = symbols.where("parent_id is null").join(child, F.col("id") == F.col("pid"), "left")
    return top.select("path", "id", F.concat_ws(" ", "kind", "name").alias("entry"), F.coalesce(F.array_join(F.transform("c", lambda x: x["e"]), ", "), F.lit("")).alias("children"))


def skeleton(symbols: DataFrame, depth: int = 2) -> DataFrame:
    """path and its symbols' signatures (or kind and name) with bodies left out."""
    rows = symbols if depth >= 2 else symbols.where("parent_id is null")
    line = F.concat(F.when(F.col("parent_id").isNull(), "").otherwise("  "), F.coalesce("signature", F.concat_ws(" ", "kind", "name")), F.lit(" { ... }"))
    return rows.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("byte_start", "id", line.alias("l")))), lambda x: x["l"]), "\n").alias("content"))


def find_refs(refs: DataFrame, symbols: DataFrame, top: int | None = None) -> DataFrame:
    """ident with the location of each referring symbol; refs of unknown symbols drop; top: first by location for each ident."""
    hits = refs.join(symbols.select("id", F.col("path").alias("at_path"), "line_start", F.col("qualified_name").alias("enclosing")), F.col("src_symbol_id") == F.col("id")).select("ident", "at_path", "line_start", "enclosing", "id")
    if top is None:
        return hits
    w = Window.partitionBy("ident").orderBy("at_path", "line_start", "id")
    return hits.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= top).drop("rn")


def parent_chain(nodes: DataFrame, key: str = "id", parent: str = "parent_id", depth: int = 32) -> DataFrame:
    """(id, ancestor, up) up to depth steps, by pointer doubling; lineage is cut each round."""
    step = cut(nodes.where(F.col(parent).isNotNull()).select(F.col(key).alias("id"), F.col(parent).alias("ancestor"), F.lit(1).alias("up")))
    pairs, reach = step, 1
    while reach < depth:
        nxt = pairs.alias("a").join(pairs.alias("b"), F.col("a.ancestor") == F.col("b.id")).select(F.col("a.id"), F.col("b.ancestor"), (F.col("a.up") + F.col("b.up")).alias("up"))
        more = cut(pairs.unionByName(nxt).where(F.col("up") <= depth).distinct())
        if more.count() == pairs.count():
            break
        pairs, reach = more, reach * 2
    return pairs
