"""The index job: walk, extract, snapshot, and what changed since the last one."""

from __future__ import annotations

import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidParams
from ..functions.text import code_terms, ignored
from .incremental import apply_changes, cascade_delete, snapshot_diff


def mtime_prefilter(old: DataFrame, new: DataFrame) -> DataFrame:
    """Paths of new whose time differs from the old snapshot's, or that it lacks: only these are read and hashed."""
    o = old.select("path", F.col("mtime").alias("was"))
    return new.join(o, "path", "left").where(~F.col("was").eqNullSafe(F.col("mtime"))).select(*new.columns)


def changed_by_git(status: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(modified, deleted) of rows (path, status, source): a rename deletes its source and adds its path; what is deleted is not modified."""
    dead = status.where("status = 'D'").select("path").union(status.where("status = 'R' and source is not null").select(F.col("source").alias("path"))).distinct()
    alive = status.where("status in ('A', 'M', 'R')").select("path").distinct()
    return alive.join(dead, "path", "left_anti"), dead


def git_status(spark: SparkSession, root: str, since: str | None = None) -> DataFrame:
    """(path, status, source) of the work tree, and of commits since one. One row a changed file, from one git call each."""
    def ask(*args: str) -> list[str]:
        r = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True)
        if r.returncode:
            raise InvalidParams(r.stderr.strip())
        return r.stdout.split("\0")[:-1]

    rows: list[tuple[str, str, str | None]] = []
    fields = ask("diff", "--name-status", "-z", "-M", since, "HEAD") if since else []
    while fields:
        kind = fields.pop(0)[0]
        first = fields.pop(0)
        rows.append((fields.pop(0), "R", first) if kind in "RC" else (first, kind, None))
    fields = ask("status", "--porcelain", "-z", "--untracked-files=all")
    while fields:
        f = fields.pop(0)
        kind = f[:2].strip()[:1]
        rows.append((f[3:], "R", fields.pop(0)) if kind in "RC" else (f[3:], "A" if kind == "?" else kind, None))
    return spark.createDataFrame(rows, "path string, status string, source string")


def contained(root: str, path: str) -> str:
    """The real path, which must lie under the root, whatever links are on the way."""
    base, real = Path(root).resolve(), (Path(root) / path).resolve()
    if real != base and base not in real.parents:
        raise InvalidParams(f"outside the root: {path}")
    return str(real)


def purge_ignored(files: DataFrame, symbols: DataFrame, refs: DataFrame, before: list[str], now: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables without files that the new patterns ignore; unchanged patterns leave all as it is."""
    if sorted(before) == sorted(now):
        return files, symbols, refs
    return cascade_delete(files, symbols, refs, files.where(ignored(F.col("path"), now)))


def drop_meta(meta: DataFrame, prefix: str) -> DataFrame:
    return meta.where(~F.col("key").startswith(prefix))


def incremental(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """files, symbols and refs after the new snapshot: rows of changed and deleted paths go, those of changed paths come. new holds the whole snapshot of files, and symbols and refs of changed paths at least."""
    diff = snapshot_diff(old["files"].select("path", "hash"), new["files"].select("path", "hash"))
    changed = diff.where("status = 'changed'").select("path")
    _, symbols, refs = cascade_delete(old["files"], old["symbols"], old["refs"], diff)
    come = new["symbols"].join(changed, "path", "left_semi")
    return {
        "files": apply_changes(old["files"], new["files"], diff),
        "symbols": symbols.unionByName(come),
        "refs": refs.unionByName(new["refs"].join(come.select(F.col("id").alias("src_symbol_id")), "src_symbol_id", "left_semi")),
    }


def merged_ranges(ranges: DataFrame, key: str = "path") -> DataFrame:
    """(key, start, stop): half-open ranges of each key, those that overlap made one; ranges that touch stay apart."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy("start", "stop")
    r = ranges.withColumn("before", F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    r = r.withColumn("part", F.sum(F.coalesce((F.col("start") >= F.col("before")).cast("int"), F.lit(1))).over(w))
    return r.groupBy(key, "part").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("part")


def save_snapshot(tables: dict[str, DataFrame], folder: str, version: int) -> None:
    """Tables under folder/version, and last of all the mark that makes the version one to read."""
    spark = next(iter(tables.values())).sparkSession
    for name, t in tables.items():
        t.write.mode("overwrite").parquet(f"{folder}/{version:012d}/{name}")
    spark.createDataFrame([(sorted(tables),)], "tables array<string>").coalesce(1).write.mode("overwrite").parquet(f"{folder}/marks/version={version}")


def open_snapshot(spark: SparkSession, folder: str, version: int | None = None) -> dict[str, DataFrame]:
    """All tables of one version, the latest complete one by default: later writes don't change what is read."""
    marks = spark.read.parquet(f"{folder}/marks")
    found = marks.orderBy(F.col("version").desc()).first() if version is None else marks.where(F.col("version") == version).first()
    if found is None:
        raise InvalidParams(f"no snapshot {version}")
    return {t: spark.read.parquet(f"{folder}/{found['version']:012d}/{t}") for t in found["tables"]}


def postings(symbols: DataFrame, most_bytes: int = 60_000) -> DataFrame:
    """(path, field, term, id, tf, len) over name, qualified name, signature and doc; fields are cut at most_bytes between characters."""
    every = None
    for name in ("name", "qualified_name", "signature", "doc"):
        text = F.coalesce(F.col(name), F.lit(""))
        short = F.when(F.octet_length(text) <= most_bytes, text).otherwise(_cut(text, most_bytes))
        terms = F.filter(F.split(F.lower(short), r"[^\p{L}\p{N}]+"), lambda w: w != "") if name == "doc" else code_terms(short)
        t = symbols.select("path", "id", F.lit(name).alias("field"), terms.alias("terms")).withColumn("len", F.size("terms"))
        # A row's terms are counted beside its list: a table of all rows' terms would be held by the few tasks that read a small file.
        each = t.select("path", "id", "field", "len", "terms", F.explode(F.array_distinct("terms")).alias("term"))
        tf = F.size(F.filter("terms", lambda x: x == F.col("term"))) if name == "doc" else F.lit(1)  # code terms are distinct
        part = each.select("path", "field", "term", "id", "len", tf.cast("long").alias("tf"))
        every = part if every is None else every.unionByName(part)
    return every


def _cut(text, most: int):
    """The first `most` bytes of a text without a broken last character."""
    raw = F.encode(text, "UTF-8")
    late = lambda k: F.hex(F.substring(raw, most - k + 1, 1)).rlike("^[89AB]")
    at = F.lit(most) - F.when(~late(0), 0).when(~late(1), 1).when(~late(2), 2).otherwise(3)
    return F.decode(F.substring(raw, F.lit(1), at), "UTF-8")


def maintain(old: DataFrame, symbols: DataFrame, changed: DataFrame) -> DataFrame:
    """Postings after a change: those of the changed paths go, those of their present symbols come."""
    return old.join(changed.select("path").distinct(), "path", "left_anti").unionByName(postings(symbols.join(changed.select("path").distinct(), "path", "left_semi")))
