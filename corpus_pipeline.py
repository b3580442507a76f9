"""A training corpus from documents: quality rules, near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and decides over all rows that the stage
before kept; all but the last return the columns of documents. Near duplicates
are texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or
more; wide SimHash fingerprints find candidates and the sets confirm them. SQL
can't express that stage, so there is no ORACLE_SQL; tests hold near-dedup
against exact Jaccard over all pairs and the other stages against planted cases.

Defined cases, for every stage: an empty table gives an empty one; columns beside
doc_id, text and source are carried along, whatever their names; a null text is
an empty one. Each stage says what else it does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnlake.llm import decontam, mixing, quality, simhash
from tarnlake.llm.common import drop_written, shared_dir, table, workers_find_package, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the cascade. Empty and null texts fail; repeated rows are each judged; ids don't matter."""
    shared_dir(spark)
    return quality.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies. Rows without an id stay and take no other's place; of rows alike in id and shingles the one with the smallest text stays, once."""
    shared_dir(spark)
    return simhash.keep_one(docs).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs. Texts without words have none and stay; repeated rows are each searched; an empty benchmark leaves all."""
    workers_find_package(spark)
    return decontam.clean(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, epoch and training position of each copy that the mix takes, sorted by position. A null source is one of its own; documents without words come once; ties of the hash fall to id, size and text."""
    shared_dir(spark)
    return mixing.stream(docs)


STAGES = [("quality rules", quality_rules), ("simhash near-dedup", near_dedup), ("benchmark decontamination", decontaminate), ("mixing", mix)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A stage's table goes when the next one's is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = written(stage(spark, docs, sf_dir), f"stage-{k}")
        if before is not None:
            drop_written(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
