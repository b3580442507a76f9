"""Embeddings: a pluggable embedder, upserts and semantic search."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import search

Embedder = Callable[[list[str]], np.ndarray]
DIM, BATCH, MOST_CHARS, TRIES = 64, 64, 8192, 3


def hashing_embedder(texts: list[str]) -> np.ndarray:
    """Counts of words by a hash, as unit vectors: the default where no model is at hand."""
    out = np.zeros((len(texts), DIM))
    for row, t in zip(out, texts):
        for w in re.split(r"[^a-z0-9]+", t.lower()):
            if w:
                row[int(hashlib.md5(w.encode()).hexdigest()[:4], 16) % DIM] += 1
    length = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, length, out=out, where=length > 0)


def embed(rows: DataFrame, text: str = "text", embedder: Embedder = hashing_embedder, most_chars: int = MOST_CHARS, batch: int = BATCH, tries: int = TRIES) -> DataFrame:
    """rows with embedding: the first most_chars characters of a text (the model's window; null is empty), in batches, each tried again where the embedder fails."""
    def one(texts: list[str]) -> np.ndarray:
        for k in range(tries):
            try:
                return embedder(texts)
            except Exception:
                if k + 1 == tries:
                    raise
        raise AssertionError

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            texts = [(x or "")[:most_chars] for x in s]
            yield pd.Series([list(map(float, v)) for k in range(0, len(texts), batch) for v in one(texts[k : k + batch])])

    return rows.withColumn("embedding", run(F.col(text)))


def normalised(embedding):
    """A vector of length one; a zero vector stays."""
    length = F.sqrt(F.aggregate(embedding, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(length > 0, F.transform(embedding, lambda x: x.cast("double") / length)).otherwise(F.transform(embedding, lambda x: x.cast("double")))


def upsert(vectors: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    return vectors.join(new.select(key), key, "left_anti").unionByName(new)


def delete(vectors: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return vectors.join(ids.select(key), key, "left_anti")


def read_through(texts: DataFrame, cache: DataFrame, now: int, ttl: int = 30 * 86_400, text: str = "text", embedder: Embedder = hashing_embedder) -> DataFrame:
    """texts with key, embedding and cached: values younger than the TTL come from the cache, of the other texts each distinct one is embedded once."""
    keyed = texts.withColumn("key", F.concat(F.lit("v1:"), F.sha2(text, 256)))
    fresh = cache.where(F.col("at") > now - ttl).select("key", F.col("embedding").alias("known"))
    missing = keyed.join(fresh, "key", "left_anti").select("key", text).dropDuplicates(["key"])
    made = embed(missing, text, embedder).select("key", F.col("embedding").alias("made"))
    j = keyed.join(fresh, "key", "left").join(made, "key", "left")
    return j.withColumns({"cached": F.col("known").isNotNull(), "embedding": F.coalesce("known", "made")}).drop("known", "made")


def semantic(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "id", embedder: Embedder = hashing_embedder) -> DataFrame:
    """(query, id, distance, rank): the nearest vectors of each query text, embedded like the rows."""
    q = embed(queries.select("query").distinct(), "query", embedder).select("query", F.col("embedding").alias("q"))
    return search.knn(vectors, q, k, key)
