"""Text scans and ranked retrieval. Every top-k has a total order."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, StructField, StructType

from ..errors import InvalidParams
from ..functions.text import BLANKS, classify, estimate_tokens

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not find this module

MAX_TERMS, KNN_BLOCK = 256, 8192  #: query terms that are filtered by a list; queries (of some hundred bytes) that are sent to all executors at once
KNN_ROWS, KNN_PAIRS = 1024, 200_000_000  #: rows of either side in a product; pairs of a task


def _is_pattern(contents: DataFrame, pattern: str) -> bool:
    try:
        contents.sparkSession.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception:  # the JVM's PatternSyntaxException arrives as a Py4J error
        return False
    return True


def lines(contents: DataFrame, path: str = "path", text: str = "text", where: Column | None = None) -> DataFrame:
    """(path, line, content): 1-based lines; a last newline opens no line. Rows without a chance are dropped before they are split."""
    c = contents if where is None else contents.where(where)
    one = F.regexp_replace(F.col(text), r"\r?\n\z", "")
    return c.select(F.col(path).alias("path"), F.posexplode(F.split(one, r"\r?\n")).alias("k", "raw")).select("path", (F.col("k") + 1).alias("line"), F.rtrim("raw", F.lit(BLANKS)).alias("content"))


def literal(contents: DataFrame, needle: str, limit: int | None = None, **cols: str) -> DataFrame:
    hits = lines(contents, where=F.col(cols.get("text", "text")).contains(needle), **cols).where(F.col("content").contains(needle))
    return hits if limit is None else hits.orderBy("path", "line").limit(limit)


def regex(contents: DataFrame, pattern: str, limit: int | None = None, **cols: str) -> DataFrame:
    """Matching lines with the 1-based column of the first match. Texts without any match are not split, where no anchor ties the pattern to a line. A pattern that is none raises InvalidParams."""
    if not _is_pattern(contents, pattern):
        raise InvalidParams(f"no regular expression: {pattern}")
    whole = None if re.search(r"[$^]|\\[AzZG]|\(\?", pattern) else F.col(cols.get("text", "text")).rlike(pattern)
    hits = lines(contents, where=whole, **cols).where(F.col("content").rlike(pattern))
    hits = hits.withColumn("column", F.length(F.substring_index(F.regexp_replace("content", f"(?s)({pattern}).*$", "\x00"), "\x00", 1)) + 1)
    return hits if limit is None else hits.orderBy("path", "line").limit(limit)


def multi_find(contents: DataFrame, patterns: list[str], per_pattern: int | None = None, **cols: str) -> DataFrame:
    """Every occurrence of each pattern on its own, with its 1-based column in bytes; one pass over the lines with the patterns as a literal array."""
    patterns = list(dict.fromkeys(p for p in patterns if p))
    if not patterns:
        return lines(contents, **cols).where("false").select("path", "line", "content", F.lit("").alias("pattern"), F.lit(0).alias("column"))
    text, some = F.col(cols.get("text", "text")), F.lit(False)
    for p in patterns:
        some = some | text.contains(p)
    found = F.filter(F.array(*[F.lit(p) for p in patterns]), lambda p: F.contains(F.col("content"), p))
    hits = lines(contents, where=some, **cols).select("path", "line", "content", F.explode(found).alias("pattern"))
    # What stands between the occurrences gives their places: pieces and patterns before them, in bytes.
    pieces = F.transform(F.split("content", F.concat(F.lit(r"\Q"), F.col("pattern"), F.lit(r"\E"))), lambda x: F.octet_length(x))
    ends = F.transform(pieces, lambda _, i: F.aggregate(F.slice(pieces, 1, i + 1), F.lit(0), lambda a, x: a + x) + i * F.octet_length("pattern") + 1)
    hits = hits.withColumn("column", F.explode(F.slice(ends, 1, F.size(pieces) - 1)))
    if per_pattern is None:
        return hits
    rank = F.row_number().over(Window.partitionBy("pattern").orderBy("path", "line", "column"))
    return hits.withColumn("rn", rank).where(F.col("rn") <= per_pattern).drop("rn")


def measured_scan(contents: DataFrame, needle: str, cap: int = 1_000_000, **cols: str) -> DataFrame:
    """(hits, tokens): lines found and their token cost, capped."""
    return literal(contents, needle, **cols).agg(F.count(F.lit(1)).alias("hits"), F.least(F.coalesce(F.sum(estimate_tokens(F.col("content"))), F.lit(0)), F.lit(cap)).cast("long").alias("tokens"))


def find_strings(contents: DataFrame, needle: str, kind: str = "both", **cols: str) -> DataFrame:
    hits = literal(contents, needle, **cols).withColumn("kind", classify(F.col("content"), needle))
    return hits if kind == "both" else hits.where(F.col("kind") == kind)


def trigram(rows: DataFrame, needle: str, *columns: str) -> DataFrame:
    """Case-insensitive substring over the columns; shorter than three characters finds nothing."""
    if len(needle) < 3:
        return rows.where("false")
    out = F.lit(False)
    for c in columns:
        out |= F.coalesce(F.lower(F.col(c)).contains(needle.lower()), F.lit(False))
    return rows.where(out)


def bm25(docs: DataFrame, queries: DataFrame, fields: dict[str, Column], key: str = "id", k: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query, id, score, rank): per-field BM25, summed. docs: key and fields of term arrays; queries: (query, term)."""
    terms = queries.select("query", F.lower("term").alias("term")).distinct()
    wanted = [r["term"] for r in terms.select("term").distinct().limit(MAX_TERMS + 1).collect()]  # a stated query set
    few = len(wanted) <= MAX_TERMS
    every = None
    for name, col in fields.items():
        p = docs.select(F.col(key).alias("id"), col.alias("terms")).withColumn("len", F.size("terms").cast("double"))
        stats = p.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("len").alias("avg_len"))  # one row
        asked = F.filter("terms", lambda t: t.isin(wanted)) if few else F.col("terms")  # other words never become rows
        post = p.select("id", "len", F.explode(asked).alias("term"))
        if not few:
            post = post.join(terms.select("term").distinct(), "term", "left_semi")
        post = post.groupBy("term", "id", "len").agg(F.count(F.lit(1)).cast("double").alias("tf"))
        df = post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        s = post.join(df, "term").crossJoin(F.broadcast(stats))
        idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        tf = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
        s = s.select("term", "id", (idf * tf).alias("s"))
        every = s if every is None else every.unionByName(s)
    scores = every.join(terms, "term").groupBy("query", "id").agg(F.round(F.sum("s"), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "id"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


def rrf(lists: list[DataFrame], key: str, k: int = 20, c: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of (key, rank from 1)."""
    every = None
    for ranked in lists:
        part = ranked.select(F.col(key).alias("key"), (F.lit(1.0) / (c + F.col("rank"))).alias("s"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy("key").agg(F.round(F.sum("s"), 9).alias("score")).orderBy(F.col("score").desc(), "key").limit(k)


def knn(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "id", embedding: str = "embedding", split: bool = True) -> DataFrame:
    """(query, id, distance, rank) by L2. queries: (query, q), a stated set; it meets the vectors in blocks of at most KNN_BLOCK queries, each block one pass."""
    n = queries.count() if split else 0
    if n > KNN_BLOCK:
        numbered = queries.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(-(-n // (KNN_BLOCK // 2)))))
        every = None
        for b in range(-(-n // (KNN_BLOCK // 2))):
            part = knn(vectors, numbered.where(F.col("block") == b).drop("block"), k, key, embedding, False)
            every = part if every is None else every.unionByName(part)
        return every
    asked = queries.where("q is not null").select("query", F.transform("q", lambda x: x.cast("double")).alias("q")).collect()  # a block
    rows = vectors.where(F.col(embedding).isNotNull()).select(F.col(key).alias("id"), F.transform(embedding, lambda x: x.cast("double")).alias("v"))
    schema = StructType([queries.schema["query"], vectors.select(F.col(key).alias("id")).schema["id"], StructField("distance", DoubleType())])
    if not asked:
        return vectors.sparkSession.createDataFrame([], schema).withColumn("rank", F.lit(1))
    sent = vectors.sparkSession.sparkContext.broadcast(([r["query"] for r in asked], np.array([r["q"] for r in asked], dtype=np.float64)))
    types = [to_arrow_type(f.dataType) for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = sent.value
        for at, ids, d in nearest(q, batches, k):
            yield pa.RecordBatch.from_arrays([pa.array([names[x] for x in at], types[0]), pa.array(ids, types[1]), pa.array(d, types[2])], ["query", "id", "distance"])

    # A file of vectors may be one task; the pairs are the work, so they set how many there are.
    pairs = rows.repartition(max(1, min(2000, rows.count() * len(asked) // KNN_PAIRS))).mapInArrow(run, schema)
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "id"))
    return pairs.withColumn("distance", F.round("distance", 6)).withColumn("rank", rank).where(F.col("rank") <= k)


def nearest(q: np.ndarray, batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[np.ndarray, list, np.ndarray]]:
    """(places of queries, ids, distances): of (id, v) all that may be among the k of least distance to 6 digits, then least id.

    Products of matrices leave out pairs that are further than any of them by more than their rounding; the others'
    distances are summed term by term. Of equal distances the k least ids are kept, so what is held is k rows a query or little more.
    """
    near = (np.empty(0, np.int64), np.empty(0, object), np.empty(0))
    qn, limit = (q * q).sum(axis=1), np.full(len(q), np.inf)
    for batch in batches:
        every, flat = np.array(batch.column(0).to_pylist(), dtype=object), batch.column(1)
        for s in range(0, batch.num_rows, KNN_ROWS):
            ids, v = every[s : s + KNN_ROWS], np.stack(flat.slice(s, KNN_ROWS).to_numpy(zero_copy_only=False))
            vn, found = (v * v).sum(axis=1), [near]
            for b in range(0, len(q), KNN_ROWS):
                part = q[b : b + KNN_ROWS]
                slack = 1e-12 * (qn[b : b + KNN_ROWS] + vn.max())
                d2 = vn[None, :] + qn[b : b + KNN_ROWS, None] - 2 * (part @ v.T)
                bound = limit[b : b + KNN_ROWS]
                if len(ids) >= k and np.isinf(bound).any():
                    bound = np.minimum(bound, _beyond(np.sqrt(np.maximum(np.partition(d2, k - 1, axis=1)[:, k - 1], 0) + slack)))
                i, j = np.nonzero(d2 <= (bound + slack)[:, None])
                for c in range(0, len(i), 1 << 20):
                    ci, cj = i[c : c + (1 << 20)], j[c : c + (1 << 20)]
                    total = np.zeros(len(ci))
                    for x in range(q.shape[1]):
                        total += (v[cj, x] - part[ci, x]) ** 2
                    found.append(_first((ci + b, ids[cj], np.sqrt(total)), k)[0])
            near, most = _first(tuple(np.concatenate(x) for x in zip(*found)), k)
            limit[most[0]] = _beyond(most[1])
    yield near[0], near[1].tolist(), near[2]


def _beyond(d: np.ndarray) -> np.ndarray:
    """The square of a distance beyond all that are rounded to the same 6 digits."""
    return (d + 2e-6) ** 2


def _first(rows: tuple[np.ndarray, np.ndarray, np.ndarray], k: int) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """rows (query, id, distance) that may be among the k of their query, and (query, distance) of each k-th."""
    place = np.argsort(rows[1], kind="stable")
    at, ids, d = (x[place] for x in rows)
    place = np.lexsort((d, at))  # stable: ids stay in order
    at, ids, d = at[place], ids[place], d[place]
    since = lambda new: np.arange(len(new)) - np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    new = np.r_[True, at[1:] != at[:-1]][: len(at)]
    kth = since(new) == k - 1
    far = np.full(int(at.max(initial=-1)) + 1, np.inf)
    far[at[kth]] = d[kth] + 2e-6
    kept = (d <= far[at]) & (since(new | np.r_[True, d[1:] != d[:-1]][: len(d)]) < k)
    return (at[kept], ids[kept], d[kept]), (at[kth], d[kth])


def fuzzy_score(candidate: str, query: str) -> int | None:
    """Ordered-subsequence score: 16 a hit, 8 more at a word's start, 6 if next to the last, less 1 a skipped character, at most 10 a gap. Smart case."""
    c = candidate if query != query.lower() else candidate.lower()
    score, at = 0, -1
    for ch in query:
        k = c.find(ch, at + 1)
        if k < 0:
            return None
        start = k == 0 or not candidate[k - 1].isalnum() or (candidate[k].isupper() and candidate[k - 1].islower())
        score += 16 + 8 * start + (6 if at >= 0 and k == at + 1 else -min(10, k - at - 1))
        at = k
    return score


def fuzzy(rows: DataFrame, query: str, column: str = "name", key: str = "id", k: int = 10) -> DataFrame:
    @F.pandas_udf("long")
    def scored(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else fuzzy_score(x, query)).astype("Int64")

    return rows.withColumn("score", scored(F.col(column))).where("score is not null").orderBy(F.col("score").desc(), column, key).limit(k)
