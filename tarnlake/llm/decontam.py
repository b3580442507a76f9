"""Benchmark decontamination by Wu-Manber search over words.

Texts and benchmark items become words; a pattern is a window of 10 consecutive
item words, or a whole shorter item. Patterns of one length share tables: the
shift table says, for the block of two words at the end of the current position,
how many positions can be skipped; shift 0 leads to the bucket of patterns whose
last words have that block; a direct comparison of all words confirms. Lengths
under ten have tables of their own, blocks of one word for one-word items.

The benchmark is the stated query set. Its windows are cut into blocks of at
most BLOCK windows by item, which the driver draws one after the other; each block
is one narrow pass over the documents, without a shuffle. Between passes the rows
are written, so what a task and the driver hold is bounded by a block.

Defined cases: null and empty texts have no words, so n_words = n_hit = 0;
items without words match nothing; repeated items count once for each distinct
id; windows of items with a null id hit, but name no item; repeated documents
are each searched; the words of a document are searched whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, workers_find_package, written

WINDOW, BLOCK = 10, 250_000

#: Bytes of ASCII letters and digits and all of non-ASCII characters stay; A-Z in lower case, the rest blank.
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_TO_WORDS).split() if text else []


class Tables:
    """Wu-Manber tables of the patterns of one length. patterns: tuple of words -> number."""

    def __init__(self, length: int, patterns: dict[tuple, int]):
        self.m, self.b = length, min(2, length)
        self.far = length - self.b + 1
        self.shift: dict = {}
        self.bucket: dict = {}
        for p, number in patterns.items():
            for end in range(self.b, length + 1):
                block = p[end - self.b : end]
                s = length - end
                if s < self.shift.get(block, self.far):
                    self.shift[block] = s
            self.bucket.setdefault(p[length - self.b :], []).append((p, number))

    def search(self, text: list[bytes]) -> list[tuple[int, int]]:
        """(start, pattern number) of every occurrence."""
        m, b, far, get, n, found = self.m, self.b, self.far, self.shift.get, len(text), []
        end = m
        while end <= n:
            s = get(tuple(text[end - b : end]), far)
            if s:
                end += s
                continue
            for p, number in self.bucket[tuple(text[end - b : end])]:
                if tuple(text[end - m : end]) == p:
                    found.append((end - m, number))
            end += 1
        return found


class Matcher:
    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        by_length: dict[int, dict[tuple, int]] = {}
        self.items: list[set[str]] = []
        self.length: list[int] = []
        for ident, w in items:
            size = min(window, len(w))
            for k in range(len(w) - size + 1 if size else 0):
                p = tuple(w[k : k + size])
                own = by_length.setdefault(size, {})
                if p not in own:
                    own[p] = len(self.items)
                    self.items.append(set())
                    self.length.append(size)
                if ident is not None:
                    self.items[own[p]].add(ident)
        self.tables = [Tables(m, p) for m, p in sorted(by_length.items())]

    def search(self, text: list[bytes]) -> list[tuple[int, int]]:
        return [x for t in self.tables for x in t.search(text)]


def blocks(benchmark: DataFrame, item: str, text: str, window: int, most: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """Items in blocks of at most `most` windows, or one longer item alone."""
    held: list = []
    n = 0
    for r in benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).cast("binary").alias("t")).toLocalIterator():
        w = words(None if r["t"] is None else bytes(r["t"]))
        size = max(1, len(w) - window + 1)
        if held and n + size > most:
            yield held
            held, n = [], 0
        held.append((r["i"], w))
        n += size
    if held:
        yield held


def scan(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, most: int = BLOCK) -> DataFrame:
    """key, n_words, n_hit, spans [(first, past)] of hit words, items (ids as strings, sorted) for each row."""
    workers_find_package(docs.sparkSession)
    kind = dict(docs.dtypes)[key]
    schema = f"key {kind}, text binary, n_words long, n_hit long, spans array<struct<first:int,past:int>>, items array<string>"
    spans_kind = pa.list_(pa.struct([("first", pa.int32()), ("past", pa.int32())]))

    def one_pass(matcher: Matcher):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                n_words, n_hit, spans, items = [], [], [], []
                before = zip(b.column("spans").to_pylist(), b.column("items").to_pylist())
                for t, (old_spans, old_items) in zip(b.column("text").to_pylist(), before):
                    w = words(t)
                    hits = matcher.search(w)
                    found = sorted([*((s, s + matcher.length[p]) for s, p in hits), *((x["first"], x["past"]) for x in old_spans)])
                    own: list[list[int]] = []
                    for a, z in found:
                        if own and a <= own[-1][1]:
                            own[-1][1] = max(own[-1][1], z)
                        else:
                            own.append([a, z])
                    n_words.append(len(w))
                    n_hit.append(sum(z - a for a, z in own))
                    spans.append([{"first": a, "past": z} for a, z in own])
                    items.append(sorted(set(old_items).union(*(matcher.items[p] for p in {p for _, p in hits}))))
                yield pa.RecordBatch.from_arrays(
                    [b.column("key"), b.column("text"), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(spans, spans_kind), pa.array(items, pa.list_(pa.string()))],
                    ["key", "text", "n_words", "n_hit", "spans", "items"],
                )

        return run

    none = F.lit(0).cast("long")
    out = docs.select(
        F.col(key).alias("key"), F.col(text).cast("binary").alias("text"), none.alias("n_words"), none.alias("n_hit"),
        F.array().cast("array<struct<first:int,past:int>>").alias("spans"), F.array().cast("array<string>").alias("items"),
    )
    out = _passes(out, (one_pass(Matcher(block, window)) for block in blocks(benchmark, item, item_text, window, most)), one_pass(Matcher([], window)), schema)
    return out.select(F.col("key").alias(key), "n_words", "n_hit", "spans", "items")


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs in which no benchmark window occurs, all columns kept, in one narrow pass for each block."""
    workers_find_package(docs.sparkSession)
    schema = docs.schema
    at = docs.columns.index(text)

    def one_pass(matcher: Matcher):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                fine = [not matcher.search(words(None if t is None else t.encode())) for t in b.column(at).to_pylist()]
                yield b.filter(pa.array(fine, pa.bool_()))

        return run

    found = (one_pass(Matcher(block)) for block in blocks(benchmark, "item_id", "text", WINDOW, BLOCK))
    return _passes(docs, found, one_pass(Matcher([])), schema)


def _passes(rows: DataFrame, found, nothing, schema) -> DataFrame:
    """One narrow pass for each block. What a pass leaves is written before the next, so that a task holds the tables of one block at a time."""
    last = None
    for k, run in enumerate(found):
        if k:
            whole = written(rows, "pass")
            if last is not None:
                drop_written(last)
            rows = last = whole
        rows, nothing = rows.mapInArrow(run, schema), None
    return rows if nothing is None else rows.mapInArrow(nothing, schema)
