"""Token counts by byte-pair merging on a heap and a linked list.

A word starts as symbols in a doubly linked list; a heap holds its adjacent
pairs by rank and place. The lowest pair is popped, checked against the list
(stale ones are skipped) and merged; its new neighbours go onto the heap. The
count is the number of first symbols minus the merges: no identifier is made.

Texts are normalised and split as the vocabulary file says: NFC, white space,
lower case, the pattern of the file, bytes as printable characters and a mark at
word ends. The file's special strings inside a text are one token each, which is
the library's default. Counts of chunks between white space are remembered in a
table of bounded size; a chunk's count doesn't depend on its surroundings.

Defined cases: null and empty texts have 0 bytes and 0 tokens; texts of any
length are counted whole; repeated rows are each counted; ids are passed on as
they are; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import workers_find_package

REMEMBERED = 700_000  #: chunks, and as many words, that a worker remembers; then it starts anew

#: White space to Python that the pattern's \s isn't.
_ODD = regex.compile("[\x1c-\x1f]")


def _printable() -> list[str]:
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = [""] * 256, 0
    for b in range(256):
        if b in keep:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + n)
            n += 1
    return out


def merged(ranks: dict[tuple[str, str], int], symbols: list[str]) -> int:
    """Symbols left when no adjacent pair has a rank."""
    n = len(symbols)
    if n < 2:
        return n
    get, sym = ranks.get, [*symbols, ""]
    nxt, prv = list(range(1, n + 1)), list(range(-1, n))  # place n is the end
    heap = [(r << 32) | k for k in range(n - 1) if (r := get((sym[k], sym[k + 1]))) is not None]
    heapq.heapify(heap)
    pop, push, left = heapq.heappop, heapq.heappush, n
    while heap:
        top = pop(heap)
        k = top & 0xFFFFFFFF
        j = nxt[k]
        if j >= n or get((sym[k], sym[j])) != top >> 32:
            continue  # stale: one of the two has been merged since
        both = sym[k] = sym[k] + sym[j]
        sym[j], q = "", nxt[j]
        nxt[k], nxt[j], prv[q] = q, n, k
        left -= 1
        p = prv[k]
        if p >= 0 and (r := get((sym[p], both))) is not None:
            push(heap, (r << 32) | p)
        if q < n and (r := get((both, sym[q]))) is not None:
            push(heap, (r << 32) | k)
    return left


class Counter(dict):
    """Chunk -> tokens, filled as chunks come."""

    def __init__(self, path: str):
        super().__init__()
        spec = json.load(open(path, encoding="utf-8"))
        model, normal = spec["model"], spec["normalizer"]["normalizers"]
        split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        if [x["type"] for x in normal] != ["NFC", "Replace", "Lowercase"] or model["type"] != "BPE" or not split["invert"] or any(x["normalized"] or x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec["added_tokens"]):
            raise ValueError("this kind of vocabulary file isn't known here")
        self.ranks = {tuple(m.split(" ") if isinstance(m, str) else m): k for k, m in enumerate(model["merges"])}
        self.vocab = frozenset(model["vocab"])
        self.end, self.pattern = model["end_of_word_suffix"], regex.compile(split["pattern"]["Regex"])
        self.special = regex.compile("|".join(regex.escape(x["content"]) for x in spec["added_tokens"]) or "(?!)")
        self.bytes = _printable()
        self.words: dict[str, int] = {}

    def word(self, w: str) -> int:
        if (n := self.words.get(w)) is not None:
            return n
        symbols = [self.bytes[b] for b in w.encode()]
        symbols[-1] += self.end
        if missing := [s for s in symbols if s not in self.vocab]:
            raise ValueError(f"no symbol {missing[0]!r} in the vocabulary")
        n = merged(self.ranks, symbols)
        if len(self.words) >= REMEMBERED:
            self.words.clear()
        if len(w) <= 64:
            self.words[w] = n
        return n

    def plain(self, part: str) -> int:
        part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
        return sum(self.word(w) for w in self.pattern.findall(part))

    def chunk(self, c: str) -> int:
        n, at = 0, 0
        for m in self.special.finditer(c):
            n, at = n + 1 + self.plain(c[at : m.start()]), m.end()
        return n + self.plain(c[at:])

    def __missing__(self, c: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        n = self.chunk(c)
        if len(c) <= 64:
            self[c] = n
        return n

    def count(self, text: str) -> int:
        if _ODD.search(text):
            return self.chunk(text)
        return sum(map(self.__getitem__, text.split()))


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_tokens, over_limit for each row; vocabulary: path of the file on the workers."""
    workers_find_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary).count
        for b in batches:
            n = [0 if t is None else count(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64())], ["key", "n_bytes", "n_tokens"])

    kind = dict(docs.dtypes)[key]
    narrow = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    return narrow.mapInArrow(run, f"key {kind}, n_bytes long, n_tokens long").select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
