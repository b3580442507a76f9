"""Unbounded n-gram scoring by sharded suffix arrays.

Model: p_0(w) = (c(w) + 1) / (N + V + 1); for the context of one token, where it
occurs in training, p_1(w) = (1 - e_1) * c(context, w) / c(context) + e_1 *
p_0(w); and where the longest context that occurs in training has L > 1 tokens,
p(w) = (1 - e_L) * c(context, w) / c(context) + e_L * p_1(w) for that L, whatever
it is. Contexts begin at the document's start mark at the earliest. All counts are
of training tokens, and each of the p sums to 1.

Short contexts: c(context) is the count of an n-gram that ends one token before,
so all that is needed are counts of 2-grams, and of 3-grams where a held-out
position has the two tokens before as well. Chunks add them up first and
send them to shards by their hash: an n-gram that a third of all positions share
is one row a chunk, and no shard is larger than another.

Long contexts of held-out documents: a round takes positions whose last R tokens
are known to match (R = 3, 8, 64, 256, ...) to R' = 8, 64, 256, ... tokens. A
shard gets, as token ids, the text before those positions and before the training
positions that some held-out position matches so far. It sorts the training ones
by their tokens read backwards (a suffix array, cut into pieces of bounded size;
beyond COLUMNS tokens the whole blocks that match are found first, by hash),
binary-searches each held-out position in every piece, compares tokens with both
neighbours, takes the longest match over all pieces, and sums the counts of that
context and of its next token over the pieces. Positions go to a shard by an
anchor: of the blocks of tokens within their last R the one of least hash, which
whoever shares these tokens picks too. Neighbouring positions mostly have one
anchor, or anchors alike, and share one stretch of text.

What matches all R' tokens goes on only while its share is open. The longest
context occurs among the contexts of R' tokens; if all of those have the position's
token next, or none has, so has it. Then only its length is missing, which is the
position before's plus one, and from SETTLED tokens on not even that. So the next
round searches positions between these shares and the ones right after them, and
the text of copies is not sent at every length.

Long contexts of training documents: the longest context of a position is all of
its document so far, which occurs there. Its counts are counts of prefixes; a
document sends its prefixes up to 8, 64, 512, ... words while another has them.

Layout: a map task turns its documents into chunks of about CHUNK tokens, files in
the shared folder under a new name for each attempt; only chunks listed in the
written manifest count. A round is one job: results of the round before go to
their chunks, chunks send to shards, shards answer in the order of sending, and
the answers are written; shuffle files of finished rounds go. A chunk's state of
a round is written alike if a task runs again. Words are known by XXH64, n-grams
and repeated stretches of a chunk by 64-bit rolling hashes.

Defined cases: null and empty texts are one end token; a null id counts as an
empty one in the split and is passed on; repeated rows are each scored and each
count; without training documents N = V = 0 and every token has probability 1;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_folder, drop_written, new_path, shuffle_width, workers_find_package, written

CHUNK, SHARD = 1_000_000, 2_000_000
FOLDS, HELD = 7, 2
ESCAPE = {1: 0.4, 2: 0.5}  #: share of p_0 after contexts of one token, of p_1 after longest contexts of two
COLUMNS, SEARCHED = 16, 250_000  #: tokens that a suffix array sorts by; positions that a shard searches
PIECE = 24 << 20  #: bytes of suffixes that a piece of a shard's suffix array has at most
DEPTHS, STEP = (3, 8, 64), 4  #: tokens that match before the first search, after it, after the next (powers of two); then by this factor
KNOWN, WIDER = 8, 8  #: words of prefixes that are counted before the first search; their growth
LEAST = 0.02  #: share of p_1 after the longest contexts of all
SETTLED = 50  #: tokens from which on the share is LEAST, however long the context
_START, _END = np.uint64(0x5BD1E9955BD1E995), np.uint64(0x27D4EB2F165667C5)
_BASE = 0x9E3779B97F4A7C15
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
_ZIP, _UNZIP = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def escape_of(length: np.ndarray) -> np.ndarray:
    """Share of p_1 after longest contexts of three tokens and more: the longer the match, the less."""
    return np.maximum(LEAST, 1.0 / np.maximum(np.asarray(length, np.float64), 1.0))


def _mix(z: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def pack(**arrays: np.ndarray) -> bytes:
    """Arrays with their bytes in planes, those that are 0 throughout left out, compressed; sorted unsigned ones as differences."""
    head, body = [], io.BytesIO()
    for name, a in arrays.items():
        a = np.ascontiguousarray(a)
        delta = a.dtype == np.uint64 and len(a) > 1 and bool((a[1:] >= a[:-1]).all())
        data = np.diff(a, prepend=np.uint64(0)) if delta else a
        size = a.dtype.itemsize
        used = -(-int(data.max()).bit_length() // 8) if len(a) and a.dtype.kind in "ui" and int(data.min()) >= 0 else size
        columns = data.view(np.uint8).reshape(len(a), size)
        raw = _ZIP.compress(b"".join(columns[:, k].tobytes() for k in range(used)))
        head.append([name, a.dtype.str, len(a), delta, used, len(raw)])
        body.write(raw)
    h = json.dumps(head).encode()
    return len(h).to_bytes(4, "little") + h + body.getvalue()


def unpack(raw: bytes, only: tuple[str, ...] = ()) -> dict[str, np.ndarray]:
    n, out = int.from_bytes(raw[:4], "little"), {}
    at = 4 + n
    for name, kind, length, delta, used, size in json.loads(raw[4 : 4 + n]):
        if not only or name in only:
            dtype = np.dtype(kind)
            planes = np.frombuffer(_UNZIP.decompress(raw[at : at + size]) if length and used else b"", np.uint8).reshape(used, length if used else 0)
            word = np.dtype(f"<u{dtype.itemsize}")
            a = planes[0].astype(word) if used else np.zeros(length, word)
            for k in range(1, used):
                a |= planes[k].astype(word) << word.type(8 * k)
            out[name] = np.cumsum(a, dtype=np.uint64) if delta else a.view(dtype)
        at += size
    return out


def _save(folder: str, name: str, raw: bytes) -> None:
    fs, base = pafs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    part = f"{base}/{name}.{uuid.uuid4().hex[:8]}.part"
    with fs.open_output_stream(part) as f:
        f.write(raw)
    fs.move(part, f"{base}/{name}")


def _load(folder: str, name: str, only: tuple[str, ...] = ()) -> dict[str, np.ndarray]:
    fs, base = pafs.FileSystem.from_uri(folder)
    with fs.open_input_stream(f"{base}/{name}") as f:
        return unpack(f.read(), only)


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


_SENT = pa.schema([("shard", pa.int64()), ("chunk", pa.string()), ("blob", pa.binary())])
_BACK = pa.schema([("chunk", pa.string()), ("shard", pa.int64()), ("types", pa.int64()), ("tokens", pa.int64()), ("blob", pa.binary())])
_SENT_SQL, _BACK_SQL = "shard long, chunk string, blob binary", "chunk string, shard long, types long, tokens long, blob binary"


def _tokenise(folder: str, size: int):
    """Documents (key, text, held) -> chunk files; yields (chunk, tokens, training documents, keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("chunk", pa.string()), ("n", pa.int64()), ("trained", pa.int64()), ("keys", pa.binary())])
        parts: list[pa.Array] = []  # words of whole documents
        lengths: list[np.ndarray] = []
        held: list[np.ndarray] = []
        keys: list[pa.Array] = []
        n = 0

        def close() -> pa.RecordBatch:
            nonlocal parts, lengths, held, keys, n
            chunk = uuid.uuid4().hex
            digest = xxhash.xxh64_intdigest
            coded = pa.concat_arrays(parts).dictionary_encode()
            hashes = np.fromiter(map(digest, coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)), np.uint64, len(coded.dictionary))
            hashes[hashes == _END] ^= np.uint64(1)
            order = np.argsort(hashes)
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order), dtype=np.int32)
            size, out_of = np.concatenate(lengths) + 1, np.concatenate(held)
            words = np.full(n, len(order), np.int32)  # the end token, last
            last = np.zeros(n, bool)
            last[np.cumsum(size) - 1] = True
            words[~last] = place[coded.indices.to_numpy()]
            _save(f"{folder}/text", chunk, pack(words=words, lengths=size, held=out_of.astype(np.uint8), hashes=hashes[order]))
            key = pa.concat_arrays(keys)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pa.schema([("key", key.type)])) as w:
                w.write_batch(pa.RecordBatch.from_arrays([key], ["key"]))
            out = _rows(schema, [(chunk, n, int((~out_of).sum()), sink.getvalue().to_pybytes())])
            parts, lengths, held, keys, n = [], [], [], [], 0
            return out

        for b in batches:
            text = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(b.column(1), "")))
            flat = text.flatten()
            real = pc.not_equal(flat, "")
            ends = text.offsets.to_numpy() - text.offsets[0].as_py()
            upto = np.r_[0, np.cumsum(real.to_numpy(zero_copy_only=False))][ends]  # words before each document
            flat, out_of, begin = flat.filter(real), b.column(2).to_numpy(zero_copy_only=False).astype(bool), 0
            while begin < b.num_rows:  # documents up to the one that fills the chunk
                room = size - n + upto[begin] + begin
                stop = min(b.num_rows, int(np.searchsorted(upto[1:] + np.arange(1, len(upto)), room)) + 1)
                stop = max(stop, begin + 1)
                parts.append(flat.slice(upto[begin], upto[stop] - upto[begin]))
                lengths.append(np.diff(upto[begin : stop + 1]))
                held.append(out_of[begin:stop])
                keys.append(b.column(0).slice(begin, stop - begin))
                n += int(upto[stop] - upto[begin]) + stop - begin
                begin = stop
                if n >= size:
                    yield close()
        if n:
            yield close()

    return run


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base^0, base^1, ...: n of them at least; the longest so far is kept."""
    if base not in _POWERS or len(_POWERS[base]) < n:
        with np.errstate(over="ignore"):
            _POWERS[base] = np.multiply.accumulate(np.r_[np.uint64(1), np.full(max(n, 1) - 1, np.uint64(base))])
    return _POWERS[base]


def _rolling(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of hash * base^place, and base^-place: sums[j] - sums[i], times inverse[i], is the hash of i..j wherever it stands."""
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x * _powers(_BASE, len(x))[: len(x)], out=sums[1:])
    return sums, _powers(pow(_BASE, -1, 1 << 64), len(x) + 1)


class _Chunk:
    """A chunk's tokens with a start mark before each document."""

    def __init__(self, d: dict[str, np.ndarray]):
        self.words, self.lengths, self.held, self.hashes = d["words"], d["lengths"], d["held"].astype(bool), d.get("hashes")
        self.train = ~np.repeat(self.held, self.lengths)
        self.doc = np.repeat(np.arange(len(self.lengths)), self.lengths)
        self.start = np.cumsum(self.lengths) - self.lengths
        self.before = np.arange(len(self.words)) - np.repeat(self.start, self.lengths)  # words of the document before this one
        self.ids: np.ndarray | None = None
        if "ids" in d:
            self.name(d["ids"].astype(np.int64))

    def arrays(self) -> dict[str, np.ndarray]:
        return {"words": self.words, "lengths": self.lengths, "held": self.held.astype(np.uint8), "ids": self.ids.astype(np.uint64)}

    def part(self, docs: np.ndarray) -> _Chunk:
        """These documents alone, with their own words."""
        on = np.zeros(len(self.lengths), bool)
        on[docs] = True
        words = self.words[on[self.doc]]
        used = np.zeros(len(self.ids), bool)
        used[words] = True
        used = np.flatnonzero(used)
        used = used[np.argsort(self.ids[used])]  # in the order of ids, whose differences are small
        place = np.empty(len(self.ids), np.int32)
        place[used] = np.arange(len(used), dtype=np.int32)
        return _Chunk({"words": place[words], "lengths": self.lengths[docs], "held": self.held[docs], "ids": self.ids[used]})

    def name(self, ids: np.ndarray) -> None:
        """sequence: ids of all tokens with start marks."""
        self.ids = ids
        self.sequence = np.zeros(len(self.words) + len(self.lengths), np.int64)
        at = self.at(np.arange(len(self.words)))
        self.sequence[at] = ids[self.words] + 1
        x = np.full(len(self.sequence), _START)
        x[at] = _mix((ids + 1).astype(np.uint64) * np.uint64(_BASE))[self.words]
        self.sums = _rolling(x)

    def hashes_of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Hashes of the tokens low..high (exclusive) of the sequence with start marks."""
        total, back = self.sums
        with np.errstate(over="ignore"):
            return _mix((total[high] - total[low]) * back[low] + (high - low).astype(np.uint64))

    def at(self, positions: np.ndarray) -> np.ndarray:
        """Places of positions in the sequence with start marks."""
        return positions + self.doc[positions] + 1

    def grams(self, n: int) -> np.ndarray:
        """Hashes of the n-grams that end at each position; n is at most 2, so that all are there."""
        end = self.at(np.arange(len(self.words))) + 1
        return self.hashes_of(end - n, end)

    def prefixes(self, docs: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of docs, words, hash) of the prefixes with low < words <= high that the documents have."""
        many = np.maximum(np.minimum(self.lengths[docs], high) - low, 0)
        row = np.repeat(np.arange(len(docs)), many)
        words = low + 1 + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        mark = (self.start[docs] + docs)[row]
        return row, words, self.hashes_of(mark, mark + words + 1)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys in order, where each key went). Keys are sorted with their places in their low bits, which is several times faster than an indirect sort; the few that the lost bits leave in disorder are put right."""
    n = len(keys)
    bits = np.uint64(max(1, n - 1).bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    both = (keys & ~low) | np.arange(n, dtype=np.uint64)
    both.sort()
    order = (both & low).astype(np.int64)
    found = keys[order]
    for k in np.flatnonzero(found[1:] < found[:-1]):
        group = slice(*np.searchsorted(both, [found[k] & ~low, found[k] | low], "left"))
        group = slice(group.start, group.stop + (group.stop < n and both[group.stop] == found[k] | low))
        again = np.argsort(found[group], kind="stable")
        order[group], found[group] = order[group][again], found[group][again]
    first = np.r_[True, found[1:] != found[:-1]] if n else np.zeros(0, bool)
    went = np.empty(n, np.int64)
    went[order] = np.cumsum(first) - 1
    return found[first], went


def _tally(keys: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys in order, their weight, whether one of no weight is among them, where each key went)."""
    known, went = _distinct(keys)
    count = np.bincount(went, weight, minlength=len(known)).astype(np.int64)
    return known, count, np.bincount(went, minlength=len(known)) > count, went


def _send_tally(known: np.ndarray, count: np.ndarray, held: np.ndarray, shards: int, chunk: str, base: int = 0) -> Iterator[pa.RecordBatch]:
    bounds, rows = np.searchsorted(_spread(known, shards), np.arange(shards + 1)), []
    for s in np.flatnonzero(np.diff(bounds)):
        k = slice(bounds[s], bounds[s + 1])
        rows.append((base + int(s), chunk, pack(context=known[k], count=count[k].astype(np.uint32), held=held[k].astype(np.uint8))))
    if rows:
        yield _rows(_SENT, rows)


class _Stretches:
    """The stretches of text that a chunk sends in a round, each once, in the order of their shards; entry: where each position's answer is."""

    def __init__(self, c: _Chunk, length: int, depth: int, positions: np.ndarray, shards: int):
        place = c.at(positions)
        window = 1 if length < 4 else length // 2
        block = length - window + 1
        # Ends of blocks within the last tokens of the positions, and nothing else: runs of them, each as long as a window at least.
        near = np.zeros(len(c.sequence) + 2, np.int64)
        np.add.at(near, place - window + 1, 1)
        np.add.at(near, place + 1, -1)
        ends = np.flatnonzero(np.cumsum(near) > 0)
        least = c.hashes_of(ends - block, ends)
        best, step = np.arange(len(ends)), 1
        while step < window:  # of equal hashes the rightmost
            left, own = best[:-step], best[step:]
            best = np.r_[best[:step], np.where(least[left] < least[own], left, own)]
            step *= 2
        anchor = best[np.searchsorted(ends, place)]
        # Neighbours with one anchor, or with anchors alike, as in text that repeats itself, share a stretch.
        beside = (c.doc[positions[1:]] == c.doc[positions[:-1]]) & (place[1:] - place[:-1] < depth)
        new = np.r_[True, ~beside | (least[anchor[1:]] != least[anchor[:-1]])] if len(anchor) else np.zeros(0, bool)
        of, first = np.cumsum(new) - 1, np.flatnonzero(new)
        last = np.r_[first[1:], len(anchor)][: len(first)] - 1
        docs = c.doc[positions[first]]
        low, high = np.maximum(c.start[docs] + docs, place[first] - depth), place[last] + 1
        offset = place - low[of]
        with np.errstate(over="ignore"):
            pattern = np.add.reduceat(_mix(offset.astype(np.uint64) * np.uint64(_BASE)), first) if len(first) else np.zeros(0, np.uint64)
            alike = _mix(c.hashes_of(low, high) * np.uint64(3) + pattern + c.held[docs].astype(np.uint64))
        shard = _spread(_mix(least[anchor[first]] * np.uint64(_BASE)), shards)  # least hashes are small: hashed again they are even
        order = np.lexsort((alike, shard))
        differs = np.r_[True, (alike[order][1:] != alike[order][:-1]) | (shard[order][1:] != shard[order][:-1])] if len(order) else np.zeros(0, bool)
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(differs) - 1
        one = order[differs]  # of each kind of stretch the first
        self.c, self.low, self.high, self.first, self.last, self.offset, self.docs = c, low[one], high[one], first[one], last[one], offset, docs[one]
        self.weight = np.bincount(number, minlength=len(one))
        entries = self.last - self.first + 1
        begin = np.cumsum(entries) - entries
        self.entry = begin[number[of]] + np.arange(len(positions)) - first[of] if len(positions) else np.zeros(0, np.int64)
        self.bounds = np.searchsorted(shard[one], np.arange(shards + 1))

    def send(self, chunk: str) -> Iterator[pa.RecordBatch]:
        rows = []
        for s in np.flatnonzero(np.diff(self.bounds)):
            k = slice(self.bounds[s], self.bounds[s + 1])
            low, size, many = self.low[k], self.high[k] - self.low[k], self.last[k] - self.first[k] + 1
            text = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())
            at = np.repeat(self.first[k] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            blob = pack(tokens=self.c.sequence[text].astype(np.int64), size=size.astype(np.uint32), entries=many.astype(np.uint32), offset=self.offset[at].astype(np.uint32), weight=self.weight[k].astype(np.uint32), held=self.c.held[self.docs[k]].astype(np.uint8))
            rows.append((int(s), chunk, blob))
        if rows:
            yield _rows(_SENT, rows)


class SuffixArray:
    """Contexts of training positions, read backwards, sorted; each with its next token and its weight."""

    def __init__(self, rows: np.ndarray, following: np.ndarray, weight: np.ndarray):
        order = np.argsort(_bytes(rows), kind="stable")
        self.rows, n = rows[order], len(rows)
        self.keys = _bytes(self.rows)
        self.sums = np.r_[0, np.cumsum(weight[order])]
        where = following[order].astype(np.int64) * (n + 1) + np.arange(n)
        by = np.argsort(where, kind="stable")
        self.where, self.n = where[by], n
        self.next_sums = np.r_[0, np.cumsum(weight[order][by])]

    def longest(self, asked: np.ndarray) -> np.ndarray:
        """For each context the tokens that it shares with the nearest of its two neighbours."""
        at = np.searchsorted(self.keys, _bytes(asked))
        return np.maximum(_common(asked, self.rows[np.maximum(at - 1, 0)]), _common(asked, self.rows[np.minimum(at, self.n - 1)]))

    def counts(self, asked: np.ndarray, length: np.ndarray, following: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weight of the contexts with the first `length` tokens of each, and of those with the next token."""
        beyond = np.arange(asked.shape[1]) >= length[:, None]
        low = np.searchsorted(self.keys, _bytes(np.where(beyond, np.uint32(0), asked)), "left")
        high = np.searchsorted(self.keys, _bytes(np.where(beyond, np.uint32(0xFFFFFFFF), asked)), "right")
        base = following.astype(np.int64) * (self.n + 1)
        first, past = np.searchsorted(self.where, base + low), np.searchsorted(self.where, base + high)
        return self.sums[high] - self.sums[low], self.next_sums[past] - self.next_sums[first]


def _bytes(rows: np.ndarray) -> np.ndarray:
    """Rows of numbers as strings of bytes in the same order."""
    return np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * rows.shape[1]}")[:, 0]


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    differ = a != b
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])


def _one_of_each(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each distinct key, which of them each key is)."""
    known, went = _distinct(keys)
    one = np.zeros(len(known), np.int64)
    one[went] = np.arange(len(keys))
    return one, went


def _blocks(context, offset: np.ndarray, asked: np.ndarray, known: np.ndarray, weight: np.ndarray, length: int, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """How many tokens of each asked context match in whole blocks of COLUMNS tokens, by binary search of the number of blocks; and the known contexts, each once for every such number at which an asked one with the same tokens stops: (base of the asked, known, their weights, their bases).

    A step asks whether `step` tokens more match. Known contexts that some asked
    one follows go along; those at which some asked one stays behind stay as well.
    """
    base = np.full(len(asked), length // COLUMNS * COLUMNS)
    row, at = np.arange(len(known)), np.full(len(known), length // COLUMNS * COLUMNS)
    step = depth // 2 // COLUMNS * COLUMNS
    while step >= COLUMNS:
        can, could = base + step <= np.minimum(offset[asked], depth), at + step <= np.minimum(offset[known[row]], depth)
        further, known_further = context(asked[can], base[can] + step), context(known[row[could]], at[could] + step)
        goes = np.zeros(len(asked), bool)
        goes[can] = np.isin(further, known_further)
        follows = np.zeros(len(row), bool)
        follows[could] = np.isin(known_further, further)
        stays = np.isin(context(known[row], at), context(asked[~goes], base[~goes]))
        row, at = np.concatenate([row[stays], row[follows]]), np.concatenate([at[stays], at[follows] + step])
        base = np.where(goes, base + step, base)
        step //= 2
    return base, known[row], weight[row], at


def _search(sent: list[tuple[str, dict]], length: int, depth: int, piece: int, open_only: bool = False) -> Iterator[tuple[str, dict, int]]:
    """(chunk, its answers in the order of sending, positions among them that match all `depth` tokens). open_only: of the training positions those alone that a held-out one matches whose share is open."""
    tokens = np.concatenate([d["tokens"] for _, d in sent])
    size, many = np.concatenate([d["size"] for _, d in sent]).astype(np.int64), np.concatenate([d["entries"] for _, d in sent]).astype(np.int64)
    offset = np.concatenate([d["offset"] for _, d in sent]).astype(np.int64)
    at = np.repeat(np.cumsum(size) - size, many) + offset
    weight = np.repeat(np.concatenate([d["weight"] for _, d in sent]), many).astype(np.int64)
    held = np.repeat(np.concatenate([d["held"] for _, d in sent]), many).astype(bool)
    small = not len(tokens) or int(tokens.max()) < (1 << 32) - 2
    codes = (tokens if small else np.unique(tokens, return_inverse=True)[1]).astype(np.uint32) + np.uint32(1)  # 0: before the start mark
    total, inverse = _rolling(_mix(tokens.astype(np.uint64) + np.uint64(_BASE)))

    def context(k: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """Hashes of the `size` tokens before the entries."""
        with np.errstate(over="ignore"):
            return _mix((total[at[k]] - total[at[k] - size]) * inverse[at[k] - size] + np.asarray(size).astype(np.uint64))

    every = np.arange(len(at))
    whole_context = context(every, np.minimum(offset, depth))
    with np.errstate(over="ignore"):
        pair = _mix(whole_context * np.uint64(3) + codes[at].astype(np.uint64))
    # Equal contexts with equal next tokens are one row each: copies and shared passages don't grow the array.
    every_asked, every_known = np.flatnonzero(held), np.flatnonzero(~held)
    asked, asked_of = _one_of_each(pair[every_asked])
    known, known_of = _one_of_each(pair[every_known])
    asked, known, of_known = every_asked[asked], every_known[known], np.bincount(known_of, weight[every_known], minlength=len(known)).astype(np.int64)
    base, known, of_known, known_base = _blocks(context, offset, asked, known, of_known, length, depth)

    def suffixes(k: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Two numbers for the tokens up to the base, and the COLUMNS tokens before those."""
        back = base[:, None] + np.arange(1, COLUMNS + 1)
        rows = np.where((back <= offset[k][:, None]) & (back <= depth), codes[np.maximum(at[k][:, None] - back, 0)], np.uint32(0))
        h = context(k, base)
        return np.concatenate([(h >> np.uint64(32)).astype(np.uint32)[:, None], h.astype(np.uint32)[:, None], rows], axis=1)

    per = max(1, piece // (4 * (COLUMNS + 2)))
    pieces = [slice(k, k + per) for k in range(0, len(known), per)]
    blocks = [slice(k, k + per) for k in range(0, len(asked), per)]
    found, whole, own = np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64)

    def arrays() -> Iterator[SuffixArray]:
        return (SuffixArray(suffixes(known[p], known_base[p]), codes[at[known[p]]], of_known[p]) for p in pieces)

    kept = list(arrays()) if len(pieces) == 1 else None
    for a in kept or arrays():
        for b in blocks:
            found[b] = np.maximum(found[b], base[b] + np.maximum(a.longest(suffixes(asked[b], base[b])) - 2, 0))
    found = np.minimum(np.minimum(found, offset[asked]), depth)
    for a in kept or arrays():
        for b in blocks:
            w, o = a.counts(suffixes(asked[b], base[b]), found[b] - base[b] + 2, codes[at[asked[b]]])
            whole[b] += w
            own[b] += o
    answer, every_whole, every_own = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    answer[every_asked], every_whole[every_asked], every_own[every_asked] = found[asked_of], whole[asked_of], own[asked_of]
    # Training positions that a held-out one matches to the end, where that one may be searched further.
    further = (found == depth) & ((0 < own) & (own < whole) | (not open_only))
    answer[every_known] = np.isin(whole_context[every_known], whole_context[asked[further]])
    goes = np.zeros(len(at), bool)
    goes[every_asked] = further[asked_of]
    begin = 0
    for chunk, d in sent:
        k = slice(begin, begin + len(d["offset"]))
        begin = k.stop
        on = int(goes[k].sum() + answer[k][~held[k]].sum())
        yield chunk, {"answer": answer[k], "whole": every_whole[k], "own": every_own[k]}, on


def _groups(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[tuple]:
    """(value, rows as dicts) of batches sorted by a column."""
    held: list[dict] = []
    for b in batches:
        for r in b.to_pylist():
            if held and held[0][by] != r[by]:
                yield held[0][by], held
                held = []
            held.append(r)
    if held:
        yield held[0][by], held


def _shard(round_: int, piece: int):
    """What chunks sent to a shard -> the answers for each chunk in its order of sending. Shards under 0 and those of rounds up to 2 add up counts."""

    length, depth = _lengths(round_)[:2] if round_ > 2 else (0, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _groups(batches, "shard"):
            sent = [(r["chunk"], unpack(r["blob"])) for r in rows]
            rows.clear()
            if shard >= 0 and round_ > 2:
                for chunk, answer, on in _search(sent, length, depth, piece, depth >= SETTLED):
                    yield _rows(_BACK, [(chunk, shard, on, 0, pack(**answer))])
                continue
            context, count = np.concatenate([d["context"] for _, d in sent]), np.concatenate([d["count"] for _, d in sent]).astype(np.int64)
            known, went = _distinct(context)
            total = np.bincount(went, count, minlength=len(known)).astype(np.int64)
            held = np.bincount(went, np.concatenate([d["held"] for _, d in sent]), minlength=len(known)) > 0
            rank = np.empty(len(known), np.int64)
            rank[np.lexsort((known, -total))] = np.arange(len(known))
            begin = 0
            for chunk, d in sent:
                k = went[begin : begin + len(d["context"])]
                begin += len(k)
                extra = {"rank": rank[k]} if round_ == 0 else {"held": held[k].astype(np.uint8)}
                yield _rows(_BACK, [(chunk, shard, int((total > 0).sum()), int(total.sum()), pack(count=total[k], **extra))])

    return run


def _take(rows: list[dict], names: tuple[str, ...], tallies: bool) -> dict[str, np.ndarray]:
    """A chunk's answers, shard after shard; those of the shards under 0 or the others."""
    got = [unpack(r["blob"], names) for r in sorted((r for r in rows if r["blob"] is not None and (r["shard"] < 0) == tallies), key=lambda r: r["shard"])]
    return {k: np.concatenate([g[k] for g in got]) if got else np.zeros(0, np.int64) for k in names}


def _ratio(own: np.ndarray, whole: np.ndarray, shorter: np.ndarray, escape) -> np.ndarray:
    return np.where(whole > 0, (1 - escape) * own / np.maximum(whole, 1) + escape * shorter, shorter)


class _State:
    """What of a chunk is not scored yet: held-out positions, of which `ask` are in the next search, training positions of that search, documents whose prefixes others have; and the sums so far of all its documents, of which `origin` are still there.

    ratio: 0 or 1 where the context so far decides it, else OPEN; length: of the longest context, 0 where unknown.
    """

    OPEN = 2

    def __init__(self, c: _Chunk, done: np.ndarray, origin: np.ndarray, left: np.ndarray, p: np.ndarray, ask: np.ndarray, ratio: np.ndarray, length: np.ndarray, known: np.ndarray, alive: np.ndarray, count: np.ndarray, rest: np.ndarray, whole: np.ndarray):
        self.c, self.done, self.origin, self.left, self.p, self.ask, self.ratio, self.length, self.known, self.alive, self.count, self.rest, self.whole = c, done, origin, left, p, ask, ratio, length, known, alive, count, rest, whole

    @property
    def asked(self) -> np.ndarray:
        return self.left[self.ask]

    def shrink(self) -> None:
        """Leaves out the documents that are scored."""
        c = self.c
        on = np.zeros(len(c.lengths), bool)
        on[c.doc[self.left]] = on[c.doc[self.known]] = on[self.alive] = True
        docs = np.flatnonzero(on)
        self.c = c.part(docs)
        shift = np.zeros(len(c.lengths), np.int64)
        shift[docs] = self.c.start - c.start[docs]
        self.left, self.known = self.left + shift[c.doc[self.left]], self.known + shift[c.doc[self.known]]
        self.alive, self.origin = np.searchsorted(docs, self.alive), self.origin[docs]

    def save(self, folder: str, chunk: str) -> None:
        """p_1 of what is left rests in single precision."""
        u = np.uint64
        _save(folder, chunk, pack(done=self.done, origin=self.origin.astype(u), left=self.left.astype(u), p=self.p.astype(np.float32), ask=self.ask.astype(np.uint8), ratio=self.ratio.astype(np.uint8), length=self.length.astype(np.uint32), known=self.known.astype(u), alive=self.alive.astype(u), count=self.count, rest=self.rest.astype(np.float32), whole=self.whole, **self.c.arrays()))

    @staticmethod
    def load(folder: str, chunk: str) -> _State:
        d = _load(folder, chunk)
        i = lambda k: d[k].astype(np.int64)
        return _State(_Chunk(d), d["done"], i("origin"), i("left"), d["p"].astype(np.float64), d["ask"].astype(bool), i("ratio"), i("length"), i("known"), i("alive"), d["count"], d["rest"].astype(np.float64), d["whole"])

    def add(self, positions: np.ndarray, p: np.ndarray) -> None:
        self.done = self.done + np.bincount(self.origin[self.c.doc[positions]], np.log10(p), len(self.done))

    def searched(self, sent: _Stretches, positions: np.ndarray, got: dict, depth: int) -> None:
        """Takes the answers of a search: scores what is decided and keeps what is not."""
        entry = sent.entry[np.searchsorted(positions, self.asked)]
        self.settle(depth, got["answer"][entry], got["whole"][entry], got["own"][entry])
        met = got["answer"][sent.entry[np.searchsorted(positions, self.known)]] > 0
        self.known = self.known[met & (self.c.before[self.known] + 1 > depth)]

    def settle(self, depth: int, found: np.ndarray, whole: np.ndarray, own: np.ndarray) -> None:
        """Scores all positions that the answers decide: for each that was asked the tokens that match, `depth` at most, and the counts of that context and of its next token.

        Contexts that go on beyond depth occur among those that end there. So if
        all of these have the next token, or none has, the longest context has
        that share too, and the next position's longest context is longer by one,
        or it is not beyond depth. Only positions between these shares are asked
        again, and the ones right after them, whose length is open; others take
        their length from the position before.
        """
        c, at, ask = self.c, self.left, self.ask
        if not len(at):
            return
        before = lambda x: np.r_[x[:1], x[:-1]]
        every = lambda x: np.bincount(np.flatnonzero(ask), x, len(at)).astype(np.int64)
        found, whole, own = every(found), every(whole), every(own)
        after = np.r_[False, (at[1:] == at[:-1] + 1) & (c.before[at[1:]] > 0)]  # the position before is left, too
        ratio = np.where(ask, np.where(own == 0, 0, np.where(own == whole, 1, self.OPEN)), self.ratio)
        exact = ask & ((found < depth) | (c.before[at] + 1 <= depth) | (self.length == depth) | after & before(ask & (found < depth) | (ratio == 0)))
        length = np.where(exact, found, self.length)
        length = np.where((length == 0) & after & before(exact & (ratio == self.OPEN)), before(found) + 1, length)
        number = np.arange(len(at))
        root = np.maximum.accumulate(np.where((length == 0) & after & before(ratio == 1), 0, number))
        behind = number - root
        length = np.where(length[root] > 0, length[root] + behind, 0)
        least = np.where(length > 0, length, depth + 1 + behind)  # what has no length yet follows a context that goes on
        ends = exact | (ratio != self.OPEN) & ((length > 0) | (least >= SETTLED))
        share = np.where(ratio == self.OPEN, own / np.maximum(whole, 1), ratio)[ends]
        escape = escape_of(least[ends])
        self.add(at[ends], (1 - escape) * share + escape * self.p[ends])
        on = ~ends
        self.left, self.p, self.ratio, self.length = at[on], self.p[on], ratio[on], length[on]
        self.ask = (self.ratio == self.OPEN) | (behind[on] == 0)

    def prefixed(self, row: np.ndarray, count: np.ndarray, low: int, high: int) -> None:
        """Takes counts of the prefixes of over low and up to high words: scores the positions before them, and the rest of documents whose prefix nobody shares any more."""
        c, docs = self.c, self.alive
        lengths = c.lengths[docs]
        many = np.minimum(lengths, high) - low
        begin = np.cumsum(many) - many
        whole = np.empty(len(count))  # of position i (words before it): the prefix of i words
        whole[1:], whole[begin] = count[:-1], self.count
        position = np.repeat(c.start[docs] + low - begin, many) + np.arange(len(count))
        left = lengths - low
        of_rest = np.cumsum(left) - left
        index = np.repeat(of_rest - begin, many) + np.arange(len(count))
        self.add(position, _ratio(count, whole, self.rest[index], escape_of(c.before[position] + 1)))
        end = count[begin + many - 1] if len(docs) else np.zeros(0, np.int64)
        tail = np.maximum(lengths - high, 0)
        doc_of = np.repeat(np.arange(len(docs)), tail)
        index = np.repeat(of_rest + many - (np.cumsum(tail) - tail), tail) + np.arange(tail.sum())
        position = np.repeat(c.start[docs] + high - (np.cumsum(tail) - tail), tail) + np.arange(tail.sum())
        rest = self.rest[index]
        alone = (end <= 1)[doc_of]
        self.add(position[alone], _ratio(1.0, np.ones(alone.sum()), rest[alone], escape_of(c.before[position[alone]] + 1)))
        stay = (end > 1) & (tail > 0)
        self.alive, self.count, self.rest = docs[stay], end[stay], rest[~alone]


def _first_state(c: _Chunk, count: np.ndarray, tokens: int, types: int, train_docs: int, got: dict) -> _State:
    """Counts of words, 2-grams and the first prefixes -> p_1 of all positions and what is left to do."""
    n, went = len(c.words), _first_keys(c)[2]
    two = got["count"][went[:n]]  # every position ends a 2-gram: with the start mark the first
    met = got["held"][went[:n]] > 0
    uni = (count + 1) / (tokens + types + 1)
    whole = np.r_[0, count[c.words[:-1]]]
    whole[c.start] = train_docs
    p = _ratio(two, whole, uni[c.words], ESCAPE[1])
    longer = c.before > 0
    before = np.where(longer, np.r_[0, two[:-1]], 0)  # count of the two tokens before
    left = np.flatnonzero((before > 0) & ~c.train)
    begins = np.r_[True, left[1:] != left[:-1] + 1][: len(left)] | (c.before[left] == 1)  # the position before matches a token at most
    known = np.flatnonzero(longer & c.train & np.r_[False, met[:-1]])
    none = np.zeros(0, np.int64)
    state = _State(c, np.zeros(len(c.lengths)), np.arange(len(c.lengths)), left, p[left], np.ones(len(left), bool), np.full(len(left), _State.OPEN), np.where(begins, 2, 0), known, none, none, np.zeros(0), before[left])
    final = np.flatnonzero((before == 0) & ~c.train | c.train & ~longer)
    state.add(final, p[final])
    # Training documents: the prefix of one word is the 2-gram of position 0.
    state.alive = np.flatnonzero(~c.held & (c.lengths > 1))
    state.count = two[c.start[state.alive]]
    many = c.lengths[state.alive] - 1
    state.rest = p[np.repeat(c.start[state.alive] + 1 - (np.cumsum(many) - many), many) + np.arange(many.sum())]
    row = c.prefixes(state.alive, 1, KNOWN)[0]
    state.prefixed(row, got["count"][went[n:]], 1, KNOWN)
    return state


def _first_keys(c: _Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """2-grams and the first prefixes of training documents, added up."""
    first = c.prefixes(np.flatnonzero(~c.held & (c.lengths > 1)), 1, KNOWN)[2]
    known, count, held, went = _tally(np.concatenate([c.grams(2), first]), np.concatenate([c.train, np.ones(len(first))]).astype(np.float64))
    return known, count, went, held


def _triples(state: _State) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(positions, and _tally of the 3-grams that end there): those of the held-out positions whose two tokens before occur in training, and of the training ones whose two a held-out one has."""
    positions = np.sort(np.concatenate([state.asked, state.known]))
    end = state.c.at(positions) + 1
    return positions, *_tally(state.c.hashes_of(end - 3, end), state.c.train[positions].astype(np.float64))


def _tripled(state: _State, got: dict) -> None:
    """Takes the counts of 3-grams, a search to two tokens."""
    positions, *_, went = _triples(state)
    count, held = np.zeros(len(state.c.words) + 1, np.int64), np.zeros(len(state.c.words) + 1, bool)
    count[positions], held[positions] = got["count"][went], got["held"][went] > 0  # others end no 3-gram that matters
    state.settle(2, np.full(len(state.left), 2), state.whole, count[state.left])
    state.whole = np.zeros(0, np.int64)
    state.known = state.known[held[state.known - 1] & (state.c.before[state.known] > 1)]


def _round(folder: str, round_: int, shards: int, wide: int, tokens: int, types: int, train_docs: int, search_shards: tuple[int, int]):
    """Answers of the round before -> state files, and what is sent in this one: 2-grams, 3-grams, then stretches and prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, rows in _groups(batches, "chunk"):
            c = _Chunk(_load(f"{folder}/text", chunk)) if round_ < 3 else None
            if round_ == 1:
                got = _take(rows, ("rank", "count"), False)
                hashes = np.r_[c.hashes, _END]
                shard, order = _spread(hashes, shards), np.argsort(hashes, kind="stable")
                ids, count = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
                ids[order], count[order] = got["rank"] * shards + shard[order], got["count"]
                uni = (count + 1) / (tokens + types + 1)
                score = np.bincount(c.doc, np.log10(uni)[c.words], len(c.lengths))
                _save(f"{folder}/ids", chunk, pack(ids=ids, count=count))
                _save(f"{folder}/base", chunk, pack(lengths=c.lengths, held=c.held.astype(np.uint8), known=np.bincount(c.doc, count[c.words] > 0, len(c.lengths)).astype(np.int64), base=score))
                c.name(ids)
                known, count, _, held = _first_keys(c)
                yield from _send_tally(known, count, held, shards, chunk)
                continue
            if round_ == 2:  # after 2-grams
                base = _load(f"{folder}/ids", chunk)
                c.name(base["ids"])
                state = _first_state(c, base["count"], tokens, types, train_docs, _take(rows, ("count", "held"), False))
            elif round_ == 3:  # after 3-grams
                state = _State.load(f"{folder}/2", chunk)
                _tripled(state, _take(rows, ("count", "held"), False))
            else:
                state = _State.load(f"{folder}/{round_ - 1}", chunk)
                length, depth, low, high = _lengths(round_ - 1)
                positions = np.sort(np.concatenate([state.asked, state.known]))
                state.searched(_Stretches(state.c, length, depth, positions, search_shards[0]), positions, _take(rows, ("answer", "whole", "own"), False), depth)
                row, _, keys = state.c.prefixes(state.alive, low, high)
                state.prefixed(row, _take(rows, ("count",), True)["count"][_tally(keys, np.ones(len(keys)))[3]], low, high)
            state.shrink()
            state.save(f"{folder}/{round_}", chunk)
            if round_ == 2:
                _, known, count, held, _ = _triples(state)
                yield from _send_tally(known, count, held, shards, chunk)
                continue
            length, depth, low, high = _lengths(round_)
            positions = np.sort(np.concatenate([state.asked, state.known]))
            if len(positions):
                yield from _Stretches(state.c, length, depth, positions, search_shards[1]).send(chunk)
            if len(state.alive):
                keys = state.c.prefixes(state.alive, low, high)[2]
                known, count, held, _ = _tally(keys, np.ones(len(keys)))
                yield from _send_tally(known, count, held, wide, chunk, -wide)

    return run


def _lengths(round_: int) -> tuple[int, int, int, int]:
    """Of rounds from 3: tokens that match before and at most after it, words of prefixes that are known before and after it."""
    k = round_ - 3
    return DEPTHS[k] if k < len(DEPTHS) else DEPTHS[-1] * STEP ** (k + 1 - len(DEPTHS)), DEPTHS[k + 1] if k + 1 < len(DEPTHS) else DEPTHS[-1] * STEP ** (k + 2 - len(DEPTHS)), KNOWN * WIDER**k, KNOWN * WIDER ** (k + 1)


def _spread(hashes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of sorted or unsorted hashes by range."""
    return np.searchsorted((np.arange(1, shards, dtype=object) * (1 << 64) // shards).astype(np.uint64), hashes, "right").astype(np.int64)


def _words(folder: str, shards: int):
    """Chunks -> distinct words with their training counts, by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk in b.column("chunk").to_pylist():
                c = _Chunk(_load(f"{folder}/text", chunk))
                hashes = np.r_[c.hashes, _END]
                count = np.bincount(c.words[c.train], minlength=len(hashes)).astype(np.int64)
                order = np.argsort(hashes, kind="stable")
                yield from _send_tally(hashes[order], count[order], np.zeros(len(order), bool), shards, chunk)

    return run


def _finish(folder: str, length: int, tokens: int):
    """Chunks -> one row for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, raw in zip(b.column("chunk").to_pylist(), b.column("keys").to_pylist()):
                keys = pa.ipc.open_stream(raw).read_all().column("key").combine_chunks()
                base = _load(f"{folder}/base", chunk)
                done = _load(f"{folder}/{length}", chunk, ("done",))["done"]
                n = len(keys)
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array(base["held"].astype(bool)), pa.array(base["lengths"]), pa.array(base["known"]), pa.array(np.full(n, tokens, np.int64)), pa.array(base["base"]), pa.array(done)],
                    ["key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return run


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", folds: int = FOLDS, held: int = HELD, chunk: int = CHUNK, shard: int = SHARD, piece: int = PIECE) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score for each row."""
    spark = docs.sparkSession
    workers_find_package(spark)
    folder = new_path(spark, "ngram")
    kind = dict(docs.dtypes)[key]
    out_of = F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == held
    narrow = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), out_of.alias("held"))
    manifest = written(narrow.mapInArrow(_tokenise(folder, chunk), "chunk string, n long, trained long, keys binary"), "chunks")
    total = manifest.agg(F.sum("n"), F.count(F.lit(1)), F.sum("trained")).first()
    if not total[0]:
        return spark.createDataFrame([], f"{key} {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    wide = shuffle_width(spark)
    shards = max(min(wide, -(-total[0] // 1000)), -(-total[0] // shard))
    listed = manifest.select("chunk").repartition(min(total[1], 4 * wide), "chunk")

    def answers(sent: DataFrame, round_: int, tasks: int) -> DataFrame:
        return written(sent.repartition(max(1, min(tasks, 8 * wide)), "shard").sortWithinPartitions("shard", "chunk").mapInArrow(_shard(round_, piece), _BACK_SQL), f"answers-{round_}")

    back = answers(listed.mapInArrow(_words(folder, shards), _SENT_SQL), 0, shards)
    sums = back.groupBy("shard").agg(F.first("types").alias("v"), F.first("tokens").alias("n")).agg(F.sum("v"), F.sum("n")).first()
    types, tokens = sums[0], sums[1]
    nothing = [F.lit(None).cast(t).alias(n) for n, t in (("shard", "long"), ("types", "long"), ("tokens", "long"), ("blob", "binary"))]
    round_, before, now = 1, 0, 0
    while True:
        every = back.unionByName(manifest.select("chunk", *nothing))
        if round_ == 3:
            now = max(min(wide, -(-total[0] // 1000)), -(-total[0] // (8 * SEARCHED)))  # an eighth of the positions, as a guess that only sizes shards
        elif round_ > 3:
            on = back.where("shard >= 0").agg(F.sum("types")).first()[0] or 0
            now = max(min(wide, -(-on // 100)), -(-on // SEARCHED), 1)
        sent = every.repartition(min(max(total[1], 1), 4 * wide), "chunk").sortWithinPartitions("chunk", "shard").mapInArrow(_round(folder, round_, shards, wide, tokens, types, total[2], (before, now)), _SENT_SQL)
        following = answers(sent, round_, shards if round_ < 3 else max(now, wide))
        drop_written(back)
        for gone in ("text", "ids") if round_ == 2 else (str(round_ - 1),) if round_ > 2 else ():
            drop_folder(spark, f"{folder}/{gone}")  # the round that read it last is written
        back, before = following, now
        if round_ > 2 and back.isEmpty():
            break
        round_ += 1
    drop_written(back)
    rows = manifest.select("chunk", "keys").repartition(min(total[1], 4 * wide), "chunk").mapInArrow(_finish(folder, round_, tokens), f"key {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return rows.withColumnRenamed("key", key)
