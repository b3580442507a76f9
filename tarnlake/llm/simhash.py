"""SimHash near-duplicates: fingerprints, bit-sliced comparison, components.

A fingerprint's bit is 1 where over half of a text's shingle hashes have it.
Rows that share a key are sorted together and cut into blocks of 64 lanes; a
block holds its fingerprints as vertical bit planes. A query's bit is spread
over a word and compared with a plane at once; carry-save adders count the
differing bits of all 64 lanes in vertical counters, and an item (query, block)
is abandoned as soon as every lane exceeds the radius. Links of a batch become a
spanning forest in the task, so a group of n near copies yields at most n - 1
links for each key, and links of all batches meet in connected components.

Keys:
* exact (``near``): 64 bits in 5 blocks; two fingerprints within 3 bits agree on
  two whole blocks at least, so the 10 pairs of blocks as keys lose no link.
* sampled (``similar``): fingerprints of 512 bits. The first SKETCH bits travel
  with every key and are compared; each table takes some of the others as key.
  The bits per key follow log2 of the row count and the number of tables
  follows from them, so that a pair at the similarity is found with probability
  ``recall`` at every size; none is capped. Prints there are of distinct shingles
  and only find candidates, within three standard deviations of what the
  similarity makes expect; a link needs the exact Jaccard similarity of the
  shingle sets. Spanning links of candidates are verified first; then all
  candidates between groups that these leave apart.

Keys with over HEAVY rows are cut into salted blocks whose pairs are separate
groups; they are counted first, so only their rows are multiplied. Equal
fingerprints (sampled: equal shingle sets) are joined before all this.

Defined cases: null and empty texts have no words and the fingerprint zero, and
are linked like others; texts under one shingle are one shingle; rows with null
ids get a fingerprint and link others, but never name a component (one without
any id has the component null); repeated rows share theirs; an empty table gives
no rows; other columns are ignored, whatever their names. ``keep_one``: of rows
with one id each distinct shingle set counts for itself; of rows alike in both
the one with the smallest text stays.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from ..operators.components import connected_components
from .common import drop_written, fresh, shared_dir, shuffle_width, workers_find_package, written

SEED, HEAVY, ROWS, SKETCH = 42, 8192, 16_384, 128
BLOCK = 16 << 20  #: bytes of text whose pairs are verified together
MAX_BROADCAST = 100_000  #: heavy keys (24 bytes each) that are sent to all executors; beyond it they are joined
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(h: np.ndarray, k: int) -> np.ndarray:
    """Another 64-bit hash from one: the k-th output of a splitmix generator; h itself for k = 0."""
    if not k:
        return h
    with np.errstate(over="ignore"):
        z = h + np.uint64((0x9E3779B97F4A7C15 * k) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def shingles(text: bytes | None, shingle: int) -> list[int]:
    """The hashes of a text's shingles; one for a text of fewer words, none for one without words."""
    words = (text or b"").lower().split()  # bytes: A-Z alone change, blanks are ASCII's six
    n = len(words)
    digest = xxhash.xxh64_intdigest
    if n <= shingle:
        return [digest(b" ".join(words), SEED)] if n else []
    return [digest(b" ".join(words[i : i + shingle]), SEED) for i in range(n - shingle + 1)]


def fingerprint(text: bytes | None, shingle: int, width: int) -> bytes:
    """width bits, most significant first."""
    return _print(shingles(text, shingle), width)


def _print(hashes: list[int], width: int) -> bytes:
    if not hashes:
        return bytes(width // 8)
    ones = np.zeros(width, np.int64)
    for at in range(0, len(hashes), 4080):
        h = np.array(hashes[at : at + 4080], np.uint64)
        planes = np.stack([_mix(h, k) for k in range(width // 64)], axis=1).astype(">u8")
        bits = np.unpackbits(planes.view(np.uint8).reshape(len(h), width // 8), axis=1)
        for k in range(0, len(h), 255):
            ones += np.add.reduce(bits[k : k + 255], axis=0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(hashes)).tobytes()


def fingerprints(docs: DataFrame, shingle: int, width: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp binary) of each row."""
    workers_find_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t, shingle, width) for t in b.column(1).to_pylist()], pa.binary())], ["key", "fp"])

    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text")).mapInArrow(run, f"key {kind}, fp binary")


def _set_prints(docs: DataFrame, shingle: int, width: int, key: str, text: str) -> DataFrame:
    """(key, fp, digest) of each row: the fingerprint and a 128-bit digest of its distinct shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints, digests = [], []
            for t in b.column(1):  # one set at a time: those of a batch are many times its text
                x = sorted(set(shingles(t.as_py(), shingle)))
                prints.append(_print(x, width))
                digests.append(_digest(x))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints, pa.binary()), pa.array(digests, pa.binary())], ["key", "fp", "digest"])

    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text")).mapInArrow(run, f"key {kind}, fp binary, digest binary")


def _digest(distinct: list[int]) -> bytes:
    return xxhash.xxh3_128_digest(np.array(distinct, np.uint64).tobytes())


def _texts(nodes: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """(node, text) of nodes (node, id, digest), written: of the docs (key, text) with the node's id one that has its shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, texts = b.column(1).to_pylist(), b.column(2).to_pylist()
            on = [k for k in range(b.num_rows) if _digest(sorted(set(shingles(texts[k], shingle)))) == digests[k]]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(on, pa.int64())), pa.array([texts[k] for k in on], pa.binary())], ["node", "text"])

    rows = nodes.join(docs, F.col("id") == F.col("key")).select("node", "digest", "text")
    return written(rows.mapInArrow(run, "node long, text binary").groupBy("node").agg(F.first("text").alias("text")), "texts")


def jaccard(a: bytes | None, b: bytes | None, shingle: int) -> float:
    """Of the shingle sets of two texts; texts without words are alike."""
    x, y = set(shingles(a, shingle)), set(shingles(b, shingle))
    return len(x & y) / len(x | y) if x or y else 1.0


class _Sets:
    """Sets of shingles by node, for pairs of nodes."""

    def __init__(self, sets: dict[int, np.ndarray]):
        self.nodes = np.array(sorted(sets), np.int64)
        each = [sets[k] for k in self.nodes.tolist()]
        self.size = np.array([len(x) for x in each], np.int64)
        self.start = np.cumsum(self.size) - self.size
        known, self.ids = np.unique(np.concatenate([np.zeros(0, np.uint64), *each]), return_inverse=True)
        self.flag = np.zeros(len(known), bool)

    def has(self, k: np.ndarray) -> np.ndarray:
        return np.isin(k, self.nodes)

    def alike(self, u: np.ndarray, v: np.ndarray, similarity: float, slab: int = 1_000_000) -> np.ndarray:
        """Which pairs have at least this Jaccard similarity; pairs with one u stand together. Sets of about slab shingles are looked up at once."""
        x, y = np.searchsorted(self.nodes, u), np.searchsorted(self.nodes, v)
        piece = np.cumsum(self.size[y]) // slab
        cut = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (piece[1:] != piece[:-1]), True])
        common = np.empty(len(x), np.int64)
        for a, b in zip(cut[:-1], cut[1:]):
            own = self.ids[self.start[x[a]] : self.start[x[a]] + self.size[x[a]]]
            many, begin = self.size[y[a:b]], self.start[y[a:b]]
            upto = np.cumsum(many)
            at = np.repeat(begin - (upto - many), many) + np.arange(many.sum())
            self.flag[own] = True
            hits = np.r_[0, np.cumsum(self.flag[self.ids[at]])]
            self.flag[own] = False
            common[a:b] = hits[upto] - hits[upto - many]
        every = self.size[x] + self.size[y] - common
        return np.where(every > 0, common / np.maximum(every, 1), 1.0) >= similarity


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float, block: int = BLOCK) -> DataFrame:
    """The pairs (u, v) whose texts (node, text) have at least this Jaccard similarity, written.

    Near copies that fall short of it are pairs of each other: in a large group
    there are many pairs of few texts. So a pair goes to the least neighbour of
    its u, which most texts of a group share, and each text goes there once and is
    cut into shingles once. Places of over block bytes of text are split by hashes
    of u and v, so that every pair meets in one part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sets, ready = None, {}, None
        for b in batches:
            places, pair = b.column(0).to_numpy(), b.column(3).is_valid().to_numpy(zero_copy_only=False)
            edge = np.flatnonzero(np.r_[True, (places[1:] != places[:-1]) | (pair[1:] != pair[:-1]), True])
            for i, j in zip(edge[:-1].tolist(), edge[1:].tolist()) if b.num_rows else ():
                if place is None or places[i] != place:
                    place, sets, ready = places[i], {}, None
                node = b.column(1).slice(i, j - i)
                if not pair[i]:
                    for k, t in zip(node.to_pylist(), b.column(2).slice(i, j - i).to_pylist()):
                        sets[k] = np.unique(np.array(shingles(t, shingle), np.uint64))
                    continue
                if ready is None:
                    ready, sets = _Sets(sets), {}
                u, v = node.to_numpy(), b.column(3).slice(i, j - i).to_numpy()
                there = ready.has(u) & ready.has(v)  # rows without an id have no text here
                u, v = u[there], v[there]
                if not len(u):
                    continue
                on = ready.alike(u, v, similarity)
                yield pa.RecordBatch.from_arrays([pa.array(u[on]), pa.array(v[on])], ["u", "v"])

    both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    placed = written(pairs.join(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("place")), "u"), "placed")
    members = lambda d: d.select("place", F.col("u").alias("node")).union(d.select("place", "v")).distinct()
    sizes = members(placed).join(texts.select("node", F.length("text").alias("n")), "node").groupBy("place").agg(F.sum("n").alias("n"))
    parts = F.ceil(F.col("n") / (block // 2)).cast("long")
    part = F.when(F.col("n") > block, F.xxhash64("place", F.pmod(F.xxhash64("u"), parts), F.pmod(F.xxhash64("v"), parts))).otherwise(F.col("place"))
    split = written(placed.join(sizes, "place").select(part.alias("place"), "u", "v"), "split")
    rows = members(split).join(texts, "node").select("place", "node", "text", F.lit(None).cast("long").alias("other"))
    rows = rows.unionByName(split.select("place", F.col("u").alias("node"), F.lit(None).cast("binary").alias("text"), F.col("v").alias("other")))
    sorted_ = rows.repartition(shuffle_width(pairs.sparkSession), "place").sortWithinPartitions("place", F.col("other").isNotNull(), "node")
    out = written(sorted_.mapInArrow(run, "u long, v long"), "verified")
    drop_written(placed, split)
    return out


def _csa(a, b, c):
    u = a ^ b
    return (a & b) | (u & c), u ^ c


def links(fps: np.ndarray, ends: np.ndarray, radius: int, slab: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j), i < j, of rows of one group within radius bits. fps: rows of bytes; ends: for each row, where its group ends."""
    n, width = len(fps), fps.shape[1] * 8
    bits = np.unpackbits(fps, axis=1)
    n_blocks = -(-n // 64)
    padded = np.zeros((n_blocks * 64, width), np.uint8)
    padded[:n] = bits
    planes = np.ascontiguousarray(np.packbits(padded.reshape(n_blocks, 64, width), axis=1, bitorder="little").transpose(2, 0, 1)).view("<u8")[:, :, 0]  # plane, block
    spread = np.ascontiguousarray((0 - bits.T.astype(np.int64)).view(np.uint64))  # plane, row
    rows = np.arange(n)
    first, last = (rows + 1) // 64, (ends - 1) // 64
    many = np.where(ends - rows > 1, last - first + 1, 0)
    query = np.repeat(rows, many)
    block = np.arange(len(query)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
    top = max(4, (radius + 1).bit_length())
    for at in range(0, len(query), slab):
        q, b = query[at : at + slab], block[at : at + slab]
        low = np.maximum(q + 1 - b * 64, 0).astype(np.uint64)
        high = np.minimum(ends[q] - b * 64, 64).astype(np.uint64)
        valid = (_ONES << low) & np.where(high < 64, (np.uint64(1) << (high % np.uint64(64))) - np.uint64(1), _ONES)
        zero = np.zeros(len(q), np.uint64)
        count = [zero] * top
        over = zero
        for p in range(0, width, 8):
            x = [planes[p + k][b] ^ spread[p + k][q] for k in range(8)]
            t0, one = _csa(count[0], x[0], x[1])
            t1, one = _csa(one, x[2], x[3])
            f0, two = _csa(count[1], t0, t1)
            t0, one = _csa(one, x[4], x[5])
            t1, one = _csa(one, x[6], x[7])
            f1, two = _csa(two, t0, t1)
            carry, four = _csa(count[2], f0, f1)
            count[0], count[1], count[2] = one, two, four
            for k in range(3, top):
                count[k], carry = count[k] ^ carry, count[k] & carry
            over = over | carry
            if p % 16 == 8 or p + 8 >= width:
                more, same = over, _ONES
                for k in range(top - 1, -1, -1):
                    if radius >> k & 1:
                        same = same & count[k]
                    else:
                        more = more | (same & count[k])
                        same = same & ~count[k]
                alive = valid & ~more
                on = alive != 0
                if not on.any():
                    break
                if p + 8 < width and on.sum() * 4 < len(on) * 3:  # the rest is abandoned
                    q, b, valid, over = q[on], b[on], valid[on], over[on]
                    count = [c[on] for c in count]
        else:
            lanes = np.unpackbits(alive[on].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            item, lane = np.nonzero(lanes)
            yield q[on][item], b[on][item] * 64 + lane


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest row reachable from each of n rows."""
    root = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = root[i], root[j]
            open_ = a != b
            if not open_.any():
                break
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (deeper := root[root]).tobytes() != root.tobytes():
                root = deeper
    return root


def _compare(radius: int, apart: bool = False):
    """Rows (grp, id, fp) sorted by grp -> spanning links (u, v) of ids. apart: rows also have a label (part); all links between labels."""

    def emit(ids: np.ndarray, grp: np.ndarray, fp: np.ndarray, part: np.ndarray | None) -> pa.RecordBatch | None:
        edge = np.flatnonzero(np.r_[True, grp[1:] != grp[:-1], True])
        size = np.diff(edge)
        many = size > 1
        if apart:
            many &= np.minimum.reduceat(part, edge[:-1]) != np.maximum.reduceat(part, edge[:-1])
        keep = np.repeat(many, size)
        if not keep.any():
            return None
        ids, fp = ids[keep], fp[keep]
        size = size[many]
        ends = np.repeat(np.cumsum(size), size)
        if apart:
            part, found = part[keep], []
            for i, j in links(fp, ends, radius):
                on = part[i] != part[j]
                found.append(np.stack([np.minimum(ids[i[on]], ids[j[on]]), np.maximum(ids[i[on]], ids[j[on]])]))
            if not found or not (pairs := np.unique(np.concatenate(found, axis=1), axis=1)).size:
                return None
            return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["u", "v"])
        root = forest(len(ids), links(fp, ends, radius))
        on = root != np.arange(len(ids))
        return pa.RecordBatch.from_arrays([pa.array(ids[on]), pa.array(ids[root[on]])], ["u", "v"]) if on.any() else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def flush(final: bool) -> tuple[pa.RecordBatch | None, pa.RecordBatch | None]:
            t = pa.Table.from_batches(held).combine_chunks()
            if not t.num_rows:
                return None, None
            grp = t.column("grp").to_numpy()
            cut = t.num_rows if final else int(np.searchsorted(grp, grp[-1]))
            rest = t.slice(cut).combine_chunks().to_batches()
            done = t.slice(0, cut)
            if not cut:
                return None, rest[0]
            raw = done.column("fp").combine_chunks()
            width = len(raw[0].as_py())
            data = np.frombuffer(b"".join(raw.to_pylist()), np.uint8).reshape(cut, width)
            part = done.column("part").to_numpy() if apart else None
            return emit(done.column("id").to_numpy(), grp[:cut], data, part), rest[0] if rest else None

        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= ROWS:
                out, rest = flush(False)
                held, rows = ([rest], rest.num_rows) if rest is not None else ([], 0)
                if out is not None:
                    yield out
        if held and (out := flush(True)[0]) is not None:
            yield out

    return run


def _grouped_links(keyed: DataFrame, radius: int, heavy: int = HEAVY, apart: bool = False, sizes: DataFrame | None = None) -> DataFrame:
    """keyed: (k, id, fp), fp binary, and part where only links between parts are wanted, all of them.

    sizes: (k, n), partial counts of the keys' rows, where they are known more
    cheaply. Keys of over heavy rows become pairs of salted blocks; every pair
    of rows meets in one.
    """
    spark, more = keyed.sparkSession, ["part"] if apart else []
    counted = (sizes if sizes is not None else keyed.select("k", F.lit(1).alias("n"))).groupBy("k").agg(F.sum("n").alias("n"))
    crowded = written(counted.where(F.col("n") > heavy).select("k", F.ceil(F.col("n") / (heavy // 2)).cast("long").alias("parts")), "crowded")
    n_heavy = crowded.count()
    if n_heavy:
        own = F.pmod(F.xxhash64("id"), F.col("parts"))
        pairs = F.when(F.col("parts").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(
            F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda j: F.least(F.col("own"), j) * F.col("parts") + F.greatest(F.col("own"), j))
        )
        joined = keyed.join(F.broadcast(crowded) if n_heavy <= MAX_BROADCAST else crowded, "k", "left")
        keyed = joined.withColumn("own", own).select(F.explode(pairs).alias("pair"), "k", "id", "fp", *more).withColumn("k", F.when(F.col("pair") < 0, F.col("k")).otherwise(F.xxhash64("k", "pair")))
    grouped = keyed.select(F.col("k").alias("grp"), "id", "fp", *more).repartition(shuffle_width(spark), "grp").sortWithinPartitions("grp", "id")
    return grouped.mapInArrow(_compare(radius, apart), "u long, v long")


def _field(c, high: int, bits: int):
    """bits of a long, from bit high (exclusive) down."""
    return F.shiftrightunsigned(c, high - bits).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def near(docs: DataFrame, shingle: int = 3, radius: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fingerprint (16 hex digits), component_id: fingerprints of 64 bits link within radius bits. The fingerprint is its node's number, so rows without an id link too."""
    spark = docs.sparkSession
    workers_find_package(spark)
    prints = written(fingerprints(docs, shingle, 64, key, text), "prints")
    n_blocks = radius + 2
    sizes = [64 // n_blocks + (k < 64 % n_blocks) for k in range(n_blocks)]
    tops = [64 - sum(sizes[:k]) for k in range(n_blocks)]
    fields = [_field(F.col("id"), t, s) for t, s in zip(tops, sizes)]
    keys = [F.lit(i).cast("long") * (1 << 52) + F.shiftleft(fields[a], sizes[b]) + fields[b] for i, (a, b) in enumerate(combinations(range(n_blocks), 2))]
    nodes = written(prints.groupBy("fp").agg(F.min("key").alias("least")).withColumn("id", F.conv(F.hex("fp"), 16, -10).cast("long")), "nodes")
    pairs = written(_grouped_links(nodes.select(F.explode(F.array(*keys)).alias("k"), "id", "fp"), radius), "links")
    found = connected_components(pairs, shared_dir(spark)).withColumnsRenamed({"node": "id"})
    classes = written(nodes.join(found, "id", "left").select("fp", "least", F.coalesce("component", "id").alias("component")), "classes")
    drop_written(pairs, nodes)
    named = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    return prints.join(classes.join(named, "component").select("fp", "component_id"), "fp").select(F.col("key").alias(key), F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def radius_of(similarity: float, width: int) -> int:
    """Differing bits to expect between sets of equal size at a Jaccard similarity, and three standard deviations more."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(width * share + 3 * math.sqrt(width * share * (1 - share)))


def _classes(docs: DataFrame, shingle: int, similarity: float, width: int, recall: float, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(prints: key and digest of each row, classes: digest, component), both written."""
    spark = docs.sparkSession
    workers_find_package(spark)
    whole = written(_set_prints(docs, shingle, width, key, text), "prints")
    prints = whole.select("key", "digest")
    share, radius = math.acos(2 * similarity / (1 + similarity)) / math.pi, radius_of(similarity, SKETCH)
    within = sum(math.comb(SKETCH, k) * share**k * (1 - share) ** (SKETCH - k) for k in range(radius + 1))
    nodes = written(whole.groupBy("digest").agg(F.min("key").alias("id"), F.first("fp").alias("fp")).withColumn("node", F.xxhash64("digest")), "nodes")
    bits = max(12, math.ceil(math.log2(max(2, nodes.count()))) - 4)
    tables = math.ceil(math.log(1 - recall / within) / math.log(1 - (1 - share) ** bits))  # a pair must share a key and be within the radius
    chosen = [SKETCH + np.random.default_rng([SEED, t]).choice(width - SKETCH, bits, replace=False) for t in range(tables)]
    weights = 1 << np.arange(bits, dtype=np.int64)

    def keys_of(raw: list[bytes]) -> Iterator[np.ndarray]:
        x = np.unpackbits(np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), width // 8), axis=1)
        for t in range(tables):
            yield x[:, chosen[t]].astype(np.int64) @ weights + (t << 40)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column("fp").to_pylist()
            rest = [pa.array([r[: SKETCH // 8] for r in raw], pa.binary()) if n == "fp" else b.column(n) for n in b.schema.names]
            for k in keys_of(raw) if raw else ():
                yield pa.RecordBatch.from_arrays([pa.array(k), *rest], ["k", *b.schema.names])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                k, n = np.unique(np.concatenate(list(keys_of(b.column(0).to_pylist()))), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], ["k", "n"])

    def candidates(rows: DataFrame, apart: bool) -> DataFrame:
        found = rows.mapInArrow(keyed, "k long, id long, fp binary" + ", part long" * apart)
        sizes = rows.select("fp").mapInArrow(counted, "k long, n long")
        return written(_grouped_links(found, radius, apart=apart, sizes=sizes).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "candidates")

    def verified(pairs: DataFrame) -> DataFrame:
        asked = nodes.join(pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct(), "node", "left_semi")
        texts = _texts(asked.select("node", "id", "digest"), docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text")), shingle)
        out = _verified(pairs, texts, shingle, similarity)
        drop_written(texts, pairs)
        return out

    rows = nodes.select(F.col("node").alias("id"), "fp")
    first = verified(candidates(rows, False))
    parts = connected_components(first, shared_dir(spark)).select(F.col("node").alias("id"), F.col("component").alias("part"))
    labelled = written(rows.join(parts, "id", "left").select("id", "fp", F.coalesce("part", "id").alias("part")), "parts")
    second = verified(candidates(labelled, True))
    found = connected_components(first.union(second), shared_dir(spark))
    classes = written(nodes.join(found, "node", "left").select("digest", "id", F.coalesce("component", "node").alias("component")), "classes")
    drop_written(labelled, first, second, nodes)
    return prints, classes


def similar(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, width: int = 512, recall: float = 0.97, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, component_id: texts whose sets of word shingles have at least this Jaccard similarity are linked, each pair that has it with probability recall or more."""
    prints, classes = _classes(docs, shingle, similarity, width, recall, key, text)
    named = classes.join(classes.groupBy("component").agg(F.min("id").alias("component_id")), "component").select("digest", "component_id")
    return prints.join(named, "digest").select(F.col("key").alias(key), "component_id")


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, width: int = 512, recall: float = 0.97, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs with the smallest id of their group, one for each group. Rows without an id stay."""
    prints, classes = _classes(docs, shingle, similarity, width, recall, key, text)
    stay = written(classes.where("id is not null").groupBy("component").agg(F.min(F.struct("id", "digest")).alias("s")).select("s.id", "s.digest"), "stay")
    ident, digest = fresh(docs.columns, "stay_id"), fresh(docs.columns, "stay_digest")
    again = written(prints.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("key").alias(ident)), "again")
    kept = docs.join(stay.select(F.col("id").alias(ident)), F.col(key) == F.col(ident), "left_semi").unionByName(docs.where(F.col(key).isNull()))
    if again.isEmpty():
        return kept
    # Ids that several rows have: their rows alone are hashed once more, and one row of each (id, shingle set) that stays is taken.
    rows = docs.join(again, F.col(key) == F.col(ident), "left_semi")
    at = docs.columns.index(text)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_digest(sorted(set(shingles(None if t is None else t.encode(), shingle)))) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.binary())], names=[*b.schema.names, digest])

    marked = rows.mapInArrow(digests, StructType([*rows.schema.fields, StructField(digest, BinaryType())]))
    chosen = _one_each(marked, stay, key, text, digest, docs.columns)
    return kept.join(again, F.col(key) == F.col(ident), "left_anti").unionByName(chosen)


def _one_each(marked: DataFrame, stay: DataFrame, key: str, text: str, digest: str, columns: list[str]) -> DataFrame:
    """Of the marked rows whose (id, digest) stays, for each the one with the smallest text."""
    on = marked.join(stay.select(F.col("id").alias(key), F.col("digest").alias(digest)), [key, digest], "left_semi")
    least = on.groupBy(key, digest).agg(F.min_by(F.struct(*[F.col(c) for c in columns]), F.struct(F.col(text))).alias("one"))
    return least.select(*[F.col("one").getField(c).alias(c) for c in columns])
