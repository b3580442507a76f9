"""N-gram scores of passages that occur once in training: held-out copies match them to the token."""

import math
import random
import zlib

import pytest

from tarnlake.llm import ngram


def held(i):
    return zlib.crc32(str(i).encode()) % ngram.FOLDS == ngram.HELD


def plain_score(rows):
    seq = lambda t: t.lower().encode().split() + [b"</>"]
    count, nexts, out = {}, {}, {}
    for i, t in rows:
        if not held(i):
            s = seq(t)
            full = [b"<>", *s]
            for j, w in enumerate(s):
                count[w] = count.get(w, 0) + 1
                for n in range(1, j + 2):
                    seen = nexts.setdefault(tuple(full[j + 1 - n : j + 1]), {})
                    seen[w] = seen.get(w, 0) + 1
    total, kinds = sum(count.values()), len(count)
    for i, t in rows:
        s = seq(t)
        full, got = [b"<>", *s], 0.0
        for j, w in enumerate(s):
            p = (count.get(w, 0) + 1) / (total + kinds + 1)
            longest = max((n for n in range(1, j + 2) if tuple(full[j + 1 - n : j + 1]) in nexts), default=0)
            for n in sorted({1, longest}):
                seen = nexts.get(tuple(full[j + 1 - n : j + 1])) if 1 <= n <= j + 1 else None
                if seen:
                    escape = ngram.ESCAPE.get(n) or float(ngram.escape_of(n))
                    p = (1 - escape) * seen.get(w, 0) / sum(seen.values()) + escape * p
            got += math.log10(p)
        out[i] = got
    return out


def test_copies_of_passages_that_occur_once(spark):
    rng = random.Random(6)
    ids = iter(range(1000))
    train, out = [i for i in (next(ids) for _ in range(200)) if not held(i)][:20], [i for i in range(200) if held(i)][:4]
    rare = [" ".join(f"w{rng.randrange(300)}" for _ in range(60)) for _ in train]
    rows = list(zip(train, rare))
    rows += list(zip(out, [rare[0], "new start " + " ".join(rare[1].split()[7:40]) + " other end", rare[2] + " " + rare[3], "w1 w2 w3 unseen"]))
    want = plain_score(rows)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for chunk, shard in ((ngram.CHUNK, ngram.SHARD), (150, 200)):
        got = {r["doc_id"]: r["score"] for r in ngram.score(d, chunk=chunk, shard=shard).collect()}
        assert got == pytest.approx(want, abs=1e-4)
