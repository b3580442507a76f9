"""Held-out positions whose share is decided are not searched on; text that repeats itself is sent once."""

import random

import numpy as np
import pytest
from test_ngram_rare import held, plain_score

from tarnlake.llm import ngram


def chunk_of(lengths, words, out_of):
    return ngram._Chunk({"words": np.array(words, np.int32), "lengths": np.array(lengths), "held": np.array(out_of, np.uint8), "ids": np.arange(max(words) + 1)})


def test_repeating_text_is_sent_once():
    n, depth = 6000, 256
    c = chunk_of([n], [k % 3 for k in range(n)], [1])
    positions = np.arange(100, n)
    s = ngram._Stretches(c, 64, depth, positions, 7)
    assert int((s.high - s.low).sum()) <= 3 * (n + depth)  # one stretch for each anchor; one for each position before
    assert (s.low[0] <= c.at(positions)).all()


def test_decided_positions_are_not_asked_again(spark, monkeypatch):
    """Copies of passages, shares between 0 and 1 after long contexts, and text that repeats itself, against all contexts."""
    rng = random.Random(16)
    word = lambda: f"w{rng.randrange(40)}"
    train, out = [i for i in range(400) if not held(i)][:60], [i for i in range(400) if held(i)][:12]
    passage = [word() for _ in range(130)]
    rows = []
    for k, i in enumerate(train):  # branches after 20, 60 and 110 words, with one or several ways on
        at = (20, 60, 110)[k % 3]
        rows.append((i, " ".join([word() for _ in range(k % 4)] + passage[k % 9 : at] + [f"b{k % 2}", *(passage[at + 1 :] if k % 4 else [word() for _ in range(9)])])))
    rows.append((next(i for i in range(1000, 1100) if not held(i)), "a b c " * 50))
    for k, i in enumerate(out):
        w = list(passage[k:])
        if k % 3:
            w[rng.randrange(len(w))] = f"b{k % 2}"
        rows.append((i, " ".join(w) if k % 5 else "x a b c " + "a b c " * 40 + "c a"))
    want = plain_score(rows)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for chunk, shard in ((ngram.CHUNK, ngram.SHARD), (400, 300)):
        got = {r["doc_id"]: r["score"] for r in ngram.score(d, chunk=chunk, shard=shard).collect()}
        assert got == pytest.approx(want, abs=1e-4)


def test_copy_of_one_text_is_decided_after_the_first_answer():
    c = chunk_of([40], list(range(40)), [1])
    left = np.arange(1, 40)
    none = np.zeros(0, np.int64)
    state = ngram._State(c, np.zeros(1), np.arange(1), left, np.full(39, 0.5), np.ones(39, bool), np.full(39, 2), np.where(left == 1, 2, 0), none, none, none, np.zeros(0), none)
    state.settle(2, np.full(39, 2), np.ones(39, np.int64), np.ones(39, np.int64))
    assert not len(state.left)  # each context occurs once, with the next token
    lengths = np.arange(2, 41)
    want = np.log10((1 - ngram.escape_of(lengths)) + ngram.escape_of(lengths) * 0.5).sum()
    assert state.done[0] == pytest.approx(want)
