"""The graph queries over all references, against plain Python on small tables."""

import random
from collections import Counter

import pytest

from tarnlake.errors import ResourceExhausted
from tarnlake.operators import graph
from tarnlake.plans.registry import QUERIES

PART = "p_partkey long, p_name string, p_brand string, p_type string, p_size int"
LINE = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """(folder, symbols, references as (source, name)); few of the lines have a quantity of 49 or more and are returned."""
    rng, d = random.Random(8), tmp_path_factory.mktemp("graph")
    parts = [(k, rng.choice(["red", "small"]) + " " + rng.choice(["ring", "gear", "bolt"]), f"Brand#1{k % 3}", rng.choice(["STEEL", "TIN"]), k % 7) for k in range(1, 121)]
    lines = [(o, rng.randrange(1, 100), 1, n, float(rng.randrange(1, 51)), 1.0, 0.0, 0.0, rng.choice("RAN"), "O", None) for o in range(40) for n in range(rng.randrange(1, 3))]
    spark.createDataFrame(parts, PART).write.parquet(f"{d}/part.parquet")
    spark.createDataFrame(lines, LINE).write.parquet(f"{d}/lineitem.parquet")
    symbols = {k: (f"{n.replace(' ', '_')}_{b}", b, t) for k, n, b, t, _ in parts}
    refs = []
    for o in range(40):
        own = [x[1] for x in sorted((x for x in lines if x[0] == o), key=lambda x: x[1:10])]
        refs += [(a, symbols[b][0]) for a, b in zip(own, own[1:])]
    return str(d), symbols, refs


def plain_edges(symbols, refs):
    return [(s, k) for s, name in refs for k, x in symbols.items() if x[0] == name and k != s]


def plain_tiers(edges, seeds, depth, reverse):
    after = {}
    for a, b in edges:
        after.setdefault(b if reverse else a, set()).add(a if reverse else b)
    out = set()
    for seed in seeds:
        seen, front = {seed}, [seed]
        for k in range(1, depth + 1):
            front = sorted({y for x in front for y in after.get(x, ())} - seen)[:50]
            seen |= set(front)
            out |= {(seed, k, x) for x in front}
    return out


def plain_components(symbols, edges):
    low = {k: k for k in symbols}
    moved = True
    while moved:
        moved = False
        for a, b in edges:
            m = min(low[a], low[b])
            moved |= (low[a], low[b]) != (m, m)
            low[a] = low[b] = m
    place = {x: k for k, x in enumerate(sorted(set(low.values())))}
    return {k: place[x] for k, x in low.items()}


def test_edges_tiers_and_components_use_all_references(spark, small):
    d, symbols, refs = small
    edges = plain_edges(symbols, refs)
    seeds = [k for k in symbols if k % 50 == 0]
    got = lambda name: [tuple(r) for r in QUERIES[name](spark, d).collect()]
    assert Counter(got("call_edges")) == Counter(edges)
    assert set(got("callers_tiers")) == plain_tiers(edges, seeds, 3, True)
    assert set(got("callees_tiers")) == plain_tiers(edges, seeds, 3, False)
    assert set(got("impact")) == {(s, k, x, x % 7 in (0, 1, 2) or x % 11 == 0) for s, k, x in plain_tiers(edges, seeds, 4, True)}
    comps = plain_components(symbols, edges)
    assert dict(got("components")) == comps
    sizes = Counter(comps.values())
    assert [(r["component"], r["size"]) for r in QUERIES["subsystems"](spark, d).collect()] == sorted(sizes.items(), key=lambda x: (-x[1], x[0]))[:50]
    fan = Counter(x[0] for x in symbols.values())
    weight = Counter()
    for s, name in refs:
        for k, x in symbols.items():
            if x[0] == name and k != s:
                weight[s, k] += 10.0 * (0.1 if fan[name] > 5 else 1.0)
    ranked = {(a, b): w for a, b, w in got("rank_edges")}
    assert ranked == pytest.approx(dict(weight)) and len(ranked) == len(weight)


def plain_shares(edges):
    n, out = Counter(edges), Counter(a for a, _ in edges)
    return [(a, b, w / out[a]) for (a, b), w in n.items()]


def plain_ranks(symbols, edges, rounds, tolerance):
    share, out = plain_shares(edges), {a for a, _ in edges}
    score = dict.fromkeys(symbols, 1 / len(symbols))
    for _ in range(rounds):
        lost = sum(x for k, x in score.items() if k not in out)
        new = dict.fromkeys(symbols, 0.15 / len(symbols) + 0.85 * lost / len(symbols))
        for a, b, w in share:
            new[b] += 0.85 * score[a] * w
        moved, score = sum(abs(new[k] - score[k]) for k in symbols), new
        if moved < tolerance:
            break
    return score


def plain_pushes(symbols, edges, seeds, rounds):
    share = plain_shares(edges)
    score, r = dict.fromkeys(symbols, 0.0), {k: 1 / len(seeds) if k in seeds else 0.0 for k in symbols}
    for _ in range(rounds):
        push = {k: x for k, x in r.items() if x > 1e-6}
        if not push:
            break
        for k, x in push.items():
            score[k] += 0.15 * x
            r[k] = 0.0
        for a, b, w in share:
            r[b] += 0.85 * push.get(a, 0.0) * w
    return score, r


def test_ranks_use_all_references(spark, small):
    d, symbols, refs = small
    edges = plain_edges(symbols, refs)
    got = {r["id"]: r["score"] for r in QUERIES["pagerank_global"](spark, d).collect()}
    assert got == pytest.approx(plain_ranks(symbols, edges, 15, 1e-6), abs=2e-9)
    want, left = plain_pushes(symbols, edges, {k for k, x in symbols.items() if x[1] == "Brand#11"}, 1000)
    assert max(left.values()) <= 1e-6
    assert {r["id"]: r["score"] for r in QUERIES["ppr_focus"](spark, d).collect()} == pytest.approx({k: x for k, x in want.items() if x > 0}, abs=2e-9)


def test_pushes_that_do_not_settle_raise(spark):
    w = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0)], "src long, dst long, weight double")
    n = spark.createDataFrame([(1,), (2,)], "id long")
    with pytest.raises(ResourceExhausted):
        graph.personalised(n, w, n.where("id = 1"), rounds=12)
