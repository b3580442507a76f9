"""Graph queries where names repeat: they give what their SQL gives, and never write out the edges, which grow with the square of the input."""

import os
import random
from decimal import Decimal

import pytest

from tarnlake.operators import graph
from tarnlake.plans import tools  # noqa: F401 (adds its queries to the registry)
from tarnlake.plans.registry import ORACLES, QUERIES

from test_graph_queries import LINE, PART

BY_NAME = ["boosted_scores", "callers_tiers", "components", "pagerank_global", "ppr_focus", "read_symbol", "repo_map_budget", "subsystem_members", "subsystems", "callees_tiers", "context_budget", "impact", "shortest_path", "degree_topn", "degree_lists", "neighbours"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Few names of many symbols; sources that refer to their own name, alone in it or not."""
    rng, d = random.Random(3), tmp_path_factory.mktemp("named")
    parts = [(k, "only one" if k == 0 else rng.choice(["red ring", "small gear", "tin bolt"]), f"Brand#1{k % 3}", rng.choice(["SMALL", "TIN"]), k % 7) for k in range(121)]
    lines = [(o, 0 if o < 3 else rng.randrange(100), 1, n, 1.0, 1.0, 0.0, 0.0, "R", "O", None) for o in range(90) for n in range(rng.randrange(1, 5))]
    spark.createDataFrame(parts, PART).write.parquet(f"{d}/part.parquet")
    spark.createDataFrame(lines, LINE).write.parquet(f"{d}/lineitem.parquet")
    return str(d)


def wanted(d, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("part", "lineitem"):
        c.execute(f"create view {t} as select * from '{os.path.join(d, t)}.parquet/*.parquet'")
    found = c.execute(ORACLES[name])
    names = [x[0] for x in found.description]
    return names, [tuple(float(x) if isinstance(x, Decimal) else x for x in r) for r in found.fetchall()]


def same(got, want):
    key = lambda r: tuple((x is None, "" if isinstance(x, float) else str(x)) for x in r)
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert [x for x in a if not isinstance(x, float)] == [x for x in b if not isinstance(x, float)]
        assert [x for x in a if isinstance(x, float)] == pytest.approx([x for x in b if isinstance(x, float)], abs=1e-5)


@pytest.mark.parametrize("name", BY_NAME)
def test_no_edges_are_written_out(spark, tables, monkeypatch, name):
    def edges(*_):
        raise AssertionError("edges written out")

    monkeypatch.setattr(graph, "call_edges", edges)
    names, want = wanted(tables, name)
    same([tuple(r) for r in QUERIES[name](spark, tables).select(*names).collect()], want)


def test_ranked_edges_are_not_shuffled(spark, tables):
    names, want = wanted(tables, "rank_edges")
    df = QUERIES["rank_edges"](spark, tables)
    same([tuple(r) for r in df.select(*names).collect()], want)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Exchange" in x and "dst" in x and "src" in x]
