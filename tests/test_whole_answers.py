"""Answers that grow with their tables: symbols of one name, nearest vectors."""

import numpy as np

from tarnlake.operators import indexing, lookup, search, symbols


def test_every_symbol_of_the_very_name_is_found(spark):
    rows = [(k, f"p{k % 4}", "Ring", f"m{k}::Ring", "fn" if k % 2 else "struct", None, None, k, 1) for k in range(90)]
    sym = spark.createDataFrame(rows, "id long, path string, name string, qualified_name string, kind string, signature string, parent_id long, byte_start long, line_start int")
    docs = spark.createDataFrame([], "symbol_id long, doc string")
    got = symbols.find_symbol(sym, docs, "RING", kind="fn").collect()
    assert {r["id"] for r in got} == set(range(1, 90, 2)) and len(got) == 45 and all(r["truncated"] for r in got)


def test_nearest_vectors_without_all_pairs_in_a_join(spark):
    rng = np.random.default_rng(4)
    v = np.round(rng.normal(size=(400, 8)), 2).astype(np.float32)
    v[200:300] = v[:100]  # equal distances, of which the least ids are taken
    v[300] = v[0] + np.float32(1e-9)
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)] + [(400, None)], "id long, embedding array<float>").repartition(3)
    q = df.where("id % 50 = 0 and id < 400").selectExpr("id as query", "embedding as q")
    got = search.knn(df, q, 5)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    w = v.astype(np.float64)
    want = set()
    for k in range(0, 400, 50):
        d = [(round(float(np.sqrt(((w[k] - x) ** 2).sum())), 6), i) for i, x in enumerate(w)]
        want |= {(k, i, x, r + 1) for r, (x, i) in enumerate(sorted(d)[:5])}
    assert {(r["query"], r["id"], r["distance"], r["rank"]) for r in got.collect()} == want
    assert search.knn(df, q.limit(0), 5).count() == 0


def _symbols(spark):
    return spark.createDataFrame([(k, f"p{k % 4}", f"aName_{k % 9}", f"m::aName_{k % 9}", "the the ring the" if k % 2 else None) for k in range(60)], "id long, path string, name string, qualified_name string, doc string").selectExpr("*", "cast(null as string) as signature")


def test_postings_are_counted_by_row(spark):
    got = indexing.postings(_symbols(spark))
    rows = {tuple(r) for r in got.where("id = 1 and field in ('name', 'doc')").collect()}
    terms = ["aname_1", "name_1", "aname", "a", "name", "1"]
    assert {r[2:] for r in rows if r[1] == "doc"} == {("the", 1, 4, 3), ("ring", 1, 4, 1)}
    assert {(r[2], r[3], r[5]) for r in rows if r[1] == "name"} <= {(t, 1, 1) for t in terms} and got.count() == got.distinct().count()
    assert "Aggregate" not in got._jdf.queryExecution().executedPlan().toString()


def test_resolve_sends_no_table_through_the_driver(spark):
    sym = _symbols(spark)
    got = lookup.resolve(sym, sym.selectExpr("upper(name) as wanted").union(sym.select("qualified_name")).distinct())
    assert {(r["wanted"], r["tier"]) for r in got.collect()} == {(f"ANAME_{k}", 4) for k in range(9)} | {(f"m::aName_{k}", 1) for k in range(9)}
    assert "BroadcastExchange" not in got._jdf.queryExecution().executedPlan().toString()
