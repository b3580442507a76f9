import random

import pytest
from pyspark.sql import functions as F

from tarnlake.errors import NotFound
from tarnlake.functions import filters
from tarnlake.functions import text as tx
from tarnlake.operators import graph, incremental, lookup, savings, search
from tarnlake.operators.components import connected_components
from tarnlake.session import shared_folder
from tarnlake.sources.tree import extract_file


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def ids(spark, xs):
    return spark.createDataFrame([(x,) for x in xs], "id long")


def test_paths_and_tiers(spark):
    e = edges(spark, [(1, 2), (2, 3), (3, 4)])
    assert [r["id"] for r in graph.shortest_path(e, ids(spark, [1]), ids(spark, [4])).orderBy("hop").collect()] == [1, 2, 3, 4]
    assert [r["id"] for r in graph.shortest_path(e, ids(spark, [3]), ids(spark, [3])).collect()] == [3]
    assert {(r["depth"], r["id"]) for r in graph.tiers(e, ids(spark, [3]), 2, reverse=True).collect()} == {(1, 2), (2, 1)}
    with pytest.raises(NotFound):
        graph.shortest_path(edges(spark, [(1, 2), (3, 4)]), ids(spark, [1]), ids(spark, [4])).collect()
    diamond = edges(spark, [(1, 2), (1, 3), (2, 4), (3, 4)])
    assert [r["id"] for r in graph.shortest_path(diamond, ids(spark, [1]), ids(spark, [4])).orderBy("hop").collect()] == [1, 2, 4]
    assert [(r["depth"], r["id"]) for r in graph.tiers(edges(spark, [(1, 2), (2, 1)]), ids(spark, [1]), 3).collect()] == [(1, 2)]
    hub = edges(spark, [(k, 0) for k in range(1, 101)])
    assert graph.tiers(hub, ids(spark, [0]), 1, reverse=True, cap=10).count() == 10


def test_components_against_a_plain_union(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(150), rng.randrange(150)) for _ in range(90)] + [(200 + k, 201 + k) for k in range(40)]
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "u long, v long"), shared_folder(spark)).collect()}
    assert got == {x: find(x) for x in root}
    assert connected_components(spark.createDataFrame([], "u long, v long"), shared_folder(spark)).count() == 0
    dense = {r["id"]: r["component"] for r in graph.components(ids(spark, [1, 2, 3, 4, 9]), edges(spark, [(1, 2), (3, 4)])).collect()}
    assert dense == {1: 0, 2: 0, 3: 1, 4: 1, 9: 2}


def test_pagerank(spark):
    w = spark.createDataFrame([(1, 3, 1.0), (2, 3, 1.0), (1, 2, 1.0)], "src long, dst long, weight double")
    r = graph.pagerank(ids(spark, [1, 2, 3]), w)
    scores = {x["id"]: x["score"] for x in r.collect()}
    assert max(scores, key=scores.get) == 3 and abs(sum(scores.values()) - 1) < 1e-9
    p = {x["id"]: x["score"] for x in graph.personalised(ids(spark, [1, 2, 3]), w, ids(spark, [1])).collect()}
    assert p[1] == pytest.approx(0.15)


def test_search(spark):
    c = spark.createDataFrame([("a.rs", "fn hello() {}\nfn world() {}\nfn hello_world() {}\n")], "path string, text string")
    assert [r["line"] for r in search.literal(c, "hello").orderBy("line").collect()] == [1, 3]
    many = spark.createDataFrame([("b", "\n".join(f"fn func_{k}() {{}}" for k in range(100)))], "path string, text string")
    assert search.literal(many, "func", 5).count() == 5
    assert [r["column"] for r in search.regex(c, r"h\w+").orderBy("line").collect()] == [4, 4]
    assert {(r["pattern"], r["line"], r["column"]) for r in search.multi_find(c, ["hello", "world", ""]).collect()} == {("hello", 1, 4), ("world", 2, 4), ("hello", 3, 4), ("world", 3, 10)}
    names = ["validate_email", "send_email", "process_data", "validate_phone"]
    f = search.fuzzy(spark.createDataFrame(list(enumerate(names)), "id long, name string"), "val_eml").collect()
    assert f[0]["name"] == "validate_email"
    v = spark.createDataFrame([(1, [0.1] * 4), (2, [0.9] * 4)], "id long, embedding array<float>")
    assert search.knn(v, spark.createDataFrame([(0, [0.1] * 4)], "query long, q array<float>"), 2).orderBy("rank").first()["id"] == 1
    terms = spark.createDataFrame([("validateEmailAddress",), ("validate_email",)], "s string").select(tx.code_terms(F.col("s")).alias("t")).collect()
    assert {"validateemailaddress", "validate"} <= set(terms[0]["t"]) and "validate_email" in terms[1]["t"]


def test_filters_and_policy(spark):
    f = filters.parse("*.rs type:rust foo status:modified !test /src/ size:>1mb size:<2gb mtime:<2d", now=1000)
    assert (f.extensions, f.types, f.text, f.modified, f.exclude, f.segments, f.min_size, f.max_size, f.max_mtime) == (["rs"], ["rust"], "foo", True, ["test"], ["src"], 1048576, 2147483648, 1000 + 172800)
    assert filters.parse("size:abc").min_size is None
    paths = [".env", ".env.local", "config/.env", "server.pem", "private.key", "id_rsa", ".envrc", "src/main.rs", "README.md", "node_modules/bar.js", "app/bundle.min.js", "proto/types.pb.go", "src/bundle.rs", "src/a/b.rs"]
    p = spark.createDataFrame([(x, 10, 0) for x in paths], "path string, size_bytes long, mtime long")
    assert {r["path"] for r in p.where(tx.sensitive(F.col("path"))).collect()} == set(paths[:6])
    assert {r["path"] for r in p.where(tx.vendored(F.col("path"))).collect()} == set(paths[9:12])
    assert {r["path"] for r in filters.apply(p, "src/*.rs").collect()} == {"src/main.rs", "src/bundle.rs"}
    assert filters.apply(p, "status:modified").count() == 0
    secret = "x = AKIA" + "A" * 16 + " and sk-blue"
    assert spark.createDataFrame([(secret,)], "t string").select(tx.redact(F.col("t"))).first()[0] == "x = ***REDACTED*** and sk-blue"


def test_incremental_and_savings(spark):
    snap = lambda m: spark.createDataFrame(list(m.items()), "path string, hash string")
    diff = lambda a, b: {(r["path"], r["status"]) for r in incremental.snapshot_diff(snap(a), snap(b)).collect()}
    assert diff({"a": "1"}, {"a": "1"}) == set() and diff({"a": "1"}, {"a": "9", "b": "2"}) == {("a", "changed"), ("b", "changed")} and diff({"a": "1", "b": "2"}, {"a": "1"}) == {("b", "deleted")}
    rows = spark.createDataFrame([("2024-01-01", 4, 400, 12000), ("2024-01-01", 2, 100, 10000), ("2024-01-02", 1, 5000, 2500)], "day string, calls long, response long, baseline long").withColumn("day", F.col("day").cast("date"))
    series = savings.daily(rows, "2024-01-01", "2024-01-31")
    assert [r["saved"] for r in series.orderBy("day").collect()] == [21500, 0]
    assert savings.totals(series).first()["saved"] == 21500
    old, new = spark.createDataFrame([("u", 10, 100)], "u string, calls long, saved long"), spark.createDataFrame([("u", 5, 30)], "u string, calls long, saved long")
    assert tuple(savings.max_merge(old, new, ["u"]).first()) == ("u", 10, 100)


def test_symbols_of_sources():
    s = extract_file("m.py", "python", 'class A:\n    def f(self):\n        """Says."""\n        return helper()\n')
    assert [(x.kind, x.qualified, x.doc) for x in s] == [("class", "A", None), ("method", "A::f", "Says.")] and "helper" in s[1].idents and s[1].parent is s[0]
    s = extract_file("l.rs", "rust", "/// Adds.\npub fn add(a: i32) {}\nstruct Config {}\n")
    assert [(x.kind, x.name, x.doc) for x in s] == [("fn", "add", "Adds."), ("struct", "Config", None)]


def test_lookup(spark):
    s = spark.createDataFrame([(1, "a.rs", "Foo", "m::Foo", "struct", None, None, 0, 1), (2, "a.rs", "bar", "m::Foo::bar", "method", None, 1, 5, 2)], "id long, path string, name string, qualified_name string, kind string, signature string, parent_id long, byte_start long, line_start int")
    w = spark.createDataFrame([("FOO",), ("m::foo",), ("bar",)], "wanted string")
    assert {(r["wanted"], r["id"], r["tier"]) for r in lookup.resolve(s, w).collect()} == {("FOO", 1, 4), ("m::foo", 1, 2), ("bar", 2, 3)}
    assert lookup.outline(s).collect()[0]["children"] == "method bar"
    chain = spark.createDataFrame([(k, k - 1 if k else None) for k in range(12)], "id long, parent_id long")
    assert {r["ancestor"] for r in lookup.parent_chain(chain).where("id = 11").collect()} == set(range(11))


def test_streams_equal_batches(spark, tmp_path):
    from tarnlake.streaming import jobs

    rows = [(k % 3, 1e9 + k * 7000) for k in range(60)]  # the epoch itself is where a watermark starts
    b = spark.createDataFrame(rows, "key long, t double").select("key", F.timestamp_seconds("t").alias("ts"))
    b.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(b.schema).parquet(str(tmp_path / "in"))
    q = jobs.credit_once(stream, ["key"], "ts", hours=6).writeStream.format("memory").queryName("credits").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {(r["key"], r["ts"], r["credited"]) for r in savings.credit_once(b, ["key"], "ts", 6).collect()}
    assert {(r["key"], r["ts"], r["credited"]) for r in spark.sql("select * from credits").collect()} == want
    q = jobs.tool_counters(stream.withColumn("v", F.lit(1.0)), "key", "v").writeStream.format("memory").outputMode("complete").queryName("counts").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r["calls"] for r in spark.sql("select * from counts").collect()} == {20}
