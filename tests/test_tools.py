"""Symbol tools, token accounting, accounts, the index and the stream jobs on small tables."""

import os
import subprocess
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnlake.errors import Ambiguous, InvalidParams, NotFound, ResourceExhausted
from tarnlake.functions import text as tx
from tarnlake.operators import accounts, graph, incremental, indexing, lookup, search, symbols, tokens, vectors
from tarnlake.sources.tree import extract, walk
from tarnlake.streaming import jobs

SYM = "id long, path string, name string, qualified_name string, kind string, signature string, parent_id long, byte_start long, line_start int"


@pytest.fixture(scope="module")
def sym(spark):
    rows = [(1, "a.rs", "parseFile", "m::parseFile", "fn", "(x)", None, 0, 1), (2, "a.rs", "Parser", "m::Parser", "struct", None, None, 50, 5), (3, "b.rs", "parse_tree", "n::parse_tree", "fn", None, None, 0, 1), (4, "b.rs", "PARSEFILE", "n::PARSEFILE", "fn", None, 2, 9, 3)]
    return spark.createDataFrame(rows, SYM)


@pytest.fixture(scope="module")
def doc(spark):
    return spark.createDataFrame([(3, "Builds a grove of nodes")], "symbol_id long, doc string")


def test_find_symbol_takes_the_first_tier_with_hits(spark, sym, doc):
    found = lambda name, **k: sorted((r["id"], r["tier"]) for r in symbols.find_symbol(sym, doc, name, **k).collect())
    assert found("parsefile") == [(1, 0), (4, 0)] and found("parsefile", kind="struct") == []
    assert found("grove") == [(3, 1)] and found("file") == [(1, 1)]
    assert found("arse_t") == [(3, 2)]
    nearest = lambda q, k: vectors.semantic(vectors.embed(sym, "name").select("id", "embedding"), spark.createDataFrame([(q,)], "query string"), k)
    assert found("zz") == [] and len(found("zz qq", semantic=nearest)) == 4
    assert symbols.find_symbol(sym, doc, "parsefile", limit=1).first()["truncated"]


def test_one_match(spark, sym):
    assert symbols.one_match(sym, "m::Parser").first()["id"] == 2
    with pytest.raises(NotFound):
        symbols.one_match(sym, "nothing")
    with pytest.raises(Ambiguous):
        symbols.one_match(sym, "parsefile")


def test_caseless_is_ascii(spark):
    s = spark.createDataFrame([(1, "a", "É", "É", "fn", None, None, 0, 1), (2, "a", "é", "é", "fn", None, None, 0, 1)], SYM)
    assert [r["id"] for r in lookup.exact(s, "é").collect()] == [2]


def test_sections_under_budget(spark):
    rows = [(1, "a", 1, 5), (1, "a", 2, 9), (1, "a", 3, 1), (1, "b", 1, 4), (1, "c", 1, 2), (2, "b", 1, 30)]
    got = symbols.sections_under_budget(spark.createDataFrame(rows, "key long, section string, rank int, cost long"), ["a", "b", "c"], 10)
    assert sorted((r["key"], r["section"], r["rank"], r["total"]) for r in got.collect()) == [(1, "a", 1, 5), (1, "b", 1, 9)]


def test_search_edges(spark):
    c = spark.createDataFrame([("p", "aXaXa \t\nünder bar\n")], "path string, text string")
    hits = search.multi_find(c, ["aX", "", "nder", "aX", "."])
    assert sorted((r["pattern"], r["line"], r["column"]) for r in hits.collect()) == [("aX", 1, 1), ("aX", 1, 3), ("nder", 2, 3)]
    assert [r["content"] for r in search.lines(c).orderBy("line").collect()] == ["aXaXa", "ünder bar"]
    assert search.multi_find(c, ["a"], per_pattern=2).count() == 2 and search.multi_find(c, []).count() == 0
    assert search.regex(c, "bar$").count() == 1
    with pytest.raises(InvalidParams):
        search.regex(c, "(")


def test_knn_blocks(spark, monkeypatch):
    v = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(30)], "id long, embedding array<double>")
    q = v.select(F.col("id").alias("query"), F.col("embedding").alias("q"))
    want = sorted(map(tuple, search.knn(v, q, 3).collect()))
    monkeypatch.setattr(search, "KNN_BLOCK", 4)
    assert sorted(map(tuple, search.knn(v, q, 3).collect())) == want


def test_tokens(spark):
    long = "é" * 30_000
    t = spark.createDataFrame([(1, "abcde"), (2, long), (3, None)], "k long, text string")
    got = {r["k"]: (r["read_tokens"], r["n_tokens"]) for r in tokens.count_tokens(tokens.file_baseline(t)).collect()}
    assert got == {1: (2, 2), 2: (8192 * 60_000 // 32_768, 15_000), 3: (None, 0)}
    assert tokens.correction(t.where("false").select(F.lit(1).alias("counted"), F.lit(1).alias("estimated"))).first()["ratio"] == 1.0
    s = spark.createDataFrame([(None, 3), (0, 3), (100, 125), (100, 126)], "stored long, now long")
    assert [r[0] for r in s.select(tokens.stale(F.col("stored"), F.col("now"))).collect()] == [True, True, False, True]


def test_embedding(spark):
    calls = []

    def flaky(texts):
        calls.append(len(texts))
        if len(calls) == 1:
            raise OSError
        return np.ones((len(texts), 2))

    from tarnlake.operators.vectors import hashing_embedder

    assert abs(np.linalg.norm(hashing_embedder(["one two two"])) - 1) < 1e-9 and not hashing_embedder([""]).any()
    t = spark.createDataFrame([("x",), (None,)], "text string").coalesce(1)
    assert [len(r["embedding"]) for r in vectors.embed(t, embedder=flaky).collect()] == [2, 2]
    pieces = spark.createDataFrame([("rust", "fn", "a::b", "(x)", None, "{}")], "l string, k string, q string, s string, d string, b string")
    assert pieces.select(tx.embedding_text(*[F.col(c) for c in "lkqsdb"])).first()[0] == "rust fn a::b((x))\n{}"


def test_accounts(spark):
    d = spark.createDataFrame([("free", 400), ("pro", 400), ("team", None), ("Enterprise", -1), ("x", 5)], "tier string, asked long")
    assert [r[0] for r in d.select(accounts.days_allowed(F.col("tier"), F.col("asked"))).collect()] == [0, 30, 90, 365, 0]
    u = spark.createDataFrame([(1,), (2,)], "user_id long")
    keys = spark.createDataFrame([(10, 1), (11, 2)], "key_id long, user_id long")
    uses = spark.createDataFrame([(10, "a"), (11, "b"), (99, "c")], "key_id long, what string")
    out = accounts.delete_accounts({"users": u, "keys": keys, "uses": uses}, u.where("user_id = 1"), through={"uses": ("keys", "key_id")})
    assert {n: t.count() for n, t in out.items()} == {"users": 1, "keys": 1, "uses": 2}
    c = spark.createDataFrame([(2.0, 0.5), (0.0, 0.5), (-1.0, 0.5), (2e6, None)], "t double, p double")
    assert [r[0] for r in c.select(accounts.saved_cost(F.col("t"), F.col("p"))).collect()] == [1e-06, None, None, None]


def test_policies(spark):
    p = spark.createDataFrame([("src/a.rs",), ("src/x/a.rs",), ("gen/z.rs",), ("gen.rs",), ("b/gen",), ("generic.rs",), ("./out/q",)], "p string")
    got = {r["p"]: r[1] for r in p.select("p", tx.ignored(F.col("p"), ["src/*.rs", "gen", "out/"])).collect()}
    assert got == {"src/a.rs": True, "src/x/a.rs": False, "gen/z.rs": True, "gen.rs": True, "b/gen": True, "generic.rs": False, "./out/q": True}


def test_containment(tmp_path):
    (tmp_path / "root").mkdir()
    (tmp_path / "root/in").symlink_to(tmp_path)
    assert indexing.contained(str(tmp_path / "root"), "a/b").endswith("root/a/b")
    for bad in ("../x", "in/secret", "/etc/passwd"):
        with pytest.raises(InvalidParams):
            indexing.contained(str(tmp_path / "root"), bad)


def test_walk_extract_and_incremental_index(spark, tmp_path):
    root = tmp_path / "tree"
    files = {
        "a.py": 'class Big:\n    """Doc of Big."""\n\n    @cached\n    def size(self):\n        return helper(self)\n\n\ndef helper(x):\n    return x\n',
        "lib.rs": "/// A point.\npub struct Point<T> { x: T }\n\nimpl<T> Point<T> {\n    /// Length.\n    pub fn norm(&self) -> f64 { root(self.x) }\n}\n\nfn root(v: f64) -> f64 { v }\n",
        "web.ts": "export class Box {\n  open(key: string) {\n    return turn(key);\n  }\n}\nexport function turn(k) { return k }\n",
        "m.go": "package m\n\n// Run starts.\nfunc (s *Server) Run() { serve(s) }\n\ntype Server struct {}\n",
        "J.java": "public class J {\n  private int count(int n) {\n    return n;\n  }\n}\n",
        "k.c": "struct node { int v; };\nint add(int a, int b) {\n  return a + b;\n}\n",
        "build/x.py": "def no(): pass\n", "skip/y.py": "def no(): pass\n", "keep.log.py": "def no(): pass\n", ".env": "A=1", "g.py": "# @generated\ndef no(): pass\n", "notes.txt": "no",
    }
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (root / ".gitignore").write_text("skip/\n*.log.py\n# comment\n")
    f = walk(spark, str(root))
    assert sorted(r["path"] for r in f.collect()) == ["J.java", "a.py", "k.c", "lib.rs", "m.go", "web.ts"]
    s = extract(f)
    got = {(r["path"], r["qualified_name"]): r for r in s.collect()}
    kinds = {k: r["kind"] for k, r in got.items()}
    assert kinds["a.py", "Big::size"] == "method" and kinds["lib.rs", "Point::norm"] == "method" and kinds["web.ts", "Box::open"] == "method" and kinds["m.go", "Server::Run"] == "method" and kinds["J.java", "J::count"] == "method"
    assert kinds["lib.rs", "root"] == "fn" and kinds["k.c", "add"] == "fn" and kinds["k.c", "node"] == "struct"
    assert got["lib.rs", "Point"]["doc"] == "A point." and got["lib.rs", "Point::norm"]["doc"] == "Length." and got["m.go", "Server::Run"]["doc"] == "Run starts." and got["a.py", "Big"]["doc"] == "Doc of Big."
    assert got["lib.rs", "Point::norm"]["parent_id"] == got["lib.rs", "Point"]["id"] and got["a.py", "Big::size"]["parent_id"] == got["a.py", "Big"]["id"] and got["m.go", "Server::Run"]["parent_id"] == got["m.go", "Server"]["id"]
    assert "cached" in got["a.py", "Big::size"]["idents"] and "root" in got["lib.rs", "Point::norm"]["idents"]
    body = symbols.bodies(s.select("id", "path", "qualified_name", "byte_start", "byte_end"), f)
    text = {r["qualified_name"]: bytes(r["body"]).decode() for r in body.collect()}
    assert text["root"] == "fn root(v: f64) -> f64 { v }" and text["helper"].startswith("def helper") and text["add"].endswith("}")
    assert got["lib.rs", "root"]["signature"] == "fn root(v: f64) -> f64 { v }" and len(got["lib.rs", "root"]["body_hash"]) == 64
    refs = s.select(F.col("id").alias("src_symbol_id"), F.explode("idents").alias("ident"))
    old = {"files": f.select("path", "hash"), "symbols": s.select("id", "path", "qualified_name"), "refs": refs}
    old = {k: spark.createDataFrame(t.collect(), t.schema) for k, t in old.items()}
    (root / "a.py").write_text("def other():\n    return 1\n")
    (root / "k.c").unlink()
    f2 = walk(spark, str(root))
    s2 = extract(f2)
    new = indexing.incremental(old, {"files": f2.select("path", "hash"), "symbols": s2.select("id", "path", "qualified_name"), "refs": s2.select(F.col("id").alias("src_symbol_id"), F.explode("idents").alias("ident"))})
    whole = sorted((r["path"], r["qualified_name"]) for r in s2.collect())
    assert sorted((r["path"], r["qualified_name"]) for r in new["symbols"].collect()) == whole and ("a.py", "other") in whole
    assert {r["path"] for r in new["files"].collect()} == {p for p, _ in whole}
    assert new["refs"].join(new["symbols"].select(F.col("id").alias("src_symbol_id")), "src_symbol_id", "left_anti").count() == 0


def test_git_status(spark, tmp_path):
    def git(*a):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)

    git("init", "-q")
    for n in "abc":
        (tmp_path / n).write_text(f"{n}\n" * 20)
    git("add", ".")
    git("commit", "-qm", "one")
    first = subprocess.run(["git", "-C", str(tmp_path), "rev-parse", "HEAD"], capture_output=True, text=True).stdout.strip()
    git("mv", "a", "z")
    git("rm", "-q", "b")
    git("commit", "-qm", "two")
    (tmp_path / "c").write_text("changed\n")
    (tmp_path / "new").write_text("x")
    modified, dead = indexing.changed_by_git(indexing.git_status(spark, str(tmp_path), first))
    assert {r["path"] for r in modified.collect()} == {"z", "c", "new"} and {r["path"] for r in dead.collect()} == {"a", "b"}


def test_visit_cap(spark):
    e = spark.createDataFrame([(0, k) for k in range(1, 40)], "src long, dst long")
    with pytest.raises(ResourceExhausted):
        graph.tiers(e, spark.createDataFrame([(0,)], "id long"), 2, visits=20)


def test_keep_latest_and_nth(spark):
    r = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (2, 1, "c")], "k long, at long, v string")
    assert {x["v"] for x in incremental.keep_latest(r, ["k"], "at").collect()} == {"b", "c"}


def run_stream(spark, tmp_path, rows, schema, build, mode="append", batches=1):
    """The rows of a stream over files, one file a batch."""
    at = tmp_path / "in"
    for k in range(batches):
        spark.createDataFrame(rows[k::batches] if batches == 1 else rows[k], schema).coalesce(1).write.mode("append").parquet(str(at / f"b{k}"))
    got = []
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(at))
    q = build(stream).writeStream.outputMode(mode).foreachBatch(lambda d, _: got.extend(d.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return got


T0 = datetime(2024, 1, 1)
EVENT = "key string, tool string, ts timestamp"


def test_stream_debounce(spark, tmp_path):
    rows = [("a", "t", T0 + timedelta(milliseconds=m)) for m in (0, 100, 300, 900)] + [("b", "t", T0), ("late", "t", T0 + timedelta(hours=1))]
    got = run_stream(spark, tmp_path, rows, EVENT, lambda s: jobs.debounce(s, "key", "ts"))
    assert sorted((r["key"], r["n"]) for r in got if r["key"] != "late") == [("a", 1), ("a", 3), ("b", 1)]


def test_stream_rollup_and_gate(spark, tmp_path):
    rows = [("a", "t", T0), ("a", "t", T0 + timedelta(hours=2)), ("a", "u", T0 + timedelta(days=1)), ("z", "t", T0 + timedelta(days=9))]
    got = run_stream(spark, tmp_path / "1", rows, EVENT, lambda s: jobs.daily_rollup(s, "ts", "key"))
    assert sorted((str(r["day"]), r["calls"]) for r in got if r["key"] == "a") == [("2024-01-01", 2), ("2024-01-02", 1)]
    got = run_stream(spark, tmp_path / "2", rows, EVENT, lambda s: jobs.first_only(s, "key", "ts"))
    assert sorted(r["key"] for r in got) == ["a", "z"]


def test_stream_credit(spark, tmp_path):
    rows = [("a", "t", T0 + timedelta(hours=h)) for h in (0, 20, 40, 70)]
    got = run_stream(spark, tmp_path, rows, EVENT, lambda s: jobs.credit_once(s, ["key", "tool"], "ts"))
    assert [r["credited"] for r in sorted(got, key=lambda r: r["ts"])] == [True, False, False, True]


def test_stream_apply(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(k,)], "x long").coalesce(1).write.parquet(str(tmp_path / f"in/b{k}"))
    seen = []
    jobs.apply_batches(jobs.source(spark, str(tmp_path / "in"), "x long", files=1), lambda d, _: seen.append(d.count()), str(tmp_path / "ck")).awaitTermination(120)
    assert sum(seen) == 3 and max(seen) == 1 and os.path.isdir(tmp_path / "ck")


def test_config(tmp_path):
    from tarnlake import config

    (tmp_path / "a.toml").write_text('max_results = 5\nignore = ["x"]\n')
    c = config.load(str(tmp_path / "a.toml"))
    assert (c.max_results, c.ignore, c.map_tokens) == (5, ("x",), 2000)
    for bad in ("max_results = 'a'", "other = 1", "x ="):
        (tmp_path / "b.toml").write_text(bad)
        with pytest.raises(InvalidParams):
            config.load(str(tmp_path / "b.toml"))


def test_sinks(spark, tmp_path):
    from tarnlake import sinks

    r = spark.createDataFrame([(1, None, [], "a\tb\\"), (2, 0.5, [3], "é\n")], "k long, x double, l array<long>, t string")
    assert [x["value"] for x in sinks.json_lines(r).collect()] == ['{"k":1,"t":"a\\tb\\\\"}', '{"k":2,"x":0.5,"l":[3],"t":"é\\n"}']
    assert [x["value"] for x in sinks.tsv_lines(r.drop("l")).collect()] == ["1\t\ta\\tb\\\\", "2\t0.5\té\\n"]
    sinks.write_lines(sinks.tsv_lines(r.select("k")), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 2


def test_snapshots_and_postings(spark, sym, doc, tmp_path):
    at = str(tmp_path / "snap")
    indexing.save_snapshot({"symbols": sym, "docs": doc}, at, 1)
    pinned = indexing.open_snapshot(spark, at)
    indexing.save_snapshot({"symbols": sym.where("id = 1"), "docs": doc}, at, 2)
    assert pinned["symbols"].count() == 4 and indexing.open_snapshot(spark, at)["symbols"].count() == 1 and indexing.open_snapshot(spark, at, 1)["docs"].count() == 1
    with pytest.raises(InvalidParams):
        indexing.open_snapshot(spark, at, 9)
    long = spark.createDataFrame([(1, "a", "é" * 40_000, "q", None, None)], "id long, path string, name string, qualified_name string, signature string, doc string")
    assert {len(r["term"]) for r in indexing.postings(long).where("field = 'name'").collect()} == {30_000}
