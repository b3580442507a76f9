"""Queries of the reference's operators, bound to the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import filters
from ..functions import text as tx
from ..operators import graph, incremental, lookup, savings, search
from ..session import cut
from ..sources import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_SYM = "symbols AS (SELECT p_partkey AS id, p_brand AS path, replace(p_name,' ','_')||'_'||p_brand AS name, p_type||'::'||replace(p_name,' ','_')||'_'||p_brand AS qualified_name, p_type AS kind, CASE WHEN p_partkey % 3 = 0 THEN p_partkey - 1 END AS parent_id, p_partkey AS byte_start, p_size AS line_start FROM part)"
_LEAD = "nx AS (SELECT *, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS next_part FROM lineitem)"
_REFS = f"{_SYM}, {_LEAD}, refs AS (SELECT l_partkey AS src_symbol_id, name AS ident FROM nx JOIN symbols ON next_part = id)"
_EDGES = ", edges AS (SELECT src_symbol_id AS src, id AS dst FROM refs JOIN symbols ON ident = name WHERE src_symbol_id <> id)"
_CONT = "contents AS (SELECT source||'/'||lang||'/'||doc_id AS path, text, lang, doc_id FROM documents)"
_LINES = f"{_CONT}, lines AS (SELECT path, unnest(range(1, len(l) + 1)) AS line, rtrim(unnest(l), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS content FROM (SELECT path, string_split(CASE WHEN text LIKE '%' || chr(10) THEN text[:-2] ELSE text END, chr(10)) AS l FROM contents))"
NEEDLE, PATTERN, MANY = "the", r"[A-Za-z]+ing\b", ["tion", "license", "und", "que"]


def _pick(values, key: str = "doc_id"):
    """One of the values by the key."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(F.col(key), F.lit(len(values))) + 1).cast("int"))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# Text scans
@query(f"WITH {_LINES} SELECT path, line, content, ceil(strlen(content) / 4)::BIGINT AS tokens FROM lines WHERE contains(content, '{NEEDLE}')")
def literal_search(s, d):
    h = search.literal(T.contents(s, d), NEEDLE)
    return h.select("path", "line", "content", tx.estimate_tokens(F.col("content")).alias("tokens"))


@query(f"WITH {_LINES} SELECT path, line, content FROM lines WHERE contains(content, '{NEEDLE}') ORDER BY path, line LIMIT 30")
def literal_search_top(s, d):
    return search.literal(T.contents(s, d), NEEDLE, 30)


@query(rf"WITH {_LINES} SELECT path, line, content, (length(string_split(regexp_replace(content, '[A-Za-z]+ing\b', chr(1)), chr(1))[1]) + 1)::INT AS column FROM lines WHERE regexp_matches(content, '[A-Za-z]+ing\b')".replace("AS column", 'AS "column"'))
def regex_search(s, d):
    return search.regex(T.contents(s, d), PATTERN)


@query(f"""WITH {_LINES}, p AS (SELECT unnest({MANY!r}) AS pattern), h AS (SELECT pattern, path, line, content, string_split(content, pattern) AS parts FROM lines JOIN p ON contains(content, pattern)),
o AS (SELECT *, unnest(range(1, len(parts))) AS k FROM h) SELECT pattern, path, line, content, (list_sum(list_transform(parts[1:k], lambda x: strlen(x))) + (k - 1) * strlen(pattern) + 1)::INT AS "column" FROM o""")
def multi_find(s, d):
    return search.multi_find(T.contents(s, d), MANY)


@query(f"WITH {_LINES} SELECT count(*) AS hits, least(coalesce(sum(ceil(strlen(content) / 4)), 0), 1000000)::BIGINT AS tokens FROM lines WHERE contains(content, '{NEEDLE}')")
def measured_scan(s, d):
    return search.measured_scan(T.contents(s, d), NEEDLE)


@query(f"""WITH {_LINES}, h AS (SELECT *, string_split(content, '{NEEDLE}')[1] AS b FROM lines WHERE contains(content, '{NEEDLE}'))
SELECT path, line, CASE WHEN regexp_matches(ltrim(content), '^(//|/\\*|\\*|--|#([^\\[!]|$))') OR (contains(b, '//') AND (length(string_split(b, '//')[1]) - length(replace(string_split(b, '//')[1], '"', ''))) % 2 = 0) THEN 'comment'
WHEN (length(b) - length(replace(b, '"', ''))) % 2 = 1 OR (length(b) - length(replace(b, '''', ''))) % 2 = 1 OR (length(b) - length(replace(b, '`', ''))) % 2 = 1 THEN 'literal' ELSE 'neither' END AS kind FROM h""")
def classify_hits(s, d):
    return search.find_strings(T.contents(s, d), NEEDLE).select("path", "line", "kind")


@query("SELECT doc_id, ceil(strlen(text) / 4)::BIGINT AS tokens FROM documents")
def token_estimate(s, d):
    return T.contents(s, d).select("doc_id", tx.estimate_tokens(F.col("text")).alias("tokens"))


@query(f"WITH {_SYM} SELECT id, name FROM symbols WHERE contains(lower(name), 'brand#1') OR contains(lower(qualified_name), 'brand#1')")
def trigram_match(s, d):
    return search.trigram(T.symbols(s, d), "BRAND#1", "name", "qualified_name").select("id", "name")


@query(f"WITH {_LINES} SELECT path, count(*) AS n FROM lines WHERE regexp_matches(content, '(^|[^A-Za-z0-9_]){NEEDLE}($|[^A-Za-z0-9_])') GROUP BY path")
def word_boundary(s, d):
    return search.lines(T.contents(s, d)).where(tx.word_match(F.col("content"), NEEDLE)).groupBy("path").agg(F.count(F.lit(1)).alias("n"))


_BM = """, t AS (SELECT id, unnest(terms) AS term, len(terms)::DOUBLE AS len FROM d), st AS (SELECT count(*)::DOUBLE AS n, avg(len(terms)) AS a FROM d),
q AS (SELECT * FROM (VALUES ('q1', 'the'), ('q1', 'from'), ('q2', 'que'), ('q2', 'une')) v(query, term)),
p AS (SELECT term, id, len, count(*)::DOUBLE AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
sc AS (SELECT query, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a))), 6) AS score FROM p JOIN f USING (term) JOIN q USING (term), st GROUP BY 1, 2),
bm AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id)::INT AS rank FROM sc QUALIFY rank <= 10)"""
_TERMS = "d AS (SELECT doc_id AS id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS terms FROM documents)"


def _bm25(s, d):
    terms = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    q = s.createDataFrame([("q1", "the"), ("q1", "from"), ("q2", "que"), ("q2", "une")], "query string, term string")
    return search.bm25(T.read(s, d, "documents").select(F.col("doc_id").alias("id"), "text"), q, {"text": terms})


@query(f"WITH {_TERMS}{_BM} SELECT * FROM bm")
def bm25_topk(s, d):
    return _bm25(s, d).select("query", "id", "score", "rank")


@query(f"""WITH {_TERMS}{_BM}, {_LINES}, l AS (SELECT path, row_number() OVER (ORDER BY hits DESC, path) AS rank FROM (SELECT path, count(*) AS hits FROM lines WHERE contains(content, 'the') GROUP BY 1 ORDER BY hits DESC, path LIMIT 30)),
u AS (SELECT path AS key, 1.0 / (60 + rank) AS s FROM bm JOIN contents ON id = doc_id WHERE query = 'q1' UNION ALL SELECT path AS key, 1.0 / (60 + rank) AS s FROM l)
SELECT key, round(sum(s), 9) AS score FROM u GROUP BY 1 ORDER BY score DESC, key LIMIT 20""")
def rrf_hybrid(s, d):
    c = T.contents(s, d)
    a = _bm25(s, d).where("query = 'q1'").join(c.select("doc_id", "path"), F.col("id") == F.col("doc_id")).select(F.col("path").alias("k"), "rank")
    b = search.literal(c, "the").groupBy("path").agg(F.count(F.lit(1)).alias("hits")).orderBy(F.col("hits").desc(), "path").limit(30)
    b = b.select(F.col("path").alias("k"), F.row_number().over(Window.orderBy(F.col("hits").desc(), "path")).alias("rank"))
    return search.rrf([a, b], "k")


def _knn(s, d, where=""):
    v = T.read(s, d, "embeddings")
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"), F.col("label").alias("ql"))
    v = v.where(where) if where else v
    return search.knn(v, q.select("query", "q"), 5, "vec_id")


def _knn_sql(where=""):
    return f"""SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, id)::INT AS rank FROM (SELECT q.vec_id AS query, v.vec_id AS id,
round(sqrt(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))), 6) AS distance FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0 {where}) QUALIFY rank <= 5"""


@query(_knn_sql())
def knn_l2(s, d):
    return _knn(s, d)


@query(_knn_sql("AND v.label = 3"))
def knn_filtered(s, d):
    return _knn(s, d, "label = 3")


@query()
def fuzzy_rank(s, d):
    return search.fuzzy(T.symbols(s, d), "wdgbrnd").select("id", "name", "score")


# Paths and content policy
@query("SELECT path, CASE WHEN ext IN ('html') THEN 'web' ELSE 'unknown' END = 'web' AS web, ext FROM (SELECT url AS path, regexp_extract(url, '\\.([^./]+)$', 1) AS ext FROM pages)")
def path_extension(s, d):
    return T.read(s, d, "pages").select(F.col("url").alias("path"), (tx.extension(F.col("url")) == "html").alias("web"), tx.extension(F.col("url")).alias("ext"))


_PARTS = ("node_modules/", "a/target/", "dist/", "src/", ".venv/lib/", "b/vendored/", "third_party/", "x/.git/")


def _in_parts(key: str):
    """A path whose first part is one of _PARTS by the key, so that both outcomes occur."""
    return F.concat(_pick(_PARTS, key), F.col(key).cast("string"), F.when(F.col(key) % 5 == 0, ".min.js").otherwise(".js"))


@query(f"""SELECT page_id, regexp_matches('/' || ({list(_PARTS)!r})[page_id % 8 + 1] || page_id || CASE WHEN page_id % 5 = 0 THEN '.min.js' ELSE '.js' END,
'/(node_modules|target|dist|build|\\.next|\\.venv|__pycache__|vendor|third_party|generated|\\.git)/|\\.min\\.js|\\.bundle\\.js|\\.pb\\.go|\\.generated\\.') AS vendored FROM pages""")
def vendored_filter(s, d):
    return T.read(s, d, "pages").select("page_id", tx.vendored(_in_parts("page_id")).alias("vendored"))


_MARKED = "CASE doc_id % 6 WHEN 0 THEN '// Code generated by x' || chr(10) WHEN 1 THEN repeat('a' || chr(10), 7) || '# DO NOT EDIT' || chr(10) WHEN 2 THEN repeat('a' || chr(10), 8) || '@generated' || chr(10) ELSE '' END || text"


def _marked():
    """Texts with a marker in the first, the eighth or (too late) the ninth line."""
    k = F.pmod("doc_id", F.lit(6))
    return F.concat(F.when(k == 0, "// Code generated by x\n").when(k == 1, "a\n" * 7 + "# DO NOT EDIT\n").when(k == 2, "a\n" * 8 + "@generated\n").otherwise(""), F.col("text"))


@query(f"SELECT doc_id, regexp_matches(array_to_string(string_split({_MARKED}, chr(10))[1:8], chr(10)), 'Code generated by|@generated|DO NOT EDIT|AUTO-GENERATED|This file is automatically generated') AS generated FROM documents")
def generated_filter(s, d):
    return T.contents(s, d).select("doc_id", tx.generated(_marked()).alias("generated"))


_LEAVES = ("main.rs", ".env", ".env.local/x.txt", "id_rsa", "id_rsa.pub", "environment", "a.pem/leaf.json", "b.key", "key", "credentials.json", "pemx.rs", ".netrc")


@query(f"""WITH {_CONT} SELECT doc_id, regexp_matches(path || '/' || ({list(_LEAVES)!r})[doc_id % 12 + 1], '(^|/)(\\.env|id_rsa|id_dsa|id_ecdsa|id_ed25519|credentials|\\.netrc)(\\.[^/]*)?(/|$)|\\.(pem|key|p12|pfx|jks)(/|$)') AS blocked FROM contents""")
def path_block(s, d):
    return T.contents(s, d).select("doc_id", tx.sensitive(F.concat("path", F.lit("/"), _pick(_LEAVES))).alias("blocked"))


#: One of the secret kinds, or a near miss, on a line of its own before each text.
_PLANTED = ("AKIA" + "A1" * 9, "ghp_" + "x" * 36, "ghp_" + "x" * 35, "sk-" + "proj-" + "y" * 40, "sk-short", "github_pat_" + "z" * 29 + ",rest", "xapp-" + "1-" * 20, "aws_secret_access_key=abc def", "xoxa-" + "q" * 50, "-----BEGIN EC PRIVATE" + " KEY-----\nabc\n-----END EC PRIVATE" + " KEY-----")


@query(f"""SELECT doc_id, sha256(regexp_replace(({[p for p in _PLANTED]!r})[doc_id % 10 + 1] || chr(10) || text, '{tx.SECRETS.replace("'", "''")}', '***REDACTED***', 'g')) AS digest FROM documents""".replace(r"KEY-----\nabc\n-----", "KEY-----' || chr(10) || 'abc' || chr(10) || '-----"))
def redact(s, d):  # every document, with every pattern
    return T.contents(s, d).select("doc_id", F.sha2(tx.redact(F.concat(_pick(_PLANTED), F.lit("\n"), "text")), 256).alias("digest"))


@query(f"WITH {_CONT} SELECT path, strlen(text)::BIGINT AS size_bytes FROM contents WHERE contains(path, '/en/') AND NOT contains(path, 'src1') AND strlen(text) >= 1024")
def filter_dsl(s, d):
    return filters.apply(T.files(s, d), "/en/ !src1 size:>1kb").select("path", "size_bytes")


# Lookup
@query(f"WITH {_SYM}, w AS (SELECT name FROM symbols WHERE id = 7) SELECT id, path, symbols.name FROM symbols JOIN w ON lower(symbols.name) = lower(w.name)")
def find_exact_nocase(s, d):
    sym = T.symbols(s, d)
    return lookup.exact(sym, sym.where("id = 7").first()["name"].upper()).select("id", "path", "name")


@query(f"""WITH {_SYM}, w AS (SELECT DISTINCT upper(name) AS wanted FROM symbols UNION SELECT qualified_name FROM symbols),
e AS (SELECT wanted, id, CASE WHEN qualified_name = wanted THEN 1 WHEN lower(qualified_name) = lower(wanted) THEN 2 WHEN name = wanted THEN 3 ELSE 4 END AS tier FROM w JOIN symbols ON lower(wanted) IN (lower(name), lower(qualified_name)))
SELECT wanted, id, tier FROM e QUALIFY tier = min(tier) OVER (PARTITION BY wanted)""")
def resolve_tiers(s, d):
    sym = T.symbols(s, d)
    w = sym.select(F.upper("name").alias("wanted")).union(sym.select("qualified_name")).distinct()
    return lookup.resolve(sym, w)


@query(f"""WITH {_SYM}, f AS (SELECT DISTINCT path FROM symbols) SELECT f.path, count(id) AS n_symbols,
coalesce(array_to_string((list(kind || ' ' || name ORDER BY byte_start) FILTER (parent_id IS NULL))[1:3], ', '), '') AS tops FROM f LEFT JOIN symbols USING (path) GROUP BY 1""")
def file_summaries(s, d):
    sym = T.symbols(s, d)
    return lookup.file_summaries(sym.select("path").distinct(), sym)


@query(f"""WITH {_SYM}, c AS (SELECT parent_id, string_agg(kind || ' ' || name, ', ' ORDER BY byte_start, id) AS children FROM symbols WHERE parent_id IS NOT NULL GROUP BY 1)
SELECT path, id, kind || ' ' || name AS entry, coalesce(children, '') AS children FROM symbols LEFT JOIN c ON c.parent_id = id WHERE symbols.parent_id IS NULL""")
def outline(s, d):
    return lookup.outline(T.symbols(s, d))


@query(f"WITH {_SYM} SELECT path, sha256(string_agg((CASE WHEN parent_id IS NULL THEN '' ELSE '  ' END) || kind || ' ' || name || ' {{ ... }}', chr(10) ORDER BY byte_start, id)) AS digest FROM symbols GROUP BY 1")
def skeleton(s, d):
    return lookup.skeleton(T.symbols(s, d)).select("path", F.sha2("content", 256).alias("digest"))


@query(f"WITH {_REFS} SELECT ident, path AS at_path, line_start, qualified_name AS enclosing, id FROM refs JOIN symbols ON src_symbol_id = id")
def find_refs(s, d):
    return lookup.find_refs(T.refs(s, d), T.symbols(s, d))


@query(f"WITH {_REFS} SELECT src_symbol_id AS src, count(*) AS n FROM refs WHERE ident NOT IN (SELECT name FROM symbols WHERE contains(path, '#1')) GROUP BY 1")
def unresolved_refs(s, d):
    return graph.unresolved(T.refs(s, d), T.symbols(s, d).where("contains(path, '#1')"))


@query("""WITH RECURSIVE p AS (SELECT conv_id * 1000 + turn AS id, conv_id * 1000 + turn - 1 AS ancestor, 1 AS up FROM conversations WHERE turn > 0
UNION ALL SELECT p.id, p.ancestor - 1, up + 1 FROM p WHERE p.ancestor % 1000 > 0) SELECT DISTINCT id, ancestor, up FROM p""")
def parent_chain(s, d):
    c = T.read(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.when(F.col("turn") > 0, F.col("conv_id") * 1000 + F.col("turn") - 1).alias("parent_id")).distinct()
    return lookup.parent_chain(c)


# Graph
@query(f"WITH {_REFS}{_EDGES} SELECT src, dst FROM edges")
def call_edges(s, d):
    return graph.call_edges(T.refs(s, d), T.symbols(s, d))


@query(f"WITH {_REFS}{_EDGES}, g AS (SELECT id, sum(i)::BIGINT AS indeg, sum(o)::BIGINT AS outdeg FROM (SELECT src AS id, 0 AS i, 1 AS o FROM edges UNION ALL SELECT dst, 1, 0 FROM edges) GROUP BY 1) SELECT * FROM g ORDER BY indeg DESC, id LIMIT 20")
def degree_topn(s, d):
    return graph.degrees(graph.by_name(T.refs(s, d), T.symbols(s, d))).orderBy(F.col("indeg").desc(), "id").limit(20)


def _tiers_sql(depth: int, a: str, b: str, seeds: str) -> str:
    q = f"WITH {_REFS}{_EDGES}, e AS MATERIALIZED (SELECT DISTINCT {a} AS a, {b} AS b FROM edges), t0 AS MATERIALIZED (SELECT DISTINCT id AS seed, id, 0 AS depth FROM symbols WHERE {seeds})"
    for k in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT seed, id FROM t{j}" for j in range(k))
        q += f", t{k} AS MATERIALIZED (SELECT seed, id, {k} AS depth FROM (SELECT DISTINCT seed, b AS id FROM t{k - 1} JOIN e ON id = a) x WHERE NOT EXISTS (SELECT 1 FROM ({seen}) y WHERE y.seed = x.seed AND y.id = x.id) QUALIFY row_number() OVER (PARTITION BY seed ORDER BY id) <= 50)"
    return q + " SELECT * FROM (" + " UNION ALL ".join(f"SELECT seed, depth, id FROM t{k}" for k in range(1, depth + 1)) + ")"


@query(_tiers_sql(3, "dst", "src", "id % 50 = 0"))
def callers_tiers(s, d):
    return graph.tiers(graph.by_name(T.refs(s, d), T.symbols(s, d)), T.symbols(s, d).where("id % 50 = 0").select("id"), 3, reverse=True)


@query(_tiers_sql(3, "src", "dst", "id % 50 = 0"))
def callees_tiers(s, d):
    return graph.tiers(graph.by_name(T.refs(s, d), T.symbols(s, d)), T.symbols(s, d).where("id % 50 = 0").select("id"), 3)


@query(_tiers_sql(4, "dst", "src", "id % 50 = 0").replace("SELECT * FROM (", "SELECT seed, depth, x.id, x.id % 7 IN (0, 1, 2) OR x.id % 11 = 0 AS is_test FROM (", 1).rstrip() + " x")
def impact(s, d):
    sym = T.symbols(s, d)
    t = graph.tiers(graph.by_name(T.refs(s, d), sym), sym.where("id % 50 = 0").select("id"), 4, reverse=True)
    k = F.col("id") % 7
    scope = F.when(k == 0, F.concat(F.lit("tests::"), "qualified_name")).when(k == 1, F.concat(F.lit("a::tests::"), "name")).when(k == 2, "a::tests").when(k == 3, F.concat(F.lit("contests::"), "name")).otherwise(F.col("qualified_name"))
    named = F.when(F.col("id") % 11 == 0, F.concat(F.lit("test_"), "name")).otherwise(F.col("name"))
    return t.join(sym.select("id", tx.test_scope(named, scope).alias("is_test")), "id").select("seed", "depth", "id", "is_test")


def _components_sql(rounds: int = 12) -> str:
    """Smallest labels spread along edges; twelve rounds are more than the graph is wide."""
    q = f"WITH {_REFS}{_EDGES}, b AS MATERIALIZED (SELECT DISTINCT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges), m0 AS (SELECT id, id AS low FROM symbols)"
    for k in range(1, rounds + 1):
        q += f", m{k} AS MATERIALIZED (SELECT m.id, least(m.low, coalesce(min(n.low), m.low)) AS low FROM m{k - 1} m LEFT JOIN b ON a = m.id LEFT JOIN m{k - 1} n ON n.id = b GROUP BY m.id, m.low)"
    return q + f", comp AS (SELECT id, dense_rank() OVER (ORDER BY low) - 1 AS component FROM m{rounds})"


_COMP = _components_sql()


@query(_COMP + " SELECT id, component FROM comp")
def components(s, d):
    sym = T.symbols(s, d)
    return graph.components(sym, graph.by_name(T.refs(s, d), sym))


@query(f"WITH {_REFS}{_EDGES}, f AS (SELECT name, count(*) AS fan FROM symbols GROUP BY 1) SELECT src, dst, round(sum((CASE WHEN strlen(name) > 8 THEN 10.0 ELSE 1.0 END) * (CASE WHEN fan > 5 THEN 0.1 ELSE 1.0 END)), 6) AS weight FROM (SELECT src_symbol_id AS src, id AS dst, name FROM refs JOIN symbols ON ident = name WHERE src_symbol_id <> id) JOIN f USING (name) GROUP BY 1, 2")
def rank_edges(s, d):
    return graph.rank_edges(T.refs(s, d), T.symbols(s, d)).withColumn("weight", F.round("weight", 6))


def _pagerank_sql(rounds: int = 15) -> str:
    """Rounds in a row; once one moves less than 1e-6 in all, later ones copy it."""
    q = f"WITH {_REFS}{_EDGES}, w AS (SELECT src, dst, count(*)::DOUBLE AS w FROM edges GROUP BY 1, 2), e AS MATERIALIZED (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS share FROM w), n AS (SELECT count(*)::DOUBLE AS n FROM symbols), r0 AS MATERIALIZED (SELECT id, id NOT IN (SELECT src FROM e) AS dangling, 1 / n AS score FROM symbols, n), f0 AS (SELECT false AS done)"
    for k in range(1, rounds + 1):
        j = k - 1
        new = f"0.15 / n + 0.85 * coalesce((SELECT sum(score) FROM r{j} WHERE dangling), 0) / n + 0.85 * coalesce(got, 0)"
        q += f", r{k} AS MATERIALIZED (SELECT id, dangling, CASE WHEN (SELECT done FROM f{j}) THEN score ELSE {new} END AS score FROM (SELECT * FROM r{j}, n) LEFT JOIN (SELECT dst, sum(score * share) AS got FROM r{j} JOIN e ON id = src GROUP BY 1) g ON g.dst = id)"
        q += f", f{k} AS MATERIALIZED (SELECT (SELECT done FROM f{j}) OR (SELECT sum(abs(a.score - b.score)) FROM r{k} a JOIN r{j} b USING (id)) < 1e-6 AS done)"
    return q + f", pr AS (SELECT id, score FROM r{rounds})"


@query(_pagerank_sql() + " SELECT id, round(score, 9) AS score FROM pr")
def pagerank_global(s, d):
    sym = T.symbols(s, d)
    return graph.pagerank(sym, graph.by_name(T.refs(s, d), sym)).select("id", F.round("score", 9).alias("score"))


def _ppr_sql(rounds: int = 70) -> str:
    """Synchronous pushes in a row; those after the last residual above 1e-6 change nothing."""
    q = f"WITH {_REFS}{_EDGES}, w AS (SELECT src, dst, count(*)::DOUBLE AS w FROM edges GROUP BY 1, 2), e AS MATERIALIZED (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS share FROM w), s0 AS MATERIALIZED (SELECT id, 0.0::DOUBLE AS score, CASE WHEN path = 'Brand#11' THEN 1.0::DOUBLE / (SELECT count(*) FROM symbols WHERE path = 'Brand#11') ELSE 0.0 END AS r FROM symbols)"
    for k in range(1, rounds + 1):
        q += f", s{k} AS MATERIALIZED (SELECT id, score + CASE WHEN r > 1e-6 THEN r * 0.15 ELSE 0 END AS score, CASE WHEN r > 1e-6 THEN 0 ELSE r END + coalesce(got, 0) AS r FROM s{k - 1} LEFT JOIN (SELECT dst, sum(r * share * 0.85) AS got FROM s{k - 1} JOIN e ON id = src WHERE r > 1e-6 GROUP BY 1) g ON g.dst = id)"
    return q + f" SELECT id, round(score, 9) AS score FROM s{rounds} WHERE score > 0"


@query(_ppr_sql())
def ppr_focus(s, d):
    sym = T.symbols(s, d)
    return graph.personalised(sym, graph.by_name(T.refs(s, d), sym), sym.where("path = 'Brand#11'").select("id")).select("id", F.round("score", 9).alias("score"))


_BOOSTED = ", g AS (SELECT dst AS id, count(*) AS deg FROM edges GROUP BY 1), boosted AS (SELECT id, path, name, round(score * sqrt(coalesce(deg, 0) + 1.0) * CASE WHEN id % 7 = 0 THEN 0.1 ELSE 1.0 END, 9) AS score FROM pr JOIN symbols USING (id) LEFT JOIN g USING (id) WHERE parent_id IS NULL)"


def _boosted(s, d):
    sym = T.symbols(s, d)
    e = graph.by_name(T.refs(s, d), sym)
    scores = graph.pagerank(sym, e)
    scoped = F.when(F.col("id") % 7 == 0, F.concat(F.lit("tests::"), "name")).otherwise(F.col("qualified_name"))
    return graph.boosted(scores, sym, graph.degrees(e), tx.test_scope(F.col("name"), scoped)).withColumn("score", F.round("score", 9))


@query(_pagerank_sql() + _BOOSTED + " SELECT id, score FROM boosted")
def boosted_scores(s, d):
    return _boosted(s, d).select("id", "score")


@query(_pagerank_sql() + _BOOSTED + """, c AS (SELECT *, (ceil(strlen(path || ':' || name) / 4))::BIGINT AS cost FROM boosted)
SELECT id, score, spent FROM (SELECT *, sum(cost) OVER (ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING)::BIGINT AS spent FROM c) WHERE spent <= 2000""")
def repo_map_budget(s, d):
    line = F.concat("path", F.lit(":"), "name")
    return graph.under_budget(_boosted(s, d), tx.estimate_tokens(line), [F.col("score").desc(), F.col("id")], 2000).select("id", "score", "spent")


@query(_COMP + """, dg AS (SELECT id, count(*) AS deg FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1),
m AS (SELECT component, symbols.id, name, path, parent_id IS NULL AS top, CASE WHEN parent_id IS NULL THEN coalesce(deg, 0) ELSE 0 END AS deg FROM comp JOIN symbols USING (id) LEFT JOIN dg USING (id)),
h AS (SELECT component, count(*) OVER (PARTITION BY component) AS size, name AS hub FROM m QUALIFY row_number() OVER (PARTITION BY component ORDER BY top DESC, deg DESC, id) = 1),
dr AS (SELECT component, path AS dir FROM m GROUP BY component, path QUALIFY row_number() OVER (PARTITION BY component ORDER BY count(*) DESC, path) = 1)
SELECT component, size, hub, dir FROM h JOIN dr USING (component) ORDER BY size DESC, component LIMIT 50""")
def subsystems(s, d):
    sym = T.symbols(s, d)
    e = graph.by_name(T.refs(s, d), sym)
    return graph.subsystems(sym, graph.components(sym, e), e)


def _path_sql(hops: int = 8) -> str:
    """Layers with the smallest predecessor of each node, and the way back from the target."""
    q = f"WITH {_REFS}{_EDGES}, e AS MATERIALIZED (SELECT DISTINCT src, dst FROM edges), a AS (SELECT src AS id FROM e ORDER BY src, dst LIMIT 1), z AS (SELECT dst AS id FROM e ORDER BY dst DESC, src LIMIT 1), l0 AS MATERIALIZED (SELECT id, NULL::BIGINT AS prev, 0 AS hop FROM a)"
    for k in range(1, hops + 1):
        seen = " UNION ALL ".join(f"SELECT id FROM l{j}" for j in range(k))
        q += f", l{k} AS MATERIALIZED (SELECT dst AS id, min(src) AS prev, {k} AS hop FROM l{k - 1} JOIN e ON id = src WHERE dst NOT IN ({seen}) AND NOT EXISTS (SELECT 1 FROM z WHERE z.id IN ({seen})) GROUP BY 1)"
    q += ", every AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM l{k}" for k in range(hops + 1)) + "), b0 AS (SELECT every.* FROM every JOIN z USING (id))"
    for k in range(1, hops + 1):
        q += f", b{k} AS (SELECT y.* FROM every y JOIN b{k - 1} x ON y.id = x.prev)"
    return q + " SELECT hop, id FROM (" + " UNION ALL ".join(f"SELECT hop, id FROM b{k}" for k in range(hops + 1)) + ")"


@query(_path_sql())
def shortest_path(s, d):
    sym = T.symbols(s, d)
    e = graph.by_name(T.refs(s, d), sym)
    g = cut(graph.degrees(e))
    return graph.shortest_path(e, g.where("outdeg > 0").orderBy("id").limit(1).select("id"), g.where("indeg > 0").orderBy(F.col("id").desc()).limit(1).select("id"))


# Incremental maintenance
_OLD, _NEW = "SELECT doc_id, sha256(text) AS h FROM documents WHERE source <> 'src0'", "SELECT doc_id, sha256(text || CASE WHEN lang = 'de' THEN '!' ELSE '' END) AS h FROM documents WHERE source <> 'src1'"


def _snapshots(s, d):
    f = T.read(s, d, "documents")
    new = F.concat("text", F.when(F.col("lang") == "de", "!").otherwise(""))
    return f.where("source <> 'src0'").select("doc_id", F.sha2("text", 256).alias("hash")), f.where("source <> 'src1'").select("doc_id", F.sha2(new, 256).alias("hash"))


@query(f"SELECT doc_id, CASE WHEN n.h IS NULL THEN 'deleted' ELSE 'changed' END AS status FROM ({_OLD}) o FULL JOIN ({_NEW}) n USING (doc_id) WHERE o.h IS DISTINCT FROM n.h")
def snapshot_diff(s, d):
    return incremental.snapshot_diff(*_snapshots(s, d), key="doc_id")


@query(f"SELECT doc_id, h AS hash FROM ({_NEW})")
def incremental_apply(s, d):
    old, new = _snapshots(s, d)
    return incremental.apply_changes(old, new, incremental.snapshot_diff(old, new, key="doc_id"), key="doc_id")


@query("SELECT vec_id AS id FROM embeddings WHERE vec_id IN (SELECT p_partkey FROM part)")
def orphan_purge(s, d):
    return incremental.purge_orphans(T.read(s, d, "embeddings").select(F.col("vec_id").alias("id")), T.symbols(s, d))


@query("SELECT DISTINCT 'v1:' || sha256(text) AS key FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE lang = 'en')")
def embed_cache_miss(s, d):
    c = T.contents(s, d)
    return incremental.cache_misses(c, c.where("lang = 'en'").select(F.concat(F.lit("v1:"), F.sha2("text", 256)).alias("key"))).select("key")


# Usage analytics
_CALLS = "calls AS (SELECT event_id, ts, event_type AS tool, user_id, props AS key, round(value * 1000)::BIGINT AS micros, ts::DATE AS day FROM events)"


@query(f"WITH {_CALLS} SELECT tool, count(*) AS calls, sum(micros)::BIGINT AS micros, round(avg(micros), 6) AS avg_micros FROM calls GROUP BY 1")
def savings_by_tool(s, d):
    return savings.by_tool(T.calls(s, d))


def _rollups(s, d):
    return T.calls(s, d).groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("calls"), F.sum("micros").alias("response"), (F.count(F.lit(1)) * 60000).alias("baseline"))


_ROLL = f"{_CALLS}, r AS (SELECT user_id, day, count(*) AS calls, sum(micros)::BIGINT AS response, count(*) * 60000 AS baseline FROM calls GROUP BY 1, 2)"
_DAY = f"{_ROLL}, s AS (SELECT day, sum(calls)::BIGINT AS calls, sum(response)::BIGINT AS response, sum(baseline)::BIGINT AS baseline, greatest(0, sum(baseline) - sum(response))::BIGINT AS saved FROM r WHERE day BETWEEN '2024-01-05' AND '2024-01-25' GROUP BY 1)"


@query(f"WITH {_DAY} SELECT day::VARCHAR AS day, calls, response, baseline, saved FROM s")
def savings_daily(s, d):
    return savings.daily(_rollups(s, d), "2024-01-05", "2024-01-25").withColumn("day", F.col("day").cast("string"))


@query(f"WITH {_DAY} SELECT sum(calls)::BIGINT AS calls, sum(response)::BIGINT AS response, sum(saved)::BIGINT AS saved FROM s")
def savings_totals_clamped(s, d):
    return savings.totals(savings.daily(_rollups(s, d), "2024-01-05", "2024-01-25"))


@query(f"WITH {_CALLS}, b AS (SELECT * FROM (VALUES ('click', 60), ('view', 40), ('purchase', 80)) v(tool, ms)) SELECT tool, greatest(0, coalesce(max(ms), 0) * count(*) * 1000 - sum(micros))::BIGINT AS saved_micros FROM calls LEFT JOIN b USING (tool) GROUP BY 1")
def latency_saved(s, d):
    b = s.createDataFrame([("click", 60), ("view", 40), ("purchase", 80)], "tool string, baseline_ms long")
    return savings.latency_saved(savings.by_tool(T.calls(s, d)), b)


@query(f"WITH {_ROLL} SELECT user_id, day::VARCHAR AS day, CASE WHEN user_id % 2 = 0 THEN calls * 2 ELSE calls END AS calls, response FROM r")
def max_merge_upsert(s, d):
    r = _rollups(s, d).select("user_id", F.col("day").cast("string").alias("day"), "calls", "response")
    return savings.max_merge(r, r.where("user_id % 2 = 0").withColumns({"calls": F.col("calls") * 2, "response": F.col("response") - 5}), ["user_id", "day"])


@query(f"WITH {_CALLS}, f AS (SELECT user_id, tool, min(ts) AS f FROM calls GROUP BY 1, 2) SELECT user_id, tool, row_number() OVER (PARTITION BY user_id ORDER BY f, tool)::INT AS rn FROM f QUALIFY rn <= 3")
def quota_register(s, d):
    return savings.first_n(T.calls(s, d), "user_id", "tool", "ts", 3).select("user_id", "tool", "rn")


@query(f"WITH {_CALLS} SELECT event_id, coalesce(epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id, tool ORDER BY ts)) > 86400, true) AS credited FROM calls")
def dedup_24h(s, d):
    return savings.credit_once(T.calls(s, d), ["user_id", "tool"]).select("event_id", "credited")


@query(f"WITH {_CALLS} SELECT event_id FROM calls QUALIFY row_number() OVER (PARTITION BY tool ORDER BY ts) % 64 = 1")
def sample_1_in_64(s, d):
    return savings.sample_one_in(T.calls(s, d), "ts", "tool").select("event_id")


@query(f"""WITH {_CALLS}, g AS (SELECT user_id, ts, CASE WHEN epoch(ts) - epoch(lag(ts) OVER w) < 3600 THEN 0 ELSE 1 END AS new FROM calls WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
b AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS burst FROM g) SELECT user_id, (min(ts)::VARCHAR)[:19] AS start, count(*) AS n FROM b GROUP BY user_id, burst""")
def debounce_sessions(s, d):
    return savings.sessions(T.calls(s, d), "user_id", "ts", 3600.0).select("user_id", F.substring(F.col("start").cast("string"), 1, 19).alias("start"), "n")


@query(f"WITH {_CALLS} SELECT tool, micros AS median FROM (SELECT tool, micros, row_number() OVER (PARTITION BY tool ORDER BY micros) AS rn, count(*) OVER (PARTITION BY tool) AS n FROM calls) WHERE rn = n // 2 + 1")
def median_upper(s, d):
    return savings.nth(T.calls(s, d), "tool", "micros", F.floor(F.col("n") / 2) + 1, "median")


@query(f"WITH {_CALLS} SELECT tool, micros AS p95 FROM (SELECT tool, micros, row_number() OVER (PARTITION BY tool ORDER BY micros) AS rn, count(*) OVER (PARTITION BY tool) AS n FROM calls) WHERE rn = floor((n - 1) * 0.95 + 0.5) + 1")
def p95_rank(s, d):
    return savings.nth(T.calls(s, d), "tool", "micros", F.floor((F.col("n") - 1) * F.lit(0.95).cast("double") + 0.5) + 1, "p95")


@query("""WITH k AS (SELECT o_orderkey AS key_id, o_custkey AS user_id, o_orderdate AS expires, CASE WHEN o_orderstatus = 'O' THEN 'free' ELSE 'pro' END AS tier FROM orders),
g AS (SELECT user_id FROM k WHERE tier <> 'free' AND expires < '1998-01-01' ORDER BY expires, key_id LIMIT 500)
SELECT DISTINCT user_id FROM g WHERE user_id NOT IN (SELECT user_id FROM k WHERE tier <> 'free' AND expires >= '1998-01-01')""")
def expiry_sweep(s, d):
    k = T.read(s, d, "orders").select(F.col("o_orderkey").alias("key_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("expires"), F.when(F.col("o_orderstatus") == "O", "free").otherwise("pro").alias("tier"))
    return savings.expiry_sweep(k, "1998-01-01")


@query(f"WITH {_CONT}, f AS (SELECT length(text) - length(replace(text, chr(10), '')) AS n FROM contents ORDER BY path LIMIT 200) SELECT (SELECT count(*) FROM contents) AS files, floor(sum(n) / count(*) * (SELECT count(*) FROM contents))::BIGINT AS estimated_loc FROM f")
def loc_estimate(s, d):
    return savings.loc_estimate(T.contents(s, d))


@query("SELECT count(*) AS n, count(DISTINCT path) AS paths, coalesce(max(p_size), 0) AS latest FROM (SELECT *, p_brand AS path FROM part)")
def counts(s, d):
    return T.symbols(s, d).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("path").alias("paths"), F.coalesce(F.max("line_start"), F.lit(0)).alias("latest"))
