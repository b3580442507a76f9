"""Queries of the compound tools, the index, token accounting and accounts, each with its SQL; joined to the registry by the entry point."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import filters
from ..functions import text as tx
from ..operators import accounts, graph, incremental, indexing, symbols, tokens, vectors
from ..session import cut
from ..sources import tables as T
from .registry import _CALLS, _COMP, _CONT, _EDGES, _LINES, _PARTS, _REFS, _SYM, _in_parts, _pick, _tiers_sql, query

_DOCS = "docs AS (SELECT p_partkey AS symbol_id, p_type || ' part of size ' || p_size AS doc FROM part WHERE p_partkey % 4 = 0)"


def _docs(s, d):
    return T.read(s, d, "part").where("p_partkey % 4 = 0").select(F.col("p_partkey").alias("symbol_id"), F.concat("p_type", F.lit(" part of size "), F.col("p_size").cast("string")).alias("doc"))


# Symbols
@query(f"WITH {_SYM}, {_DOCS} SELECT id, name, doc FROM symbols LEFT JOIN docs ON symbol_id = id WHERE path = 'Brand#11'")
def symbols_for_path(s, d):
    return symbols.for_path(T.symbols(s, d), _docs(s, d), "Brand#11").select("id", "name", "doc")


@query(f"WITH {_SYM}, {_DOCS} SELECT qualified_name, id, doc FROM (SELECT * FROM symbols QUALIFY row_number() OVER (PARTITION BY qualified_name ORDER BY path, byte_start, id) = 1) LEFT JOIN docs ON symbol_id = id")
def symbol_by_qname(s, d):
    sym = T.symbols(s, d)
    return symbols.first_by(sym, _docs(s, d), "qualified_name", sym.select(F.col("qualified_name").alias("wanted"))).select("qualified_name", "id", "doc")


@query("""WITH g AS (SELECT source || '/' || lang AS path, doc_id AS id, doc_id AS byte_start, 1 + doc_id % 40 AS line_start, 1 + doc_id % 40 + doc_id % 7 AS line_end FROM documents),
w AS (SELECT DISTINCT path, unnest(range(1, 50)) AS line FROM g) SELECT w.path, line, arg_min(id, byte_start) AS id FROM w JOIN g ON g.path = w.path AND line BETWEEN line_start AND line_end GROUP BY 1, 2""")
def containing_line(s, d):
    at = (F.col("doc_id") % 40 + 1).alias("line_start")
    g = T.read(s, d, "documents").select(F.concat_ws("/", "source", "lang").alias("path"), F.col("doc_id").alias("id"), F.col("doc_id").alias("byte_start"), at, (F.col("doc_id") % 40 + 1 + F.col("doc_id") % 7).alias("line_end"))
    return symbols.containing_line(g, g.select("path").distinct().select("path", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(49).cast("long"))).alias("line")))


@query(f"WITH {_CONT} SELECT doc_id AS id, sha256(substr(hex(encode(text)), 2 * 11 + 1, 2 * 200)) AS body FROM contents WHERE text IS NOT NULL")
def symbol_bodies(s, d):
    c = T.contents(s, d)
    sym = c.select(F.col("doc_id").alias("id"), "path", F.lit(11).alias("byte_start"), F.lit(211).alias("byte_end"))
    return symbols.bodies(sym, c).select("id", F.sha2(F.hex("body"), 256).alias("body"))


@query(f"""WITH {_REFS}{_EDGES}, {_DOCS}, e AS (SELECT DISTINCT src, dst FROM edges),
i AS (SELECT dst AS id, count(*) AS n_callers, string_agg(CASE WHEN rn <= 10 THEN src END, ',' ORDER BY src) AS callers FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY src) AS rn FROM e) GROUP BY 1),
o AS (SELECT src AS id, count(*) AS n_callees, string_agg(CASE WHEN rn <= 10 THEN dst END, ',' ORDER BY dst) AS callees FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst) AS rn FROM e) GROUP BY 1)
SELECT symbols.id, doc, substr(repeat(path || ' ', 300), byte_start + 1, 5) AS body, coalesce(n_callers, 0) AS n_callers, coalesce(callers, '') AS callers, coalesce(n_callees, 0) AS n_callees, coalesce(callees, '') AS callees
FROM symbols LEFT JOIN docs ON symbol_id = symbols.id LEFT JOIN i USING (id) LEFT JOIN o USING (id)""")
def read_symbol(s, d):
    sym = T.symbols(s, d).withColumn("byte_end", F.col("byte_start") + 5)
    c = sym.select("path").distinct().withColumn("text", F.repeat(F.concat("path", F.lit(" ")), 300))
    card = symbols.card(sym, c, _docs(s, d), T.refs(s, d))
    return card.select("id", "doc", F.col("body").cast("string").alias("body"), "n_callers", F.array_join("callers", ",").alias("callers"), "n_callees", F.array_join("callees", ",").alias("callees"))


@query(f"WITH {_CONT} SELECT path, lang, strlen(text)::BIGINT AS size_bytes, 2 AS n_symbols, lang || ' s' || doc_id AS tops FROM contents WHERE strlen(text) >= 1024 AND lang = 'en' AND contains(path, 'src1')")
def file_list(s, d):
    c = T.contents(s, d)
    sym = c.select("path", F.col("lang").alias("kind"), F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("name"), F.explode(F.array(F.lit(1), F.lit(2))).alias("byte_start"), "doc_id")
    sym = sym.withColumns({"id": F.col("doc_id") * 2 + F.col("byte_start"), "parent_id": F.when(F.col("byte_start") == 2, F.col("doc_id") * 2 + 1)})
    return symbols.file_list(T.files(s, d), sym, "size:>1kb", "en", "*src1*")


_FOUND = "id, qualified_name, path, line_start, kind, {tier} AS tier, 'lexical' AS source, {cut} AS truncated"


@query(f"WITH {_SYM}, w AS (SELECT name FROM symbols WHERE id = 7), h AS (SELECT symbols.* FROM symbols JOIN w ON lower(symbols.name) = lower(w.name)) SELECT {_FOUND.format(tier=0, cut='(SELECT count(*) FROM h) >= 30')} FROM h WHERE kind = (SELECT kind FROM symbols WHERE id = 7)")
def find_symbol_exact(s, d):
    sym = T.symbols(s, d)
    one = sym.where("id = 7").first()
    return symbols.find_symbol(sym, _docs(s, d), one["name"].upper(), kind=one["kind"])


def _code_terms(c: str) -> str:
    w = f"string_split_regex({c}, '[^\\p{{L}}\\p{{N}}_]+')"
    return f"list_distinct(list_filter(list_transform(list_concat([{c}], {w}, flatten(list_transform({w}, lambda w: string_split(w, '_')))), lambda w: lower(w)), lambda w: w <> ''))"


def _fields_sql(term: str, limit: int) -> str:
    """BM25 over the fields of symbols, summed."""
    q, sums = f"{_SYM}, {_DOCS}, sd AS (SELECT symbols.*, coalesce(doc, '') AS doc FROM symbols LEFT JOIN docs ON symbol_id = id)", []
    for n, c in (("x", _code_terms("name")), ("y", _code_terms("qualified_name")), ("z", "list_filter(string_split_regex(lower(doc), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')")):
        q += f", {n}d AS (SELECT id, {c} AS terms FROM sd), {n}s AS (SELECT count(*)::DOUBLE AS n, avg(len(terms)) AS a FROM {n}d), {n}p AS (SELECT id, len(terms)::DOUBLE AS len, len(list_filter(terms, lambda t: t = '{term}'))::DOUBLE AS tf FROM {n}d WHERE list_contains(terms, '{term}')), {n}f AS (SELECT count(*) AS df FROM {n}p)"
        sums.append(f"SELECT id, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a)) AS s FROM {n}p, {n}s, {n}f")
    return q + f", hits AS (SELECT id, round(sum(s), 6) AS score FROM ({' UNION ALL '.join(sums)}) GROUP BY 1 ORDER BY score DESC, id LIMIT {limit})"


@query(f"WITH {_fields_sql('bolt', 30)} SELECT {_FOUND.format(tier=1, cut='true')} FROM symbols SEMI JOIN hits USING (id)")
def find_symbol_ranked(s, d):
    return symbols.find_symbol(T.symbols(s, d), _docs(s, d), "BOLT")


@query(f"WITH {_SYM} SELECT {_FOUND.format(tier=2, cut='false')} FROM symbols WHERE contains(lower(name), 'mall_bol')")
def find_symbol_substring(s, d):
    return symbols.find_symbol(T.symbols(s, d), _docs(s, d), "mall_bol", limit=1_000_000)


@query(f"WITH {_fields_sql('bolt', 50)} SELECT id, score FROM hits")
def bm25_fields(s, d):
    q = s.createDataFrame([("q", "bolt")], "query string, term string")
    return symbols.ranked(T.symbols(s, d), _docs(s, d), q, 50).select("id", "score")


# Search modes
@query(f"""WITH {_CONT}, d AS (SELECT path AS id, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS terms FROM contents), st AS (SELECT count(*)::DOUBLE AS n, avg(len(terms)) AS a FROM d),
p AS (SELECT id, len(terms)::DOUBLE AS len, len(list_filter(terms, lambda t: t = 'que'))::DOUBLE AS tf FROM d WHERE list_contains(terms, 'que')), f AS (SELECT count(*) AS df FROM p)
SELECT id AS path, NULL::INT AS line, round(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a)), 6) AS score FROM p, st, f ORDER BY score DESC, path LIMIT 30""")
def search_exact_ranked(s, d):
    return symbols.search_exact(T.contents(s, d), "que")


@query(f"WITH {_LINES} SELECT path, line::INT AS line, NULL::DOUBLE AS score FROM lines WHERE contains(content, ', ') ORDER BY path, line LIMIT 30")
def search_exact_literal(s, d):
    return symbols.search_exact(T.contents(s, d), ", ")


@query(f"WITH {_LINES}, big AS (SELECT path AS p FROM contents WHERE contains(path, '/en/') AND strlen(text) >= 1024) SELECT path, line, content FROM lines JOIN big ON p = path WHERE regexp_matches(content, '[A-Za-z]+ing\\b')")
def search_regex_scoped(s, d):
    return symbols.search_regex(T.contents(s, d), T.files(s, d), r"[A-Za-z]+ing\b", "/en/ size:>1kb").drop("column")


_HEX = "strpos('0123456789abcdef', substr(md5(t), {k}, 1)) - 1"
_BUCKET = f"(({_HEX.format(k=3)}) * 16 + {_HEX.format(k=4)}) % 64"
_ASKED = ("the light of the house", "und der die", "que la de")


@query(f"""WITH w AS (SELECT doc_id AS id, unnest(string_split_regex(lower(substr(text, 1, 8192)), '[^a-z0-9]+')) AS t FROM documents), qw AS (SELECT q, unnest(string_split(q, ' ')) AS t FROM (SELECT unnest({list(_ASKED)!r}) AS q)),
b AS (SELECT id, {_BUCKET} AS k, count(*)::DOUBLE AS n FROM w WHERE t <> '' GROUP BY 1, 2), bn AS (SELECT id, sqrt(sum(n * n)) AS len FROM b GROUP BY 1), qb AS (SELECT q, {_BUCKET} AS k, count(*)::DOUBLE AS n FROM qw GROUP BY 1, 2), qn AS (SELECT q, sqrt(sum(n * n)) AS len FROM qb GROUP BY 1),
dots AS (SELECT q, id, sum(b.n * qb.n) AS dot FROM b JOIN qb USING (k) GROUP BY 1, 2)
SELECT q AS query, doc_id AS id, round(sqrt(greatest(0, CASE WHEN bn.len IS NULL THEN 1 ELSE 2 - 2 * coalesce(dot, 0) / (bn.len * qn.len) END)), 6) AS distance FROM documents CROSS JOIN qn LEFT JOIN bn ON bn.id = doc_id LEFT JOIN dots ON dots.q = qn.q AND dots.id = doc_id
QUALIFY row_number() OVER (PARTITION BY qn.q ORDER BY distance, doc_id) <= 10""".replace("SELECT q AS query, doc_id", "SELECT qn.q AS query, doc_id"))
def semantic_search(s, d):
    v = vectors.embed(T.read(s, d, "documents").select(F.col("doc_id").alias("id"), "text")).select("id", "embedding")
    return vectors.semantic(v, s.createDataFrame([(q,) for q in _ASKED], "query string")).select("query", "id", "distance")


# Embedding store
@query(f"WITH {_SYM}, {_DOCS} SELECT id, sha256('rust ' || kind || ' ' || qualified_name || CASE WHEN id % 2 = 0 THEN '(sig)' ELSE '' END || coalesce(' ' || doc, '') || chr(10) || name) AS digest FROM symbols LEFT JOIN docs ON symbol_id = id")
def embedding_text(s, d):
    sym = symbols.with_docs(T.symbols(s, d), _docs(s, d))
    return sym.select("id", F.sha2(tx.embedding_text(F.lit("rust"), F.col("kind"), F.col("qualified_name"), F.when(F.col("id") % 2 == 0, "sig"), F.col("doc"), F.col("name")), 256).alias("digest"))


@query("SELECT vec_id, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS first, round(embedding[64]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS last FROM embeddings")
def vectors_normalised(s, d):
    v = T.read(s, d, "embeddings").select("vec_id", vectors.normalised(F.col("embedding")).alias("e"))
    return v.select("vec_id", F.round(F.element_at("e", 1), 6).alias("first"), F.round(F.element_at("e", 64), 6).alias("last"))


@query("SELECT vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN label + 100 ELSE label END AS label FROM embeddings WHERE vec_id % 7 <> 1 UNION ALL SELECT vec_id + 1000000, label FROM embeddings WHERE vec_id % 11 = 0")
def vector_upsert(s, d):
    v = T.read(s, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    new = v.where("id % 3 = 0").withColumn("label", F.col("label") + 100).unionByName(v.where("id % 11 = 0").withColumn("id", F.col("id") + 1_000_000))
    return vectors.delete(vectors.upsert(v, new), v.where("id % 7 = 1"))


@query("WITH c AS (SELECT sha256(text) AS k, max(doc_id % 2) AS old FROM documents WHERE lang = 'en' GROUP BY 1) SELECT doc_id, coalesce(old = 0, false) AS cached, true AS embedded FROM documents LEFT JOIN c ON k = sha256(text)")
def embed_read_through(s, d):
    t = T.read(s, d, "documents").select("doc_id", "text", "lang")
    c = t.where("lang = 'en'").groupBy(F.concat(F.lit("v1:"), F.sha2("text", 256)).alias("key")).agg((F.lit(100 * 86_400) - F.max(F.col("doc_id") % 2) * 40 * 86_400).alias("at")).withColumn("embedding", F.array(F.lit(0.0)))
    return vectors.read_through(t.select("doc_id", "text"), c, 100 * 86_400).select("doc_id", "cached", (F.size("embedding") > 0).alias("embedded"))


@query(f"WITH {_SYM} SELECT id FROM symbols WHERE id % 3 <> 0")
def changed_to_embed(s, d):
    sym = T.symbols(s, d).withColumn("body_hash", F.sha2("name", 256))
    have = sym.where("id % 3 <> 2").select("id", F.when(F.col("id") % 3 == 0, F.col("body_hash")).otherwise("old").alias("body_hash"))
    return incremental.to_embed(sym, have).select("id")


# Tokens
@query("SELECT doc_id, CASE WHEN strlen(text) <= 1024 THEN ceil(strlen(text) / 4) ELSE floor(ceil(cut / 4) * strlen(text) / cut) END::BIGINT AS tokens FROM (SELECT *, 1024 - CASE WHEN substr(h, 2049, 1) NOT IN ('8', '9', 'A', 'B') THEN 0 WHEN substr(h, 2047, 1) NOT IN ('8', '9', 'A', 'B') THEN 1 WHEN substr(h, 2045, 1) NOT IN ('8', '9', 'A', 'B') THEN 2 ELSE 3 END AS cut FROM (SELECT doc_id, text, hex(encode(text)) AS h FROM documents))")
def tokens_capped(s, d):
    return T.read(s, d, "documents").select("doc_id", tx.capped_tokens(F.col("text"), 1024).alias("tokens"))


@query("SELECT doc_id, CASE WHEN strlen(text) <= 4096 THEN ceil(strlen(text) / 4) END::BIGINT AS read_tokens FROM documents")
def file_read_baseline(s, d):
    return tokens.file_baseline(T.read(s, d, "documents"), largest=4096).select("doc_id", "read_tokens")


@query("SELECT doc_id, ceil(strlen(text) / 4)::BIGINT AS n_tokens FROM documents")
def count_tokens_fallback(s, d):
    return tokens.count_tokens(T.read(s, d, "documents")).select("doc_id", "n_tokens")


_DEFS = "CASE doc_id % 4 WHEN 0 THEN 'fn f_' || doc_id || '(x)' WHEN 1 THEN '  class C' || doc_id || ':' WHEN 2 THEN 'def ab(x)' ELSE 'x = 1' END"


@query(f"WITH {_CONT}, h AS (SELECT path, regexp_extract({_DEFS}, '^[ \\t]*(?:fn |class |def )([\\p{{L}}\\p{{N}}_]{{3,}})', 1) AS ident FROM (SELECT * FROM contents ORDER BY path LIMIT 20)) SELECT row_number() OVER (ORDER BY path)::INT AS place, ident FROM h WHERE ident <> '' ORDER BY path LIMIT 9")
def sample_identifiers(s, d):
    k = F.col("doc_id") % 4
    line = F.when(k == 0, F.concat(F.lit("fn f_"), "doc_id", F.lit("(x)"))).when(k == 1, F.concat(F.lit("  class C"), "doc_id", F.lit(":"))).when(k == 2, "def ab(x)").otherwise("x = 1")
    return tokens.sample_identifiers(T.contents(s, d).withColumn("text", F.concat(line, F.lit("\n"), "text")))


_WORDS = ("the", "und", "que", "and", "de")
_ALT = f"""{_LINES}, w AS (SELECT unnest({list(_WORDS)!r}) AS ident), g AS (SELECT ident, path, sum(strlen(path || ':' || line || ':' || content) + 1) AS bytes FROM lines JOIN w ON regexp_matches(content, '(^|[^A-Za-z0-9_])' || ident || '($|[^A-Za-z0-9_])') GROUP BY 1, 2),
c AS (SELECT path, ceil(strlen(text) / 4)::BIGINT AS read FROM contents), r AS (SELECT ident, sum(read) AS two, sum(CASE WHEN rn = 1 THEN read END) AS one FROM (SELECT *, row_number() OVER (PARTITION BY ident ORDER BY path) AS rn FROM g) JOIN c USING (path) WHERE rn <= 2 GROUP BY 1),
k AS (SELECT ident, ceil(sum(bytes) / 4)::BIGINT AS grep FROM g GROUP BY 1), f AS (SELECT *, row_number() OVER (ORDER BY path) AS rn FROM c), h AS (SELECT regexp_replace(min(path), '/[^/]*$', '') AS home FROM c), nd AS (SELECT c.*, row_number() OVER (ORDER BY path) AS rn FROM c, h WHERE regexp_replace(path, '/[^/]*$', '') = home),
alt AS (SELECT 'code_find_refs' AS tool, ident, grep AS tokens FROM k UNION ALL SELECT 'code_find_symbol', ident, grep + two FROM k JOIN r USING (ident) UNION ALL SELECT unnest(['code_callers', 'code_callees']), ident, grep + one FROM k JOIN r USING (ident) UNION ALL SELECT 'code_impact', ident, 3 * grep FROM k
UNION ALL SELECT 'code_repo_map', NULL, ceil(sum(strlen(path) + 1) / 4) + sum(CASE WHEN rn <= 5 THEN read END) FROM f UNION ALL SELECT 'code_subsystems', NULL, ceil(sum(strlen(path) + 1) / 4) + sum(CASE WHEN rn <= 10 THEN read END) FROM f UNION ALL SELECT 'code_subsystem', NULL, ceil(sum(strlen(path) + 1) / 4) + sum(CASE WHEN rn <= 4 THEN read END) FROM nd)"""


@query(f"WITH {_ALT} SELECT tool, ident, tokens::BIGINT AS tokens FROM alt")
def alternative_costs(s, d):
    return tokens.alternatives(T.contents(s, d), list(_WORDS))


@query(f"WITH {_ALT} SELECT tool, tokens::BIGINT AS tokens FROM (SELECT tool, tokens, row_number() OVER (PARTITION BY tool ORDER BY tokens) AS rn, count(*) OVER (PARTITION BY tool) AS n FROM alt) WHERE rn = n // 2 + 1")
def calibrate_baselines(s, d):
    return tokens.calibrated(tokens.alternatives(T.contents(s, d), list(_WORDS)))


_STATIC = "st(tool, tokens, low, high, latency_ms) AS (VALUES " + ", ".join(f"('{a}', {b}, {c}, {e}, {f})" for a, b, c, e, f in tokens.STATIC) + ")"


@query(f"WITH {_STATIC} SELECT tool, tokens::BIGINT AS tokens, low::BIGINT AS low, high::BIGINT AS high, latency_ms::BIGINT AS latency_ms FROM st")
def static_baselines(s, d):
    return tokens.static_baselines(s)


@query(f"WITH {_STATIC}, l AS (SELECT tool, CASE WHEN tool = 'code_search' THEN 7 ELSE tokens // 2 END AS v FROM st WHERE tool IN ('code_path', 'code_search', 'code_impact')) SELECT tool, CASE WHEN tokens = 0 THEN 0 ELSE coalesce(v, tokens) END::BIGINT AS tokens FROM st LEFT JOIN l USING (tool)")
def local_baselines(s, d):
    st = tokens.static_baselines(s)
    local = st.where("tool in ('code_path', 'code_search', 'code_impact')").select("tool", F.when(F.col("tool") == "code_search", 7).otherwise(F.floor(F.col("tokens") / 2)).cast("long").alias("tokens"))
    return tokens.local_baselines(st, local)


@query("SELECT round(sum(length(text)) / sum(ceil(strlen(text) / 4)), 9) AS ratio FROM documents WHERE doc_id % 64 = 0")
def correction_ratio(s, d):
    t = T.read(s, d, "documents").where("doc_id % 64 = 0")  # the 1-in-64 sample that the correction is made of
    return tokens.correction(t.select(F.length("text").alias("counted"), tx.estimate_tokens(F.col("text")).alias("estimated"))).withColumn("ratio", F.round("ratio", 9))


_DIV = f"{_CALLS}, m AS (SELECT tool, sum(micros) / count(*) AS measured, 100 * 490::DOUBLE AS static FROM calls GROUP BY 1)"


@query(f"WITH {_DIV} SELECT tool, round(abs(measured - static) / static, 6) AS divergence, abs(measured - static) / static < 0.15 AS passes FROM m")
def divergence_by_tool(s, d):
    return tokens.divergence(_measured(s, d)).select("tool", F.round("divergence", 6).alias("divergence"), "passes")


@query(f"WITH {_DIV} SELECT count(*) FILTER (abs(measured - static) / static < 0.15) AS passing, count(*) AS tools, count(*) FILTER (abs(measured - static) / static < 0.15) >= 5 AS ok FROM m")
def divergence_gate(s, d):
    return tokens.gate(_measured(s, d))


def _measured(s, d):
    return T.calls(s, d).groupBy("tool").agg((F.sum("micros") / F.count(F.lit(1))).alias("measured")).withColumn("static", F.lit(49_000.0))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity = 0 OR abs(l_linenumber * 8 - l_quantity) / l_quantity > 0.25 AS stale FROM lineitem")
def calibration_stale(s, d):
    return T.read(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", tokens.stale(F.col("l_quantity"), F.col("l_linenumber") * 8).alias("stale"))


# Graph
@query(f"WITH {_REFS}{_EDGES} SELECT src AS id, dst AS neighbour, count(*) AS n FROM edges WHERE src % 50 = 0 GROUP BY 1, 2")
def neighbours(s, d):
    sym = T.symbols(s, d)
    return graph.neighbours(graph.by_name(T.refs(s, d), sym), sym.where("id % 50 = 0"))


@query(_COMP + """, dg AS (SELECT id, count(*) AS deg FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1),
m AS (SELECT id, coalesce(deg, 0) AS deg, ceil(strlen(path || ':' || line_start || ' ' || kind || ' ' || qualified_name) / 4)::BIGINT + 1 AS cost FROM comp JOIN symbols USING (id) LEFT JOIN dg USING (id) WHERE component = 0)
SELECT id, deg, spent FROM (SELECT id, deg, sum(cost) OVER (ORDER BY deg DESC, id ROWS UNBOUNDED PRECEDING)::BIGINT AS spent FROM m) WHERE spent <= 2000""")
def subsystem_members(s, d):
    sym = T.symbols(s, d)
    e = graph.by_name(T.refs(s, d), sym)
    return graph.members(sym, graph.components(sym, e), e, 0, 2000)


_TIERS = _tiers_sql(4, "dst", "src", "id % 50 = 0")
_STEP = "k{n} AS (SELECT key, other, section, total FROM (SELECT h.key, other, section, spent + sum(cost) OVER (PARTITION BY h.key ORDER BY rank) AS total FROM h JOIN b{p} ON b{p}.key = h.key WHERE section = '{s}') WHERE total <= 120), b{n} AS (SELECT b{p}.key, coalesce(max(total), max(spent)) AS spent FROM b{p} LEFT JOIN k{n} USING (key) GROUP BY 1)"


@query(_TIERS[: _TIERS.rindex(" SELECT * FROM (")] + ", far AS (SELECT * FROM (" + " UNION ALL ".join(f"SELECT seed, depth, id FROM t{k}" for k in range(1, 5)) + """)), ed AS MATERIALIZED (SELECT DISTINCT src, dst FROM edges),
near AS (SELECT dst AS key, src AS other FROM ed WHERE dst % 50 = 0 QUALIFY row_number() OVER (PARTITION BY dst ORDER BY src) <= 5),
cs AS (SELECT src AS key, dst AS other, kind IN ('SMALL', 'LARGE') AS ty, row_number() OVER (PARTITION BY src, kind IN ('SMALL', 'LARGE') ORDER BY dst) AS tn FROM ed JOIN symbols ON id = dst WHERE src % 50 = 0),
hops AS (SELECT key, other, 'types' AS section, tn AS rank FROM cs WHERE ty AND tn <= 3 UNION ALL SELECT key, other, 'callees', row_number() OVER (PARTITION BY key ORDER BY other) FROM cs WHERE NOT (ty AND tn <= 3) QUALIFY row_number() OVER (PARTITION BY key ORDER BY other) <= 5
UNION ALL SELECT seed, id, 'tests', row_number() OVER (PARTITION BY seed ORDER BY depth, id) FROM far WHERE id % 7 = 0 QUALIFY row_number() OVER (PARTITION BY seed ORDER BY depth, id) <= 3),
h AS (SELECT hops.*, ceil(strlen(qualified_name) / 4)::BIGINT + 6 AS cost FROM hops JOIN symbols ON id = other),
b0 AS (SELECT key, CASE WHEN start <= 120 THEN start ELSE 0 END AS spent, start FROM (SELECT id AS key, (ceil(strlen(qualified_name) / 4) + coalesce((SELECT sum(ceil(strlen(y.qualified_name) / 4)) FROM near JOIN symbols y ON y.id = other WHERE near.key = symbols.id), 0))::BIGINT AS start FROM symbols WHERE id % 50 = 0)), """
       + ", ".join(_STEP.format(n=n, p=n - 1, s=x) for n, x in ((1, "types"), (2, "callees"), (3, "tests")))
       + " SELECT key AS id, section, other, total::BIGINT AS total FROM (SELECT near.key, other, 'callers' AS section, start AS total FROM near JOIN b0 USING (key) UNION ALL SELECT key, other, section, total FROM k1 UNION ALL SELECT key, other, section, total FROM k2 UNION ALL SELECT key, other, section, total FROM k3)")
def context_budget(s, d):
    sym = T.symbols(s, d)
    return symbols.context(sym, graph.by_name(T.refs(s, d), sym), sym.where("id % 50 = 0").select("id"), 120, ("SMALL", "LARGE"), F.col("other") % 7 == 0)


_STATS = f"{_REFS}{_EDGES}, g AS (SELECT id, sum(i)::BIGINT AS indeg, sum(o)::BIGINT AS outdeg FROM (SELECT src AS id, 0 AS i, 1 AS o FROM edges UNION ALL SELECT dst, 1, 0 FROM edges) JOIN symbols USING (id) WHERE parent_id IS NULL GROUP BY 1)"


@query(f"WITH {_STATS} SELECT * FROM (SELECT 'in' AS list, id, indeg AS degree FROM g WHERE indeg > 0 ORDER BY indeg DESC, id LIMIT 20) UNION ALL SELECT * FROM (SELECT 'out', id, outdeg FROM g WHERE outdeg > 0 ORDER BY outdeg DESC, id LIMIT 20)")
def degree_lists(s, d):
    sym = T.symbols(s, d)
    return graph.degree_lists(sym, graph.by_name(T.refs(s, d), sym))


@query(f"WITH {_SYM}, {_DOCS}, t AS (SELECT path, id, 'name' AS field, {_code_terms('name')} AS terms FROM symbols UNION ALL SELECT path, id, 'qualified_name', {_code_terms('qualified_name')} FROM symbols UNION ALL SELECT path, id, 'doc', list_filter(string_split_regex(lower(doc), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') FROM symbols JOIN docs ON symbol_id = id) SELECT path, field, term, id, len::INT AS len, count(*) AS tf FROM (SELECT path, field, id, len(terms) AS len, unnest(terms) AS term FROM t) GROUP BY ALL")
def index_maintenance(s, d):
    sym = symbols.with_docs(T.symbols(s, d), _docs(s, d))
    changed = sym.where("path in ('Brand#11', 'Brand#12')").select("path").distinct()
    before = indexing.postings(sym.withColumn("name", F.when(F.col("path") == "Brand#11", F.concat("name", F.lit("_old"))).otherwise(F.col("name"))).where("path <> 'Brand#12'"))
    return indexing.maintain(before, sym, changed)


# Filters
def _typed(s, d):
    """Files with one of five extensions and a time."""
    return T.files(s, d).withColumns({"path": F.concat("path", F.lit("."), _pick(("rs", "py", "ts", "cpp", "hh"))), "mtime": F.col("doc_id")})


_TYPED = f"{_CONT}, files AS (SELECT doc_id, path || '.' || (['rs', 'py', 'ts', 'cpp', 'hh'])[doc_id % 5 + 1] AS path, doc_id AS mtime FROM contents)"


@query(f"WITH {_TYPED} SELECT path FROM files WHERE path LIKE '%.rs' OR path LIKE '%.hh'")
def filter_extension(s, d):
    return filters.apply(_typed(s, d), "*.rs *.hh").select("path")


@query(f"WITH {_TYPED} SELECT path FROM files WHERE path LIKE '%.cpp' OR path LIKE '%.hh'")
def filter_type(s, d):
    return filters.apply(_typed(s, d), "type:cpp type:hh").select("path")


@query(f"WITH {_TYPED} SELECT path FROM files WHERE regexp_matches(path, '^src[0-9]/en/[^/]*[.]py$') OR regexp_matches(path, '/fr/')")
def filter_glob(s, d):
    return filters.apply(_typed(s, d), "src?/en/*.py **/fr/*").select("path")


@query(f"WITH {_TYPED} SELECT path FROM files WHERE mtime >= 400 AND mtime <= 720")
def filter_mtime(s, d):
    return filters.apply(_typed(s, d), "mtime:>200 mtime:<2m", now=600).select("path")


@query(f"WITH {_TYPED} SELECT path FROM files WHERE doc_id % 3 = 0 AND path LIKE '%.rs'")
def filter_modified(s, d):
    f = _typed(s, d)
    return filters.apply(f, "*.rs status:modified", modified=f.where("doc_id % 3 = 0")).select("path")


# Index maintenance
_DP = f"({list(_PARTS)!r})[doc_id % 8 + 1] || doc_id || CASE WHEN doc_id % 5 = 0 THEN '.min.js' ELSE '.js' END"


@query(f"SELECT doc_id, regexp_matches(p, '(^|/)node_modules(/|$)|^src/[^/]*[.]js$|^third_party(/|[.])|^a/target(/|[.])|(^|/)[.]git(/|$)') AS ignored FROM (SELECT doc_id, {_DP} AS p FROM documents)")
def ignore_patterns(s, d):
    return T.read(s, d, "documents").select("doc_id", tx.ignored(_in_parts("doc_id"), ["node_modules", "src/*.js", " third_party/ ", "./a/target", "", ".git"]).alias("ignored"))


@query(f"WITH {_CONT} SELECT path AS key FROM contents WHERE NOT starts_with(path, 'src1')")
def meta_drop_prefix(s, d):
    return indexing.drop_meta(T.contents(s, d).select(F.col("path").alias("key")), "src1").select("key")


@query("SELECT doc_id FROM documents WHERE source = 'src0' OR (source <> 'src0' AND lang = 'de')")
def mtime_prefilter(s, d):
    t = T.read(s, d, "documents").select(F.col("doc_id").alias("path"), "source", "lang")
    old = t.where("source <> 'src0'").select("path", F.lit(1).alias("mtime"))
    return indexing.mtime_prefilter(old, t.select("path", F.when((F.col("lang") == "de"), 2).otherwise(1).alias("mtime"))).select(F.col("path").alias("doc_id"))


_GIT = "st AS (SELECT doc_id AS path, (['A', 'M', 'R', 'D'])[doc_id % 4 + 1] AS status, doc_id - 1 AS source FROM documents), dead AS (SELECT path FROM st WHERE status = 'D' UNION SELECT source FROM st WHERE status = 'R')"


@query(f"WITH {_GIT} SELECT path, 'deleted' AS state FROM dead UNION ALL SELECT path, 'modified' FROM st WHERE status IN ('A', 'M', 'R') AND path NOT IN (SELECT path FROM dead)")
def git_changes(s, d):
    st = T.read(s, d, "documents").select(F.col("doc_id").alias("path"), _pick(("A", "M", "R", "D")).alias("status"), (F.col("doc_id") - 1).alias("source"))
    modified, dead = indexing.changed_by_git(st)
    return dead.withColumn("state", F.lit("deleted")).unionByName(modified.withColumn("state", F.lit("modified")))


@query("""WITH r AS (SELECT l_suppkey AS path, (l_partkey * 7) AS start, (l_partkey * 7 + l_quantity)::BIGINT AS stop FROM lineitem), o AS (SELECT *, CASE WHEN start >= max(stop) OVER (PARTITION BY path ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) IS NOT FALSE THEN 1 ELSE 0 END AS new FROM r),
g AS (SELECT *, sum(new) OVER (PARTITION BY path ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS part FROM o) SELECT path, min(start) AS start, max(stop) AS stop FROM g GROUP BY path, part""")
def merge_ranges(s, d):
    return indexing.merged_ranges(T.read(s, d, "lineitem").select(F.col("l_suppkey").alias("path"), (F.col("l_partkey") * 7).alias("start"), (F.col("l_partkey") * 7 + F.col("l_quantity")).cast("long").alias("stop")))


_INC = "WITH n AS (SELECT doc_id FROM documents WHERE source <> 'src1'), o AS (SELECT doc_id FROM documents WHERE source <> 'src0')"


@query(f"{_INC} SELECT 'files' AS relation, doc_id AS k, CASE WHEN lang = 'de' OR source = 'src0' THEN 'new' ELSE 'old' END AS v FROM documents WHERE source <> 'src1' UNION ALL SELECT 'symbols', doc_id, CASE WHEN lang = 'de' OR source = 'src0' THEN 'new' ELSE 'old' END FROM documents WHERE source <> 'src1' UNION ALL SELECT 'refs', doc_id, CASE WHEN lang = 'de' OR source = 'src0' THEN 'new' ELSE 'old' END FROM documents WHERE source <> 'src1'")
def incremental_index(s, d):
    t = T.read(s, d, "documents")

    def snapshot(rows, version):
        h = F.sha2(F.concat("text", F.when((F.col("lang") == "de") & F.lit(version == "new"), "!").otherwise("")), 256)
        f = rows.select(F.col("doc_id").alias("path"), h.alias("hash"), F.lit(version).alias("v"))
        return {"files": f, "symbols": f.select(F.col("path").alias("id"), "path", "v"), "refs": f.select(F.col("path").alias("src_symbol_id"), F.lit("x").alias("ident"), "v")}

    out = indexing.incremental(snapshot(t.where("source <> 'src0'"), "old"), snapshot(t.where("source <> 'src1'"), "new"))
    every = None
    for name, key in (("files", "path"), ("symbols", "id"), ("refs", "src_symbol_id")):
        part = out[name].select(F.lit(name).alias("relation"), F.col(key).alias("k"), "v")
        every = part if every is None else every.unionByName(part)
    return every


@query(f"WITH {_REFS}, gone AS (SELECT id FROM symbols WHERE path IN ('Brand#11', 'Brand#12')) SELECT 'symbols' AS relation, count(*) AS n FROM symbols WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'refs', count(*) FROM refs WHERE src_symbol_id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'files', count(DISTINCT path) FROM symbols WHERE id NOT IN (SELECT id FROM gone)")
def cascade_delete(s, d):
    sym = T.symbols(s, d)
    files = sym.select("path").distinct()
    out = incremental.cascade_delete(files, sym, T.refs(s, d), files.where("path in ('Brand#11', 'Brand#12')"))
    every = None
    for name, t in zip(("files", "symbols", "refs"), out):
        part = t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("relation"), "n")
        every = part if every is None else every.unionByName(part)
    return every


@query("SELECT path, n FROM (SELECT path, count(*) AS n FROM (SELECT p_brand AS path, p_partkey FROM part) WHERE path NOT IN ('Brand#11', 'Brand#22') GROUP BY 1)")
def ignore_purge(s, d):
    sym = T.symbols(s, d)
    _, kept, _ = indexing.purge_ignored(sym.select("path").distinct(), sym, T.refs(s, d), ["a"], ["Brand#11", "Brand?22"])
    return kept.groupBy("path").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_CALLS} SELECT user_id, tool, event_id FROM calls QUALIFY row_number() OVER (PARTITION BY user_id, tool ORDER BY ts DESC) = 1")
def upsert_latest(s, d):
    return incremental.keep_latest(T.calls(s, d), ["user_id", "tool"], "ts").select("user_id", "tool", "event_id")


# Accounts
_TIER = "CASE o_orderpriority WHEN '1-URGENT' THEN 'pro' WHEN '2-HIGH' THEN 'team' WHEN '5-LOW' THEN 'enterprise' ELSE 'free' END"
_LIMITS = "lim(tier, max_repos) AS (VALUES ('free', 1), ('pro', 10), ('team', 25), ('enterprise', 1000))"


def _keys(s, d):
    p = F.col("o_orderpriority")
    tier = F.when(p == "1-URGENT", "pro").when(p == "2-HIGH", "team").when(p == "5-LOW", "enterprise").otherwise("free")
    return T.read(s, d, "orders").select(F.col("o_orderkey").alias("key_id"), F.col("o_custkey").alias("user_id"), tier.alias("tier"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("revoked_at"), F.when(F.col("o_orderstatus") == "O", "active").otherwise("closed").alias("status"))


_KEYS = f"keys AS (SELECT o_orderkey AS key_id, o_custkey AS user_id, {_TIER} AS tier, o_orderdate AS created_at, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS revoked_at, CASE WHEN o_orderstatus = 'O' THEN 'active' ELSE 'closed' END AS status FROM orders)"


def _users(s, d):
    return T.read(s, d, "customer").select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_nationkey") % 2 == 0, "free").otherwise("pro").alias("tier"), F.col("c_name").alias("name"))


_USERS = "users AS (SELECT c_custkey AS user_id, CASE WHEN c_nationkey % 2 = 0 THEN 'free' ELSE 'pro' END AS tier, c_name AS name FROM customer)"


@query(f"""WITH {_CALLS}, {_KEYS}, {_USERS}, {_LIMITS}, rp AS (SELECT user_id, key AS fingerprint, max(ts) AS last_seen FROM calls GROUP BY 1, 2), lk AS (SELECT user_id, tier FROM keys WHERE revoked_at IS NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, key_id DESC) = 1)
SELECT rp.user_id, fingerprint, row_number() OVER (PARTITION BY rp.user_id ORDER BY last_seen DESC, fingerprint)::INT AS rank, coalesce(lk.tier, users.tier) AS tier, max_repos::BIGINT AS max_repos FROM rp JOIN users USING (user_id) LEFT JOIN lk ON lk.user_id = rp.user_id JOIN lim ON lim.tier = coalesce(lk.tier, users.tier)""")
def repo_list(s, d):
    repos = T.calls(s, d).groupBy("user_id", F.col("key").alias("fingerprint")).agg(F.max("ts").alias("last_seen"))
    return accounts.repositories(repos, _keys(s, d), _users(s, d), accounts.tier_limits(s))


@query(f"WITH {_CALLS}, {_USERS}, {_LIMITS}, f AS (SELECT user_id, key AS fingerprint, min(ts) AS f FROM calls GROUP BY 1, 2) SELECT user_id, fingerprint, rn::INT AS rn FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY f, fingerprint) AS rn FROM f) JOIN users USING (user_id) JOIN lim USING (tier) WHERE rn <= max_repos")
def repos_registered(s, d):
    return accounts.registered(T.calls(s, d).withColumnRenamed("key", "fingerprint"), accounts.tier_limits(s), _users(s, d))


@query("""SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'day' WHEN event_id % 13 = 0 THEN 'calls' WHEN event_id % 17 = 0 THEN 'micros' WHEN event_id % 19 = 0 THEN 'fingerprint' END AS reason FROM events""")
def rollup_validation(s, d):
    k = F.col("event_id")
    rows = T.calls(s, d).select(
        "event_id", F.when(k % 11 == 0, F.element_at(F.array(F.lit("2024-13-01"), F.lit("24-01-01"), F.lit(None).cast("string")), (k % 3 + 1).cast("int"))).otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("day"),
        F.when(k % 13 == 0, F.lit(-1)).otherwise(1).cast("long").alias("calls"), F.when(k % 17 == 0, F.lit(2**53)).otherwise(F.col("micros")).cast("long").alias("micros"),
        F.when(k % 19 == 0, "xyz").when(k % 2 == 0, F.sha2(k.cast("string"), 256)).alias("fingerprint"),
    )
    return accounts.validated(rows, ["calls", "micros"]).select("event_id", "reason")


@query(f"WITH {_KEYS} SELECT user_id, key_id AS subscription_id, tier FROM keys WHERE tier <> 'free' AND status = 'active' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, key_id DESC) = 1")
def latest_subscription(s, d):
    return accounts.latest_paid(_keys(s, d).withColumnRenamed("key_id", "subscription_id")).select("user_id", "subscription_id", "tier")


@query(f"WITH {_KEYS} SELECT user_id, key_id AS claim_id FROM keys WHERE tier = 'free' AND user_id NOT IN (SELECT user_id FROM keys WHERE tier <> 'free' AND status IN ('created', 'active')) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at, key_id) = 1")
def slot_claim(s, d):
    k = _keys(s, d)
    claims = k.where("tier = 'free'").select("user_id", F.col("key_id").alias("claim_id"), F.col("created_at").alias("claimed_at"))
    return accounts.claim_slots(k.where("tier <> 'free'"), claims).select("user_id", "claim_id")


@query(f"WITH {_USERS}, l AS (SELECT o_custkey AS login_id, o_orderpriority AS name, CASE WHEN o_orderkey % 2 = 0 THEN 'm' || o_orderkey END AS email FROM orders WHERE o_orderstatus = 'P' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1) SELECT coalesce(user_id, login_id) AS login_id, coalesce(l.name, users.name) AS name, coalesce(l.email, CASE WHEN user_id IS NOT NULL THEN 'old' END) AS email FROM (SELECT * FROM users WHERE user_id % 3 = 0) users FULL JOIN l ON login_id = user_id")
def user_upsert(s, d):
    u = _users(s, d).where("user_id % 3 = 0").select(F.col("user_id").alias("login_id"), "name", F.lit("old").alias("email"))
    logins = T.read(s, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("login_id"), F.col("o_orderpriority").alias("name"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("m"), F.col("o_orderkey").cast("string"))).alias("email"), F.col("o_orderkey").alias("at"))
    return accounts.upsert_users(u, logins)


@query(f"WITH {_KEYS}, {_CALLS} SELECT 'keys' AS relation, count(*) AS n FROM keys WHERE user_id % 10 <> 3 UNION ALL SELECT 'calls', count(*) FROM calls WHERE user_id % 10 <> 3 UNION ALL SELECT 'items', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT key_id FROM keys WHERE user_id % 10 = 3)")
def account_delete(s, d):
    tables = {"keys": _keys(s, d), "calls": T.calls(s, d), "items": T.read(s, d, "lineitem").withColumnRenamed("l_orderkey", "key_id")}
    out = accounts.delete_accounts(tables, _users(s, d).where("user_id % 10 = 3"), through={"items": ("keys", "key_id")})
    every = None
    for name, t in out.items():
        part = t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("relation"), "n")
        every = part if every is None else every.unionByName(part)
    return every


def _tools(s, d):
    t = F.col("tool")
    c = T.calls(s, d).groupBy("tool").agg(F.count(F.lit(1)).alias("calls"), F.sum(F.col("micros") % 1000).alias("response"), F.sum("micros").alias("micros"))
    return c.withColumns({"static_tokens": F.when(t.isin("click", "view"), F.col("calls") * 600).otherwise(0).cast("long"), "measured_tokens": F.when(t == "purchase", F.col("calls") * 300).otherwise(0).cast("long")})


_TOOLS = f"{_CALLS}, tools AS (SELECT tool, count(*) AS calls, sum(micros % 1000)::BIGINT AS response, sum(micros)::BIGINT AS micros, CASE WHEN tool IN ('click', 'view') THEN count(*) * 600 ELSE 0 END AS static_tokens, CASE WHEN tool = 'purchase' THEN count(*) * 300 ELSE 0 END AS measured_tokens FROM calls GROUP BY 1), lat(tool, latency_ms) AS (VALUES ('click', 60), ('view', 40), ('purchase', 80))"


def _lat(s):
    return s.createDataFrame([("click", 60), ("view", 40), ("purchase", 80)], "tool string, latency_ms long")


@query(f"WITH {_TOOLS} SELECT sum(calls)::BIGINT AS calls, sum(response)::BIGINT AS response, sum(static_tokens)::BIGINT AS static_tokens, sum(measured_tokens)::BIGINT AS measured_tokens, sum(micros)::BIGINT AS micros, sum(greatest(0, coalesce(latency_ms, 0) * calls * 1000 - micros))::BIGINT AS latency_saved, greatest(0, sum(static_tokens) + sum(measured_tokens) - sum(response))::BIGINT AS tokens_saved FROM tools LEFT JOIN lat USING (tool)")
def client_day(s, d):
    return accounts.client_day(_tools(s, d), _lat(s))


@query(f"WITH {_TOOLS}, u AS (SELECT * FROM tools UNION ALL SELECT 'total', sum(calls), sum(response), NULL, sum(static_tokens), sum(measured_tokens) FROM tools) SELECT tool, calls::BIGINT AS calls, floor(response * 1.25)::BIGINT AS response, (static_tokens + measured_tokens)::BIGINT AS baseline, greatest(0, static_tokens + measured_tokens - floor(response * 1.25))::BIGINT AS saved, round(micros / (calls * 1000.0), 2) AS avg_ms FROM u")
def savings_report(s, d):
    return accounts.savings_report(_tools(s, d), 1.25)


@query(f"WITH {_TOOLS}, e AS (SELECT tool, calls, response, static_tokens + measured_tokens AS baseline, micros, greatest(0, coalesce(latency_ms, 0) * calls * 1000 - micros) // 1000 AS ms FROM tools LEFT JOIN lat USING (tool)), u AS (SELECT * FROM e UNION ALL SELECT 'total', sum(calls), sum(response), sum(baseline), sum(micros), sum(ms) FROM e) SELECT tool, calls::BIGINT AS calls, baseline::BIGINT AS baseline, greatest(0, baseline - response)::BIGINT AS saved, round(micros / (calls * 1000.0), 2) AS avg_ms, ms::BIGINT AS time_saved_ms FROM u")
def savings_show(s, d):
    return accounts.savings_table(_tools(s, d), _lat(s))


@query(f"WITH {_TOOLS} SELECT tool, CASE WHEN price IS NOT NULL AND v > 0 THEN round(v / 1e6 * price, 9) END AS cost FROM (SELECT tool, static_tokens - response AS v, CASE WHEN tool <> 'view' THEN 3.0 END AS price FROM tools)")
def saved_cost(s, d):
    return _tools(s, d).select("tool", F.round(accounts.saved_cost(F.col("static_tokens") - F.col("response"), F.when(F.col("tool") != "view", 3.0)), 9).alias("cost"))


@query(f"WITH {_TOOLS} SELECT tool, calls, response, micros FROM tools UNION ALL SELECT NULL, sum(calls)::BIGINT, sum(response)::BIGINT, sum(micros)::BIGINT FROM tools")
def counters_all_tools(s, d):
    return accounts.with_all(_tools(s, d), ["calls", "response", "micros"])


@query(f"WITH {_TOOLS} SELECT tool, calls, CASE WHEN tool IN ('click', 'view') THEN 0 ELSE response END AS response, micros, 'v2' AS version FROM tools")
def encoder_reset(s, d):
    t = _tools(s, d).select("tool", "calls", "response", "micros", F.when(F.col("tool") == "click", "v1").when(F.col("tool") != "view", "v2").alias("version"))
    return accounts.reset_counters(t, "v2", ["response"])


@query("SELECT * FROM (VALUES ('free', 1::BIGINT, 250::BIGINT, 10000::BIGINT, 0::BIGINT), ('pro', 10, 5000, 200000, 30), ('team', 25, 50000, 4000000, 90), ('enterprise', 1000, NULL, NULL, 365)) v(tier, max_repos, max_files, max_loc, max_days)")
def tier_limits(s, d):
    return accounts.tier_limits(s)


@query(f"WITH {_KEYS} SELECT key_id, CASE WHEN asked IS NULL OR asked < 0 THEN cap ELSE least(asked, cap) END::BIGINT AS days FROM (SELECT key_id, CASE tier WHEN 'pro' THEN 30 WHEN 'team' THEN 90 WHEN 'enterprise' THEN 365 ELSE 0 END AS cap, CASE WHEN key_id % 5 = 0 THEN NULL ELSE key_id % 400 - 10 END AS asked FROM keys)")
def tier_days(s, d):
    asked = F.when(F.col("key_id") % 5 != 0, F.col("key_id") % 400 - 10)
    return _keys(s, d).select("key_id", accounts.days_allowed(F.col("tier"), asked).alias("days"))


@query(f"WITH {_KEYS}, {_LIMITS} SELECT key_id, CASE WHEN key_id % 30 > max_repos THEN 'repos' WHEN key_id % 6000 > CASE tier WHEN 'free' THEN 250 WHEN 'pro' THEN 5000 WHEN 'team' THEN 50000 END THEN 'files' WHEN key_id * 9 > CASE tier WHEN 'free' THEN 10000 WHEN 'pro' THEN 200000 WHEN 'team' THEN 4000000 END THEN 'loc' END AS over FROM keys JOIN lim USING (tier)")
def over_limits(s, d):
    k = _keys(s, d).select("key_id", "tier", (F.col("key_id") % 30).alias("n_repos"), (F.col("key_id") % 6000).alias("files"), (F.col("key_id") * 9).alias("loc"))
    return accounts.over_limits(k, accounts.tier_limits(s)).select("key_id", "over")


@query("""WITH e AS (SELECT event_id // 3 AS event_id, ts, event_id AS payload, CASE WHEN event_id % 10 <> 0 THEN user_id END AS sub FROM events), o AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ts, payload) = 1),
a AS (SELECT c_custkey AS sub, CASE WHEN c_nationkey % 4 = 0 THEN 'cancelled' ELSE 'active' END AS status FROM customer WHERE c_custkey % 9 <> 0) SELECT event_id, payload, CASE WHEN sub IS NULL OR status IS NULL THEN 'unknown' WHEN status = 'cancelled' THEN 'terminal' END AS reason FROM o LEFT JOIN a USING (sub)""")
def event_gate(s, d):
    e = T.read(s, d, "events").select(F.floor(F.col("event_id") / 3).alias("event_id"), F.col("ts").alias("at"), F.col("event_id").alias("payload"), F.when(F.col("event_id") % 10 != 0, F.col("user_id")).alias("subscription_id"))
    a = T.read(s, d, "customer").where("c_custkey % 9 <> 0").select(F.col("c_custkey").alias("subscription_id"), F.when(F.col("c_nationkey") % 4 == 0, "cancelled").otherwise("active").alias("status"))
    good, bad = accounts.event_gate(e, a)
    return good.select("event_id", "payload", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("event_id", "payload", "reason"))

