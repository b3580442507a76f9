"""Each operator against a brute-force version on small fixtures with nulls, empty and repeated rows."""

import hashlib
import io
import math
import random
import re
import struct
import zipfile
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from tarnlake.llm import bpe, chat, decontam, html, mixing, ngram, quality, simhash, urls, warc

RNG = random.Random(11)
VOC = ["the", "of", "Ring", "thou", "ab,", "été", "x", "lyre", "and", "not"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def prose(n, rng=RNG, voc=VOC):
    return " ".join(rng.choice(voc) for _ in range(n))


def docs(spark, texts):
    return spark.createDataFrame([(k, t, "en", f"s{(k or 0) % 4}" if (k or 0) % 7 else None, None, "clash") for k, t in texts], DOCS)


@pytest.fixture(scope="module")
def sample():
    base = [prose(n) for n in (0, 1, 2, 3, 9, 25, 60, 140, 2500)]
    out = list(enumerate([None, "", " \n\t", *base, base[7], base[7] + " the", base[6]]))
    return [*out, out[-1], (None, base[5])]


PAGE = '<html><head><title>T</title></head><body><nav><a href=x>Menu</a></nav><article><h1>Head &amp; <b>line</b></h1><p>One<br>two <script>var a="</p>";</script>three</p><aside>Side words here</aside><div class="ad">Buy now</div><p>Last</p><section class="comments"><p>First!</p></section></article><footer>Foot words</footer>'


def test_html_edges():
    weights = html.fit(html.count_keys(PAGE))
    assert html.extract(PAGE, dict(weights)) == "Head & line\n\nOne two three\n\nLast"
    assert html.extract(None, {}) == html.extract("", {}) == html.extract("<p", {}) == ""
    assert html.extract("<body><nav><ul><li><a>x</a></li></ul></nav><div><p>Some words without any marker</p><p>and more</p></div><footer>f</footer>", {}) == "Some words without any marker\n\nand more"


def test_html_articles_own_words():
    """Class words and elements that articles use too, a teaser beside the story, and markup that is never closed."""
    story = "<p>" + "many words of a story " * 30 + "</p>"
    told = " ".join(("many words of a story " * 30).split())
    own = f'<article><header><h1>Title here</h1></header>{story}<div class="social"><p>Society news in plain words</p></div><div class="related"><a href=1>More one</a> <a href=2>two</a></div></article>'
    assert html.extract(own, {}) == f"Title here\n\n{told}\n\nSociety news in plain words"
    assert html.extract(f"<header>Site</header><div>{story}</div><article><p>teaser</p></article><div>{story}</div>", {}) == f"{told}\n\nteaser\n\n{told}"
    assert html.extract("<article><p>Body of text</p></article><div>aside of three</div>", {}) == "Body of text"
    import time

    began = time.perf_counter()
    assert html.extract("<i>" * 20_000 + "</b>" * 20_000 + "x", {}) == "x"
    assert html.extract("<p>" + "word " * 1_000_000, {}).count("word") == 1_000_000
    assert time.perf_counter() - began < 20


def test_html_weights_carry_over():
    """Fitted on marked pages, the keys are those of pages without a mark: the fit changes what comes out, and the mark isn't needed."""
    rng = random.Random(9)
    page = lambda mark: f'<body><div><ul><li>{prose(9, rng)}</li><li>{prose(8, rng)}</li></ul></div>{"<article>" if mark else "<div>"}<p>{prose(30, rng)}</p><p>{prose(20, rng)}</p>{"</article>" if mark else "</div>"}<div><ul><li>{prose(40, rng)}</li></ul></div></body>'
    counts = sum((html.count_keys(page(True)) for _ in range(20)), html.count_keys(""))
    weights = html.fit(counts)
    assert {k[0] for k, _ in counts} >= {"word", "p", "li"} and not any(k[0] == "mark" for k, _ in counts)
    assert weights["word", False, False, "p"] > 0.9 and weights["word", False, False, "li"] == 0
    plain = page(False)
    assert html.extract(plain, dict(weights)) == "\n\n".join(" ".join(x.split()) for x in re.findall("<p>(.*?)</p>", plain))
    assert html.extract(plain, {}) != html.extract(plain, dict(weights))


def test_best_span_against_all_spans():
    rng = random.Random(2)
    for _ in range(300):
        s = [rng.choice([-2.0, -1.0, -0.5, 0.0, 1.0, 3.0]) for _ in range(rng.randrange(14))]
        every = [(sum(s[i:j]), -i, -(j - i), (i, j)) for i in range(len(s)) for j in range(i + 1, len(s) + 1)]
        best = max((x[0] for x in every), default=0)
        i, j = html.best_span(s)
        assert sum(s[i:j]) == max(best, 0) and (best > 0 or (i, j) == (0, 0))


def test_html_rows(spark):
    rows = [(1, "u", "<article><p>A b</p></article>"), (None, None, None), (1, "u", "<article><p>A b</p></article>")]
    p = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    assert sorted((r["text"], r["n_chars"]) for r in html.main_text(p).collect()) == [("", 0), ("A b", 3), ("A b", 3)]
    assert html.main_text(p.where("false")).count() == 0


def test_zip_directories(monkeypatch):
    sink = io.BytesIO()
    with zipfile.ZipFile(sink, "w") as z:
        z.writestr("a.txt", b"hello")
        z.comment = b"PK\x05\x06 not the end"
    z = warc.ZipReader(sink, len(sink.getvalue()))
    assert z.read("a.txt", 1, 3) == b"ell"
    with pytest.raises(ValueError):
        z.read("a.txt", 3, 3)
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 3)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 0)
    big = io.BytesIO()
    with zipfile.ZipFile(big, "w") as z:
        for k in range(3):
            z.writestr(f"m{k}", b"x" * 9 + b"%d" % k)
    raw = big.getvalue()
    assert b"PK\x06\x06" in raw and struct.pack("<I", 0xFFFFFFFF) in raw
    assert [warc.ZipReader(big, len(raw)).read(f"m{k}") for k in range(3)] == [b"x" * 9 + b"%d" % k for k in range(3)]
    with pytest.raises(ValueError):
        warc.ZipReader(io.BytesIO(b"nothing"), 7)


def test_warc_round_trip(spark):
    same = "é" * 60
    rows = [(5, "http://a/ b", same), (3, None, same), (9, "u", same), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (7, "u\r\nX: y", "\r\n\r\n" * 40)]
    p = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    got = {r["page_id"]: r for r in warc.round_trip(p, payloads=True).collect()}
    for i, u, h in rows:
        raw, r = (h or "").encode(), got[i]
        assert (r["payload_bytes"], r["payload_digest"], r["url"]) == (len(raw), hashlib.sha256(raw).hexdigest(), u)
        assert (r["record_type"], r["refers_to"]) == (("revisit", 3) if i in (5, 9) else ("response", None))
        assert r["payload"] is None if i in (5, 9) else bytes(r["payload"]) == raw
    assert warc.round_trip(p.where("false")).count() == 0


def plain_quality(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = {}
    for k in range(len(w) - 7):
        seen.setdefault(tuple(w[k : k + 8]), []).append(k)
    covered = {k + j for v in seen.values() if len(v) > 1 for k in v for j in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, sample):
    texts = [*sample, (90, "a b c d e f g h i a b c d e f g h j"), (91, "x\nx\n \n\nx y\n"), (92, "# * $ %%| <a> &")]
    got = quality.judge(docs(spark, texts)).select("text", "_q.n_words", "_q.word_chars", "_q.n_symbols", "_q.n_dup_lines", "_q.n_repeat_words", "base_failed", "kept").collect()
    assert len(got) == len(texts)
    for r in got:
        want = plain_quality(r["text"])
        assert tuple(r)[1:6] == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (r["base_failed"] and r["kept"])
    assert quality.judge(docs(spark, sample).where("false")).count() == 0


def test_mixing(spark, sample):
    d = docs(spark, [(k, prose(RNG.randrange(30))) for k in range(200)]).unionByName(docs(spark, sample))
    rows = mixing.assign(d).collect()
    assert len(rows) == 200 + len(sample) and all(r["taken"] <= 3 * r["size"] for r in rows)
    sizes, taken, goal = {}, {}, {}
    for r in rows:
        s = r["source"]
        sizes[s], taken[s], goal[s] = sizes.get(s, 0) + r["size"], taken.get(s, 0) + r["taken"], r["target"]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    want, open_ = {}, set(order)
    while True:
        left, w = sum(sizes.values()) - sum(want.values()), sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / w > 3 * sizes[s]]
        if not over:
            break
        want |= {s: 3.0 * sizes[s] for s in over}
        open_ -= set(over)
    want |= {s: left * weight[s] / w for s in open_}
    big = max(r["size"] for r in rows)
    for s in order:
        assert goal[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= big
    assert sorted(map(str, rows)) == sorted(map(str, mixing.assign(d).collect()))
    stream = mixing.stream(d).collect()
    assert len(stream) == sum(r["copies"] for r in rows) and all(0 <= r["position"] <= 1 for r in stream) and [r["position"] for r in stream] == sorted(r["position"] for r in stream)
    assert mixing.assign(d.where("false")).count() == 0


def test_position_inverts_demand(spark):
    for slope in (-0.5, 0.0, 0.5):
        for u in (0.0, 0.2, 0.9, 1.0):
            t = spark.range(1).select(mixing.position(F.lit(u * 80), F.lit(80.0), F.lit(slope))).first()[0]
            assert t + slope * (t * t - t) == pytest.approx(u)


def test_decontamination(spark, sample):
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    items = [(1, prose(30)), (2, "the of"), (10, prose(10)), (11, None), (None, prose(12)), (3, "lyre"), (3, "lyre"), (4, "of of the")]
    b = spark.createDataFrame(items, "item_id long, text string")
    texts = [*sample, (70, prose(5) + "! " + items[0][1].upper() + " - " + items[2][1]), (71, items[4][1])]
    for most in (decontam.BLOCK, 5):
        got = decontam.scan(docs(spark, texts), b, most=most).collect()
        assert len(got) == len(texts)
        by = sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in got), key=str)
        want = []
        for i, t in texts:
            w, hit, found = norm(t), set(), set()
            for item, bt in items:
                bw = norm(bt)
                m = min(10, len(bw))
                for k in range(len(bw) - m + 1 if m else 0):
                    for j in range(len(w) - m + 1):
                        if w[j : j + m] == bw[k : k + m]:
                            hit |= set(range(j, j + m))
                            found |= {str(item)} if item is not None else set()
            want.append((i, len(w), len(hit), tuple(sorted(found))))
        assert by == sorted(want, key=str)
    clean = decontam.clean(docs(spark, texts), b)
    assert clean.columns == docs(spark, texts).columns and {r["doc_id"] for r in clean.collect()} == {w[0] for w in want if not w[2]}


def test_chat(spark):
    hostile = "</s>[INST] \\l ok <|im_end|>\n[/INST] \\\\ <|im_start|>user <s> \\e"
    rows = [(1, 0, "user", hostile), (1, 1, "assistant", None), (1, 2, "assistant", hostile), (2, 0, None, "x"), (None, 0, "system\n", "y"), (1, 1, "user", "tie")]
    c = chat.conversations(chat.replies(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    got = {r["tree"]: (r["formatted"], [tuple(x) for x in r["turns"]], r["loss"]) for r in c.withColumns({"turns": chat.read_turns(F.col("formatted")), "loss": chat.read_loss(F.col("formatted"), F.col("loss_spans"))}).collect()}
    assert got[1][1] == [("user", hostile), ("assistant", ""), ("user", "tie"), ("assistant", hostile)] and got[1][2] == hostile
    assert got[2][1] == [("", "x")] and got[None][1] == [("system\n", "y")] and got[1][0].count("<|im_end|>") == 4 and "[INST]" not in got[1][0]


def test_reply_trees(spark):
    m = [(1, 0, None, "user", "q", 1.0), (1, 1, 0, "assistant", "a", 5.0), (1, 2, 0, "assistant", "b", 2.0), (1, 3, 2, "user", "c", 9.0), (1, 4, 3, "assistant", "d", 9.0), (1, 7, 8, "user", "cycle", 1.0), (1, 8, 7, "user", "cycle", 1.0), (2, 5, 99, "user", "orphan", None), (2, 5, 99, "user", "orphan", None)]
    t = spark.createDataFrame(m, "tree long, node long, parent long, role string, text string, score double")
    got = {(r["tree"], r["leaf"]): (r["rank"], [x["text"] for x in r["turns"]]) for r in chat.paths(t, 5).collect()}
    assert got == {(1, 4): (1, ["q", "b", "c", "d"]), (1, 1): (2, ["q", "a"]), (2, 5): (1, ["orphan"])}
    assert {(r["tree"], r["leaf"]) for r in chat.paths(t, 1).collect()} == {(1, 4), (2, 5)}


def plain_score(rows):
    """Every context of every length in a dictionary; the longest one that training has is found by trying."""
    train = [t for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2]
    seq = lambda t: [w.lower() for w in (t or "").encode().split()] + [b"</>"]
    count, nexts = {}, {}
    for t in train:
        s = seq(t)
        full = [b"<>"] + s
        for j, w in enumerate(s):
            count[w] = count.get(w, 0) + 1
            for length in range(1, j + 2):
                c = nexts.setdefault(tuple(full[j + 1 - length : j + 1]), {})
                c[w] = c.get(w, 0) + 1
    n, v, out, lengths = sum(count.values()), len(count), [], set()
    for i, t in rows:
        s = seq(t)
        full, total, base = [b"<>"] + s, 0.0, 0.0
        for j, w in enumerate(s):
            p = (count.get(w, 0) + 1) / (n + v + 1)
            base += math.log10(p)
            best = max((k for k in range(1, j + 2) if tuple(full[j + 1 - k : j + 1]) in nexts), default=0)
            for k in sorted({1, best}):
                seen = nexts.get(tuple(full[j + 1 - k : j + 1]), {}) if 0 < k <= j + 1 else {}
                if whole := sum(seen.values()):
                    escape = ngram.ESCAPE.get(k) or float(ngram.escape_of(k))
                    p = (1 - escape) * seen.get(w, 0) / whole + escape * p
            lengths.add(best)
            total += math.log10(p)
        out.append((i, len(s), sum(w in count for w in s), n, round(base, 6), round(total, 6)))
    return sorted(out, key=str), lengths


def test_ngram(spark, sample):
    rng = random.Random(21)
    rows = [(i, t) for i, t in sample if len(t or "") < 2000] + [(100 + k, prose(rng.randrange(80), rng)) for k in range(60)]
    rare = [f"w{k}" for k in range(400)]
    passage = prose(150, rng, rare)
    for k in range(30):  # copies of a passage with other starts, ends and edits: matches of all lengths
        w = passage.split()[rng.randrange(60) : rng.randrange(80, 151)]
        if k % 2:
            w[rng.randrange(len(w))] = "edit"
        rows.append((200 + k, " ".join([prose(rng.randrange(4), rng), *w, prose(rng.randrange(3), rng)])))
    rows += [(300, passage), (301, passage), (302, passage + " tail"), (303, "new " + passage), (306, passage), (309, passage[:700])]
    want, lengths = plain_score(rows)
    assert {1, 2, 3, 4, 5, 6, 7, 9, 15, 16, 17, 31, 50} <= lengths
    for chunk, shard, piece in ((ngram.CHUNK, ngram.SHARD, ngram.PIECE), (300, 200, 400)):
        got = [(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in ngram.score(docs(spark, rows), chunk=chunk, shard=shard, piece=piece).collect()]
        for a, b in zip(sorted(got, key=str), want):
            assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], abs=1e-5)
        assert len(got) == len(want)
    assert ngram.score(docs(spark, rows).where("false")).count() == 0


def test_suffix_array_against_all_contexts():
    """Longest match and counts of one array and of many pieces, against trying every length."""
    rng = random.Random(5)
    for depth, piece in ((16, 1 << 20), (16, 200), (64, 1 << 20), (64, 500)):
        sent, truth, train = [], [], []
        shared = [rng.randrange(1, 5) for _ in range(90)]
        for c in range(3):
            text = [[rng.randrange(1, 5) for _ in range(rng.randrange(2, 40))] for _ in range(20)]
            text += [t[: rng.randrange(2, len(t) + 1)] + [rng.randrange(1, 5)] * rng.randrange(3) for t in text * (depth // 16)]
            text += [[rng.randrange(1, 5) for _ in range(rng.randrange(1, 30))] + shared[: rng.randrange(2, 90)] for _ in range(20)]
            held = [rng.random() < 0.4 for _ in text]
            offset = [sorted(rng.sample(range(1, len(t)), min(3, len(t) - 1))) for t in text]
            weight = [rng.randrange(1, 4) for _ in text]
            import numpy as np

            sent.append((str(c), {"tokens": np.array(sum(text, []), np.int64), "size": np.array([len(t) for t in text]), "entries": np.array([len(o) for o in offset]), "offset": np.array(sum(offset, [])), "weight": np.array(weight), "held": np.array(held)}))
            for t, h, o, w in zip(text, held, offset, weight):
                for k in o:
                    truth.append((str(c), h, tuple(t[:k][::-1][:depth]), t[k], w))
                    if not h:
                        train.append((tuple(t[:k][::-1][:depth]), t[k], w))
        got = [(chunk, *x) for chunk, a, _ in ngram._search(sent, 0, depth, piece) for x in zip(a["answer"], a["whole"], a["own"])]
        full = {c for _, h, c, _, _ in truth if h and len(c) == depth}
        for (chunk, h, context, nxt, _), g in zip(truth, got):
            assert g[0] == chunk
            if not h:
                assert (g[1] > 0) == (context in full and any(x == context for x, _, _ in train))
                continue
            best = max(k for k in range(len(context) + 1) if any(x[:k] == context[:k] for x, _, _ in train))
            like = [(y, w) for x, y, w in train if x[:best] == context[:best]]
            assert g[1:] == (best, sum(w for _, w in like), sum(w for y, w in like if y == nxt))


def plain_print(text, n):
    w = [x.lower() for x in (text or "").encode().split()]
    s = [b" ".join(w[k : k + n]) for k in range(max(1, len(w) - n + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, sample):
    rng = random.Random(3)
    long = prose(900, rng, [f"w{k}" for k in range(400)]).split()
    texts = [*sample]
    for k in range(40):
        w = list(long)
        for j in range(k % 6):
            w[rng.randrange(len(w))] = f"edit{k}{j}"
        texts.append((300 + k, " ".join(w)))
    d = docs(spark, texts)
    got = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash.near(d).collect()}
    prints = {i: plain_print(t, 3) for i, t in texts}
    ids = sorted(i for i in prints if i is not None)
    root = {i: i for i in ids}
    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                ra, rb = a, b
                while root[ra] != ra:
                    ra = root[ra]
                while root[rb] != rb:
                    rb = root[rb]
                root[max(ra, rb)] = min(ra, rb)
    for i in ids:
        r = i
        while root[r] != r:
            r = root[r]
        assert got[i, f"{prints[i]:016x}"] == r
    assert simhash.near(d.where("false")).count() == 0
    heavy = simhash._grouped_links(d.select(F.lit(1).cast("long").alias("k"), F.col("doc_id").alias("id"), F.lit(b"12345678").alias("fp")).where("id is not null").distinct(), 3, heavy=8)
    from tarnlake.llm.common import shared_dir
    from tarnlake.operators.components import connected_components

    assert connected_components(heavy, shared_dir(spark)).select("component").distinct().count() == 1
    kept = {r["doc_id"] for r in simhash.keep_one(docs(spark, [x for x in texts if x[0] is not None and x[0] >= 300])).collect()}
    assert kept == {300}


def test_token_counts(spark, sample):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    texts = [x for _, x in sample] + ["a<|endoftext|>b <|startoftext|>", "ΑΣ İx", "a\x1cb", "don't I'LL x²³ ½", "日本語" * 9, "x" * 3000, "é  y"]
    got = bpe.token_counts(docs(spark, list(enumerate(texts))), path, limit=50).collect()
    for r in got:
        x = texts[r["doc_id"]] or ""
        n = len(t.encode(x, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(x.encode()), n, n > 50)


def test_urls(spark):
    listed = [urls.Listed("allow", "com/"), urls.Listed("block", "example.com/en/"), urls.Listed("allow", "www.example.com/en/")]
    cases = {"http://A.com/x": ("a.com", "/x", "com/", "allow"), "http://m.example.com/en/1?q": ("m.example.com", "/en/1", "example.com/en/", "block"), "https://www.Example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"), "http://a.com": ("a.com", "", None, "allow"), "nothing": ("", "", None, "allow"), None: ("", "", None, "allow"), "http://bad.org/spam/1": ("bad.org", "/spam/1", None, "block"), "http://b.org/es#x": ("b.org", "/es", None, "allow")}
    labels = [(f"http://h{k}.org/spam/{k}", "block") for k in range(20)] + [(f"http://h{k}.org/ok/{k}", "allow") for k in range(30)]
    p = spark.createDataFrame([(k, u) for k, u in enumerate(cases)] * 2, "page_id long, url string").withColumn("mine", F.lit(1))
    got = urls.judge(p, listed, spark.createDataFrame(labels, "url string, verdict string")).collect()
    assert len(got) == 2 * len(cases)
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == cases[r["url"]]
    assert urls.judge(p, listed, spark.createDataFrame([], "url string, verdict string")).where("verdict is null").count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(4)
    words = [f"{a}{b}" for a in ("tha", "ring", "lo", "mer", "an", "sted") for b in ("one", "two", "ish", "er", "ly", "ness", "ward")]
    clean = [prose(150, rng, words) for _ in range(12)]
    copy = clean[0].split()
    copy[70] = "changed"
    item = prose(25, rng, words)
    texts = [*enumerate(clean), (20, clean[0]), (21, " ".join(copy)), (22, clean[3] + " " + item), (23, "# * " * 60), (24, None), (25, "short")]
    docs(spark, texts).drop("extra").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    d = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = []
    for _, stage in corpus_pipeline.STAGES[:3]:
        d = stage(spark, d, str(tmp_path))
        assert d.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        left.append({r["doc_id"] for r in d.collect()})
    assert left[0] == {*range(12), 20, 21, 22} and left[2] == set(range(12))
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} <= set(range(12))



def test_warc_small_archives(spark, monkeypatch):
    """Many archives and slices, and the join that stands in where repeated digests are too many to send."""
    rows = [(k, f"u{k}", "page %d " % (k % 60) * 30) for k in range(200)] + [(None, None, None), (500, "u", "page 1 " * 30)]
    p = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted(map(str, warc.round_trip(p).collect()))
    assert len(want) == len(rows)
    assert sorted(map(str, warc.round_trip(p, most=3000, slice_bytes=700).collect())) == want
    monkeypatch.setattr(warc, "MAX_BROADCAST", 0)
    assert sorted(map(str, warc.round_trip(p).collect())) == want


def test_simhash_null_id_is_a_bridge(spark):
    """A fingerprint that only rows without an id have still links what is within its reach."""
    prints = spark.createDataFrame([(1, bytes(8)), (None, b"\0" * 7 + b"\x07"), (2, b"\0" * 7 + b"\x3f"), (9, b"\xff" * 8)], "key long, fp binary")
    real, simhash.fingerprints = simhash.fingerprints, lambda *a: prints
    try:
        got = {r["doc_id"]: r["component_id"] for r in simhash.near(spark.createDataFrame([(1, "x")], "doc_id long, text string")).collect()}
    finally:
        simhash.fingerprints = real
    assert got == {1: 1, 2: 1, None: 1, 9: 9}


def test_clashing_columns(spark):
    texts = [(1, prose(40)), (2, prose(40)), (2, "other " + prose(50)), (3, None), (None, prose(45))]
    d = docs(spark, texts).withColumns({c: F.lit("mine") for c in ("kept", "_q", "_row", "base_failed", "stay_id", "stay_digest", "digest", "id", "node", "key", "rule")})
    kept = quality.keep(d, rules=())
    assert kept.columns == d.columns and {r["kept"] for r in kept.collect()} <= {"mine"}
    one = simhash.keep_one(d)
    assert one.columns == d.columns and sorted((r["doc_id"] or 0, r["stay_id"]) for r in one.collect()) == [(0, "mine"), (1, "mine"), (2, "mine"), (2, "mine"), (3, "mine")]
    p = spark.createDataFrame([(1, "http://a.com/x", "mine", "mine", "mine")], "page_id long, url string, rule string, mined string, asked_url string")
    r = urls.judge(p, [urls.Listed("block", "com/")], spark.createDataFrame([], "url string, verdict string")).first()
    assert (r["rule"], r["verdict"], r["mined"], r["asked_url"]) == ("com/", "block", None, "mine")


def test_near_dedup_recall(spark):
    """Planted pairs at 0.80, 0.82 and 0.85 of Jaccard similarity: at least nine in ten found, and none under 0.8."""
    rng, rows, true = random.Random(8), [], {}
    for g in range(240):
        words = [f"w{rng.randrange(10**6)}" for _ in range(404)]
        n, share = 400, (0.79, 0.80, 0.82, 0.85)[g % 4]
        # Replacing the last words leaves n - k shingles of n in common: J = (n - k) / (n + k).
        k = max(0, math.floor(n * (1 - share) / (1 + share))) + (share == 0.79)
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(words[: 404 - k] + [f"x{rng.randrange(10**6)}" for _ in range(k)]))]
        a, b = (set(simhash.shingles(t.encode(), 5)) for _, t in rows[-2:])
        true[g] = len(a & b) / len(a | b) >= 0.8
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(docs(spark, rows)).collect()}
    found = {g: got[2 * g + 1] == 2 * g for g in true}
    assert not any(found[g] for g in true if not true[g])
    for s in range(1, 4):
        mine = [found[g] for g in true if g % 4 == s and true[g]]
        assert len(mine) >= 50 and sum(mine) >= 0.9 * len(mine), (s, sum(mine), len(mine))


def test_mined_rules_against_a_plain_miner(spark):
    """The surest rule of every token set, found by trying all sets, gives the same verdicts."""
    from itertools import combinations

    rng = random.Random(14)
    url = lambda: f"http://{rng.choice(['a', 'bet', 'c'])}.{rng.choice(['org', 'net'])}/{rng.choice(['x', 'win', 'y'])}"
    labelled = [(u := url(), "block" if ("bet" in u) + ("win" in u) + (rng.random() < 0.25) >= 1 else "allow") for _ in range(70)]
    asked = sorted({url() for _ in range(60)} | {"http://new.org/win", "ftp://bet.net/q", "none"})
    of = {r["url"]: frozenset(r["t"]) for r in spark.createDataFrame([(u,) for u in {*asked, *(x for x, _ in labelled)}], "url string").select("url", urls.tokens(F.col("url")).alias("t")).collect()}
    seen = {}
    for u, v in labelled:
        for k in range(1, len(of[u]) + 1):
            for c in combinations(sorted(of[u]), k):
                seen.setdefault(c, {}).setdefault(v, 0)
                seen[c][v] += 1
    for least in (3, 9):
        rules = [(frozenset(c), v, n / sum(by.values()), n) for c, by in seen.items() for v, n in by.items() if n >= least and n / sum(by.values()) >= 0.7]
        want = {}
        for u in asked:
            fit = [(conf, n, v == "allow", v) for c, v, conf, n in rules if c <= of[u]]
            if fit:
                want[u] = max(fit)[3]
        mined = urls.mine(spark.createDataFrame(labelled, "url string, verdict string"), 0.005, 0.7, least)
        got = {r["url"]: r["mined"] for r in urls.match(spark.createDataFrame([(u,) for u in asked], "url string"), mined).collect()}
        assert got == want


def test_empty_tables(spark):
    conv = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.conversations(chat.replies(conv)).count() == 0
    import public_tokenizers

    assert bpe.token_counts(docs(spark, []), public_tokenizers.path("word_bpe_49k.json")).count() == 0
    none = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge(none, [], spark.createDataFrame([("http://a/b", "allow")], "url string, verdict string")).count() == 0


def test_pipeline_defined_cases(spark, tmp_path):
    """Empty table; null ids, repeated rows, ties and clashing columns; every stage against plain versions of its rule."""
    import corpus_pipeline

    b = spark.createDataFrame([(1, prose(25))], "item_id long, text string")
    for name, rows in (("none", []), ("some", None)):
        at = tmp_path / name
        rng = random.Random(17)
        words = [f"{a}{c}" for a in ("tha", "ring", "lo", "mer", "an", "sted") for c in ("one", "two", "ish", "er", "ly", "ness", "ward")]
        if rows is None:
            clean = [prose(120, rng, words) for _ in range(8)]
            rows = [*enumerate(clean), (3, clean[3]), (4, clean[5] + " " + prose(3, rng, words)), (None, clean[6]), (None, None), (40, clean[7])]
        docs(spark, rows).withColumnRenamed("extra", "kept").write.parquet(str(at / "documents.parquet"))
        b.write.parquet(str(at / "benchmark.parquet"))
        d = spark.read.parquet(str(at / "documents.parquet"))
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
            d = stage(spark, d, str(at))
            assert d.columns == ["doc_id", "text", "lang", "source", "n_chars", "kept"] and {r["kept"] for r in d.collect()} <= {"clash"}
            if k == 1 and rows:
                # Groups by plain Jaccard over all pairs; of each the smallest id stays, rows without an id stay as they are.
                sets = [set(simhash.shingles((t or "").encode(), 5)) for _, t in rows]
                group = list(range(len(rows)))
                for i in range(len(rows)):
                    for j in range(i):
                        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                            group = [min(group[i], group[j]) if g in (group[i], group[j]) else g for g in group]
                want = sorted([min(rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None and rows[i][1]) for g in {group[i] for i in range(len(rows)) if rows[i][0] is not None and rows[i][1]}] + [-1])
                assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in d.collect()) == want
        out = corpus_pipeline.run(spark, str(at)).collect()
        assert bool(out) == bool(rows)
