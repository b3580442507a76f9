"""URL rules over every host label, every path segment and antecedents of any length."""

from itertools import product

from pyspark.sql import functions as F

from tarnlake.llm import urls


def test_tokens_of_long_hosts_and_paths(spark):
    got = set(spark.range(1).select(urls.tokens(F.lit("https://www.free-bets.example.com/a/b/c/d/e7?x=1"))).first()[0])
    assert got == {
        "host:com", "host:example.com", "host:free-bets.example.com", "host:www.free-bets.example.com", "label:www", "label:free-bets", "label:example", "label:com", "part:free", "part:bets", "first:www",
        "path1:a", "path2:b", "path3:c", "path4:d", "path5:e0", "query:x", "scheme:https",
    }


def test_site_labels_are_learned_behind_others(spark):
    labels = [(f"https://{w}.{site}.example.{tld}/{k}", "block" if site == "free-bets" else "allow") for k, (w, site, tld) in enumerate(product(("www", "m", "blog"), ("free-bets", "calm", "plain"), ("com", "net", "org")))]
    asked = {"https://free-bets.example.com/x": "block", "https://new.free-bets.other.eu/x": "block", "https://www.calm.example.com/x": "allow", "https://www.all-bets.example.com/": "block"}
    p = spark.createDataFrame([(u,) for u in asked], "url string")
    got = {r["url"]: r["mined"] for r in urls.judge(p, [], spark.createDataFrame(labels, "url string, verdict string")).collect()}
    assert got == asked


def test_rules_of_four_and_deep_segments(spark):
    # block only where all of four segments are the second kind: no rule of three is sure enough
    labels = [("http://h.org/" + "/".join(f"{c}{'xy'[b]}" for c, b in zip("abcd", bits)), "block" if all(bits) else "allow") for bits in product((0, 1), repeat=4)] * 3
    deep = [("http://h.org/p/p/p/p/bad", "block"), ("http://h.org/p/p/p/p/good", "allow")] * 3
    p = spark.createDataFrame([("http://h.org/ay/by/cy/dy",), ("http://h.org/p/p/p/p/bad",)], "url string")
    got = {r["url"]: r["mined"] for r in urls.match(p, urls.mine(spark.createDataFrame(labels + deep, "url string, verdict string"), confidence=0.9)).collect()}
    assert got == {"http://h.org/ay/by/cy/dy": "block", "http://h.org/p/p/p/p/bad": "block"}
