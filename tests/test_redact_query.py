import hashlib

from pyspark.sql import functions as F

from tarnlake.functions import text as tx
from tarnlake.plans import registry

ENDS = " \t\n\x0b\f\r\"'`,"
PREFIXES = {"AKIA": 20, "aws_secret_access_key": 0, "ghp_": 40, "gho_": 40, "ghs_": 40, "github_pat_": 40, "sk-": 40, "xoxb-": 40, "xoxp-": 40, "xapp-": 40}


def plain(text):
    """Ranges of secrets found one prefix after the other, merged where they overlap."""
    if text is None:
        return None
    ranges = []
    for kind in ("RSA ", "", "EC ", "DSA ", "OPENSSH "):
        head, tail, at = f"-----BEGIN {kind}PRIVATE" + " KEY-----", f"-----END {kind}PRIVATE" + " KEY-----", 0
        while (a := text.find(head, at)) >= 0 and (z := text.find(tail, a)) >= 0:
            ranges.append((a, at := z + len(tail)))
    for p, least in PREFIXES.items():
        at = 0
        while (a := text.find(p, at)) >= 0:
            z = next((k for k in range(a, len(text)) if text[k] in ENDS), len(text))
            if z - a >= max(least, len(p)):
                ranges.append((a, z))
                at = z
            else:
                at = a + 1
    out, past = "", 0
    merged = []
    for a, z in sorted(ranges):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], z)
        else:
            merged.append([a, z])
    for a, z in merged:
        out, past = out + text[past:a] + "***REDACTED***", z
    return out + text[past:]


TEXTS = ["key " + "AKIA" + "A1B2" * 4 + " end", "no secret and no address", "desk-top of a@b.c, task-" + "q" * 40, "", None, "'sk-" + "proj-" + "a" * 40 + "' sk-short sk-" + "b" * 37, "x" + "ghp_" + "c" * 40 + "AKIA" + "d" * 30 + "`tail", "github_pat_" + "e" * 28 + " github_pat_" + "e" * 29]


def test_redact_returns_every_document(spark, tmp_path):
    rows = [(k, t, "en", "s", None) for k, t in enumerate(TEXTS * 2)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["digest"] for r in registry.QUERIES["redact"](spark, str(tmp_path)).collect()}
    want = {k: None if t is None else plain(registry._PLANTED[k % len(registry._PLANTED)] + "\n" + t) for k, t, *_ in rows}
    assert got == {k: t if t is None else hashlib.sha256(t.encode()).hexdigest() for k, t in want.items()}


def test_redact_allows_a_pattern(spark):
    ours = "sk-ours-" + "a" * 40
    one = spark.createDataFrame([(ours + " sk-" + "b" * 40,)], "t string").select(tx.redact(F.col("t"), allow="sk-ours-")).first()[0]
    assert one == ours + " ***REDACTED***"
