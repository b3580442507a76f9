"""Column expressions over paths, lines and texts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

LANGUAGES = {"rs": "rust", "py": "python", "pyi": "python", "ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "javascript", "go": "go", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp"}
VENDORED = ("/node_modules/", "/target/", "/dist/", "/build/", "/.next/", "/.venv/", "/__pycache__/", "/vendor/", "/third_party/", "/generated/", "/.git/", ".min.js", ".bundle.js", ".pb.go", ".generated.")
GENERATED = ("Code generated by", "@generated", "DO NOT EDIT", "AUTO-GENERATED", "This file is automatically generated")
SECRET_NAMES = (".env", "id_rsa", "id_dsa", "id_ecdsa", "id_ed25519", "credentials", ".netrc")
SECRET_EXT = ("pem", "key", "p12", "pfx", "jks")
_KEY_KINDS = ("RSA ", "", "EC ", "DSA ", "OPENSSH ")
#: A token ends at white space, a quote, a backtick or a comma.
_TOKEN = r"""[^ \t\n\x{B}\f\r\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"'`,]"""
#: Prefixes and the fewest characters that a token must have after them.
_PREFIXES = (("AKIA", 16), ("aws_secret_access_key", 0), ("ghp_", 36), ("gho_", 36), ("ghs_", 36), ("github_pat_", 29), ("sk-", 37), ("xoxb-", 35), ("xoxp-", 35), ("xapp-", 35))
SECRETS = "|".join([*(f"(?s:-----BEGIN {k}PRIVATE KEY-----.*?-----END {k}PRIVATE KEY-----)" for k in _KEY_KINDS), *(f"{p}{_TOKEN}{{{n},}}" for p, n in _PREFIXES)])
BLANKS = " \t\n\x0b\x0c\r"


def lower_ascii(c: Column) -> Column:
    """A-Z alone become lower case, as in a caseless ASCII collation."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([^./]+)$", 1)


def language(path: Column) -> Column:
    ext, out = extension(path), F.lit("unknown")
    for name in sorted(set(LANGUAGES.values())):
        out = F.when(ext.isin([e for e, v in LANGUAGES.items() if v == name]), name).otherwise(out)
    return out


def vendored(path: Column) -> Column:
    return F.concat(F.lit("/"), path).rlike("|".join(re.escape(v) for v in VENDORED))


def generated(text: Column) -> Column:
    return F.substring_index(text, "\n", 8).rlike("|".join(re.escape(m) for m in GENERATED))


def sensitive(path: Column) -> Column:
    """Any component that is a secret's name, such a name with a suffix, or has a key's extension."""
    names = F.array(*[F.lit(n) for n in SECRET_NAMES])
    return F.exists(F.split(path, "/"), lambda c: F.exists(names, lambda n: (c == n) | c.startswith(F.concat(n, F.lit(".")))) | extension(c).isin(*SECRET_EXT))


def redact(text: Column, more: str = "", allow: str = "") -> Column:
    """Private-key blocks and tokens with a secret's prefix; what starts with the pattern `allow` is left."""
    return F.regexp_replace(text, (f"(?!{allow})(?:" if allow else "(?:") + SECRETS + (f"|{more}" if more else "") + ")", "***REDACTED***")


def estimate_tokens(text: Column) -> Column:
    """Bytes over four, rounded up."""
    return F.ceil(F.octet_length(text) / 4).cast("long")


def test_scope(name: Column, qualified: Column) -> Column:
    return (qualified == "tests") | qualified.startswith("tests::") | qualified.contains("::tests::") | qualified.endswith("::tests") | name.startswith("test_") | name.startswith("Test")


def word_match(text: Column, word: str) -> Column:
    return text.rlike(rf"(?<![A-Za-z0-9_]){re.escape(word)}(?![A-Za-z0-9_])")


def classify(line: Column, needle: str) -> Column:
    """comment, literal or neither, from what stands before the first hit."""
    before = F.substring_index(line, needle, 1)
    lead = F.ltrim(line)
    odd = lambda q: F.regexp_count(before, F.lit(q)) % 2 == 1
    comment = lead.rlike(r"^(//|/\*|\*|--|#(?![\[!]))") | (before.contains("//") & (F.regexp_count(F.substring_index(before, "//", 1), F.lit('"')) % 2 == 0))
    return F.when(comment, "comment").when(odd('"') | odd("'") | odd("`"), "literal").otherwise("neither")


def code_terms(text: Column) -> Column:
    """Lower-case terms of an identifier text: whole, words, underscore and camel-case pieces."""
    words = F.filter(F.split(text, r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    bits = F.flatten(F.transform(words, lambda w: F.split(w, "_")))
    camel = F.flatten(F.transform(bits, lambda w: F.split(w, r"(?<=[\p{Ll}\p{N}])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})")))
    return F.filter(F.array_distinct(F.transform(F.concat(F.array(text), words, bits, camel), lambda w: F.lower(w))), lambda w: w != "")


def glob_regex(glob: str) -> str:
    """`*` and `?` stop at a slash, `**` crosses it."""
    out = re.escape(glob).replace(r"\*\*/", "(?:.*/)?").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
    return f"^{out}$"


def ignored(path: Column, patterns: list[str]) -> Column:
    """Ignore patterns of a configuration: globs, prefixes at a slash or dot, and bare names of a path component."""
    path = F.regexp_replace(path, r"^(\./)+", "")
    out = F.lit(False)
    for p in (x.strip().replace("\\", "/") for x in patterns):
        if not p:
            continue
        bare = re.sub(r"^(\./)+", "", p).strip("/")
        globs = [p] if any(c in p for c in "*?[]{}") else [p, p.strip("/")] if "/" in p else [p, f"**/{p.strip('/')}/**"]
        out = out | path.rlike("|".join(glob_regex(g) for g in globs))
        if bare:
            out = out | (path == bare) | path.startswith(bare + "/") | path.startswith(bare + ".") | F.array_contains(F.split(path, "/"), bare)
    return out


def capped_tokens(text: Column, cap: int = 32 * 1024) -> Column:
    """estimate_tokens of the first `cap` bytes, cut between characters, scaled to the whole."""
    raw, n = F.encode(text, "UTF-8"), F.octet_length(text).cast("long")
    later = lambda k: F.hex(F.substring(raw, cap - k + 1, 1)).rlike("^[89AB]")
    cut = F.lit(cap) - F.when(~later(0), 0).when(~later(1), 1).when(~later(2), 2).otherwise(3)
    return F.when(n <= cap, estimate_tokens(text)).otherwise(F.floor(F.ceil(cut / 4) * n / cut).cast("long"))


def embedding_text(lang: Column, kind: Column, qualified: Column, signature: Column, doc: Column, body: Column) -> Column:
    """`lang kind name(signature) doc`, a new line, and the body; absent parts leave nothing."""
    sig = F.coalesce(F.concat(F.lit("("), signature, F.lit(")")), F.lit(""))
    return F.concat(lang, F.lit(" "), kind, F.lit(" "), qualified, sig, F.coalesce(F.concat(F.lit(" "), doc), F.lit("")), F.lit("\n"), body)
