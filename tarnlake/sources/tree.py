"""Source trees: walk under ignore rules, and symbols and references of each file.

Python files are read by their syntax tree, the others by declarations and
braces in text whose comments and strings are blanked out. A symbol holds kind,
qualified name, parent, first line as signature, doc, byte and line ranges, the
hash of its body, and the identifiers in it.
"""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import generated, ignored, language, sensitive, vendored

MAX_RULES = 10_000  #: ignore rules of a tree, all files together


def git_rules(text: str, base: str = "") -> list[tuple[str, bool]]:
    """(regular expression over paths, whether it ignores) of a .gitignore in the folder `base`, in order."""
    rules = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\)\s+$", "", line)
        if not line or line.startswith("#"):
            continue
        keep = line.startswith("!")
        line = line[keep:].removeprefix("\\")
        folder, rooted = line.endswith("/"), "/" in line.rstrip("/")
        body = ""
        for part in re.findall(r"\*\*/|/\*\*$|\*|\?|\[[^\]]+\]|.", line.strip("/")):
            body += {"**/": "(?:.*/)?", "/**": "/.*", "*": "[^/]*", "?": "[^/]"}.get(part) or (part.replace("[!", "[^") if len(part) > 1 else re.escape(part))
        head = f"^{re.escape(base + '/') if base else ''}" + ("" if rooted else "(?:.*/)?")
        rules.append((f"{head}{body}{'/' if folder else '(?:/|$)'}", not keep))
    return rules


def git_ignored(path: Column, rules: list[tuple[str, bool]]) -> Column:
    """The last rule that fits decides."""
    out = F.lit(False)
    for pattern, ignores in rules:
        out = F.when(path.rlike(pattern), F.lit(ignores)).otherwise(out)
    return out


def walk(spark: SparkSession, root: str, max_bytes: int = 1 << 20, ignore: tuple[str, ...] = ()) -> DataFrame:
    """(path, lang, size_bytes, hash, mtime, text) of the known sources under a root; vendored, generated, secret, hidden, ignored and oversized files are left out. Raises ValueError beyond MAX_RULES ignore rules."""
    base = root.removeprefix("file://").rstrip("/") + "/"
    rel = F.regexp_replace(F.col("path"), "^.*?" + re.escape(base), "")

    def files(glob: str) -> DataFrame:
        return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)

    def rule_files(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, top = pafs.FileSystem.from_uri(root)
        for f in frames:
            there = [x for x in f["folder"] if fs.get_file_info(f"{top}/{x}/.gitignore").type == pafs.FileType.File]
            yield pd.DataFrame({"folder": there, "text": [fs.open_input_stream(f"{top}/{x}/.gitignore").read().decode("utf-8", "replace") for x in there]}, dtype=object)

    # Readers of the session pass over hidden files, so the folders of the files are asked one by one.
    parts = F.split(rel, "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    folders = files("*").select(F.explode(above).alias("folder")).distinct()
    own = folders.mapInPandas(rule_files, "folder string, text string").limit(MAX_RULES + 1).collect()
    rules = [r for f in sorted(own, key=lambda f: (f["folder"].count("/") + bool(f["folder"]), f["folder"])) for r in git_rules(f["text"], f["folder"])]
    if len(rules) > MAX_RULES:
        raise ValueError(f"over {MAX_RULES} ignore rules")
    p = F.col("path")
    f = files("*").where(F.col("length") <= max_bytes).select(rel.alias("path"), F.col("length").alias("size_bytes"), F.unix_millis("modificationTime").alias("mtime"), "content")
    f = f.where(~vendored(p) & ~sensitive(p) & ~p.rlike(r"(^|/)\.[^/]") & ~git_ignored(p, rules) & ~ignored(p, list(ignore)) & (language(p) != "unknown") & F.is_valid_utf8("content"))
    out = f.select("path", language(p).alias("lang"), "size_bytes", F.sha2("content", 256).alias("hash"), "mtime", F.col("content").cast("string").alias("text"))
    return out.where(~generated(F.col("text")))


@dataclass
class Symbol:
    kind: str
    name: str
    qualified: str
    start: int  #: characters
    end: int
    doc: str | None = None
    parent: Symbol | None = None
    idents: list[str] = field(default_factory=list)


_C_LIKE = r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"?"
_QUIET = {"rust": _C_LIKE + r"|'(?:\\.[^']*|[^'\\])'", "go": _C_LIKE + r"|`[^`]*`?|'(?:\\.|[^'\\])'", "typescript": _C_LIKE + r"|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?"}
_QUIET |= {"tsx": _QUIET["typescript"], "javascript": _QUIET["typescript"]}
_MODS = r"(?:(?:public|private|protected|internal|static|final|abstract|async|readonly|override|synchronized|native|default|declare|export|get|set|inline|virtual|explicit|constexpr)\s+)*"
#: (pattern, kind; None: the word found), with the name in the group `n` and a word in `k`.
_RULES = {
    "rust": [
        (r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:(?:async|unsafe|default|const|extern(?:\s+\"[^\"]*\")?)\s+)*(?P<k>fn)\s+(?P<n>\w+)", "fn"),
        (r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?(?P<k>struct|enum|trait|mod|const|static|type|union)\s+(?:mut\s+)?(?P<n>\w+)", None),
        (r"^[ \t]*(?P<k>macro_rules!)\s*(?P<n>\w+)", "macro"),
        (r"^[ \t]*(?:unsafe\s+)?(?P<k>impl)\b(?:\s*<[^{]*?>)?\s+(?:[\w:<>, '&]+?\s+for\s+)?&?(?:\w+::)*(?P<n>\w+)", "impl"),
    ],
    "go": [
        (r"^(?P<k>func)\s+(?:\(\s*(?:\w+\s+)?\*?(?P<of>\w+)[^)]*\)\s*)?(?P<n>\w+)", "fn"),
        (r"^type\s+(?P<n>\w+)(?:\[[^\]]*\])?\s+(?P<k>struct|interface)\b", None),
        (r"^(?P<k>type|const)\s+(?P<n>\w+)(?!\S*\s+(?:struct|interface)\b)", None),
    ],
    "java": [
        (r"^[ \t]*" + _MODS + r"(?P<k>class|interface|enum|record)\s+(?P<n>\w+)", None),
        (r"^[ \t]*" + _MODS + r"(?:<[^>]+>\s+)?(?!(?:return|new|else|throw|case)\b)[\w.]+(?:<[^;{}()]*>)?(?:\[\])*\s+(?P<n>\w+)\s*\([^;{}]*\)\s*(?:throws\s+[\w,. ]+)?\s*(?=[{;])", "fn"),
    ],
    "typescript": [
        (r"^[ \t]*" + _MODS + r"(?P<k>class|interface|enum|type|const)\s+(?P<n>\w+)", None),
        (r"^[ \t]*" + _MODS + r"(?P<k>function)\s*\*?\s*(?P<n>\w+)", "fn"),
        (r"^[ \t]+" + _MODS + r"(?!(?:if|for|while|switch|catch|function|return|with)\b)#?(?P<n>\w+)\s*(?:<[^>()]*>)?\([^;{}]*\)\s*(?::[^;{}=]+)?(?=\{)", "method"),
    ],
    "c": [
        (r"^[ \t]*(?:typedef\s+)?(?:template\s*<[^>]*>\s*)?(?P<k>struct|enum|class|union|namespace)\s+(?:class\s+)?(?P<n>\w+)(?=[^;()]*\{)", None),
        (r"^[ \t]*" + _MODS + r"(?!(?:return|else|new|if|for|while|switch)\b)(?:[\w:<>,]+[ \t*&]+)+(?:(?P<of>\w+)::)?(?P<n>~?\w+)\s*\([^;{}]*\)\s*(?:const|noexcept|override|\s)*(?=\{)", "fn"),
    ],
}
_RULES |= {"tsx": _RULES["typescript"], "javascript": _RULES["typescript"], "cpp": _RULES["c"]}
_RULES = {lang: [(re.compile(p, re.M), k) for p, k in rules] for lang, rules in _RULES.items()}
_KIND = {"union": "struct", "namespace": "mod", "record": "class"}
_HOLDERS = frozenset("struct class interface enum trait impl mod".split())
_WORD = re.compile(r"[A-Za-z_]\w+")


def _quiet(lang: str, text: str) -> str:
    """The text with comments and strings blanked out, line ends kept."""
    return re.sub(_QUIET.get(lang, _C_LIKE + r"|'(?:\\.|[^'\\\n])*'?"), lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)


def _end(quiet: str, start: int, closing: dict[int, int]) -> int:
    """Past a declaration: its block, or what ends it."""
    m = re.compile(r"[{;]").search(quiet, start)
    if not m:
        return len(quiet.rstrip())
    return closing.get(m.start(), len(quiet) - 1) + 1 if m[0] == "{" else m.end()


def _braces(quiet: str) -> dict[int, int]:
    """Where each opening brace is closed."""
    found, open_ = {}, []
    for m in re.finditer(r"[{}]", quiet):
        if m[0] == "{":
            open_.append(m.start())
        elif open_:
            found[open_.pop()] = m.start()
    return found


def _doc(text: str, start: int) -> str | None:
    """Comment lines right above, past attributes and annotations."""
    lines: list[str] = []
    for x in reversed(text[: text.rfind("\n", 0, start) + 1].splitlines()):
        s = x.strip()
        if re.match(r"#!?\[|@\w", s):
            if lines:
                break
            continue
        m = re.match(r"(?:///?!?|/\*\*?|\*/|\*)\s?(.*?)(?:\s*\*/)?$", s)
        if not m:
            break
        lines.append(m[1])
    return "\n".join(reversed(lines)).strip("\n") or None


def scan(lang: str, text: str) -> list[Symbol]:
    """Symbols of a file in a language with braces, in order."""
    quiet = _quiet(lang, text)
    closing = _braces(quiet)
    found: list[tuple[int, Symbol, str | None]] = []
    taken: set[int] = set()
    for pattern, kind in _RULES.get(lang, ()):
        for m in pattern.finditer(quiet):
            g = m.groupdict()
            if m.start("n") in taken:
                continue
            taken.add(m.start("n"))
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            word = kind or g["k"]
            found.append((start, Symbol(_KIND.get(word, word), g["n"], g["n"], start, _end(quiet, m.end(), closing)), g.get("of")))
    found.sort(key=lambda x: x[0])
    types = {s.name: s for _, s, _ in found if s.kind in _HOLDERS and s.kind not in ("impl", "mod")}  # of equal names the latest
    around: list[Symbol] = []
    out = []
    for start, s, of in found:
        while around and around[-1].end <= start:
            around.pop()
        holder = around[-1] if around else None
        if holder is not None and holder.kind not in _HOLDERS:
            if s.kind != "fn" or lang not in ("rust", "typescript", "tsx", "javascript"):
                continue  # declarations inside a function are its own
        if s.kind == "method" and (holder is None or holder.kind not in ("class", "interface")):
            continue
        around.append(s)
        if s.kind == "impl":
            continue
        owner = types.get(of) if of else types.get(holder.name) if holder is not None and holder.kind == "impl" else holder
        prefix = of or (owner.qualified if owner is not None else holder.name if holder is not None else "")
        s.qualified = f"{prefix}::{s.name}" if prefix else s.name
        if s.kind == "fn" and (of or holder is not None and holder.kind in _HOLDERS - {"mod"}):
            s.kind = "method"
        s.parent, s.doc = owner, _doc(text, start)
        s.idents = sorted(set(_WORD.findall(quiet, s.start, s.end)) - {s.name})
        out.append(s)
    return out


def python_symbols(text: str) -> list[Symbol]:
    """Symbols of a Python file; one that doesn't parse has none. Decorators count among a symbol's identifiers."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    lines = text.encode().split(b"\n")
    ahead = [0]
    for x in lines:
        ahead.append(ahead[-1] + len(x.decode()) + 1)
    place = lambda line, col: ahead[line - 1] + len(lines[line - 1][:col].decode())
    out: list[Symbol] = []

    def visit(node, parent: Symbol | None, inside: bool) -> None:
        for n in ast.iter_child_nodes(node):
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "class" if isinstance(n, ast.ClassDef) else "method" if inside else "fn"
                s = Symbol(kind, n.name, f"{parent.qualified}::{n.name}" if parent else n.name, place(n.lineno, n.col_offset), place(n.end_lineno, n.end_col_offset), ast.get_docstring(n), parent)
                s.idents = sorted({x for y in ast.walk(n) if isinstance(y, (ast.Name, ast.Attribute)) and len(x := y.id if isinstance(y, ast.Name) else y.attr) > 1})
                out.append(s)
                visit(n, s, isinstance(n, ast.ClassDef))
            else:
                visit(n, parent, inside)

    visit(tree, None, False)
    return out


def extract_file(path: str, lang: str, text: str) -> list[Symbol]:
    return python_symbols(text) if lang == "python" else scan(lang, text)


_COLUMNS = "path string, name string, qualified_name string, kind string, signature string, doc string, byte_start long, byte_end long, line_start int, line_end int, body_hash string, idents array<string>, parent_name string, parent_line int"


def extract(files: DataFrame) -> DataFrame:
    """One row for each symbol: id, path, name, qualified_name, kind, signature, doc, parent_id, byte and line ranges, body_hash, idents. Ids are hashes of path, name and line, so they need no numbering across files."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, lang, text in zip(f["path"], f["lang"], f["text"]):
                line = lambda k, t=text: t.count("\n", 0, k) + 1
                for s in extract_file(path, lang, text):
                    body = text[s.start : s.end]
                    at, raw = len(text[: s.start].encode()), body.encode()
                    rows.append((
                        path, s.name, s.qualified, s.kind, body.split("\n", 1)[0].strip(), s.doc, at, at + len(raw), line(s.start), line(max(s.start, s.end - 1)), hashlib.sha256(raw).hexdigest(), s.idents,
                        s.parent and s.parent.qualified, s.parent and line(s.parent.start),
                    ))
            d = pd.DataFrame(rows, columns=[c.split()[0] for c in _COLUMNS.split(", ")])
            yield d.astype({"parent_line": "Int32"})

    out = files.select("path", "lang", "text").mapInPandas(run, _COLUMNS)
    parent = F.when(F.col("parent_name").isNotNull(), F.xxhash64("path", "parent_name", "parent_line"))
    return out.withColumns({"id": F.xxhash64("path", "qualified_name", "line_start"), "parent_id": parent}).drop("parent_name", "parent_line")
