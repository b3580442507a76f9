"""The filter language: `*.rs type:rust /src/ !test size:>1mb mtime:<2d status:modified glob`."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidParams
from .text import extension, glob_regex

TYPES = {"rust": ["rs"], "python": ["py"], "typescript": ["ts", "tsx"], "javascript": ["js", "jsx"], "go": ["go"], "java": ["java"], "c": ["c", "h"], "cpp": ["cpp", "hpp", "cc", "cxx"]}


@dataclass
class Filter:
    extensions: list[str] = field(default_factory=list)
    types: list[str] = field(default_factory=list)
    segments: list[str] = field(default_factory=list)
    globs: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    modified: bool = False
    min_size: int | None = None
    max_size: int | None = None
    min_mtime: int | None = None
    max_mtime: int | None = None
    text: str = ""


def _size(s: str) -> int | None:
    m = re.fullmatch(r"(\d+)(kb|mb|gb|b)?", s.lower())
    if not m:
        return None
    n = int(m[1]) * 1024 ** {"kb": 1, "mb": 2, "gb": 3}.get(m[2] or "", 0)
    if n >= 1 << 63:
        raise InvalidParams(f"size too large: {s}")
    return n


def parse(query: str, now: int = 0) -> Filter:
    """Unknown or malformed constraints are text, bad sizes and times are ignored."""
    f, rest = Filter(), []
    for t in query.split():
        if m := re.fullmatch(r"\*\.(\w+)", t):
            f.extensions.append(m[1])
        elif t.startswith("type:"):
            f.types.append(t[5:])
        elif t == "status:modified":
            f.modified = True
        elif m := re.fullmatch(r"size:([<>])(.+)", t):
            if (n := _size(m[2])) is not None:
                f.min_size, f.max_size = (n, f.max_size) if m[1] == ">" else (f.min_size, n)
        elif m := re.fullmatch(r"mtime:([<>])(\d+)([dhm]?)", t):
            n = int(m[2]) * {"d": 86400, "h": 3600, "m": 60, "": 1}[m[3]]
            f.min_mtime, f.max_mtime = (now - n, f.max_mtime) if m[1] == ">" else (f.min_mtime, now + n)
        elif t.startswith("!") and len(t) > 1:
            f.exclude.append(t[1:])
        elif len(t) > 2 and t[0] == t[-1] == "/":
            f.segments.append(t[1:-1])
        elif any(c in t for c in "*?["):
            f.globs.append(t)
        else:
            rest.append(t)
    f.text = " ".join(rest)
    return f


def condition(f: Filter, path: str = "path", size: str = "size_bytes", mtime: str = "mtime") -> Column:
    p, out = F.col(path), F.lit(True)
    if f.extensions:
        out &= extension(p).isin(f.extensions)
    if f.types:
        out &= extension(p).isin([e for t in f.types for e in TYPES.get(t, [t])])
    for s in f.segments:
        out &= p.contains(s)
    if f.globs:
        out &= p.rlike("|".join(glob_regex(g) for g in f.globs))
    for x in f.exclude:
        out &= ~p.contains(x)
    for bound, col, low in ((f.min_size, size, True), (f.max_size, size, False), (f.min_mtime, mtime, True), (f.max_mtime, mtime, False)):
        if bound is not None:
            out &= F.col(col) >= bound if low else F.col(col) <= bound
    return out


def apply(files: DataFrame, query: str, now: int = 0, modified: DataFrame | None = None, **columns: str) -> DataFrame:
    """files under the filter; status:modified keeps paths of `modified`, none without such a list."""
    f = parse(query, now)
    out = files.where(condition(f, **columns))
    if f.modified:
        out = out.join(modified.select("path").distinct(), "path", "left_semi") if modified is not None else out.where("false")
    return out
