"""Settings with defaults, read from a TOML file."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, fields

from .errors import InvalidParams


@dataclass(frozen=True)
class Config:
    max_file_bytes: int = 1 << 20
    max_results: int = 30
    map_tokens: int = 2000
    debounce_ms: int = 250
    pagerank_damping: float = 0.85
    pagerank_rounds: int = 15
    ignore: tuple[str, ...] = ()


def load(path: str) -> Config:
    """The file's settings over the defaults. Unknown names and wrong kinds raise InvalidParams."""
    try:
        with open(path, "rb") as f:
            own = tomllib.load(f)
    except tomllib.TOMLDecodeError as e:
        raise InvalidParams(f"{path}: {e}") from None
    known = {f.name: type(getattr(Config(), f.name)) for f in fields(Config)}
    for name, value in own.items():
        if name not in known:
            raise InvalidParams(f"{path}: unknown setting {name}")
        kind = list if known[name] is tuple else known[name]
        if isinstance(value, bool) or not isinstance(value, (int, float) if kind is float else kind):
            raise InvalidParams(f"{path}: {name} must be {kind.__name__}")
    return Config(**{k: tuple(v) if isinstance(v, list) else v for k, v in own.items()})
