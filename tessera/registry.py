"""Named parts that settings can choose: embedders, scorers, providers and readers of files."""

from __future__ import annotations

from collections.abc import Callable

from .errors import TesseraError
from .operators.chunk import hashed_embedder
from .operators.rank import lexical_scorer
from .sources import files, providers

_PARTS: dict[tuple[str, str], Callable] = {
    ("embedder", "hashed"): hashed_embedder,
    ("scorer", "lexical"): lambda: lexical_scorer,
    ("provider", "table"): providers.TableProvider,
    ("provider", "json"): providers.JsonProvider,
    ("provider", "html"): providers.HtmlProvider,
    **{("reader", kind): (lambda read=read: read) for kind, read in files.READERS.items()},
}


def register(kind: str, name: str, factory: Callable) -> None:
    """Adds a part, or replaces the one of that name. factory(**options) makes it."""
    _PARTS[kind, name] = factory
    if kind == "reader":
        files.READERS[name] = factory()


def names(kind: str) -> list[str]:
    return sorted(n for k, n in _PARTS if k == kind)


def make(kind: str, name: str, *args, **options):
    if (kind, name) not in _PARTS:
        raise TesseraError(f"{kind}s are {names(kind)}", "config", name=name)
    return _PARTS[kind, name](*args, **options)
