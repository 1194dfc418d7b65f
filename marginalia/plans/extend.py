"""Rules and languages of one's own beside the built-in ones."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from .vocabulary import LANGUAGES


@dataclass(frozen=True)
class BlockRule:
    """Fires on the blocks where ``instruction()``, a column over the columns of blocks, isn't null.

    line, block, doc: what it may do to each kind of comment, as tier/fix; None where it doesn't apply.
    withheld_by: what a syntax error keeps it from: nothing, subtree or file.
    """

    name: str
    instruction: Callable[[], Column]
    line: str | None = "warn/rewrite"
    block: str | None = "warn/rewrite"
    doc: str | None = "warn/rewrite"
    autofix: bool = False
    withheld_by: str = "nothing"
    runs = "block"


@dataclass(frozen=True)
class SubjectRule:
    """``find(blocks, subjects)`` gives path, start, end, lang, kind, block and instruction of what it reports."""

    name: str
    find: Callable[[DataFrame, DataFrame], DataFrame]
    line: str | None = "warn/rewrite"
    block: str | None = "warn/rewrite"
    doc: str | None = "warn/rewrite"
    autofix: bool = False
    withheld_by: str = "nothing"
    runs = "subject"


#: Parsers of added languages: text to ``sources.parse.Facts``.
PARSERS: dict[str, Callable] = {}


def register_language(name: str, parser: Callable, extensions: list[str], interpreters: list[str] = (), directives: list[str] = (), generated: list[str] = (), references: list[str] = ()) -> None:
    """A further language; the first one registered keeps an extension.  The parser must be picklable: it runs on executors."""
    if name in LANGUAGES:
        raise ValueError(f"language {name} is there already")
    LANGUAGES[name] = {"extensions": list(extensions), "interpreters": list(interpreters), "directives": list(directives), "generated": list(generated), "references": list(references)}
    PARSERS[name] = parser


def unregister_language(name: str) -> None:
    """Take an added language away again; built-in ones stay."""
    if PARSERS.pop(name, None) is not None:
        del LANGUAGES[name]
