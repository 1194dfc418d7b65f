"""Chat formatting: incremental black-box rendering.

A template is any function from a list of (role, text) turns to a string.  Nothing is assumed about
it: successive prefixes of a conversation are rendered, and where the output of one prefix extends
the output of the prefix before it, the new part is the span of the new turn.  A template whose
later output changes earlier output is detected and reported (``rewrites``), and such a
conversation gets no spans.  The texts inside a span are found through ``template.escape``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]

CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
_ESCAPE = re.compile(r"\\|<(?=/?s>)|\[(?=/?INST\])")


def escape(text: str) -> str:
    """Text without any control string: a backslash goes after the first sign of each; ``\\`` doubles."""
    return _ESCAPE.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return re.sub(r"([\\<\[])\\", r"\1", text)


class BracketTemplate:
    """``[INST]role\\n\\ttext[/INST]`` for every turn but the assistant's: ``<s>role\\n\\ttext</s>``."""

    loss_role = "assistant"

    def header(self, role: str) -> str:
        return ("<s>" if role == self.loss_role else "[INST]") + escape(role).replace("\n", "\n ") + "\n\t"

    def footer(self, role: str) -> str:
        return "</s>" if role == self.loss_role else "[/INST]"

    def turn(self, role: str, text: str) -> str:
        return f"{self.header(role)}{escape(text)}{self.footer(role)}"

    def __call__(self, turns: list[Turn]) -> str:
        return "".join(self.turn(*t) for t in turns)


_TURN_ANY = re.compile(r"(?:<s>|\[INST\])(.*?)(?:</s>|\[/INST\])", re.S)


def read_turns(formatted: str) -> list[Turn]:
    """The turns of a string that ``BracketTemplate`` made, texts unescaped."""
    out = []
    for m in _TURN_ANY.finditer(formatted):
        role, _, text = m[1].partition("\n\t")  # a line break inside a role is followed by a blank
        out.append((unescape(role.replace("\n ", "\n")), unescape(text)))
    return out


def render_spans(template: Callable[[list[Turn]], str], turns: list[Turn]) -> tuple[str, list[tuple[int, int]], bool]:
    """Output for all turns, the span of each turn, and whether the template rewrote history."""
    before, spans = template([]), []
    for k in range(1, len(turns) + 1):
        now = template(turns[:k])
        if not now.startswith(before):
            return template(turns), [], True
        spans.append((len(before), len(now)))
        before = now
    return before, spans, False


def loss_spans(template: BracketTemplate, turns: list[Turn], spans: list[tuple[int, int]], output: str) -> list[tuple[int, int]] | None:
    """Spans of the escaped assistant texts, each inside the span of its turn; None where the output lacks one as it is.

    A template that says where a text begins (``header``) is asked; with any other the text must stand once in
    what the turn added, else it can't be told which place is meant.
    """
    found = []
    for (role, text), (a, b) in zip(turns, spans, strict=True):
        if role == getattr(template, "loss_role", "assistant"):
            body = template.escape(text) if hasattr(template, "escape") else escape(text)
            if hasattr(template, "header"):
                at = a + len(template.header(role))
            else:
                at = output.find(body, a, b)
                if body and at >= 0 and output.find(body, at + 1, b) >= 0:
                    return None
            if at < 0 or at + len(body) > b or not output.startswith(body, at):
                return None
            found.append((at, at + len(body)))
    return found


FORMATTED = "conv_id long, n_turns long, formatted string, loss_start array<long>, loss_end array<long>, rewrites boolean, unmarked boolean"


def _sorted_conversations(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list[Turn]]]:
    conv, turns = None, []
    for b in batches:
        for c, role, text in zip(*(b.column(k).to_pylist() for k in ("conv_id", "role", "text")), strict=True):
            if c != conv:
                if turns:
                    yield conv, turns
                conv, turns = c, []
            turns.append((role, text))
    if turns:
        yield conv, turns


def format_conversations(conversations: DataFrame, template: Callable[[list[Turn]], str] | None = None) -> DataFrame:
    """One row per conversation: the rendered text and the loss mask as code-point spans.

    Input: conv_id, turn, role, text; other columns are ignored.  Null role or text: empty.  Rows are
    taken by turn, ties by role and text, null turn first; a repeated row is a turn of its own.
    Null conv_id is a conversation of its own.  rewrites: the template changed earlier output; unmarked: the output
    lacks an assistant text as it is, or has it twice in its turn; such rows have no spans.  An empty table gives no rows.  One conversation is one
    output row, so it is held in memory once; rows of others only stream past.
    """
    template = template or BracketTemplate()

    def run(batches):
        rows: list[tuple] = []

        def flush():
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            types = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.bool_(), pa.bool_()]
            names = ["conv_id", "n_turns", "formatted", "loss_start", "loss_end", "rewrites", "unmarked"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

        size = 0
        for conv, turns in _sorted_conversations(batches):
            text, spans, rewrites = render_spans(template, turns)
            loss = loss_spans(template, turns, spans, text) if not rewrites else []
            rows.append((conv, len(turns), text, [a for a, _ in loss or []], [b for _, b in loss or []], rewrites, loss is None))
            size += len(text)
            if size > 4 << 20:
                yield flush()
                rows, size = [], 0
        yield flush()

    columns = [F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))]
    rows = conversations.select(*columns).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.mapInArrow(run, FORMATTED)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, digests of what its formatted text and loss mask say."""

    def run(batches):
        for b in batches:
            rows = []
            for conv, text, starts, ends in zip(*(b.column(k).to_pylist() for k in ("conv_id", "formatted", "loss_start", "loss_end")), strict=True):
                turns = read_turns(text)
                loss = "".join(unescape(text[x:y]) for x, y in zip(starts, ends, strict=True))
                said = "".join(f"{role}\n{body}\n" for role, body in turns)
                rows.append((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [x.split()[0] for x in DIGEST.split(", ")])

    return formatted.mapInArrow(run, DIGEST)
