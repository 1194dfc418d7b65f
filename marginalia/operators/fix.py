"""Deletions: the byte range each one takes, ranges united, texts without them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .report import merged
from .spread import matched

#: Languages in which blank lines around a removed comment stay.
LEAVES_BLANKS = ("python",)


def deletable(findings: DataFrame, registry: DataFrame) -> DataFrame:
    """Findings that may be applied: unsuppressed, a deletion, and switched on for their rule."""
    on = registry.where("autofix and fix = 'delete'").select("lang", "rule", "kind").distinct()
    return findings.where(~F.col("suppressed") & (F.col("fix") == "delete")).join(F.broadcast(on), ["lang", "rule", "kind"], "left_semi")


def deletion_range(src: bytes, start: int, end: int, code_before: bool, directive: tuple[int, int] | None, collapse: bool) -> tuple[int, int]:
    """Bytes to remove for a comment at ``start:end``: its lines, or where code shares them, itself and the blanks on one side."""
    head, tail = src[:start], src[end:]
    rest = tail.split(b"\n", 1)[0]
    if code_before:
        return len(head.rstrip(b" \t")), end
    if rest.strip():
        return start, end + len(tail) - len(tail.lstrip(b" \t"))
    line_start = lambda at: src.rfind(b"\n", 0, at) + 1
    line_end = lambda at: src.find(b"\n", at) + 1 or len(src)
    a, z = line_start(start), line_end(end)
    if directive:
        a, z = min(a, line_start(directive[0])), max(z, line_end(directive[1]))
    blank_above = a > 0 and not src[line_start(a - 1) : a].strip()
    if collapse and blank_above:
        while z < len(src) and not src[z : line_end(z)].strip():
            z = line_end(z)
    return a, z


def spliced(src: bytes, ranges: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, z in ranges:
        out.append(src[at:a])
        at = z
    return b"".join([*out, src[at:]])


def fixed(files: DataFrame, deletions: DataFrame) -> DataFrame:
    """(path, content) of the files that change.

    deletions: path, lang, start, end, is_trailing, directive_start, directive_end (null without one).
    """
    wanted = deletions.select("path", "start", "end", "is_trailing", "directive_start", "directive_end").distinct()
    per = wanted.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start", "end", "is_trailing", "directive_start", "directive_end"))).alias("cuts"))

    def ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, lang, content, cuts in zip(b["path"], b["lang"], b["content"], b["cuts"], strict=True):
                src = content.encode()
                for c in cuts:
                    d = None if pd.isna(c["directive_start"]) else (int(c["directive_start"]), int(c["directive_end"]))
                    rows.append((path, *deletion_range(src, c["start"], c["end"], c["is_trailing"], d, lang not in LEAVES_BLANKS)))
            yield pd.DataFrame(rows, columns=["path", "start", "end"])

    def splice(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "content": [spliced(c.encode(), [(x["start"], x["end"]) for x in r]).decode() for c, r in zip(b["content"], b["ranges"], strict=True)]})

    cut = matched(files, per, "path").select("path", "lang", "content", "cuts").mapInPandas(ranges, "path string, start long, end long")
    united = merged(cut).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("ranges"))
    return matched(files, united, "path").select("path", "content", "ranges").mapInPandas(splice, "path string, content string")
