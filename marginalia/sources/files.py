"""Source files: listing, exclusion, reading, language, generated files.

The driver only lists names.  Contents are read by executors, which must see the same file system.
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.vocabulary import EXCLUDED_PATHS, LANGUAGES

HEAD, MARK_BYTES = 256, 2048


def walk(roots: list[str], excluded: tuple[str, ...] = EXCLUDED_PATHS) -> list[str]:
    """Files under the roots, sorted, each once; folders that begin with a dot or are excluded aren't entered."""
    out = set()
    for root in roots:
        if os.path.isfile(root):
            out.add(root)
        for at, folders, names in os.walk(root):
            folders[:] = sorted(d for d in folders if not d.startswith(".") and d not in excluded)
            out.update(os.path.normpath(os.path.join(at, n)) for n in names)
    return sorted((p for p in out if not set(Path(p).parts) & set(excluded)), key=lambda p: p.split("/"))


def changed_since(ref: str, folder: str = ".") -> list[str]:
    """Existing files that differ from a git revision, are staged or untracked; ValueError where git can't say."""

    def git(*args: str) -> str:
        done = subprocess.run(["git", "-C", folder, *args], capture_output=True, text=True)
        if done.returncode:
            raise ValueError(f"git {' '.join(args)}: {done.stderr.strip() or 'failed'}")
        return done.stdout

    top = git("rev-parse", "--show-toplevel").strip()
    try:
        git("rev-parse", "--verify", "-q", f"{ref}^{{commit}}")
    except ValueError:
        raise ValueError(f"no such revision: {ref}") from None
    runs = [["ls-files", "--others", "--exclude-standard", "--full-name", ":/"]]
    try:
        git("rev-parse", "--verify", "-q", "HEAD")
        runs += [["diff", "--name-only", "--diff-filter=ACMR", f"{ref}...HEAD"], ["diff", "--name-only", "--diff-filter=ACMR", "HEAD"]]
    except ValueError:
        pass  # no commit here yet: nothing to differ from
    found = {os.path.join(top, x) for args in runs for x in git(*args).splitlines()}
    return sorted(p for p in found if os.path.isfile(p))


def staged(folder: str, into: str) -> list[str]:
    """Copies under ``into`` of the added, copied and modified files as the index has them, not the working tree."""
    top = subprocess.run(["git", "-C", folder, "rev-parse", "--show-toplevel"], capture_output=True, text=True, check=True).stdout.strip()
    names = subprocess.run(["git", "-C", top, "diff", "--cached", "--name-only", "-z", "--diff-filter=ACM"], capture_output=True, check=True).stdout.split(b"\0")
    out = []
    for name in sorted(os.fsdecode(n) for n in names if n):
        target = Path(into) / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(subprocess.run(["git", "-C", top, "show", f":{name}"], capture_output=True, check=True).stdout)
        out.append(str(target))
    return out


def not_excluded(path: Column, excluded: tuple[str, ...] = EXCLUDED_PATHS) -> Column:
    return ~F.arrays_overlap(F.split(path, "/"), F.lit(list(excluded))) if excluded else F.lit(True)


def language_of(name: Column, head: Column | None = None) -> Column:
    """Language by extension, or by the shebang where there is none; null where no language takes the file."""
    ext, out = T.extension(name), F.lit(None).cast("string")
    for lang, facts in reversed(LANGUAGES.items()):
        out = F.when(ext.isin(facts["extensions"]), lang).otherwise(out)
    if head is not None:
        program = T.interpreter(head)
        for lang, facts in LANGUAGES.items():
            if facts["interpreters"]:
                out = F.when(ext.isNull() & program.isin(facts["interpreters"]), lang).otherwise(out)
    return out


def is_generated(lang: Column, content: Column) -> Column:
    """Whether a mark of a generator stands in the first bytes of the file."""
    head, out = F.substring(F.encode(content, "UTF-8"), 1, MARK_BYTES).cast("string"), F.lit(False)
    for name, facts in LANGUAGES.items():
        mine = F.lit(False)
        for m in facts["generated"]:
            mine = mine | head.contains(m)
        out = out | ((lang == name) & mine)
    return out


def read(spark: SparkSession, paths: list[str], each: int = 200) -> tuple[DataFrame, DataFrame]:
    """(path, lang, content) of the files some language takes, and (path, reason) of those that can't be read."""

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path in b["path"]:
                try:
                    rows.append((path, Path(path).read_bytes().decode("utf-8"), None))
                except (OSError, UnicodeDecodeError) as e:
                    rows.append((path, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "content", "reason"])

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path in b["path"]:
                try:
                    with open(path, "rb") as f:
                        out.append(f.read(HEAD).decode("utf-8", "replace"))
                except OSError:
                    out.append("")
            yield b.assign(head=out)

    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, -(-len(paths) // each)))
    name = F.element_at(F.split("path", "/"), -1)
    known = listed.withColumn("lang", language_of(name)).where("lang is not null")
    bare = listed.where(T.extension(name).isNull()).mapInPandas(heads, "path string, head string").withColumn("lang", language_of(name, F.col("head"))).where("lang is not null").drop("head")
    taken = known.unionByName(bare)
    found = taken.select("path").mapInPandas(load, "path string, content string, reason string")
    good = found.where("reason is null").drop("reason").withColumn("__name", F.element_at(F.split("path", "/"), -1))
    return good.withColumn("lang", language_of(F.col("__name"), F.substring("content", 1, HEAD))).select("path", "lang", "content"), found.where("reason is not null").select("path", "reason")
