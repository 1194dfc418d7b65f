"""python -m marginalia check|fix|defaults [PATH...] [--since REF] [--format human|machine] [--config FILE] [--no-config]"""

from __future__ import annotations

import argparse
import os
import sys
import tempfile
from pathlib import Path

from . import __version__
from .plans.registry import Config, defaults_toml, discover

CONFIG_NAME = "marginalia.toml"


def replace_text(path: str, text: str) -> None:
    """Write a file whole or not at all: beside it first, then in its place, with its mode."""
    at = Path(path).resolve()
    with tempfile.NamedTemporaryFile("w", encoding="utf-8", newline="", dir=at.parent, delete=False) as f:
        f.write(text)
    os.chmod(f.name, at.stat().st_mode)
    os.replace(f.name, at)


def main(argv: list[str]) -> int:
    p = argparse.ArgumentParser(prog="marginalia", description=__doc__)
    p.add_argument("--version", action="version", version=f"%(prog)s {__version__}")
    p.add_argument("command", choices=["check", "fix", "defaults"])
    p.add_argument("paths", nargs="*")
    p.add_argument("--since")
    p.add_argument("--format", choices=["human", "machine"], default="human")
    p.add_argument("--config")
    p.add_argument("--no-config", action="store_true")
    a = p.parse_args(argv)
    if a.since and a.paths:
        p.error("--since takes no paths")
    if a.command == "defaults":
        print(defaults_toml(), end="")
        return 0
    from pyspark.sql import SparkSession

    from .check import check, corrected
    from .sources import files as S

    try:
        found = None if a.no_config else a.config or discover(".", CONFIG_NAME)
        config = Config.load(found) if found else Config()
        paths = S.walk(S.changed_since(a.since) if a.since else a.paths or ["."], config.excluded_paths)
    except (OSError, ValueError) as e:
        print(e, file=sys.stderr)
        return 2
    spark = SparkSession.builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    files, bad = S.read(spark, paths)
    if a.command == "fix":
        for r in corrected(files, config).toLocalIterator():
            replace_text(r["path"], r["content"])
            print(r["path"], file=sys.stderr)
        files, bad = S.read(spark, paths)
    report = check(files, config, bad)
    try:
        for r in (report.machine() if a.format == "machine" else report.human()).toLocalIterator():
            print(r["text"])
        sys.stdout.flush()
    except BrokenPipeError:  # the reader has seen enough
        os.dup2(os.open(os.devnull, os.O_WRONLY), sys.stdout.fileno())
    return report.exit_code()


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
