"""Column functions and parsing on single values."""

import pytest
from marginalia.functions import text as T
from marginalia.operators.fix import deletion_range, spliced
from marginalia.sources.parse import is_code, parse
from pyspark.sql import functions as F


def value(spark, x, f):
    return spark.createDataFrame([(x,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("name", "parts"), [("parseHTTPResponse", ["parse", "http", "response"]), ("user_name", ["user", "name"]), ("a-b__C", ["a", "b", "c"]), ("ABC", ["abc"]), ("", []), ("x1Y2", ["x1", "y2"])]
)
def test_split_identifier(spark, name, parts):
    assert value(spark, name, T.split_identifier) == parts


@pytest.mark.parametrize(("head", "program"), [("#!/bin/bash", "bash"), ("#!/usr/bin/env bash\nx", "bash"), ("#!/usr/bin/env -S A=b sh -e", "sh"), ("#!/usr/bin/env -u HOME bash", "bash"), ("echo", None), ("#! /bin/sh -e", "sh")])
def test_interpreter(spark, head, program):
    assert value(spark, head, T.interpreter) == program


@pytest.mark.parametrize(("body", "marker"), [("TODO(KAT-1)", None), ("TODO( )", "TODO"), ("TODO(", "TODO"), ("aTODO", None), ("FIXME then TODO(#1)", "FIXME"), ("`TODO`", None), ("TODOs", "TODO"), ("todo", None)])
def test_task(spark, body, marker):
    assert value(spark, body, T.task_without_reference) == marker


def test_deletion_ranges():
    src = b"a\n\n// x\n\n\nb // y\n/* z */ c\n"
    cut = lambda a, z, before=False, collapse=True: spliced(src, [deletion_range(src, a, z, before, None, collapse)])
    assert cut(3, 7) == b"a\n\nb // y\n/* z */ c\n"
    assert cut(3, 7, collapse=False) == b"a\n\n\n\nb // y\n/* z */ c\n"
    assert cut(12, 16, True) == b"a\n\n// x\n\n\nb\n/* z */ c\n"
    assert cut(17, 24) == b"a\n\n// x\n\n\nb // y\nc\n"


@pytest.mark.parametrize("lang", ["go", "python", "rust", "java", "typescript", "swift", "bash"])
def test_parse_never_fails(lang):
    for text in ("", "\n", "}}}{", '"""', "'", "/*", "#", "é // ü\n", "`", "func (", "<<EOF\n", "\x00", "a" * 5000 + "\n" * 50):
        parse(lang, text)


def test_strings_hold_no_comments():
    assert [c[4] for c in parse("go", 'x := "// no" // yes\ny := `/* no */`\n').comments] == [" yes"]
    assert [c[4] for c in parse("python", 'x = "# no"  # yes\n').comments] == [" yes"]
    assert [c[4] for c in parse("bash", 'x="# no" # yes\ny=$#\ncat <<EOF\n# no\nEOF\n').comments] == [" yes"]


def test_offsets_are_bytes():
    (c,) = parse("go", "// é\nx := 1 // ü\n").comments[1:]
    assert c[:2] == (13, 18)


@pytest.mark.parametrize(("lang", "body", "want"), [("go", " x := foo(1)", True), ("go", " the value (see below)", False), ("python", " return x", False), ("python", "x = foo(1)", True), ("bash", "rm -rf $x", True), ("bash", " runs the tool.", False), ("rust", "let x = 1;", True)])
def test_is_code(lang, body, want):
    assert is_code(lang, body) is want
