"""Whole files with the findings that each rule must give, line by line, and files that must give none."""

import pytest
from marginalia.check import check
from marginalia.plans.registry import Config

MARK = "marginalia:ignore"


def go(*notes, head="package p\n\nfunc Load() {\n"):
    """A function with a note above a call on lines 4, 8 and 12."""
    return head + "\n\n\n".join(f"\t// {n}\n\topen{k}(cfg)" for k, n in enumerate(notes)) + "\n}\n"


def sh(*notes):
    """A script with a note above a command on lines 2, 6 and 10."""
    return "set -eu\n" + "\n\n".join(f"# {n}\nrun{k} \"$1\"\n" for k, n in enumerate(notes))


GOLDEN = {
    "bash/attribution": (sh("Written by an intern over lunch.", "The loop is adapted from a mailing list."), "2:attribution 6:attribution"),
    "bash/banner": (sh("==========", "STEP 2", "--- SETUP ---").replace("STEP 2", "Step 2:"), "2:banner 6:banner 10:banner"),
    "bash/commentedOutCode": (sh("rm -rf \"$tmp\" && exit 1"), "2:commentedOutCode"),
    "bash/deadIgnore": ("#!/bin/sh\n# " + MARK + " narration — it was once so\n# The cache survives a reboot.\nrun \"$1\"\n", "2:deadIgnore"),
    "bash/density": ("f() {\n  # One reason a reader could not guess.\n  # Another that took a day to find.\n  # And a third about the kernel.\n  run \"$1\"\n}\n", "1:density"),
    "bash/detached": ("#!/bin/sh\nset -eu\n\n# The mirror drops idle sockets.\n\nrun \"$1\"\n", "4:detached"),
    "bash/docbloat": ("#!/bin/sh\nset -eu\n\n# Fetches a thing.\n# It waits.\n# It retries.\n# It gives up.\n# It says so.\n# It leaves.\n# It ends.\nget() {\n  one\n  two\n  three\n}\n", "4:docbloat"),
    "bash/hedging": (sh("This should work on every mirror.", "Kept for now as the host is slow."), "2:hedging 6:hedging"),
    "bash/ignoreReason": ("#!/bin/sh\n# " + MARK + " narration\n# Previously the cache was elsewhere.\nrun \"$1\"\n", "2:ignoreReason"),
    "bash/implInInterface": ("#!/bin/sh\nset -eu\n\n_spool_dir=/tmp/spool\n\n# Looks into _spool_dir before the network.\nfetch() {\n  cat \"$1\"\n}\n", "6:implInInterface"),
    "bash/narration": (sh("Previously the mirror came first.", "Moved to a second host."), "2:narration 6:narration"),
    "bash/restate": ("set -eu\n# fetch mirror\nfetch_mirror \"$1\"\n\n\nset -eu\n\n# retry count\nretry_count=3\n", "2:restate 8:restate"),
    "bash/task": (sh("TODO drop the mirror", "FIXME: quote the name"), "2:task 6:task"),
    "bash/vague": (sh("This handles the logic of mirrors.", "Reads names, hosts, etc."), "2:vague 6:vague"),
    "go/attribution": (go("Authored by the night shift.", "Based on code from a gist."), "4:attribution 8:attribution"),
    "go/banner": (go("**********", "Step 4", "## HELPERS").replace("## HELPERS", "HELPERS"), "4:banner 8:banner 12:banner"),
    "go/commentedOutCode": (go("if err != nil { return err }"), "4:commentedOutCode"),
    "go/deadIgnore": ("package p\n\nfunc Load() {\n\t// " + MARK + " hedging — it was once so\n\t// The server counts from one.\n\topen(cfg)\n}\n", "4:deadIgnore"),
    "go/density": ("package p\n\nfunc Load() {\n\t// The first of many reasons.\n\t// A second one.\n\t// A third one.\n\topen(cfg)\n}\n", "3:density"),
    "go/density/scoped": (
        "package p\n\nfunc Quiet() {\n\t// " + MARK + " density — each line stands for an outage\n\t// The first of many reasons.\n\t// A second one.\n\t// A third one.\n\topen(cfg)\n}\n\n"
        + "\n" * 8 + "\nfunc Loud() {\n\t// The first of many reasons.\n\t// A second one.\n\t// A third one.\n\topen(cfg)\n}\n", "20:density",
    ),
    "go/detached": ("package p\n\nfunc Load() {\n\topen(cfg)\n\n\t// The server counts from one.\n\n\tshut(cfg)\n}\n", "6:detached"),
    "go/docbloat": ("package p\n\n// Load opens it.\n// It waits.\n// It retries.\n// It gives up.\n// It says so.\n// It leaves.\n// It ends.\nfunc Load() {\n\ta()\n\tb()\n\tc()\n}\n", "3:docbloat"),
    "go/docbloat/type": ("package p\n\n// Pair has two.\n// One here.\n// One there.\n// Both count.\ntype Pair struct {\n\tA int\n}\n", "3:docbloat"),
    "go/fileref": (go("The table is in wire.go too.", "See (decode.go) first."), "4:fileref 8:fileref"),
    "go/hedging": (go("This probably holds.", "Kept if needed by the host."), "4:hedging 8:hedging"),
    "go/ignoreReason": ("package p\n\nfunc Load() {\n\t// " + MARK + " narration\n\t// Now we open it twice.\n\topen(cfg)\n}\n", "4:ignoreReason"),
    "go/implInInterface/package": ("// Package wire speaks through frameCodec.\npackage wire\n\ntype frameCodec struct{}\n", "1:implInInterface"),
    "go/implInInterface": ("package wire\n\ntype frameCodec struct{}\n\n// Send goes through frameCodec once.\nfunc Send() {}\n", "5:implInInterface"),
    "go/narration": (go("This now opens it first.", "Refactored to one call."), "4:narration 8:narration"),
    "go/restate": ("package p\n\nfunc Load() {\n\ta()\n\n\t// open the file\n\topenFile(x)\n\n\tb()\n\n\t// close file\n\tfileClose(x)\n}\n", "6:restate 11:restate"),
    "go/restate/trailing": ("package p\n\nfunc Load() {\n\tretryCount := 3 // retry count\n\ta()\n\n\tb()\n\n\tidleTime = 4 // the idle time\n}\n", "4:restate 9:restate"),
    "go/task": (go("TODO: shut it", "HACK around the host"), "4:task 8:task"),
    "go/vague": (go("It does the necessary.", "Opens as appropriate."), "4:vague 8:vague"),
}
#: Nothing is to be said of these.
CLEAN = {
    "go/density/above": ("package p\n\n// " + MARK + " density — each line stands for an outage\nfunc Load() {\n\t// The first of many reasons.\n\t// A second one.\n\t// A third one.\n\topen(cfg)\n}\n"),
    "go/density/struct": "package p\n\ntype Wire struct {\n\tHost string // as the broker prints it\n\tPort int    // zero means any\n\tTries int   // after the first\n}\n",
    "go/density/const": "package p\n\nconst (\n\t// Far is as the chart has it.\n\tFar = 3\n\t// Near is half of it.\n\tNear = 1\n)\n",
    "go/detached/tail": "package p\n\n// Load opens it.\n//\n//nolint:gocyclo\nfunc Load() {\n\topen(cfg)\n}\n",
    "go/carveouts": "//go:build linux\n// +build linux\n\npackage p\n\n//go:generate stringer\n//nolint:errcheck\nfunc f() {}\n",
    "python/carveouts": "#!/usr/bin/env python\n# -*- coding: utf-8 -*-\nimport a  # noqa: F401\nx = 1  # type: ignore\n# pylint: disable=all\ny = 2  # pragma: no cover\n",
    "rust/carveouts": "fn f() {\n    // SAFETY: the pointer is ours\n    unsafe { g() }\n}\n// cbindgen:ignore\nconst A: u8 = 1;\n",
    "java/carveouts": "// CHECKSTYLE:OFF\nclass A {\n  int b; // NOPMD\n  int c; // NOSONAR\n}\n// @formatter:on\n",
    "typescript/carveouts": "/// <reference path=\"a\" />\n// @ts-nocheck\n/* eslint-disable */\nlet a = 1; // prettier-ignore\nlet r = /https?:\\/\\//; let t = `// no ${`//`}`;\n",
    "swift/carveouts": "// MARK: - Helpers\n// swiftlint:disable all\nlet a = #\"x // TODO no\"b\"#\n",
    "bash/carveouts": "#!/bin/sh\n# shellcheck disable=SC2086\necho \"$#\" ${#a} '# TODO no'\ncat <<EOF\n# TODO no\nEOF\n",
}


@pytest.fixture(scope="module")
def report(spark):
    """One run over all of them; density is asked for in its own files only."""
    files = [(k.replace("/", "-"), k.split("/")[0], v[0] if isinstance(v, tuple) else v) for k, v in (GOLDEN | CLEAN).items()]
    found: dict[str, list[tuple[int, str]]] = {name: [] for name, _, _ in files}
    for r in check(spark.createDataFrame(files, "path string, lang string, content string"), Config()).findings.where("not suppressed").collect():
        if r.rule != "density" or "density" in r.path:
            found[r.path].append((r.line, r.rule))
    return {name: " ".join(f"{line}:{rule}" for line, rule in sorted(rows)) for name, rows in found.items()}


def test_expected_findings(report):
    assert {k: report[k.replace("/", "-")] for k in GOLDEN} == {k: want for k, (_, want) in GOLDEN.items()}
    assert sum(len(want.split()) for _, want in GOLDEN.values()) == 51


def test_nothing_to_say(report):
    assert {k: report[k.replace("/", "-")] for k in CLEAN} == dict.fromkeys(CLEAN, "")
