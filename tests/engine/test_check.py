"""Files in, findings out."""

import pytest
from marginalia.check import check, corrected
from marginalia.plans.registry import Config, defaults_toml, registry_rows

GO = """// Package p does x.
package p

// previously this was elsewhere
func one() {}

// ----------
func two() {
	x := 1 // TODO fix it
	// x := foo(1)
	return
}

// orphan note

// marginalia:ignore narration — history matters here
// now we go on
func three() {}

// marginalia:ignore hedging
// plain words about nothing in particular
func four() {}

// See parser.go for this.
func five() {}

// Six calls hidden() first.
func Six() {}

func hidden() {}
"""
PY = '"""Module."""\n\n\ndef f(x):\n    """Does f, etc."""\n    y = x\n    # updated to return x\n    return y\n'


@pytest.fixture(scope="module")
def files(spark):
    rows = [("a/b.go", "go", GO), ("a-b.py", "python", PY), ("gen.go", "go", "// Code generated by x. DO NOT EDIT.\npackage p\n// previously\n"), ("vendor/x.go", "go", "package p\n// previously\n"), ("e.go", "go", ""), ("n.go", "go", None), ("bad.go", "go", "package p\nfunc f() {\n// restated\n")]
    return spark.createDataFrame(rows, "path string, lang string, content string")


@pytest.fixture(scope="module")
def report(files):
    return check(files)


def test_findings(report):
    got = {(r.path, r.line, r.rule, r.suppressed) for r in report.findings.collect()}
    want = {
        ("a/b.go", 7, "banner", False), ("a/b.go", 9, "task", False), ("a/b.go", 10, "commentedOutCode", False), ("a/b.go", 14, "detached", False),
        ("a/b.go", 17, "narration", True), ("a/b.go", 20, "ignoreReason", False), ("a/b.go", 20, "deadIgnore", False), ("a/b.go", 24, "fileref", False),
        ("a/b.go", 4, "narration", False), ("a/b.go", 27, "implInInterface", False), ("a-b.py", 5, "vague", False), ("a-b.py", 7, "narration", False),
    }
    assert {x for x in got if x[2] != "density"} == want
    assert not {x[0] for x in got} & {"gen.go", "vendor/x.go", "e.go", "n.go"}


def test_renderings(report):
    human = [r.text for r in report.human().collect()]
    assert human == sorted(human, key=lambda x: "withheld" in x) and any(x.startswith("a/b.go:9:9: warn [task] add an issue reference to this TODO") for x in human)
    assert any(x.startswith("bad.go: not fully analysed; rules withheld: ") and "detached" in x for x in human)
    assert [x.split("\t")[0] for x in (r.text for r in report.machine().collect())].count("finding") == report.findings.where("not suppressed").count()
    assert report.exit_code() == 1


def test_config():
    with pytest.raises(ValueError, match="unknown rule nope"):
        Config.parse("[rules.nope]\nenabled = false\n[languages.go.rules.banner]\ntier = 'loud'\n")
    assert registry_rows(Config.parse(defaults_toml())) == registry_rows(Config())


def test_fix(files):
    out = {r.path: r.content for r in corrected(files).collect()}
    assert out.keys() == {"a-b.py"} and out["a-b.py"] == PY.replace("    # updated to return x\n", "")
