"""Files found, read, parsed and rewritten; the command; rules and languages of one's own."""

import subprocess
import sys
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from marginalia import BlockRule, Config, SubjectRule, check, register_language, unregister_language
from marginalia.__main__ import main, replace_text
from marginalia.plans.registry import discover
from marginalia.sources import files as S
from marginalia.sources.parse import Facts, is_code, parse

ROOT = Path(__file__).resolve().parents[2]


@pytest.fixture
def tree(tmp_path):
    for name in ("b.go", "a/x.py", "a/.hidden.py", "a/__init__.py", ".git/config", "a/.cache/y.py", "vendor/z.go", "a/testdata/t.go", "a-b/q.sh"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("# text\n")
    return tmp_path


def git(folder, *args):
    subprocess.run(["git", "-C", str(folder), "-c", "user.name=n", "-c", "user.email=n@example.org", *args], check=True, capture_output=True)


def test_walk(tree):
    found = [str(Path(p).relative_to(tree)) for p in S.walk([str(tree), str(tree / "b.go")])]
    assert found == ["a/.hidden.py", "a/__init__.py", "a/x.py", "a-b/q.sh", "b.go"]
    assert len(S.walk([str(tree)], ())) == 7 and S.walk([str(tree / "nowhere")]) == []


def test_changed_since(tree):
    with pytest.raises(ValueError, match="rev-parse"):
        S.changed_since("HEAD", str(tree))
    for x in (tree / ".git").iterdir():
        x.unlink()
    git(tree, "init", "-q")
    with pytest.raises(ValueError, match="no such revision"):
        S.changed_since("main", str(tree))
    git(tree, "add", "b.go", "a/x.py", "vendor")
    git(tree, "commit", "-qm", "one")
    git(tree, "tag", "first")
    (tree / "a/x.py").write_text("# more\n")
    git(tree, "commit", "-qam", "two")
    (tree / "b.go").unlink()
    (tree / "vendor/z.go").write_text("// changed\n")
    found = {str(Path(p).relative_to(tree)) for p in S.changed_since("first", str(tree / "a"))}
    assert found == {"a/x.py", "vendor/z.go", "a/.hidden.py", "a/__init__.py", "a/.cache/y.py", "a/testdata/t.go", "a-b/q.sh"}
    with pytest.raises(ValueError, match="no such revision: nothing"):
        S.changed_since("nothing", str(tree))


def test_staged_files_are_those_of_the_index(tree, tmp_path_factory):
    for x in (tree / ".git").iterdir():
        x.unlink()
    git(tree, "init", "-q")
    (tree / "b.go").write_text("// staged\n")
    git(tree, "add", "b.go", "a/x.py")
    (tree / "b.go").write_text("// not staged\n")
    out = tmp_path_factory.mktemp("index")
    assert [str(Path(p).relative_to(out)) for p in S.staged(str(tree), str(out))] == ["a/x.py", "b.go"]
    assert (out / "b.go").read_text() == "// staged\n"


def test_read(spark, tree):
    (tree / "bad.go").write_bytes(b"\xff\xfe\x00")
    (tree / "tool").write_text("#!/usr/bin/env -S bash -e\n# text\n")
    files, bad = S.read(spark, S.walk([str(tree)]) + [str(tree / "gone.py")])
    assert sorted((Path(r.path).name, r.lang) for r in files.collect()) == [(".hidden.py", "python"), ("__init__.py", "python"), ("b.go", "go"), ("q.sh", "bash"), ("tool", "bash"), ("x.py", "python")]
    assert {Path(r.path).name for r in bad.collect()} == {"bad.go", "gone.py"} and all(r.reason for r in bad.collect())


def test_discover(tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    assert discover(tmp_path / "a/b", "none-such.toml") is None
    (tmp_path / "m.toml").write_text("")
    assert discover(tmp_path / "a/b", "m.toml") == tmp_path / "m.toml"
    (tmp_path / "a/m.toml").write_text("")
    assert discover(tmp_path / "a/b", "m.toml") == tmp_path / "a/m.toml"


def test_rewrite_is_whole_or_not_at_all(tmp_path):
    path = tmp_path / "s.sh"
    path.write_text("old")
    path.chmod(0o755)
    replace_text(str(path), "né\r\nw")
    assert path.read_bytes() == "né\r\nw".encode() and path.stat().st_mode & 0o777 == 0o755
    with pytest.raises(UnicodeEncodeError):
        replace_text(str(path), "\ud800")
    assert path.read_bytes() == "né\r\nw".encode()


def test_command(tmp_path, capsys, monkeypatch):
    monkeypatch.chdir(tmp_path)
    assert main(["defaults"]) == 0 and "[rules.narration]" in capsys.readouterr().out
    assert main(["check", "--since", "HEAD"]) == 2 and "git" in capsys.readouterr().err
    (tmp_path / "bad.toml").write_text("[rules.nonsense]\nenabled = true\n")
    assert main(["check", "--config", "bad.toml"]) == 2 and "unknown rule nonsense" in capsys.readouterr().err
    for args, code in ((["--version"], 0), (["check", "--since", "HEAD", "x"], 2), (["nothing"], 2)):
        with pytest.raises(SystemExit) as e:
            main(args)
        assert e.value.code == code
    done = subprocess.run([sys.executable, "-m", "marginalia", "--version"], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0 and done.stdout.startswith("marginalia ")


SOURCES = {
    "go": ("package p\n\ntype T struct {\n\tA, b string // one\n\tIn struct{ C int }\n}\n\nvar q, R = `// no`, '\"'\n\nfunc (t *T) do(a int,\n\tb int) {\n\tvar local = 1\n}\n", {"T", "q", "R", "do"}, ["// one"], 7),
    "rust": ("#[derive(X)]\npub struct P { pub a: u8 }\n/* a /* b */ c */\nimpl D for P { fn go<'a>(&self) { let s = r#\"/* \" no */\"#; } }\nenum E { A, B { x: u8 } }\n", {"P", "a", "go", "E", "A", "B", "x"}, ["/* a /* b */ c */"], 9),
    "java": ("@A(\"}\")\npublic class C<T> {\n  private List<T> m = \"\"\"\n  // no \" }\n  \"\"\";\n  enum K { ONE, TWO { void f() {} } }\n  <R> R get(int a) { int local; return null; } // yes\n}\n", {"C", "m", "K", "ONE", "TWO", "f", "get"}, ["// yes"], 7),
    "typescript": ("export class C {\n  #p = /[/\"]\\/\\//; // yes\n  f(a = 1 / 2 / 3) { return `${`//`} // no`; }\n}\nconst k = a / b; // two\nfunction g() { const local = 1; }\n", {"C", "#p", "f", "k", "g"}, ["// yes", "// two"], 5),
    "swift": ("class C {\n  let s = #\"a // no\"b\"# /* x /* y */ z */\n  func f() { let local = 1 }\n}\nenum E { case a, b }\n", {"C", "s", "f", "E", "a", "b"}, ["/* x /* y */ z */"], 5),
    "bash": ("_v=1\nf() {\n  echo \"# no\" $# # yes\n}\nif true; then\n  w=2\nfi\n", {"_v", "f"}, ["# yes"], 2),
    "python": ("def f():\n    '''D # no'''\n    x = '#'  # yes\n\n\nclass C:\n    pass\n", {"f", "C"}, ["# yes", "'''D # no'''"], 3),
}


@pytest.mark.parametrize("lang", sorted(SOURCES))
def test_parse(lang):
    text, names, comments, subjects = SOURCES[lang]
    f = parse(lang, text)
    raw = text.encode()
    assert not f.file_error and {n for _, n, _ in f.symbols} == names
    assert sorted(raw[c[0] : c[1]].decode() for c in f.comments) == sorted(comments) and len(f.subjects) == subjects


@pytest.mark.parametrize(("lang", "text"), [("go", "package p\nfunc f() {\n"), ("java", "class A { int[] b = {1, 2; }"), ("python", "def f(:\n"), ("rust", "fn f() { (] }")])
def test_broken_files_are_flagged(lang, text):
    assert parse(lang, text).file_error


@pytest.mark.parametrize("lang", sorted(SOURCES))
def test_parse_takes_linear_time(lang):
    took = []
    for n in (40, 320):
        text = ("# é\n" if lang in ("python", "bash") else "// é\n") + SOURCES[lang][0] * n
        began = time.process_time()
        parse(lang, text)
        took.append(time.process_time() - began)
    assert took[1] < 20 * took[0] + 0.2


def test_code_in_comments():
    assert is_code("go", "if err != nil { return err }") and is_code("bash", 'rm -rf "$tmp" && exit 1') and is_code("python", "x = f(1)")
    assert not is_code("go", "the server counts from one") and not is_code("bash", "as the host likes it") and not is_code("python", "note: x")


def _notes(text):
    """A language of lines: those that begin with a semicolon are comments."""
    out, at = Facts(), 0
    for row, line in enumerate(text.split("\n")):
        end = at + len(line.encode())
        if line.startswith(";"):
            out.comments.append((at, end, row, row, line[1:], False, False, "line", None, False))
        elif line.strip():
            out.nodes.append((at, end, row, row, None, [], False))
        at = end + 1
    return out


def test_own_rules_and_languages(spark):
    register_language("lines", _notes, ["ln"])
    try:
        with pytest.raises(ValueError, match="already"):
            register_language("go", _notes, ["go"])
        many = SubjectRule("many", lambda blocks, subjects: subjects.where("code_lines > 2 and not file_scope").select("path", "start", "end", F.lit("go").alias("lang"), F.lit("line").alias("kind"), F.lit(None).cast("int").alias("block"), F.lit("split this").alias("instruction")))
        config = Config(extra_rules=(BlockRule("shout", lambda: F.when(F.col("body").contains("!"), F.lit("say it calmly"))), many))
        assert config.problems() == [] and Config(extra_rules=(BlockRule("task", F.col),)).problems() == ["rule task is there already"]
        files = [("a.ln", "lines", "; stop!\nx\n; TODO it\ny\n"), ("b.go", "go", "package p\n\n// Hey!\nvar x = 1\n\nfunc f() {\n\ta()\n\tb()\n}\n")]
        found = check(spark.createDataFrame(files, "path string, lang string, content string"), config).findings
        assert {(r.path, r.line, r.rule, r.tier, r.instruction[:5]) for r in found.collect()} == {
            ("a.ln", 1, "shout", "warn", "say i"), ("a.ln", 3, "task", "warn", "add a"), ("b.go", 3, "shout", "warn", "say i"), ("b.go", 6, "many", "warn", "split"),
        }
    finally:
        unregister_language("lines")


def test_watch(spark, tmp_path):
    from marginalia.streaming.watch import watch

    rows = [("a.go", "go", "package p\n\n// Previously x\nvar y = 1\n")]
    spark.createDataFrame(rows, "path string, lang string, content string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("path string, lang string, content string").parquet(f"{tmp_path}/in")
    watch(stream, f"{tmp_path}/out", f"{tmp_path}/state", once=True).awaitTermination(300)
    assert [(r.path, r.rule) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [("a.go", "narration")]
