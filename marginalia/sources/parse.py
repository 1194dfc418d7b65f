"""The one step outside Spark SQL: a file's text to facts about its comments, code and declarations.

A scanner per language separates comments, strings and code; declarations come from Python's own
parser for Python and from an outline of bracketed statements for the others.  All offsets are bytes.
"""

from __future__ import annotations

import ast
import bisect
import re
import textwrap
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from ..plans.extend import PARSERS
from ..plans.vocabulary import LICENCE_OPENERS, MIN_CODE_NODES, SHELL_FUNCTION_WORDS
from .outline import TYPE, VARIANTS, Declaration, outline
from .scan import scan

_FUNCTION = re.compile(r"[ \t]*(?:function[ \t]+(?P<name>[\w:.-]+)[ \t]*(?:\([ \t]*\))?|(?P<name2>[\w:.-]+)[ \t]*\([ \t]*\))\s*(?=\{|\()")
_ASSIGNED = re.compile(r"(?:(?:export|readonly|declare|typeset|local)\s+(?:-\w+\s+)*)?(?P<name>[A-Za-z_]\w*)(?:\[[^\]]*\])?\+?=")
_COMMAND = re.compile(r"(?:^|[;|&({`]|\$\(|\b(?:then|do|else|if|while|until|elif|!)\s)\s*((?:[A-Za-z_]\w*\+?=\S*\s+)*)([\w./:-]+)")
_IDENT = re.compile(r"[^\W\d]\w*")
_CUT = re.compile(r"[_\-]+|(?<=[^A-Z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][^A-Z])")


def shell_names(line: str) -> list[str]:
    """Sorted parts of what a line of shell binds or calls: assigned variables, commands, a function's name; no arguments."""
    f = _FUNCTION.match(line)
    words = [f["name"] or f["name2"]] if f else [w for m in _COMMAND.finditer(line) for w in (m[2], *re.findall(r"(\w+)\+?=", m[1]))]
    words += [m["name"] for m in [_ASSIGNED.match(line.strip())] if m]
    return parts_of(" ".join(words))


def parts_of(code: str) -> list[str]:
    """Sorted lower-case identifier parts of a piece of code."""
    return sorted({p.lower() for w in _IDENT.findall(code) for p in _CUT.split(w) if p})


@dataclass
class Facts:
    comments: list[tuple] = field(default_factory=list)
    nodes: list[tuple] = field(default_factory=list)
    subjects: list[tuple] = field(default_factory=list)
    symbols: list[tuple] = field(default_factory=list)
    file_error: bool = False


class _Text:
    """Rows and byte offsets of character positions, each found by bisection."""

    def __init__(self, text: str):
        self.text = text
        self.rows = [0, *(m.end() for m in re.finditer("\n", text))]
        self.wide, self.extra = [], [0]
        for m in re.finditer(r"[^\x00-\x7f]+", text):
            for k, c in enumerate(m[0]):
                self.wide.append(m.start() + k)
                self.extra.append(self.extra[-1] + len(c.encode("utf-8", "surrogatepass")) - 1)

    def row(self, at: int) -> int:
        return bisect.bisect_right(self.rows, at) - 1

    def byte(self, at: int) -> int:
        return at + self.extra[bisect.bisect_left(self.wide, at)]


def strip_marks(lang: str, raw: str) -> str:
    """A comment's body without its marks."""
    if lang in ("python", "bash"):
        return raw[1:] if raw.startswith("#") else raw
    if raw.startswith("//"):
        body = raw[2:]
        return body[1:] if lang in ("rust", "swift") and body[:1] in ("/", "!") and body[:2] != "//" else body
    if raw.startswith("/*"):
        inner = raw[2:].removesuffix("*/")
        inner = inner[1:] if inner[:1] in ("*", "!") and inner[1:2] != "*" else inner
        return "\n".join(re.sub(r"^\s*\*(?!/)", "", x) if k else x for k, x in enumerate(inner.split("\n")))
    return re.sub(r"^<!--|-->$", "", raw)


def exported(lang: str, name: str, head: str, owner: str | None = None) -> str:
    """Visibility of a name by its head; ``owner``: that of the interface, enumeration, trait or class it's a member of."""
    if lang == "go":
        return "exported" if (name[:1].isupper() if not head.startswith("package") else name != "main") else "restricted"
    if lang == "python":
        return "restricted" if name.startswith("_") else "exported"
    if lang == "bash":
        return "private" if name.startswith("_") else "exported"
    head = head.split("(")[0] if not re.match(r"\s*pub\s*\(", head) else head
    if lang == "rust":
        return "restricted" if re.match(r"\s*pub\s*\(", head) else "exported" if re.match(r"\s*pub\b", head) else owner or "private"
    if re.search(r"\b(?:private|fileprivate)\b(?!\(set)", head) or name.startswith("#"):
        return "private"
    if lang == "java":
        return "exported" if re.search(r"\b(public|protected)\b", head) else owner or "restricted"
    if lang == "typescript":
        return "private" if re.search(r"\bprotected\b", head) else "exported" if re.search(r"\bexport\b", head) else owner or "restricted"
    return "exported" if re.search(r"\b(public|open)\b(?!\(set)", head) else owner or "restricted"


def _owned(lang: str, d: Declaration, vis: dict[int, str]) -> str | None:
    """Visibility that a member takes from what it's a member of, if it takes any."""
    up = d.parent
    if up is None:
        return None
    if lang == "rust":
        if up.head.startswith("impl") and re.search(r"\bfor\b", up.head):
            return "exported"
        return vis.get(id(up)) if d.owner == VARIANTS or re.search(r"\btrait\b", up.head) else None
    if lang == "java":
        return vis.get(id(up)) if d.owner == VARIANTS or re.search(r"\binterface\b", up.head) else None
    if lang == "swift":
        return vis.get(id(up)) if (d.owner == VARIANTS and "case" in d.head) or re.search(r"\bprotocol\b", up.head) else None
    return vis.get(id(up)) if d.owner in (TYPE, VARIANTS) else None


def is_doc_mark(lang: str, raw: str) -> bool:
    block = bool(re.match(r"/\*\*(?![*/])", raw))
    if lang == "rust":
        return block or bool(re.match(r"///(?!/)|//!|/\*!", raw))
    return block or (lang == "swift" and bool(re.match(r"///(?!/)", raw)))


def parse(lang: str, text: str) -> Facts:
    """Facts of one file.  An unknown construct is code; a file that can't be scanned whole has ``file_error``."""
    t, out = _Text(text), Facts()
    docstrings, tree = {}, None
    found, masked = scan(lang, text)
    code = masked
    errors: list[tuple[int, int]] = []
    subjects: list[dict] = []
    symbols: list[tuple[str, str]] = []
    end_row = len(t.rows) - 1
    if lang == "python":
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError) as e:
            row = max(0, (getattr(e, "lineno", None) or 1) - 1)
            tops = [r for r in range(end_row + 1) if text[t.rows[r] : t.rows[r] + 1].strip() not in ("", "#", ")", "]", "}")]
            errors.append((max([r for r in tops if r <= row], default=0), min([r - 1 for r in tops if r > row], default=end_row)))
            out.file_error = True
        if tree is not None:

            def at(n: ast.AST, end: bool = False) -> int:
                row, column = (n.end_lineno - 1, n.end_col_offset) if end else (n.lineno - 1, n.col_offset)
                line = text[t.rows[row] : t.rows[row + 1] if row < end_row else len(text)]
                return t.rows[row] + (column if line.isascii() else len(line.encode()[:column].decode("utf-8", "ignore")))

            for node in ast.walk(tree):
                if isinstance(node, ast.Module | ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                    doc = node.body[0] if node.body and isinstance(node.body[0], ast.Expr) and isinstance(node.body[0].value, ast.Constant) and isinstance(node.body[0].value.value, str) else None
                    root = isinstance(node, ast.Module)
                    s = {"a": 0 if root else at(node), "z": len(text) if root else at(node, True), "name": None if root else node.name, "vis": "exported" if root else exported(lang, node.name, ""), "members": len(node.body) - (doc is not None), "root": root, "row": -1 if root else node.lineno - 1}
                    subjects.append(s)
                    if doc is not None:
                        docstrings[at(doc)] = (at(doc, True), s)
            subjects.sort(key=lambda s: (s["a"], not s["root"]))
            symbols += [(s["name"], s["vis"]) for s in subjects if s["name"]]
            spans = sorted((a, z) for a, (z, _) in docstrings.items())
            edges = [0, *(x for span in spans for x in span), len(text)]
            code = "".join(masked[a:z] if k % 2 == 0 else re.sub(r"[^\n]", " ", text[a:z]) for k, (a, z) in enumerate(zip(edges[:-1], edges[1:], strict=True)))
    else:
        found_in, loose = (_shell(masked), []) if lang == "bash" else outline(lang, masked)
        if loose:
            out.file_error = True
            tops = [r for r in range(end_row + 1) if masked[t.rows[r] : t.rows[r] + 1].strip() not in ("", "}", ")")]
            for row in sorted({t.row(at) for at in loose}):
                k = bisect.bisect_right(tops, row)
                errors.append((tops[k - 1] if k else 0, tops[k] - 1 if k < len(tops) else end_row))
        if lang in ("rust", "bash"):
            subjects.append({"a": 0, "z": len(text), "vis": "exported", "members": sum(1 for r in t.rows if masked[r : r + 1].strip() not in ("", "}", ")")), "root": True, "row": -1})
        vis: dict[int, str] = {}
        for d in found_in:
            owner = _owned(lang, d, vis)
            vis[id(d)] = exported(lang, d.names[0] if d.names else "", d.head.strip(), owner)
            if d.symbol:
                symbols += [(name, exported(lang, name, d.head.strip(), owner)) for name in d.names]
            if d.listed:
                subjects.append({"a": d.a, "z": d.z, "vis": vis[id(d)], "members": d.members, "root": False, "row": t.row(d.a), "head": masked[d.a : d.head_end]})
    by_row: dict[int, int] = {}
    for k, s in enumerate(subjects):
        by_row.setdefault(s["row"], k)
    code_rows, bad = [], set()
    for x, y in errors:
        bad.update(range(x, y + 1))
    for r, start in enumerate(t.rows):
        line = code[start : t.rows[r + 1] if r < end_row else len(text)]
        if line.strip():
            a, z = start + len(line) - len(line.lstrip()), start + len(line.rstrip())
            k = by_row.get(r)
            names = shell_names(line) if lang == "bash" else parts_of((line if k is None else subjects[k].get("head") or line.split("{")[0]).replace("\x00", " "))
            out.nodes.append((t.byte(a), t.byte(z), r, r, k, names, r in bad))
            code_rows.append(r)
    items = [(a, z, None) for a, z in found] + [(a, z, s) for a, (z, s) in docstrings.items()]
    number = {id(s): k for k, s in enumerate(subjects)}
    first_code, runs_above = (code_rows[0] if code_rows else end_row + 1), {}
    for a, z, doc_of in sorted(items, key=lambda x: x[0]):
        raw = text[a:z]
        row = t.row(a)
        last = row + raw.rstrip().count("\n")
        trailing = bool(code[t.rows[row] : a].strip())
        kind = "block" if raw.startswith("/*") else "line"
        subject = number[id(doc_of)] if doc_of is not None else None
        is_doc = doc_of is not None
        if not is_doc and not trailing and lang != "python":
            k = bisect.bisect_left(code_rows, last + 1)
            below = code_rows[k] if k < len(code_rows) else None
            if lang == "go":
                is_doc, subject = below == last + 1 and below in by_row, by_row.get(below)
            elif lang == "bash":
                is_doc, subject = below == last + 1 and below in by_row, by_row.get(below)
                if not is_doc and row < first_code and not raw.startswith(("#!", "# shellcheck ")) and not re.match(rf"(?i)#\s*({'|'.join(LICENCE_OPENERS)})", raw) and runs_above.setdefault("end", row - 1) == row - 1:
                    is_doc, subject, runs_above["end"] = True, 0, last
            elif is_doc_mark(lang, raw):
                inner = raw.startswith(("//!", "/*!"))
                while below is not None and below not in by_row and re.match(r"\s*[#@]", code[t.rows[below] :]):
                    k += 1  # attributes and annotations stand between a comment and its declaration
                    below = code_rows[k] if k < len(code_rows) else None
                subject = 0 if inner else by_row.get(below)
                is_doc = subject is not None
        out.comments.append((t.byte(a), t.byte(z), row, last, strip_marks(lang, raw), trailing, is_doc, kind, subject if is_doc else None, a == 0 and text.startswith("#!")))
    for k, s in enumerate(subjects):
        lines = bisect.bisect_right(code_rows, t.row(max(s["a"], s["z"] - 1))) - bisect.bisect_left(code_rows, t.row(s["a"]))
        out.subjects.append((k, t.byte(s["a"]), t.byte(s["z"]), s["members"], lines, s["root"], s["vis"]))
    out.symbols += [(k, name, seen) for k, (name, seen) in enumerate(symbols)]
    return out


def _shell(masked: str) -> list[Declaration]:
    """Functions, and the variables that are assigned at the top."""
    out: list[Declaration] = []
    close, stack, depth = {}, [], []
    for m in re.finditer(r"[{}]", masked):
        if m[0] == "{":
            stack.append(m.start())
        elif stack:
            close[stack.pop()] = m.start()
    at, opened, nested = 0, sorted(close.items()), 0
    for line in masked.split("\n"):
        line += "\n"
        nested -= len(re.findall(r"(?:^|;)\s*(?:fi|done|esac)\b", line))
        stripped = at + len(line) - len(line.lstrip())
        while opened and opened[0][0] < at:
            a, z = opened.pop(0)
            depth.append(z)
        depth = [z for z in depth if z >= at]
        f = _FUNCTION.match(masked, at)
        if f and line.strip() and not f[0].strip().startswith("if "):
            body = f.end()
            z = close.get(body, at + len(line.rstrip()) - 1) + 1
            inside = [x for x in masked[body + 1 : z - 1].split("\n") if x.strip() and x.strip() not in ("}", "fi", "done", "esac", "then", "do", "else")]
            out.append(Declaration(stripped, z, body, [f["name"] or f["name2"]], masked[stripped:body], TYPE, len(inside)))
        elif not depth and nested <= 0 and (v := _ASSIGNED.match(line.strip())):
            out.append(Declaration(stripped, at + len(line.rstrip()), at + len(line.rstrip()), [v["name"]], line.strip(), TYPE, listed=False))
        nested += len(re.findall(r"(?:^|;|&&|\|\|)\s*(?:if|for|while|until|case|select)\b(?!.*;\s*(?:fi|done|esac)\b)", line))
        at += len(line)
    return out


FACTS = (
    "path string, lang string, file_error boolean, "
    "comments array<struct<start:long,end:long,start_row:long,end_row:long,body:string,is_trailing:boolean,is_doc:boolean,kind:string,doc_subject:long,is_shebang:boolean>>, "
    "nodes array<struct<start:long,end:long,start_row:long,end_row:long,subject:long,identifiers:array<string>,in_error:boolean>>, "
    "subjects array<struct<subject:long,start:long,end:long,member_count:long,code_lines:long,file_scope:boolean,vis:string>>, "
    "symbols array<struct<ord:long,name:string,vis:string>>"
)


def _named(rows: list[tuple], names: str) -> list[dict]:
    keys = names.split()
    return [dict(zip(keys, r, strict=True)) for r in rows]


def facts(files: DataFrame) -> DataFrame:
    """One row of nested facts per file (path, lang, content); the text goes no further than this."""
    added = dict(PARSERS)  # goes to the executors with the function

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, lang, content in zip(b["path"], b["lang"], b["content"], strict=True):
                f = added[lang](content) if lang in added else parse(lang, content)
                rows.append({
                    "path": path, "lang": lang, "file_error": f.file_error,
                    "comments": _named(f.comments, "start end start_row end_row body is_trailing is_doc kind doc_subject is_shebang"),
                    "nodes": _named(f.nodes, "start end start_row end_row subject identifiers in_error"),
                    "subjects": _named(f.subjects, "subject start end member_count code_lines file_scope vis"),
                    "symbols": _named(f.symbols, "ord name vis"),
                })
            yield pd.DataFrame(rows, columns=["path", "lang", "file_error", "comments", "nodes", "subjects", "symbols"])

    return files.select("path", "lang", "content").mapInPandas(run, FACTS)


def is_code(lang: str, body: str) -> bool:
    """Whether a comment body reads as statements of its language rather than as a sentence."""
    text = textwrap.dedent(body).strip("\n")
    if not re.search(r"[^\W\d_]", text):
        return False
    if lang == "python":
        try:
            tree = ast.parse(text.strip())
        except (SyntaxError, ValueError, RecursionError):
            return False
        trivial = all(isinstance(s, ast.Expr) and isinstance(s.value, ast.Name | ast.Constant | ast.Tuple | ast.BinOp | ast.Compare) or isinstance(s, ast.AnnAssign) and s.value is None for s in tree.body)
        return not trivial and sum(isinstance(n, ast.stmt | ast.expr) for n in ast.walk(tree)) >= MIN_CODE_NODES
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    if lang == "bash":
        words = [w for x in lines for w in x.split()]
        prose = any(a in text for a in ("->", "=>", "<-")) or any(not w.startswith("-") and (w.lower() in SHELL_FUNCTION_WORDS or re.search(r"[\w\"'`)][.,:;!?]$", w)) for w in words)
        return not prose and bool(re.search(r"\$[\w{(]|(?<!\|)\|(?!\|)|&&|\|\||[<>]|^\w+=|\[\[?\s|(?:^|\s)--?\w", re.sub(r"`[^`]*`", "", text), re.M))
    if not re.search(r"[=(){}\[\];]", text) and not re.match(r"(return|break|continue|import|use|package)\b\s*[\w.:]+;?$", text):
        return False
    shape = re.compile(r"[\w.$\[\]*&<>:, ]+\s*(:=|[+\-*/|&]?=(?!=))\s*\S.*|(return|throw|break|continue|import|use|defer|go)\b.*[;)\w]$|(if|for|while|switch|match|guard|else|func|fn|function|class|let|var|const|try|catch)\b.*[{};)]$|[\w.$:]+(!|\?)?\([^)]*\)?.*[;,){]$|[\w.$:]+\([^()]*\)$|[})\]]+[;,]?.*|.*[{;]$")
    prose = re.compile(r"\b(the|a|an|is|are|this|that|which|because|when|should)\b\s+\w+\s+\w+", re.I)
    return all(shape.fullmatch(x) for x in lines) and not prose.search(re.sub(r'"[^"]*"', "", text))
