"""Declarations of a file in a language of braces, in one pass over its tokens.

Every bracket opens a frame.  A frame knows what its statements may be: items of a file, members of a type,
variants of an enumeration, specs of a group, code, or nothing.  A statement ends at a semicolon, at a line end or
comma where its language and frame say so, or with the block that closes it; its head decides what it declares.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

FILE, TYPE, FIELDS, VARIANTS, GROUP, CODE, OTHER = "file", "type", "fields", "variants", "group", "code", "other"


@dataclass
class Declaration:
    """a, z: the statement.  head_end: where its body opens, else z.  owner: frame it stands in."""

    a: int
    z: int
    head_end: int
    names: list[str]
    head: str
    owner: str
    members: int = 0
    listed: bool = True
    symbol: bool = True
    parent: Declaration | None = None


@dataclass
class _Frame:
    kind: str
    opener: str
    at: int
    mine: Declaration | None = None  # whose body this is
    counted: Declaration | None = None  # whose members are counted here
    start: int | None = None
    last: int = 0
    n: int = 0
    closed: bool = False  # the statement ended in a block
    now: Declaration | None = None


_MODS = r"(?:(?:public|private|protected|internal|package|fileprivate|open|static|final|abstract|override|async|export|default|declare|readonly|mutating|nonmutating|sealed|non-sealed|synchronized|native|transient|volatile|strictfp|lazy|weak|unowned|required|convenience|dynamic|indirect|nonisolated|accessor|get|set|public\(set\)|private\(set\)|fileprivate\(set\)|internal\(set\))\s+)*"
_NOTE = re.compile(r"(?:#!?\[(?:[^\[\]]|\[[^\]]*\])*\]|@(?!interface\b)[\w.]+(?:\s*\((?:[^()]|\([^()]*\))*\))?)\s*")
_ONLY_NOTES = re.compile(f"(?:{_NOTE.pattern})+")
_NAMES = r"(?P<name>\w+(?:\s*,\s*\w+)*)"
_GO = {
    FILE: rf"package\s+(?P<name>\w+)|func\s*(?:\([^)]*\)\s*)?(?P<name2>\w+)|(?:const|var|type)\s+{_NAMES.replace('<name>', '<name3>')}|(?P<name4>(?:const|var|type)(?=\s*\(?\Z))",
    GROUP: _NAMES, TYPE: rf"{_NAMES}|(?P<name2>\*?[\w.]+)|(?P<name3>[~\w].*)",
}
_RUST_ITEM = r"(?:pub(?:\s*\([^)]*\))?\s+)?(?:(?:default|async|unsafe|const|safe|extern(?:\s*\x00+)?)\s+)*(?:(?:fn|struct|enum|union|trait|mod|type|static(?:\s+mut)?|const|macro_rules!)\s+(?P<name>\w+)|impl\b(?P<name2>(?:\s*<[^{]*?>)?))"
_RUST = {FILE: _RUST_ITEM, TYPE: _RUST_ITEM, CODE: _RUST_ITEM, FIELDS: r"(?:pub(?:\s*\([^)]*\))?\s+)?(?P<name>\w+)\s*:(?!:)", VARIANTS: r"(?P<name>\w+)"}
_JAVA_TYPE = rf"{_MODS}(?:class|interface|enum|record|@interface)\s+(?P<name>\w+)"
_JAVA_MEMBER = rf"{_MODS}(?:<[^>]*>\s*)?(?!(?:return|new|else|throw|case|if|for|while|switch|do|try|assert|yield|package|import|static\s*\Z)\b)(?:[\w.]+(?:<[^=;(]*>)?(?:\s*\[\s*\])*(?:\.\.\.)?\s+)?(?P<name2>\w+)\s*(?:\(|=|,|\[|\Z)"
_JAVA = {FILE: _JAVA_TYPE, TYPE: f"{_JAVA_TYPE}|{_JAVA_MEMBER}", VARIANTS: rf"{_JAVA_TYPE}|(?P<name2>\w+)\s*(?:\(|\Z)", CODE: _JAVA_TYPE}
_TS_LOCAL = rf"{_MODS}(?:function\s*\*?|class|interface|(?:const\s+)?enum|type|namespace|module)\s+(?P<name>[\w$.\x00]+)"
_TS = {
    FILE: rf"{_TS_LOCAL}|{_MODS}(?:const|let|var)\s+(?P<name2>[\w$]+)|(?:export\s+default\s+(?:async\s+)?(?:class|function)\b)(?P<name3>)|declare\s+(?P<name4>global)\b", CODE: _TS_LOCAL,
    TYPE: rf"{_MODS}\*?\s*(?P<name>[\w$#]+|\x00+|\[[^\]]*\]|(?=\())\s*[?!]?\s*(?:[:=(<]|\Z)", VARIANTS: r"(?P<name>[\w$]+|\x00+)",
}
_SWIFT_TYPE = rf"{_MODS}(?:class|struct|enum|protocol|extension|actor)\s+(?!func\b|var\b|let\b)(?P<name>[\w.]+)|{_MODS}(?:class\s+)?(?:func\s+(?P<name2>\w+|[^\s\w(]+)|typealias\s+(?P<name3>\w+))"
_SWIFT_ITEM = rf"{_SWIFT_TYPE}|{_MODS}(?:class\s+)?(?:(?:var|let|associatedtype|macro|precedencegroup|(?:prefix|infix|postfix)\s+operator)\s+(?P<name4>[^\s:=<{{]+)|(?P<name5>init|deinit|subscript)\b)"
_SWIFT = {FILE: _SWIFT_ITEM, TYPE: _SWIFT_ITEM, VARIANTS: rf"{_MODS}case\s+{_NAMES.replace('<name>', '<name6>')}|{_SWIFT_ITEM}", CODE: _SWIFT_TYPE}
_HEADS = {lang: {k: re.compile(v) for k, v in table.items()} for lang, table in (("go", _GO), ("rust", _RUST), ("java", _JAVA), ("typescript", _TS), ("swift", _SWIFT))}
#: Frame that a declared body opens, by what its head says; first match wins.
_BODIES = {
    "go": [(r"\b(?:struct|interface)\s*\Z", TYPE)],
    "rust": [(r"\b(?:fn|macro_rules!)\b", CODE), (r"\benum\b", VARIANTS), (r"\b(?:struct|union)\b", FIELDS), (r"\b(?:impl|trait|mod|extern)\b", TYPE)],
    "java": [(r"\benum\s+\w+[^=(]*\Z", VARIANTS), (r"(?:\b(?:class|interface|record)|@interface)\s+\w+[^=]*\Z", TYPE), (r"=\s*\Z|\[\s*\]\s*\Z", OTHER)],
    "typescript": [(r"\benum\s+\S+\s*\Z", VARIANTS), (r"\b(?:class|interface)\b[^=]*\Z|\btype\s+[^=]*=\s*\Z", TYPE), (r"\b(?:namespace|module|global)\b[^=]*\Z", FILE), (r"\bclass\b[^=(]*\Z", TYPE), (r"=\s*\Z|:\s*\Z", OTHER)],
    "swift": [(r"\benum\s+[\w.]+[^=]*\Z", VARIANTS), (r"\b(?:class|struct|protocol|extension|actor)\s+(?!func\b|var\b|let\b)[^=]*\Z", TYPE)],
}
_BODIES = {k: [(re.compile(p), kind) for p, kind in v] for k, v in _BODIES.items()}
_TOKENS = re.compile(r"\n|[{}()\[\];,]|[^\s{}()\[\];,]+")
_GOES_ON = frozenset("else catch finally while where throws rethrows".split())
_CLOSES = {")": "(", "]": "[", "}": "{"}
_OPEN_END = re.compile(r"(?:[-+*/%&|^<>=!.:?,(~]|\b(?:else|return|extends|implements|where|in|is|as))\Z")
_GO_OPEN_END = re.compile(r"(?:(?<!\+)\+|(?<!-)-|[*/%&|^<>=!.:,(])\Z")
_NEXT_GOES_ON = re.compile(r"\s*(?:[.{?:&|=*/%,)\]]|[-+](?![-+])|=>|->|else\b|where\b|catch\b|extends\b|implements\b|throws\b)")


def outline(lang: str, masked: str) -> tuple[list[Declaration], list[int]]:
    """Declarations by start, and the brackets without a partner.  ``masked`` has neither comments nor strings."""
    heads, bodies = _HEADS[lang], _BODIES[lang]
    found: list[Declaration] = []
    loose: list[int] = []
    root = _Frame(FILE, "", 0)
    stack = [root]

    def declare(f: _Frame, end: int) -> Declaration | None:
        """What the statement of a frame declares, judged by its text up to ``end``."""
        pattern = heads.get(f.kind)
        if pattern is None or f.start is None:
            return None
        a = f.start
        while end > a and masked[end - 1] in ";, \t\n":
            end -= 1
        while m := _NOTE.match(masked, a, end):
            a = m.end()
        m = pattern.match(masked, a, end)
        if not m or (not m.group().strip() and f.kind != TYPE):
            return None
        names = next((g for k, g in sorted(m.groupdict().items()) if g is not None), "")
        head = masked[a:end]
        if lang == "rust" and m.groupdict().get("name2") is not None:
            names = ""  # an impl declares nothing new
        d = Declaration(a if lang == "rust" else f.start, end, end, [x.strip() for x in names.split(",") if x.strip(" \x00")], head, f.kind, parent=f.mine)
        if lang == "go":
            spec = f.kind == GROUP and f.mine is not None and f.mine.head.startswith("type")
            grouped = m.groupdict().get("name4") is not None
            d.listed = not spec
            d.symbol = (f.kind == FILE and not head.startswith("package") and not grouped) or f.kind == GROUP
            d.names = [] if grouped else d.names
            if f.kind == FILE and re.match(r"(?:const|var)\b", head) and not grouped:
                d.members = 1
        if lang == "swift" and re.search(r"\b(?:extension|init|deinit|subscript)\b[^=]*\Z", head):
            d.symbol = False
        found.append(d)
        return d

    def finish(f: _Frame) -> None:
        if f.start is None:
            return
        d = f.now or declare(f, f.last)
        if d is not None:
            d.z = max(f.last, d.a + 1)
        if d is not None or not _ONLY_NOTES.fullmatch(masked, f.start, f.last):
            f.n += 1
        f.start, f.now, f.closed = None, None, False

    def word(f: _Frame, a: int, z: int) -> None:
        if f.start is None:
            f.start = a
        f.last = z

    def body_kind(f: _Frame, head: str, declared: bool) -> str:
        if f.opener in ("(", "[") and f.kind != GROUP:
            return TYPE if lang == "go" and re.search(r"\b(?:struct|interface)\s*\Z", head) else CODE if lang in ("typescript", "swift", "rust", "go") else OTHER
        for pattern, kind in bodies:
            if (declared or lang == "go") and pattern.search(head):
                return kind
        return {"java": TYPE, "rust": FIELDS}.get(lang, CODE) if f.kind == VARIANTS else CODE

    for m in _TOKENS.finditer(masked):
        t, a, f = m[0], m.start(), stack[-1]
        if f.closed and t != "\n":
            if not (t in _GOES_ON or t in ",;).]" or t[0] in ".?:=&|*/" or (t in "([" and f.kind == OTHER)):
                finish(f)
            f.closed = False
        if t == "\n":
            if f.start is None or f.opener in ("(", "[") and f.kind != GROUP or lang not in ("go", "swift", "typescript"):
                continue
            if lang == "go":
                if f.kind != OTHER and not _GO_OPEN_END.search(masked, max(0, f.last - 12), f.last):
                    finish(f)
            elif f.kind != OTHER and not _OPEN_END.search(masked, max(0, f.last - 12), f.last) and not _NEXT_GOES_ON.match(masked, a):
                finish(f)
        elif t in "{([":
            word(f, a, a + 1)
            head = masked[f.start : a]
            if t == "{":
                d = f.now or declare(f, a)
                kind = body_kind(f, head, d is not None)
                first = d is not None and (f.now is None or d.head_end == d.z)
                f.now = d
                if first:
                    d.head_end = a
                counts = first and kind != OTHER and not (lang == "go" and f.kind != FILE) and not (lang == "typescript" and (kind == CODE or re.match(r"(?:export\s+|declare\s+)*type\b", d.head)))
                stack.append(_Frame(kind, t, a, d, d if counts else None))
            elif t == "(" and lang == "go" and f.kind in (FILE, CODE) and re.search(r"\A(?:const|var|type|import)\s*\Z", head):
                d = declare(f, a) if f.kind == FILE and not head.startswith("import") else None
                f.now = d
                if d is not None:
                    d.head_end = a
                stack.append(_Frame(GROUP if d is not None else CODE, t, a, d, d if d is not None and not head.startswith("type") else None))
            else:
                stack.append(_Frame(OTHER, t, a))
        elif t in "})]":
            if len(stack) == 1 or f.opener != _CLOSES[t]:
                loose.append(a)
                continue
            finish(f)
            stack.pop()
            if f.counted is not None:
                f.counted.members = f.n
            up = stack[-1]
            word(up, up.start if up.start is not None else a, a + 1)
            up.closed = t == "}" and up.kind in (FILE, TYPE, CODE, VARIANTS) and f.kind != OTHER and up.opener not in ("(", "[")
        elif t == ";":
            word(f, a, a + 1) if f.start is not None else None
            if f.opener not in ("(", "["):
                finish(f)
                if f.kind == VARIANTS and lang == "java":
                    f.kind = TYPE  # members follow the constants
        elif t == ",":
            if f.opener not in ("(", "[") and (f.kind in (FIELDS, VARIANTS) and lang != "swift" or f.kind == TYPE and lang == "typescript"):
                finish(f)
            else:
                word(f, a, a + 1) if f.start is not None else None
        else:
            word(f, a, m.end())
    loose += [f.at for f in stack[1:]]
    while stack:
        finish(stack.pop())
    return sorted((d for d in found if d.listed or d.symbol), key=lambda d: (d.a, -d.z)), loose
