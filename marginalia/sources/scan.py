"""Comments, strings and code of a text, told apart by a scanner per language; all offsets are characters."""

from __future__ import annotations

import re

_STRING = r'"(?:\\.|[^"\\\n])*"?'
_TOKEN = {
    "go": rf"(?P<line>//[^\n]*)|(?P<block>/\*)|{_STRING}|`[^`]*`?|'(?:\\.|[^'\\\n])+'",
    "rust": r"(?P<line>//[^\n]*)|(?P<block>/\*)|(?<!\w)[bc]?r(?P<q>\#*)\".*?(?:\"(?P=q)|\Z)|\"(?:\\.|[^\"\\])*\"?|'(?:\\[^']*|[^'\\\n])'",
    "java": rf'(?P<line>//[^\n]*)|(?P<block>/\*)|"""(?:\\.|.)*?(?:"""|\Z)|{_STRING}|\'(?:\\.|[^\'\\\n])+\'',
    "typescript": rf"(?P<line>//[^\n]*|<!--[^\n]*)|(?P<block>/\*)|(?P<slash>/)|(?P<tick>`)|{_STRING}|'(?:\\.|[^'\\\n])*'?",
    "swift": rf'(?P<line>//[^\n]*)|(?P<block>/\*)|(?P<q>\#+)(?P<m>"""|").*?(?:(?P=m)(?P=q)|\Z)|"""(?:\\.|.)*?(?:"""|\Z)|{_STRING}',
    "python": r'(?P<line>\#[^\n]*)|[rRbBuUfFtT]{0,2}(?:"""(?:\\.|.)*?(?:"""|\Z)|\'\'\'(?:\\.|.)*?(?:\'\'\'|\Z)|"(?:\\.|[^"\\\n])*"?|\'(?:\\.|[^\'\\\n])*\'?)',
    "bash": r"(?P<line>(?:(?<=[\s;(&|])|^|\A)\#[^\n]*)|<<-?\s*(?P<q>['\"]?)(?P<w>\w+)(?P=q).*?\n\s*(?P=w)\b|'[^']*'?|\"(?:\\.|[^\"\\])*\"?|(?P<keep>\\.|\$\#|\$\{\#)",
}
_TOKEN = {k: re.compile(v, re.S | (re.M if k == "bash" else 0)) for k, v in _TOKEN.items()}
_NESTED = frozenset({"rust", "swift"})
_EDGE = re.compile(r"/\*|\*/")
_TICK_TEXT, _TICK_HOLE = re.compile(r"\\.|`|\$\{", re.S), re.compile(r"`|[{}]|//[^\n]*|/\*.*?\*/|" + _STRING + r"|'(?:\\.|[^'\\\n])*'?", re.S)
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
#: After these a slash opens a regular expression; after a name, a number or a closing bracket it divides.
_OPENS = re.compile(r"(?:^|[(,=:\[!&|?{};+\-*%~^<>]|\b(?:return|typeof|case|in|of|delete|void|throw|new|else|do|instanceof|await|yield))\s*\Z")


def _block_end(text: str, at: int, nested: bool) -> int:
    """End of the block comment that opens at ``at``."""
    if not nested:
        end = text.find("*/", at + 2)
        return len(text) if end < 0 else end + 2
    depth = 0
    for m in _EDGE.finditer(text, at):
        depth += 1 if m[0] == "/*" else -1
        if not depth:
            return m.end()
    return len(text)


def _template_end(text: str, at: int) -> int:
    """End of the template literal that opens at ``at``, with the literals inside its holes."""
    stack, at = ["`"], at + 1
    while m := (_TICK_TEXT if stack[-1] == "`" else _TICK_HOLE).search(text, at):
        t, at = m[0], m.end()
        if t == ("`" if stack[-1] == "`" else "}"):
            stack.pop()
        elif t in ("`", "{", "${"):
            stack.append(t[-1])
        if not stack:
            return at
    return len(text)


def scan(lang: str, text: str) -> tuple[list[tuple[int, int]], str]:
    """Where the comments are, and the text with comments as blanks and what is quoted as zeros; line breaks stay."""
    comments, parts, done, at, find = [], [], 0, 0, _TOKEN[lang].search
    while m := find(text, at):
        a, z, which = m.start(), m.end(), m.lastgroup
        at = max(z, a + 1)
        if which == "block":
            at = z = _block_end(text, a, lang in _NESTED)
        elif which == "tick":
            at = z = _template_end(text, a)
        elif which == "slash":
            r = _REGEX.match(text, a) if _OPENS.search(text[max(0, a - 40, text.rfind("\n", 0, a) + 1) : a]) else None
            if not r:
                continue
            at = z = r.end()
        elif which == "keep":
            continue
        comment = which in ("line", "block")
        if comment:
            z = a + len(text[a:z].rstrip("\r"))
            comments.append((a, z))
        filler = " " if comment else "\x00"
        parts += text[done:a], re.sub(r"[^\n]", filler, text[a:at])
        done = at
    return comments, "".join(parts) + text[done:]
