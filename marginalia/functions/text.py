"""Column functions over comment bodies; built-in expressions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.vocabulary import LICENCE_OPENERS, STOPWORDS, TASK_MARKERS

W = r"\p{IsAlphabetic}\p{N}_"
RULE = r"[\-=*_#~+]"


def strip(x: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def normalise(x: Column) -> Column:
    return strip(F.regexp_replace(x, r"(?U)\s+", " "))


def strip_code_spans(x: Column) -> Column:
    """Backtick spans become blanks if the backticks pair up."""
    ticks = F.length(x) - F.length(F.replace(x, F.lit("`"), F.lit("")))
    return F.when(ticks % 2 == 0, F.regexp_replace(x, "`[^`]*`", " ")).otherwise(x)


def quoted(term: str) -> str:
    return r"\Q" + term + r"\E"


def opens_with(x: Column, prefixes: Sequence[str]) -> Column:
    """Whether the text, without white space at both ends, starts with one of the prefixes."""
    shown = lambda p: quoted(p) + (r"(?=(?s:.*)\S)" if p[-1:].isspace() else "")
    return x.rlike(rf"(?U)\A\s*+(?:{'|'.join(map(shown, prefixes))})")


def bounded(x: Column, term: str) -> Column:
    return x.rlike(f"(?<![{W}]){quoted(term)}(?![{W}])")


def first_match(body: Column, terms: Sequence[str]) -> Column:
    """First term of the list that stands in the body at word boundaries; case and code spans don't count."""
    text = F.lower(normalise(strip_code_spans(body)))
    # Most bodies lack the longest word of every term, which no step on the way to the text can bring about.
    maybe = F.lower(body).rlike(f"(?:{'|'.join(sorted({quoted(max(t.split(), key=len)) for t in terms}))})(?![{W}])")
    some = text.rlike(f"(?<![{W}])(?:{'|'.join(map(quoted, terms))})(?![{W}])")
    return F.when(maybe & some, F.coalesce(*(F.when(bounded(text, t), F.lit(t)) for t in terms)))


def words(x: Column) -> Column:
    return F.filter(F.split(x, f"[^{W}]+"), lambda w: w != "")


def split_identifier(x: Column) -> Column:
    """Lower-case parts of an identifier: at ``_`` and ``-`` and at changes of case."""
    cut = r"[_\-]+|(?<=\P{IsUppercase})(?=\p{IsUppercase})|(?<=\p{IsUppercase})(?=\p{IsUppercase}\P{IsUppercase})"
    return F.transform(F.filter(F.split(x, cut), lambda w: w != ""), lambda w: F.lower(w))


def content_tokens(body: Column) -> Column:
    """Distinct identifier parts of the lower-cased words, without stop words."""
    parts = F.flatten(F.transform(words(F.lower(body)), split_identifier))
    return F.array_except(parts, F.lit(list(STOPWORDS)))


def body_lines(body: Column) -> Column:
    return F.filter(F.transform(F.split(body, "\n"), strip), lambda x: x != "")


def is_step_label(line: Column) -> Column:
    return F.lower(line).rlike(r"(?U)^step\s*[0-9]+(?![0-9])\s*($|[:\-.)])")


def is_section_label(line: Column) -> Column:
    letters = F.regexp_replace(line, r"[^\p{IsAlphabetic}]", "")
    return (F.length(letters) >= 2) & ~letters.rlike(r"\p{IsLowercase}")


def is_fenced_label(line: Column) -> Column:
    return line.rlike(f"^{RULE}{{3}}") & line.rlike(f"{RULE}{{3}}$") & line.rlike(r"\p{IsAlphabetic}")


def claimed_by_task(line: Column) -> Column:
    return line.rlike(f"(?<![{W}])({'|'.join(TASK_MARKERS)})(?![{W}])")


def banner_reason(body: Column, trailing: Column) -> Column:
    lines = body_lines(body)
    label = lambda x: ~claimed_by_task(x) & (is_section_label(x) | is_fenced_label(x))
    return F.when(F.size(lines) == 0, F.lit(None)).when(F.forall(lines, lambda x: x.rlike(f"^{RULE}{{3,}}$")), "a rule of repeated punctuation").when(
        F.forall(lines, is_step_label), "a step number"
    ).when(~trailing & (F.size(lines) == 1) & F.forall(lines, label), "a section label")


def ends_with_etc(body: Column) -> Column:
    return F.lower(body).contains("etc") & F.regexp_replace(F.lower(normalise(body)), r"""[. )\]"']+$""", "").rlike("(^|[ ,])etc$")


def task_without_reference(body: Column) -> Column:
    """First marker of the list that stands somewhere without ``(reference)`` after it."""
    text = normalise(strip_code_spans(body))
    bare = lambda m: text.rlike(rf"(?U)(?<![{W}]){m}(?!\([^)]*[^)\s][^)]*\))")
    return F.when(body.rlike("|".join(TASK_MARKERS)), F.coalesce(*(F.when(bare(m), F.lit(m)) for m in TASK_MARKERS)))


def source_path(body: Column, extensions: Column) -> Column:
    """First word that is a path with one of the extensions, without the marks prose puts around it."""
    both = r"""^[()\[\]:,;"'`]+|[()\[\]:,;"'`]+$"""
    clean = lambda w: F.regexp_replace(F.regexp_replace(F.regexp_replace(w, both, ""), r"\.+$", ""), both, "")
    found = F.transform(F.split(F.regexp_replace(body, r"(?U)\s+", " "), " "), clean)
    good = lambda w: ~w.contains("://") & w.rlike(r".\.[^.]+$") & F.array_contains(extensions, F.regexp_extract(w, r"\.([^.]+)$", 1))
    return F.get(F.filter(found, good), 0)


def is_licence_text(body: Column) -> Column:
    opener = f"(?U)(?i)^\\s*({'|'.join(LICENCE_OPENERS)})"
    return F.exists(F.split(body, "\n"), lambda x: x.rlike(opener))


def referenced_as_code(body: Column, name: Column) -> Column:
    """The name, bounded, before ``(`` or a backtick, or after ``.`` or a backtick."""
    safe = F.concat(F.lit(r"\Q"), name, F.lit(r"\E"))
    return F.regexp_like(body, F.concat(F.lit(f"(?<![{W}])"), safe, F.lit(r"[(`]"))) | F.regexp_like(body, F.concat(F.lit("[.`]"), safe, F.lit(f"(?![{W}])")))


def bounded_by(body: Column, name: Column) -> Column:
    return F.regexp_like(body, F.concat(F.lit(rf"(?<![{W}])\Q"), name, F.lit(rf"\E(?![{W}])")))


def phrase(n: Column, one: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(one.replace("line ", "lines ") if one.startswith("line ") else one + "s"))


def ignore_rule(body: Column, marker: str) -> Column:
    """The rule a directive names; null where the body isn't a directive."""
    return F.when(opens_with(body, [marker]), strip(F.regexp_extract(strip(body), rf"(?s)^{quoted(marker)}([^—\-]*)", 1)))


def ignore_reason(body: Column, marker: str) -> Column:
    """What follows the first dash of a directive; null where nothing does."""
    reason = F.regexp_replace(F.regexp_extract(strip(body), rf"(?s)^{quoted(marker)}[^—\-]*[—\-](.*)$", 1), r"(?U)^[—\-\s]+|\s+$", "")
    return F.when(opens_with(body, [marker]) & (reason != ""), reason)


def extension(name: Column) -> Column:
    """After the last dot of a file name that doesn't begin with its only dot; else null."""
    return F.nullif(F.regexp_extract(name, r"^.+\.([^.]*)$", 1), F.lit(""))


def interpreter(head: Column) -> Column:
    """Program a shebang line runs; ``env``, its options and assignments are passed over."""
    parts = F.split(F.regexp_replace(F.regexp_extract(head, r"^#![ \t]*([^\r\n]*)", 1), r"[ \t]+-[uC] *[ \t]+\S+(?=[ \t])", ""), r"[ \t]+")
    program = lambda x: F.element_at(F.split(x, "/"), -1)
    after = F.get(F.filter(F.slice(parts, 2, 1000), lambda x: ~x.startswith("-") & ~x.contains("=")), 0)
    first = program(F.get(parts, 0))
    return F.nullif(F.when(first == "env", program(after)).otherwise(first), F.lit(""))
