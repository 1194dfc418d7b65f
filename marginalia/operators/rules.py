"""The block rules: one projection of an array of hits, exploded and joined to the small registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.vocabulary import ATTRIBUTION, HEDGING, IGNORE_MARKER, LANGUAGES, MIN_SYMBOL_LEN, NARRATION, NOTE, SAY, VAGUE
from .spread import matched


def say(key: str, *found: Column) -> Column:
    """The instruction with what was found put in; null if that is null."""
    text, parts = SAY[key], []
    while "{" in text:
        head, _, text = text.partition("{")
        number, _, text = text.partition("}")
        parts += [F.lit(head), found[int(number)]]
    return F.concat(*parts, F.lit(text))


def references(lang: Column) -> Column:
    out = F.array().cast("array<string>")
    for name, facts in LANGUAGES.items():
        out = F.when(lang == name, F.lit(facts["references"]) if facts["references"] else F.array().cast("array<string>")).otherwise(out)
    return out


def docbloat(lines: Column, members: Column, cap: Column, each: Column) -> tuple[Column, Column]:
    """Instruction and note of a doc comment that is too long for what it documents."""
    over_cap, over_each = lines > cap, (members > 0) & (lines > members * each)
    instruction = F.when(over_each, say("docbloat_relative", lines.cast("string"), T.phrase(members, "member"))).when(over_cap, say("docbloat", lines.cast("string")))
    budget = F.when(over_cap & over_each, F.least(cap, members * each)).when(over_cap, cap).otherwise(members * each)
    return instruction, F.when(lines > 2 * budget, NOTE)


def text_rules(body: Column, trailing: Column, lang: Column, marker: str = IGNORE_MARKER) -> dict[str, Column]:
    """Instruction per rule that needs the text alone; null where it doesn't fire."""
    return {
        "narration": say("narration", T.first_match(body, NARRATION)),
        "banner": say("banner", T.banner_reason(body, trailing)),
        "attribution": say("attribution", T.first_match(body, ATTRIBUTION), F.lit(marker)),
        "fileref": say("fileref", T.source_path(body, references(lang))),
        "hedging": say("hedging", T.first_match(body, HEDGING)),
        "vague": F.coalesce(say("vague", T.first_match(body, VAGUE)), F.when(T.ends_with_etc(body), SAY["vague_etc"])),
        "task": say("task", T.task_without_reference(body)),
    }


def restates(body: Column, attached: Column) -> Column:
    within = lambda tokens: (F.size(tokens) > 0) & (F.size(F.array_except(tokens, attached)) == 0)
    # As the one item of an array the tokens are made once, however often they are named.
    return (F.size(attached) > 0) & F.exists(F.array(T.content_tokens(body)), within)


def block_hits(blocks: DataFrame, marker: str = IGNORE_MARKER, more: dict[str, Column] | None = None) -> DataFrame:
    """(path, block, rule, instruction, note) of all block rules, disabled ones included.

    blocks: body, is_trailing, lang, attachment, attached, kind, line_count, member_count (null without subject), code (whether
    the body is code), leaked (an unexported name it uses), absolute_doc_lines, doc_lines_per_member.
    more: instructions of further rules.
    """
    body = F.col("body")
    found = text_rules(body, F.col("is_trailing"), F.col("lang"), marker)
    found["restate"] = F.when((F.col("attachment") != "detached") & restates(body, F.col("attached")), SAY["restate"])
    found["detached"] = F.when(F.col("attachment") == "detached", SAY["detached"])
    found["commentedOutCode"] = F.when(F.col("code"), SAY["commentedOutCode"])
    found["implInInterface"] = say("implInInterface", F.col("leaked"))
    long, note = docbloat(F.col("line_count"), F.col("member_count"), F.col("absolute_doc_lines"), F.col("doc_lines_per_member"))
    found["docbloat"] = F.when(F.col("member_count").isNotNull(), long)
    found |= more or {}
    hits = F.array(*(F.struct(F.lit(rule).alias("rule"), c.alias("instruction"), (note if rule == "docbloat" else F.lit(None).cast("string")).alias("note")) for rule, c in found.items()))
    each = blocks.select("path", "block", F.explode(F.filter(hits, lambda h: h["instruction"].isNotNull())).alias("h"))
    return each.select("path", "block", "h.*")


def leaked_names(blocks: DataFrame, symbols: DataFrame, common: tuple[str, ...]) -> DataFrame:
    """(path, block, leaked): first unexported name that the doc comment of an exported subject uses.

    blocks: exported doc comments (path, block, body).  symbols: path, ord, name, vis.
    A plain mention counts unless the name is a common word, with or without a plural ending.
    """
    names = symbols.where((F.col("vis") != "exported") & (F.length("name") >= MIN_SYMBOL_LEN)).select("path", "ord", "name")
    known = F.lit(sorted({w.lower() for w in common})) if common else F.array().cast("array<string>")
    low = F.lower("name")
    is_common = F.array_contains(known, low) | F.array_contains(known, F.regexp_replace(low, "s$", "")) | F.array_contains(known, F.regexp_replace(low, "es$", ""))
    met = matched(blocks.select("path", "block", "body"), names, "path")
    uses = T.referenced_as_code(F.col("body"), F.col("name")) | (T.bounded_by(F.col("body"), F.col("name")) & ~is_common)
    return met.where(F.col("body").contains(F.col("name"))).where(uses).groupBy("path", "block").agg(F.min_by("name", "ord").alias("leaked"))
