"""From hits to findings: registry, error policy, precedence, density, directives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.vocabulary import IGNORE_MARKER, NOTE, PRECEDENCE
from .rules import say


def allowed(blocks: DataFrame, registry: DataFrame) -> DataFrame:
    """(block, rule) with a disposition, enabled; ``withheld`` where a syntax error forbids an answer.

    The registry has at most 7 languages x 15 rules x 3 kinds rows, so it's broadcast whatever the data.
    """
    dims = F.broadcast(registry.where("enabled and runs = 'block'"))
    withheld = ((F.col("withheld_by") == "subtree") & F.col("in_error")) | ((F.col("withheld_by") == "file") & F.col("file_error"))
    return blocks.select("path", "block", "lang", "kind", "in_error", "file_error").join(dims, ["lang", "kind"]).withColumn("withheld", withheld)


def without_losers(hits: DataFrame, pairs=PRECEDENCE) -> DataFrame:
    """Hits but those of a losing rule whose winner hit the same block.

    The rules that hit a block, fifteen at most, stand beside each of its hits: no join.
    """
    lost = F.lit(False)
    for winner, loser in pairs:
        lost = lost | ((F.col("rule") == loser) & F.array_contains("__hit", winner))
    return hits.withColumn("__hit", F.collect_set("rule").over(W.partitionBy("path", "block"))).where(~lost).drop("__hit")


def density(blocks: DataFrame, subjects: DataFrame, limits: DataFrame) -> DataFrame:
    """Subjects with too much commentary: path, subject, start, end, kind, block (first inside), instruction, note.

    A range join within a path: the blocks that lie inside a subject.  Only blocks that belong to no
    subject count; a subject with a block in broken code is withheld.
    """
    spans = subjects.where("not file_scope and code_lines > 0").select("path", F.col("subject").alias("subj"), F.col("start").alias("s"), F.col("end").alias("e"), "code_lines")
    inside = blocks.join(spans.hint("merge"), (blocks["path"] == spans["path"]) & (F.col("start") >= F.col("s")) & (F.col("end") <= F.col("e"))).drop(spans["path"])
    lines = inside.groupBy("path", "subj", "s", "e", "code_lines").agg(
        F.sum(F.when(F.col("subject").isNull(), F.col("line_count")).otherwise(0)).cast("long").alias("comment_lines"), F.bool_or("in_error").alias("withheld"), F.min_by("lang", "block").alias("lang"),
        F.min_by("kind", F.when(F.col("kind") != "doc", F.col("block"))).alias("kind"), F.min("block").alias("block"),
    )
    room = F.col("density_allowance") * F.sqrt("code_lines")
    fired = lines.join(F.broadcast(limits), "lang").where(F.col("kind").isNotNull() & (F.col("comment_lines") > room))
    text = say("density", T.phrase(F.col("comment_lines"), "comment line"), F.concat(F.col("code_lines").cast("string"), F.when(F.col("code_lines") == 1, " line of code").otherwise(" lines of code")))
    return fired.select("path", F.col("subj").alias("subject"), F.col("s").alias("start"), F.col("e").alias("end"), "lang", "kind", "block", "comment_lines", "code_lines", "withheld", text.alias("instruction"), F.when(F.col("comment_lines") > 2 * room, NOTE).alias("note"))


def suppressed(findings: DataFrame, held: DataFrame) -> DataFrame:
    """Adds suppressed: the block's directive names the rule.  Findings are marked, not dropped."""
    both = findings.unionByName(held.select("path", "block", "rule", F.lit(True).alias("__named")), allowMissingColumns=True)
    named = F.max("__named").over(W.partitionBy("path", "block", "rule"))
    return both.withColumn("suppressed", F.coalesce(named, F.lit(False))).where("__named is null").drop("__named")


def dead_ignores(held: DataFrame, tried: DataFrame) -> DataFrame:
    """Directives whose rule ran on the block and didn't fire.

    tried: path, block, rule, fired; a rule ran where it has a row, and fired where one of its rows says so.
    """
    key = ["path", "block", "rule"]
    both = held.withColumn("__held", F.lit(True)).unionByName(tried.select(*key, "fired"), allowMissingColumns=True)
    both = both.withColumn("__fired", F.max("fired").over(W.partitionBy(*key)))  # null where it didn't run
    return both.where("__held and not __fired").select(*held.columns)


def missing_reasons(held: DataFrame, loose: DataFrame, marker: str = IGNORE_MARKER) -> DataFrame:
    """(path, block or null, directive_start, directive_end, instruction) of directives without a reason."""
    text = say("ignoreReason", F.col("rule"), F.lit(marker))
    both = held.select("path", "block", "directive_start", "directive_end", "rule", "reason").unionByName(
        loose.select("path", F.lit(None).cast("int").alias("block"), F.col("start").alias("directive_start"), F.col("end").alias("directive_end"), "rule", "reason")
    )
    return both.where("reason is null").select("path", "block", "directive_start", "directive_end", text.alias("instruction"))


def withheld_rules(tried: DataFrame) -> DataFrame:
    """(path, rules): per file, the rules that a syntax error withheld."""
    return tried.where("withheld").groupBy("path").agg(F.array_sort(F.collect_set("rule")).alias("rules"))


def layered(spark: SparkSession, defaults: DataFrame, general: DataFrame, per_language: DataFrame) -> DataFrame:
    """(lang, name, value): a language's value, else the general one, else the default."""
    g = general.select("name", F.col("value").alias("g"))
    own = per_language.select("lang", "name", F.col("value").alias("l"))
    return defaults.join(g, "name", "left").join(own, ["lang", "name"], "left").select("lang", "name", F.coalesce("l", "g", "value").alias("value"))
