"""The whole engine: files in, findings out; and the corrected files."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import blocks as B
from .operators import dispatch as D
from .operators import fix as X
from .operators import report as R
from .operators import rules
from .operators.spread import matched, parts
from .plans.registry import Config, registry, thresholds
from .sources import files as S
from .sources import parse
from .sources.kept import kept as keep


@dataclass
class Report:
    """findings and withheld are per file; unreadable files stand apart."""

    findings: DataFrame
    withheld: DataFrame
    unreadable: DataFrame
    blocks: DataFrame
    directives: DataFrame

    def exit_code(self) -> int:
        return R.exit_code(self.findings).first()[0]

    def human(self) -> DataFrame:
        return self._text(R.human_line(R.active(self.findings)), lambda: F.concat("path", F.lit(": not fully analysed; rules withheld: "), F.array_join("rules", ", ")), lambda: F.concat("path", F.lit(": not read: "), "reason"))

    def machine(self) -> DataFrame:
        return self._text(R.machine_line(R.active(self.findings)), lambda: F.concat(F.lit("#withheld\t"), "path", F.lit("\t"), F.array_join("rules", ",")), lambda: F.concat(F.lit("#unreadable\t"), "path", F.lit("\t"), "reason"))

    def _text(self, lines: DataFrame, withheld, unreadable) -> DataFrame:
        none = [F.lit(0).cast("long").alias("start"), F.lit("").alias("rule"), F.lit(0).alias("ord")]
        one = lines.select(F.lit(0).alias("part"), "path", F.col("start").cast("long").alias("start"), "rule", F.col("ord").cast("int").alias("ord"), "text")
        two = self.withheld.select(F.lit(1).alias("part"), "path", *none, withheld().alias("text"))
        three = self.unreadable.select(F.lit(2).alias("part"), "path", *none, unreadable().alias("text"))
        return one.unionByName(two).unionByName(three).orderBy("part", F.split("path", "/"), "start", "rule", "ord").select("text")


def _code_bodies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield b[["path", "block"]].assign(code=[parse.is_code(x, y) for x, y in zip(b["lang"], b["body"], strict=True)])


def _places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Line and column, both from 1, of the starts of each file."""
    for b in batches:
        rows = []
        for path, content, starts in zip(b["path"], b["content"], b["starts"], strict=True):
            src = content.encode()
            for at in starts:
                head = src[: min(at, len(src))]
                rows.append((path, at, head.count(b"\n") + 1, len(head[head.rfind(b"\n") + 1 :].decode("utf-8", "ignore")) + 1))
        yield pd.DataFrame(rows, columns=["path", "start", "line", "col"])


def check(files: DataFrame, config: Config | None = None, unreadable: DataFrame | None = None) -> Report:
    """Findings over files (path, lang, content), parsed once.

    Null or empty contents have no findings; files of a path given twice are an error of the caller.
    """
    spark, config = files.sparkSession, config or Config()
    marker, reg, limits = config.ignore_marker, registry(spark, config), thresholds(spark, config)
    source = files.where(F.col("content").isNotNull() & S.not_excluded(F.col("path"), config.excluded_paths) & ~S.is_generated(F.col("lang"), F.col("content")))
    facts = keep(parse.facts(source))  # read by many branches, so each file is parsed once
    n = parts(facts, 1 << 20)
    met = lambda left, right, on, how="inner": matched(left, right, on, how, n)
    part = lambda name: facts.select("path", "lang", "file_error", F.explode(name).alias("x")).select("path", "lang", "file_error", "x.*")
    nodes, subjects, symbols = part("nodes").drop("lang", "file_error"), part("subjects").drop("file_error"), part("symbols").drop("lang", "file_error")
    comments = keep(B.marked(B.with_runs(part("comments").drop("file_error").repartition(n, "path")), marker))
    notes = comments.where(F.col("rule").isNotNull() & ~F.col("is_directive")).select("path", "start", "end", "start_row", "rule", "reason")
    joined = keep(B.attach(B.blocks_of(comments.repartition(n, "path")), nodes.repartition(n, "path")))
    held, loose = B.bind(joined.repartition(n, "path"), notes.repartition(n, "path"))
    held = keep(met(held, B.without_licence(joined).select("path", "block"), ["path", "block"], "left_semi"))
    blocks = met(B.without_licence(joined), facts.select("path", "file_error"), "path").join(F.broadcast(limits), "lang")
    blocks = keep(met(blocks, subjects.select("path", "subject", "member_count", F.col("vis").alias("subject_vis")), ["path", "subject"], "left"))
    maybe = blocks.where(F.col("body").rlike(r"[=(){}\[\];|<>$\-.]|^\s*(return|break|continue|import)\b") & (F.col("kind") != "doc"))
    code = maybe.select("path", "block", "lang", "body").mapInPandas(_code_bodies, "path string, block int, code boolean").where("code")
    leaks = rules.leaked_names(blocks.where("kind = 'doc' and subject_vis = 'exported'"), symbols, config.common_words)
    ready = met(met(blocks, code, ["path", "block"], "left"), leaks, ["path", "block"], "left").withColumn("code", F.coalesce("code", F.lit(False)))
    ready = keep(ready)
    tried = keep(D.allowed(ready, reg))
    ran = tried.where("not withheld").select("path", "block", "rule", "tier", "fix", "lang", "kind")
    fired = rules.block_hits(ready, marker, {r.name: r.instruction() for r in config.extra_rules if r.runs == "block"})
    hits = keep(D.without_losers(met(fired, ran, ["path", "block", "rule"]).repartition(n, "path")))
    place = ready.select("path", "block", "start", "end")
    found = D.suppressed(met(hits, place, ["path", "block"]).repartition(n, "path"), held.repartition(n, "path"))
    of_rule = lambda rule: F.broadcast(reg.where(f"enabled and rule = '{rule}'").select("lang", "kind", "tier", "fix", "rule"))

    thick = D.density(ready.repartition(n, "path"), subjects.repartition(n, "path"), limits).join(of_rule("density"), ["lang", "kind"])
    told = met(held.where("rule = 'density'"), ready.select("path", "block", F.col("start").alias("bs"), F.col("end").alias("be"), F.col("subject").alias("bsub")), ["path", "block"]).select("path", "bs", "be", "bsub")
    inside = met(thick, told, "path").where(((F.col("bs") >= F.col("start")) & (F.col("be") <= F.col("end"))) | (F.col("bsub") == F.col("subject"))).select("path", "subject")
    rows = nodes.where("subject is not null").select("path", "subject", "start_row")
    above = met(loose.where("rule = 'density'").select("path", (F.col("start_row") + 1).alias("start_row")), rows, ["path", "start_row"]).select("path", "subject")
    quiet = inside.union(above).distinct().withColumn("__quiet", F.lit(True))
    dense = met(thick.where("not withheld"), quiet, ["path", "subject"], "left").withColumn("suppressed", F.coalesce("__quiet", F.lit(False)))

    kind_of = ready.select("path", "block", "kind", "lang")
    bare = met(met(D.missing_reasons(held, loose, marker), kind_of, ["path", "block"], "left"), facts.select("path", F.col("lang").alias("file_lang")), "path")
    bare = bare.withColumn("kind", F.coalesce("kind", F.lit("line"))).withColumn("lang", F.col("file_lang")).join(of_rule("ignoreReason"), ["lang", "kind"])
    key = ["path", "block", "rule"]
    was_tried = ran.select(*key, F.lit(False).alias("fired")).unionByName(hits.select(*key, F.lit(True).alias("fired")))
    dead = met(D.dead_ignores(held.repartition(n, "path"), was_tried.repartition(n, "path")), kind_of, ["path", "block"]).withColumnRenamed("rule", "named").join(of_rule("deadIgnore"), ["lang", "kind"])
    dead = dead.withColumn("instruction", rules.say("deadIgnore", F.col("named")))

    def shaped(df: DataFrame, start: str, end: str, ord_: int) -> DataFrame:
        has = set(df.columns)
        pick = lambda c, kind, default: (F.col(c) if c in has else F.lit(default)).cast(kind).alias(c)
        return df.select("path", "lang", "kind", pick("block", "int", None), F.col(start).cast("long").alias("start"), F.col(end).cast("long").alias("end"), "rule", "tier", "fix", "instruction", pick("note", "string", None), pick("suppressed", "boolean", False), F.lit(ord_).alias("ord"))

    every = shaped(found, "start", "end", 0).unionByName(shaped(dense, "start", "end", 1)).unionByName(shaped(bare, "directive_start", "directive_end", 2)).unionByName(shaped(dead, "directive_start", "directive_end", 3))
    for r in config.extra_rules:
        if r.runs == "subject":
            every = every.unionByName(shaped(r.find(ready, subjects).join(of_rule(r.name), ["lang", "kind"]), "start", "end", 1))
    every = keep(every)
    starts = met(source.select("path", "content"), every.groupBy("path").agg(F.array_sort(F.collect_set("start")).alias("starts")), "path").mapInPandas(_places, "path string, start long, line long, col long")
    findings = R.without_repeats(met(every, starts, ["path", "start"]).repartition(n, "path"))
    lost = tried.where("withheld").select("path", "rule").unionByName(thick.where("withheld").select("path", "rule"))
    withheld = D.withheld_rules(lost.withColumn("withheld", F.lit(True)))
    none = spark.createDataFrame([], "path string, reason string")
    return Report(findings, withheld, unreadable if unreadable is not None else none, ready, held)


def check_paths(spark: SparkSession, paths: list[str], config: Config | None = None) -> Report:
    config = config or Config()
    files, bad = S.read(spark, S.walk(paths, config.excluded_paths))
    return check(files, config, bad)


def corrected(files: DataFrame, config: Config | None = None) -> DataFrame:
    """(path, content) of the files that the switched-on deletions change."""
    report = check(files, config)
    wanted = X.deletable(report.findings.where("block is not null"), registry(files.sparkSession, config))
    n = parts(report.blocks, 1 << 20)
    spots = matched(wanted.select("path", "lang", "block", "start", "end"), report.blocks.select("path", "block", "is_trailing"), ["path", "block"], n=n)
    return X.fixed(files, matched(spots, report.directives.select("path", "block", "directive_start", "directive_end"), ["path", "block"], "left", n))
