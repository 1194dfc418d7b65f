"""Order, repeats and renderings of findings.

findings: path, start, end, rule, line, col, tier, fix, instruction, note, suppressed, ord.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SAME = ("rule", "line", "col", "instruction")


def without_repeats(findings: DataFrame) -> DataFrame:
    """Findings but those equal to the one before in the order of their file; the first of such stays."""
    w = W.partitionBy("path").orderBy("start", "rule", "ord")
    same = F.lit(True)
    for c in SAME:
        same = same & F.col(c).eqNullSafe(F.lag(c).over(w)) & F.lag(F.lit(1)).over(w).isNotNull()
    return findings.withColumn("__same", same).where(~F.col("__same")).drop("__same")


def ordered(findings: DataFrame) -> DataFrame:
    """By path, component by component, then start and rule."""
    return findings.orderBy(F.split("path", "/"), "start", "rule", "ord")


def active(findings: DataFrame) -> DataFrame:
    return findings.where(~F.col("suppressed"))


def human_line(findings: DataFrame) -> DataFrame:
    place = F.concat_ws(":", "path", F.col("line").cast("string"), F.col("col").cast("string"))
    head = F.concat(place, F.lit(": "), "tier", F.lit(" ["), "rule", F.lit("] "), "instruction")
    return findings.withColumn("text", F.concat(head, F.coalesce(F.concat(F.lit("\n  note: "), "note"), F.lit(""))))


def machine_line(findings: DataFrame) -> DataFrame:
    head = F.concat_ws("\t", F.lit("finding"), "rule", "path", *(F.col(c).cast("string") for c in ("start", "end", "line", "col")), "tier", "fix")
    return findings.withColumn("text", F.concat(head, F.lit("\n\tinstruction\t"), "instruction", F.coalesce(F.concat(F.lit("\n\tnote\t"), "note"), F.lit(""))))


def exit_code(findings: DataFrame) -> DataFrame:
    """One row: 1 if an unsuppressed gate finding exists, else 0."""
    return findings.agg(F.coalesce(F.bool_or((F.col("tier") == "gate") & ~F.col("suppressed")), F.lit(False)).cast("int").alias("exit_code"))


def merged(ranges: DataFrame) -> DataFrame:
    """(path, start, end): touching and overlapping ranges of a path become one."""
    w = W.partitionBy("path").orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    cut = ranges.select("path", "start", "end").withColumn("__new", F.when(F.col("start") <= before, 0).otherwise(1))
    isles = cut.withColumn("__isle", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return isles.groupBy("path", "__isle").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__isle")
