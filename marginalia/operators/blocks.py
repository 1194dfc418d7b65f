"""From comments to blocks: runs, directives, attachment, subjects.

Every step partitions by ``path`` alone, so Spark deals the comments out once and keeps them there.

comments: path, lang, start, end, start_row, end_row, body, is_trailing, is_doc, kind, doc_subject,
is_shebang.  nodes (code between comments): path, start, end, start_row, end_row, subject, identifiers, in_error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.vocabulary import IGNORE_MARKER, LANGUAGES, LICENCE_ROWS

def by_path():
    return W.partitionBy("path")


def with_runs(comments: DataFrame, order: str = "start") -> DataFrame:
    """run: rises where a comment doesn't stand right below the one before, or either is trailing."""
    w = by_path().orderBy(order)
    joins = (F.lag("end_row").over(w) + 1 == F.col("start_row")) & ~F.lag("is_trailing").over(w) & ~F.col("is_trailing")
    return comments.withColumn("__new", F.when(joins, 0).otherwise(1)).withColumn("run", F.sum("__new").over(w)).drop("__new")


def is_machine_directive(body: Column, lang: Column) -> Column:
    """Whether the body opens with a directive that some tool of its language reads."""
    opens = F.lit(False)
    for name, facts in LANGUAGES.items():
        if facts["directives"]:
            opens = opens | ((lang == name) & T.opens_with(body, facts["directives"]))
    return opens


def marked(runs: DataFrame, marker: str = IGNORE_MARKER) -> DataFrame:
    """Adds is_directive, rule and reason."""
    marks = runs.withColumn("is_directive", is_machine_directive(F.col("body"), F.col("lang")) | F.col("is_shebang"))
    return marks.withColumn("rule", T.ignore_rule(F.col("body"), marker)).withColumn("reason", T.ignore_reason(F.col("body"), marker))


def blocks_of(comments: DataFrame) -> DataFrame:
    """One row per run that still has prose; a run of directives makes none.

    Directives count only for what holds for the whole run: run_end, run_end_row, run_doc, run_subject.
    """
    prose = ~F.col("is_directive") & F.col("rule").isNull()
    of = lambda c: F.when(prose, F.col(c))
    # Runs are short and come in order, so windows over them cost less than an aggregate with lists, which sorts whole rows twice.
    run = W.partitionBy("path", "run").orderBy("start").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    whole = {
        "run_doc": F.bool_or("is_doc"), "run_subject": F.max("doc_subject"), "run_end": F.max("end"), "run_end_row": F.max("end_row"), "__end": F.max(of("end")),
        "__start_row": F.min(of("start_row")), "__end_row": F.max(of("end_row")), "__trailing": F.bool_or(of("is_trailing")),
        "__count": F.sum(of("end_row") - F.col("start_row") + 1), "__lines": F.collect_list(of("body")),
    }
    told = comments.withColumns({k: v.over(run) for k, v in whole.items()} | {"__nth": F.sum(prose.cast("int")).over(run.rowsBetween(W.unboundedPreceding, 0))}).where(prose & (F.col("__nth") == 1))
    out = told.select(
        "path", "run", "lang", "kind", "run_doc", "run_subject", "run_end", "run_end_row", "start", F.col("__end").alias("end"), F.col("__start_row").alias("start_row"), F.col("__end_row").alias("end_row"),
        F.col("__trailing").alias("is_trailing"), F.col("__count").cast("long").alias("line_count"), F.array_join("__lines", "\n").alias("body"),
    )
    return out.withColumn("kind", F.when(F.col("run_doc"), "doc").otherwise(F.col("kind"))).withColumn("block", F.row_number().over(by_path().orderBy("start")))


def attach(blocks: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds attachment, subject, attached identifiers and in_error, by as-of windows within a path.

    Code and blocks are laid side by side in order of position, and each block takes along the code last seen
    from above and from below.  Running frames only, so the time is linear in the rows of a file.
    """
    what = F.struct("start", "end", "start_row", "end_row", "subject", "identifiers", "in_error").alias("node")
    no_tie = F.lit(0).cast("long").alias("tie")

    def seen(*order: Column) -> Column:
        return F.last("node", ignorenulls=True).over(by_path().orderBy(*order).rowsBetween(W.unboundedPreceding, 0))

    starts = nodes.select("path", what, F.col("start").alias("pos"), F.lit(1).alias("side"), (-F.col("end")).alias("tie"))
    mine = blocks.select("path", F.struct(*(c for c in blocks.columns if c != "path")).alias("b"), F.col("run_end").alias("pos"), F.lit(0).alias("side"), no_tie)
    one = mine.unionByName(starts, allowMissingColumns=True).withColumn("above", seen(F.col("pos"), F.col("side"), F.col("tie")))
    one = one.withColumn("below", seen(F.desc("pos"), F.desc("side"), F.desc("tie"))).where("b is not null")
    ends = nodes.select("path", what, F.col("end").alias("pos"), F.lit(0).alias("side"), (-F.col("start")).alias("tie"))
    mine = one.select("path", "b", "above", "below", F.col("b.start").alias("pos"), F.lit(1).alias("side"), no_tie)
    out = mine.unionByName(ends, allowMissingColumns=True).withColumn("beside", seen(F.col("pos"), F.col("side"), F.col("tie"))).where("b is not null")
    out = out.select("path", "b.*", "above", "below", F.when(F.col("beside.end_row") == F.col("b.start_row"), F.col("beside")).alias("beside"))
    state = F.when(F.col("is_trailing"), "trailing").when(F.col("below.start_row") == F.col("run_end_row") + 1, "below").otherwise("detached")
    node = F.when(F.col("attachment") == "trailing", F.col("beside")).when(F.col("attachment") == "below", F.col("below"))
    return (
        out.withColumn("attachment", state).withColumn("__node", node)
        .withColumn("subject", F.when(F.col("kind") == "doc", F.col("run_subject")).otherwise(F.col("__node.subject")))
        .withColumn("attached", F.coalesce("__node.identifiers", F.array().cast("array<string>")))
        .withColumn("in_error", F.coalesce(F.col("below.in_error"), F.lit(False)) | F.coalesce(F.col("above.in_error"), F.lit(False)))
        .drop("__node", "below", "above", "beside", "run_subject", "run_doc")
    )


def bind(blocks: DataFrame, directives: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, block, rule, reason, directive) that hold, and the directives with no block.

    A directive (path, start, start_row, rule, reason) goes to the first block on its row or the next; of several
    that go to one block the last one holds and the others are gone.  Blocks and directives are laid side by side
    by row, so there is no join.
    """
    near = by_path().orderBy("start_row").rangeBetween(0, 1)
    both = blocks.select("path", "start_row", "block").unionByName(directives.withColumn("is_mark", F.lit(True)), allowMissingColumns=True)
    met = both.withColumn("block", F.min("block").over(near)).where("is_mark").drop("is_mark")
    last = F.row_number().over(W.partitionBy("path", "block").orderBy(F.desc("start")))
    held = met.where("block is not null").withColumn("__last", last).where("__last = 1")
    held = held.select("path", "block", "rule", "reason", F.col("start").alias("directive_start"), F.col("end").alias("directive_end"), F.col("start_row").alias("directive_row"))
    return held, met.where("block is null").select(*directives.columns)


def without_licence(blocks: DataFrame) -> DataFrame:
    """Blocks but the first of a file where that is a licence notice near the top and no doc comment."""
    notice = (F.col("block") == 1) & (F.col("kind") != "doc") & (F.col("start_row") < LICENCE_ROWS) & T.is_licence_text(F.col("body"))
    return blocks.where(~notice)
