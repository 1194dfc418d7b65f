"""From raw documents to packed training sequences: quality, lines, near copies, benchmarks, packing.

Each stage works on all that its predecessor kept.  All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import copies, decontaminate, lines, packing, quality
from marginalia.llm.work import Work, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _unless(docs: DataFrame, losers: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id isn't among the losers' (doc_id); rows without doc_id stay."""
    return docs.join(losers.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the threshold table keep; the verdict is of the row itself.

    Null and empty texts have too few words and go.  Equal rows share their fate.  Columns keep their
    names and values whatever they are called.  An empty table gives an empty one.
    """
    return quality.with_verdict(docs).where("__kept").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat or resemble an earlier line; none is dropped.

    Null and empty texts, and rows without doc_id, stay as they are; rows of one doc_id are ordered by
    the hash of their text.  n_chars, where there is such a column, is that of the new text; other columns stay.
    """
    out = lines.without_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group whose five-word shingles are 0.8 similar.

    Texts without words, null ones too, are one group.  Rows of one doc_id are one document and share
    its fate.  Rows without doc_id stay.
    """
    found = copies.near_copies(docs, 5, 0.8)
    return _unless(docs, found.where("component_id <> doc_id"))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no template of a benchmark item.

    Null and empty texts hold none and stay.  Rows of one doc_id share their fate: all go if one holds an item.
    """
    return _unless(docs, decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, each with its sequence and offset; a null or empty text is the end id alone."""
    return packing.pack(docs, 2048)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", drop_low_quality),
    ("line dedup", drop_repeated_lines),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's result is written to the shared folder and read again."""
    work, docs = Work(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = work.put(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            work.drop(f"stage-{k - 1}")
    return docs


#: Stages 2 to 5 link, judge and tokenise; tests/llm/test_lines_and_leaks.py holds each stage against brute force.
ORACLE_SQL = None
