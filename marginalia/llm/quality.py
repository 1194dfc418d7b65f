"""Quality rules: one threshold table compiled into one projection.

``RULES`` is data: a name, a counted feature, what it is divided by, the bounds of the quotient, and
the least number of words for which the rule applies.  ``score`` computes every feature and every
verdict of a document from its own row, with built-in functions only, so nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Common words of the languages the corpus may hold; a word counts if it is one of them in lower case, as it stands: "the," isn't.
STOP_WORDS = (
    "the of and to in a is that it for was on are as with be by this at from an or not "
    "de la le et les des en un une du que qui dans est pour au avec sur pas par "
    "der die das und ist von den mit zu ein eine im des nicht sich auf dem für auch "
    "el los las y del se por con una es para su al lo como "
    "in che di il per non sono gli da"
).split()


@dataclass(frozen=True)
class Rule:
    """Keep a document while ``low <= feature / base <= high``, tested in whole numbers of 1/1000."""

    name: str
    feature: str
    base: str
    low: int | None
    high: int | None
    least_words: int = 0


RULES = (
    Rule("word_count", "n_words", "one", 10_000, 1_000_000_000),
    Rule("mean_word_length", "word_chars", "n_words", 2_000, 20_000),
    Rule("symbol_ratio", "n_symbols", "n_words", None, 300),
    Rule("stop_word_ratio", "n_stop_words", "n_words", 20, None, 40),
    Rule("repeated_line_ratio", "n_dup_lines", "n_lines", None, 700, 40),
)


def _bind(value: Column, use) -> Column:
    """``use(value)`` with value computed once per row, whatever the optimiser merges."""
    return F.get(F.transform(F.array(value), use), 0)


def _repeated(words: Column) -> Column:
    """Words that lie in a 5-word window which the text holds twice or more, the first included."""

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - 5), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(5))))

    def positions(s: Column) -> Column:
        n = F.size(s)
        same = lambda k: ((k > 0) & (F.get(s, k - 1)["h"] == F.get(s, k)["h"])) | ((k < n - 1) & (F.get(s, k + 1)["h"] == F.get(s, k)["h"]))
        return F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), n - 1), same), lambda k: F.get(s, k)["i"]))

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, k: F.least(F.lit(5), F.coalesce(F.get(p, k + 1) - x, F.lit(5))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    def count(w: Column) -> Column:
        found = _bind(F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), lambda s: _bind(positions(s), covered))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(found)

    hashed = _bind(F.transform(words, lambda w: F.xxhash64(w)), lambda h: _bind(windows(h), count))
    return F.when(F.size(words) < 6, F.lit(0)).otherwise(hashed)


def features(docs: DataFrame) -> DataFrame:
    """doc_id and the counted features of each whole text.

    Null or empty text: every count is zero.  Columns other than doc_id and text are ignored; a
    repeated row is scored once per row; an empty table gives no rows.
    """
    return _features(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id")


def _features(docs: DataFrame, *carried: str) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    staged = docs.select(*carried, text.alias("text")).select(*carried, "text", F.array_remove(F.split("text", SPACE), "").alias("words"))
    stop = F.lit(list(dict.fromkeys(STOP_WORDS)))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.regexp_replace(x, SPACE, "")) > 0)
    return staged.select(
        *carried,
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", SPACE, "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        _bind(lines, lambda x: F.struct(F.size(x).alias("all"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("lines"),
        _repeated(F.col("words")).cast("long").alias("n_repeat_words"),
        F.size(F.filter("words", lambda w: F.array_contains(stop, F.lower(w)))).cast("long").alias("n_stop_words"),
    ).select(*carried, "n_words", "word_chars", "n_symbols", F.col("lines.dup").cast("long").alias("n_dup_lines"), "n_repeat_words", "n_stop_words", F.col("lines.all").cast("long").alias("n_lines"), F.lit(1).cast("long").alias("one"))


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """True for rows of ``features`` that every rule keeps."""
    kept = F.lit(True)
    for r in rules:
        value, base = 1000 * F.col(r.feature), F.col(r.base)
        good = F.lit(True)
        if r.low is not None:
            good = good & (value >= r.low * base)
        if r.high is not None:
            good = good & (value <= r.high * base)
        kept = kept & (good if not r.least_words else (F.col("n_words") < r.least_words) | good)
    return kept


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def score(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Features, ``base_failed`` and ``kept`` of every document."""
    return features(docs).withColumn("base_failed", base_failed()).withColumn("kept", ~base_failed() & verdict(rules)).drop("one")


def with_verdict(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The input's rows and columns, and ``__kept``; no shuffle, whatever the other columns are called."""
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), F.col("text").alias("text"))
    judged = _features(packed, "__row").select("__row", (~base_failed() & verdict(rules)).alias("__kept"))
    return judged.select("__row.*", "__kept")
