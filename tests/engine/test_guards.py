"""Text steps that most bodies are spared: the same results, without the work."""

import re
import time

import pytest
from marginalia.functions import text as T
from marginalia.plans import vocabulary as V
from pyspark.sql import functions as F

BODIES = ["changed\t to", "changed `x` to", "chan`x`ged to", "Changed  TO.", "now", "now we", "know we", "now weed", "as requested", "odd ` now we", "`now we` as words", "FOR NOW", "for  now, probably", "if\nneeded", "as requested, previously", "written\nby x", "", " ", "previously_x", "x.previously"]


def first(body, terms):
    if body.count("`") % 2 == 0:
        body = re.sub("`[^`]*`", " ", body)
    text = re.sub(r"\s+", " ", body).strip().lower()
    return next((t for t in terms if re.search(rf"(?<!\w){t}(?!\w)", text)), None)


@pytest.mark.parametrize("terms", [V.NARRATION, V.ATTRIBUTION, V.HEDGING, V.VAGUE])
def test_first_match(spark, terms):
    df = spark.createDataFrame([(x,) for x in BODIES], "body string")
    assert [(r.body, r.t) for r in df.select("body", T.first_match(F.col("body"), terms).alias("t")).collect()] == [(x, first(x, terms)) for x in BODIES]


def test_opens_with(spark):
    bodies = ["go:x", "  go:x", "ago:x", "export ", "export x", "\texport  x ", "exported", "+build", "", "x\ngo:"]
    df = spark.createDataFrame([(x,) for x in bodies], "body string")
    want = [any(x.strip().startswith(p) for p in V.LANGUAGES["go"]["directives"]) for x in bodies]
    assert [r.t for r in df.select(T.opens_with(F.col("body"), V.LANGUAGES["go"]["directives"]).alias("t")).collect()] == want


def test_plain_bodies_are_not_normalised(spark):
    df = spark.range(4000).select(F.concat(F.repeat(F.lit("plain  words "), 200), F.col("id").cast("string")).alias("body")).cache()
    df.count()

    def took(c):
        def run():
            began = time.time()
            df.where(c.isNotNull()).select(c.alias("c")).write.format("noop").mode("overwrite").save()
            return time.time() - began

        return min(run() for _ in range(3))

    once = took(F.nullif(T.normalise(T.strip_code_spans(F.col("body"))), F.lit("x")))
    assert took(T.first_match(F.col("body"), V.NARRATION)) < once and took(T.first_match(F.col("body"), V.HEDGING)) < once
