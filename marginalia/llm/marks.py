"""A bitmap of fixed size over 64-bit hashes: says which rows are worth sending to a join."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 24


def marks_of(df: DataFrame, column: str) -> np.ndarray:
    """The bitmap of a long column, 2 MB whatever the number of rows; the driver gets at most 2 ** 19 words."""
    mark = F.shiftrightunsigned(column, 64 - BITS).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("m") % 32)
    words = df.select(mark.alias("m")).groupBy(F.shiftright("m", 5).alias("w")).agg(F.bit_or(one).alias("bits"))
    out = np.zeros(1 << (BITS - 5), "<u4")
    for r in words.collect():
        out[r["w"]] = r["bits"]
    return out.view(np.uint8)


def marked(marks: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each unsigned hash has its mark set; false for no hash of the bitmap's own rows."""
    low = (hashes >> np.uint64(64 - BITS)).astype(np.int64)
    return (marks[low >> 3] >> (low & 7).astype(np.uint8)) & 1 > 0
