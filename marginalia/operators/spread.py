"""How tables that grow with the files are dealt out and joined.

Neither a session's number of shuffle partitions nor the size that a compressed table has on disk says what a
task or the driver must hold, so both are settled here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def parts(stored: DataFrame, each: int) -> int:
    """Partitions for what is derived from a stored table: one for ``each`` bytes of its files, as many as there are cores at least."""
    size = int(str(stored._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(stored.sparkSession.sparkContext.defaultParallelism, -(-size // each))


def matched(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner", n: int | None = None) -> DataFrame:
    """A join of two tables that both grow with the files: neither is sent whole to the driver, however small it looks on disk.

    n: partitions that both are dealt to; the session's without it.
    """
    if n:
        keys = [on] if isinstance(on, str) else on
        left, right = left.repartition(n, *keys), right.repartition(n, *keys)
    return left.join(right.hint("merge"), on, how)
