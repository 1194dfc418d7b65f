"""Checks a stream of files, micro-batch by micro-batch, and appends findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..check import check
from ..plans.registry import Config


def watch(files: DataFrame, out: str, checkpoint: str, config: Config | None = None, once: bool = False) -> StreamingQuery:
    """Findings of each batch of (path, lang, content) go to their own folder under ``out``, so a replayed batch replaces its own."""

    def each(batch: DataFrame, number: int) -> None:
        check(batch.dropDuplicates(["path"]), config).findings.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
