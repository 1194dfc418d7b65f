"""Packing: shortest-pack-first over the length histogram.

A document's ids are cut into full sequences and one remainder.  Only the histogram of remainder
lengths (at most ``seq_len - 1`` counters, whatever the corpus size) reaches the driver.  There,
lengths are placed longest first, each time into the open packing pattern that is emptiest, and
pattern counts are split as a length fills them only in part.  The patterns give, for every
length, ranges of ranks with the sequence and offset they get; documents find their range by their
rank among the remainders of equal length.  Ranks come from per-bucket counts, so a length that a
third of all documents share is still ranked by many tasks.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tokens import default_vocabulary, encoder
from .work import Work, tidied


def shortest_pack_first(histogram: dict[int, int], seq_len: int) -> list[tuple[list[int], int]]:
    """Packing patterns as (lengths in order, count) for remainder lengths below ``seq_len``.

    Longest length first; an open pattern with the most room takes it if it fits, else a new pattern
    is opened.  A pattern holding more packs than there are documents left is split in two.
    """
    heap: list[tuple[int, int, list[int]]] = []  # (used, tie, lengths), emptiest first
    counts: dict[int, int] = {}
    tie = 0
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        placed: list[tuple[int, int, list[int]]] = []
        while left:
            if heap and heap[0][0] + length <= seq_len:
                used, key, items = heapq.heappop(heap)
                n = counts.pop(key)
                if n > left:
                    tie += 1
                    counts[tie] = n - left
                    heapq.heappush(heap, (used, tie, items))
                take, before = min(n, left), items
            else:
                # As many copies of this length in one new pattern as fit, so that equal lengths share packs.
                each = max(1, seq_len // length)
                if left >= each:
                    take, before, used, reps = left // each, [], 0, each
                else:
                    take, before, used, reps = 1, [], 0, left
                tie += 1
                counts[tie] = take
                placed.append((length * reps, tie, [length] * reps))
                left -= take * reps
                continue
            tie += 1
            counts[tie] = take
            left -= take
            # The same pattern may take the length again while it has room.
            heapq.heappush(heap, (used + length, tie, [*before, length]))
        for x in placed:
            heapq.heappush(heap, x)
    return [(items, counts[key]) for _, key, items in sorted(heap, key=lambda x: x[1])]


def _slots(patterns: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: first rank of each slot, first sequence and offset of that slot."""
    by: dict[int, list[list[int]]] = defaultdict(lambda: [[], [], []])
    taken: dict[int, int] = defaultdict(int)
    first = 0
    for items, n in patterns:
        at = 0
        for length in items:
            slot = by[length]
            slot[0].append(taken[length])
            slot[1].append(first)
            slot[2].append(at)
            taken[length] += n
            at += length
        first += n
    return {k: tuple(np.array(x, dtype=np.int64) for x in v) for k, v in by.items()}


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _cut(vocabulary: str, end_id: int, seq_len: int):
    def run(batches):
        enc = encoder(vocabulary)
        for batch in batches:
            docs = batch.column(0)
            for i, j, ids, n in enc.encode(batch.column(1), end_id):
                pieces = -(-n // seq_len)
                first = np.cumsum(pieces) - pieces
                row = np.repeat(np.arange(j - i), pieces)
                nth = np.arange(len(row)) - first[row]
                base, data = (np.cumsum(n) - n)[row], ids.astype("<u4", copy=False)
                a = base + nth * seq_len
                z = np.minimum(a + seq_len, base + n[row])
                crc = [zlib.crc32(data[x:y]) for x, y in zip(a.tolist(), z.tolist(), strict=True)]
                cols = [docs.slice(i, j - i).take(pa.array(row)), *(pa.array(x, pa.int64()) for x in (nth * seq_len, z - a, crc, n[row]))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def pack(docs: DataFrame, seq_len: int = 2048, vocabulary: str | None = None, end_id: int = 1, per_bucket: int = 50_000) -> DataFrame:
    """Pieces of all documents with the sequence and offset each lies in.

    Input: doc_id, text (other columns are ignored, whatever their names).  Null and empty texts are
    a document of the end id alone.  A repeated doc_id is packed once per row.  An empty table gives
    no rows.  Equal lengths are interchangeable: ties in rank are broken by bucket, doc_id, crc.
    Output: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    """
    spark, vocabulary = docs.sparkSession, vocabulary or default_vocabulary()
    work = Work(spark, "packing")
    pieces = work.put(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidied(_cut(vocabulary, end_id, seq_len)), PIECE), "pieces")
    buckets = max(1, -(-pieces.count() // per_bucket))
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)).cast("int"))
    counts = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    ranked = W.partitionBy("length").orderBy("bucket")
    bases = work.put(counts.withColumn("base", F.sum("n").over(ranked) - F.col("n")), "bases")
    histogram = {r["length"]: r["n"] for r in bases.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most seq_len rows
    full = histogram.pop(seq_len, 0)
    slots = _slots(shortest_pack_first(histogram, seq_len))
    within = W.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")
    placed = pieces.withColumn("nth", F.row_number().over(within)).join(bases.select("length", "bucket", "base"), ["length", "bucket"])

    def place(batches):
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            seq, off = rank.copy(), np.zeros(len(rank), np.int64)
            for k in np.unique(length):
                if k == seq_len:
                    continue  # a sequence of its own, numbered by rank
                at, (start, first, offset) = np.flatnonzero(length == k), slots[int(k)]
                slot = np.searchsorted(start, rank[at], "right") - 1
                seq[at], off[at] = full + first[slot] + rank[at] - start[slot], offset[slot]
            cols = [b.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(seq), pa.array(off)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    ready = placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("nth") - 1).alias("rank"))
    return ready.mapInArrow(place, PIECE + ", sequence_id long, offset long")
