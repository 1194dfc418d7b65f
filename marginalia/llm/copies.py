"""Near copies by similarity of word shingles: SimHash gives the closest, MinHash bands the rest, whole sets decide.

Texts with one set of shingles are one node from the start.  The set's 64-bit SimHash goes through the grid
join of ``simhash``, and what it links is joined if the sets are similar.  Sets of similarity 0.8 differ by ten
bits in the mean, and a radius that reaches them all would meet far texts too, so the rest is found by MinHash:
``BANDS`` bands of ``ROWS`` minima miss a pair of similarity 0.8 with a chance of 3 in a million.  A band's bucket is
looked into where it holds sets that aren't joined yet.  No pair counts without its exact similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .components import smallest_reachable
from .marks import marked, marks_of
from .work import Work, tidied

BANDS, ROWS, SEED = 24, 4, 42
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted hashes of the shingles; a text of fewer words is one, and one without words has none."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # bytes: only A-Z are lowered, only ASCII blanks split
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[min(size, len(words)) - 1 :]
    return np.unique(np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts.tolist(), last.tolist(), strict=False)], np.uint64))


def bands(hashes: np.ndarray) -> np.ndarray:
    """A hash of each band's minima; none for an empty set."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(hashes), 4096):
        least = np.minimum(least, (hashes[None, a : a + 4096] * _FACTORS[:, None]).min(1))
    out = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        out = (out ^ least[k::ROWS]) * _MIX[k]
        out ^= out >> np.uint64(31)
    return out.view(np.int64)


def _key(hashes: np.ndarray) -> bytes:
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(hashes.tobytes())


def _sets(size: int):
    """Of every text the key of its set, the SimHash and the band hashes."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 2000):
                part = b.slice(start, 2000)
                found = [[_key(x), simhash.majority(x) if len(x) else 0, bands(x)] for x in (shingles(t.as_py(), size) for t in part.column("text"))]
                keys, prints, hashes = zip(*found, strict=True)
                cols = [part.column("doc_id"), pa.array(keys, pa.binary()), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(hashes, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "key", "fp", "bands"])

    return run


def _held(size: int, marks: np.ndarray):
    """Key and hashes of the sets of the documents that are marked."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.filter(pa.array(marked(marks, b.column("mark").to_numpy().view(np.uint64)))).column("text")
            for start in range(0, len(texts), 200):
                found = [shingles(t.as_py(), size) for t in texts.slice(start, 200)]
                yield pa.RecordBatch.from_arrays([pa.array([_key(x) for x in found], pa.binary()), pa.array([x.tobytes() for x in found], pa.binary())], ["key", "hashes"])

    return run


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have at least this Jaccard similarity."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both)


def forest(nodes: list[tuple[int, int, np.ndarray]], similarity: float) -> list[tuple[int, int]]:
    """Links that join the nodes (node, group, set) as all links of at least this similarity do; a group is joined already."""
    clusters: list[tuple[set[int], list[tuple[int, np.ndarray]]]] = []
    out = []
    for node, group, mine in nodes:
        groups, joined, rest = {group}, [(node, mine)], []
        for known, held in clusters:
            if group not in known:
                hit = next((x for x in held if similar(x[1], mine, similarity)), None)
                if hit is None:
                    rest.append((known, held))
                    continue
                out.append((hit[0], node))
            groups |= known
            joined = held + joined if len(joined) == 1 else joined + held
        clusters = [(groups, joined), *rest]
    return out


def _links(similarity: float):
    """Rows come sorted by bucket; one bucket's sets are held."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True))
        for _, mine in groupby(rows, itemgetter(0)):
            edges = np.array(forest([(node, group, np.frombuffer(h, np.uint64)) for _, node, group, h in mine], similarity), np.int64).reshape(-1, 2)
            if len(edges):
                yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0].copy()), pa.array(edges[:, 1].copy())], ["x", "y"])

    return run


def _confirmed(similarity: float):
    """Rows come sorted by bucket, its centre first; the sets that are similar to the centre's are linked to it."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        bucket = node = centre = None
        for b in batches:
            xs, ys = [], []
            for now, rim, other, h in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                mine = np.frombuffer(h, np.uint64)
                if not rim:
                    bucket, node, centre = now, other, mine
                elif now == bucket and similar(centre, mine, similarity):
                    xs.append(node)
                    ys.append(other)
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.int64()), pa.array(ys, pa.int64())], ["x", "y"])

    return run


def _with_sets(members: DataFrame, rows: DataFrame, size: int, *order: str) -> DataFrame:
    """Members (bucket, key, node, ...) with the hashes of their sets instead of the key, a bucket in one task.

    A bitmap of fixed size tells the documents whose sets are made once more.
    """
    marks = marks_of(members.select(F.xxhash64("node").alias("mark")), "mark")
    held = rows.mapInArrow(tidied(_held(size, marks)), "key binary, hashes binary").groupBy("key").agg(F.first("hashes").alias("hashes"))
    return members.join(held, "key").select("bucket", *order, "hashes").repartition("bucket").sortWithinPartitions("bucket", *order)


def by_fingerprint(nodes: DataFrame, rows: DataFrame, size: int, similarity: float, work: Work, radius: int = simhash.REACH) -> DataFrame:
    """Links (x, y) of similar sets among those whose fingerprints the grid join links within ``radius`` bits.

    A fingerprint's first set is compared with its others and with the first sets of the fingerprints linked to it.
    """
    first = work.put(nodes.groupBy("fp").agg(F.min(F.struct("node", "key")).alias("first")).select("fp", "first.node", "first.key"), "prints")
    near = simhash.links(first, radius).select(F.least("a", "b").alias("bucket"), F.greatest("a", "b").alias("fp")).distinct()
    others = nodes.join(first.select("fp", F.col("key").alias("least")), "fp").where("key <> least").select(F.col("fp").alias("bucket"), "key", "node")
    rim = work.put(near.join(first, "fp").select("bucket", "key", "node").unionByName(others), "rim")
    centres = first.withColumnRenamed("fp", "bucket").join(rim.select("bucket").distinct(), "bucket", "left_semi").select("bucket", "key", "node")
    members = centres.withColumn("rim", F.lit(0)).unionByName(rim.withColumn("rim", F.lit(1)))
    return _with_sets(members, rows, size, "rim", "node").mapInArrow(tidied(_confirmed(similarity)), "x long, y long")


def near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id and component_id of every document.

    component_id: the smallest doc_id reachable over pairs whose sets of ``shingle``-word shingles have a Jaccard
    similarity of at least ``similarity``.  Input: doc_id, text; other columns are ignored.  Wordless texts, null
    ones too, are copies of each other.  Rows of one doc_id are one document.  Rows without doc_id are left out.
    """
    work = Work(docs.sparkSession, "copies")
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("doc_id").cast("long")).alias("mark"))
    sets = work.put(rows.mapInArrow(tidied(_sets(shingle)), "doc_id long, key binary, fp long, bands array<long>"), "sets")
    nodes = work.put(sets.groupBy("key").agg(F.min("doc_id").alias("node"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "nodes")
    close = work.put(by_fingerprint(nodes, rows, shingle, similarity, work), "close")
    work.drop("prints", "rim")
    joined = smallest_reachable(close, Work(docs.sparkSession, "close")).select("node", F.col("component").alias("group"))
    grouped = nodes.join(joined, "node", "left").select("key", "node", F.coalesce("group", "node").alias("group"), "bands")
    spread = grouped.select("key", "node", "group", F.explode("bands").alias("bucket"))
    # Buckets with the same members say the same, those of one group nothing new; one of the others is looked into.
    counted = spread.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.xxhash64("key").cast("decimal(38,0)")).alias("who"), F.min("group").alias("least"), F.max("group").alias("most"))
    chosen = work.put(counted.where("least < most").groupBy("n", "who").agg(F.min("bucket").alias("bucket")).select("bucket"), "buckets")
    members = work.put(spread.join(chosen, "bucket").select("bucket", "key", "node", "group"), "members")
    edges = work.put(_with_sets(members, rows, shingle, "node", "group").mapInArrow(tidied(_links(similarity)), "x long, y long"), "links")
    # A document of several rows stands for all its sets.
    same = sets.select("doc_id", "key").join(nodes.select("key", "node"), "key").where("doc_id <> node").select(F.col("doc_id").alias("x"), F.col("node").alias("y"))
    moved = smallest_reachable(edges.unionByName(close).unionByName(same), work)
    work.drop("nodes", "close", "buckets", "members", "links")
    out = sets.select("doc_id").distinct().join(moved.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select("doc_id", F.coalesce("component", "doc_id").alias("component_id"))
