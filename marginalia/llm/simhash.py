"""SimHash near-dedup: segment-popcount embedding and a grid range join.

A fingerprint of 64 bits is cut into 32 segments of two bits; the bit counts of the segments are its
image, and the Manhattan distance of two images never exceeds the Hamming distance of the
fingerprints.  The 32 coordinates form three grids.  Within distance 4 the images differ by at most
1 in one of the three, so a fingerprint stands in its own cell of each grid and looks into the cells
that differ by one step.  Pairs that meet pass the full Manhattan bound and then the exact
distance.  Identical fingerprints are one node from the start, and a cell gives back only a
spanning forest of its links, so a group of near copies never turns into all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import smallest_reachable
from .work import Work, tidied

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Segments (of two bits each) per grid.
GRIDS = (11, 11, 10)
#: The largest distance at which one of the grids differs by one step at most.
REACH = 2 * len(GRIDS) - 1


def _lanes() -> np.ndarray:
    """For every byte, its bits as eight counters of eight bits in one word."""
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.uint64)
    return (bits << (np.arange(8, dtype=np.uint64) * np.uint64(8))).sum(1, dtype=np.uint64)


LANES = _lanes()


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes."""
    n, counts = len(hashes), np.zeros(64, np.int64)
    raw = hashes.astype("<u8").view(np.uint8).reshape(n, 8)
    starts = np.arange(0, n, 255)  # a lane holds 255
    for k in range(8):
        sums = np.add.reduceat(LANES[raw[:, k]], starts)
        counts[8 * k : 8 * k + 8] = sums.view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
    return int((np.uint64(1) << np.flatnonzero(2 * counts > n).astype(np.uint64)).sum(dtype=np.uint64))


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Fingerprint of a whole text; zero where it has no words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # bytes: only A-Z are lowered, only ASCII blanks split
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[min(shingle, len(words)) - 1 :]
    hashes = [xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts.tolist(), last.tolist(), strict=False)]
    return majority(np.array(hashes, np.uint64))


def _fingerprints(batches) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = np.array([fingerprint(x.as_py()) for x in b.column("text")], np.uint64)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])


def image(fp: np.ndarray) -> np.ndarray:
    """Bit counts of the two-bit segments, each in its own two bits."""
    low = np.uint64(0x5555555555555555)
    return (fp & low) + ((fp >> np.uint64(1)) & low)


def unary(fp: np.ndarray) -> np.ndarray:
    """The image with each count of 0, 1 or 2 written as that many set bits."""
    low = np.uint64(0x5555555555555555)
    a, b = fp & low, (fp >> np.uint64(1)) & low
    return (a | b) | ((a & b) << np.uint64(1))


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of the images of two fingerprints, given in unary."""
    return np.bitwise_count(a ^ b)


def _cells(batches) -> Iterator[pa.RecordBatch]:
    """A fingerprint's own cell in each grid (home), and those one step away (visits)."""
    for b in batches:
        fp = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        im = image(fp)
        keys, fps, home = [], [], []
        first = 0
        for g, n in enumerate(GRIDS):
            part = (im >> np.uint64(2 * first)) & np.uint64((1 << 2 * n) - 1)
            tag = np.uint64(g << 24)
            keys.append(part | tag)
            fps.append(fp)
            home.append(np.ones(len(fp), bool))
            for k in range(n):
                one = np.uint64(1 << 2 * k)
                now = (part >> np.uint64(2 * k)) & np.uint64(3)
                for can, moved in ((now < 2, part + one), (now > 0, part - one)):
                    keys.append(moved[can] | tag)
                    fps.append(fp[can])
                    home.append(np.zeros(int(can.sum()), bool))
            first += n
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).astype(np.int32)), pa.array(np.concatenate(fps).view(np.int64)), pa.array(np.concatenate(home))], ["cell", "fp", "home"])


class Forest:
    """Union-find over the fingerprints of one task; ``join`` tells whether a link is new."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def links_in_cell(home: np.ndarray, visits: np.ndarray, radius: int = RADIUS, block: int = 1 << 20) -> list[tuple[int, int]]:
    """A spanning forest of all links between homes, and between homes and visitors, of one cell.

    Pairs are compared in blocks of bounded size: the Manhattan bound first, then the exact distance.
    """
    forest, out = Forest(), []
    others = np.concatenate([home, visits])
    mine, them = unary(home), unary(others)
    step = max(1, block // len(others))
    for a in range(0, len(home), step):
        i, j = np.nonzero(manhattan(mine[a : a + step, None], them[None, :]) <= radius)
        i += a
        ok = (np.bitwise_count(home[i] ^ others[j]) <= radius) & (i != j)
        for x, y in zip(home[i[ok]].tolist(), others[j[ok]].tolist(), strict=True):
            if forest.join(x, y):
                out.append((x, y))
    return out


def _links(batches, radius: int = RADIUS) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by cell; one cell at a time is held."""
    rest: list[np.ndarray] = []

    def solve(cell, fp, home):
        edges: list[tuple[int, int]] = []
        bounds = np.flatnonzero(np.diff(cell, prepend=cell[0] - 1, append=cell[-1] + 1))
        for a, z in zip(bounds[:-1], bounds[1:], strict=True):
            h = home[a:z]
            if z - a > 1 and h.any():
                edges += links_in_cell(fp[a:z][h], fp[a:z][~h], radius)
        x = np.array(edges, np.uint64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(x[:, 0].copy().view(np.int64)), pa.array(x[:, 1].copy().view(np.int64))], ["a", "b"])

    for b in batches:
        now = [b.column("cell").to_numpy(), b.column("fp").to_numpy().view(np.uint64), b.column("home").to_numpy(zero_copy_only=False)]
        if rest:
            now = [np.concatenate(x) for x in zip(rest, now, strict=True)]
        if not len(now[0]):
            continue
        cut = int(np.searchsorted(now[0], now[0][-1], "left"))
        if cut:
            yield solve(*(x[:cut] for x in now))
        rest = [x[cut:] for x in now]
    if rest:
        yield solve(*rest)


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) that join distinct fingerprints (fp) as all links of at most ``radius`` differing bits do."""
    if radius > REACH:
        raise ValueError(f"the grids find distances up to {REACH}")
    cells = prints.select("fp").mapInArrow(tidied(_cells), "cell int, fp long, home boolean").repartition("cell").sortWithinPartitions("cell")
    return cells.mapInArrow(tidied(lambda batches: _links(batches, radius)), "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document.

    Input: doc_id, text; other columns are ignored.  Null, empty and wordless texts have fingerprint
    zero and link like any other.  Repeated rows and equal doc_ids give a row each.  An empty
    table gives no rows.  component_id: the smallest doc_id reachable over links of at most
    ``RADIUS`` differing bits.
    """
    work = Work(docs.sparkSession, "simhash")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return grouped(work.put(rows.mapInArrow(_fingerprints, "doc_id long, fp long"), "fingerprints"), work)


def grouped(prints: DataFrame, work: Work) -> DataFrame:
    """What ``near_duplicates`` returns, from (doc_id, fp) rows; fp holds the 64 bits as a signed number."""
    nodes = work.put(prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "nodes")
    edges = work.put(links(nodes), "links")
    named = edges.join(nodes.select(F.col("fp").alias("a"), F.col("doc_id").alias("x")), "a").join(nodes.select(F.col("fp").alias("b"), F.col("doc_id").alias("y")), "b")
    moved = smallest_reachable(named.select("x", "y"), work)
    # Only fingerprints whose group has a smaller document need a row here.
    better = nodes.join(moved.withColumnRenamed("node", "doc_id"), "doc_id").select("fp", "component")
    roots = work.put(nodes.join(better, "fp", "left").select("fp", F.coalesce("component", "doc_id").alias("component_id")), "roots")
    out = prints.join(roots, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
