"""Sharding: minimax contiguous partition of ordered atomic groups.

Documents with equal text form one atomic group.  Groups are ordered: first those heavier than a
fixed share of the whole (their number has a proven bound: at most ``1 / share``), heaviest first,
then all others by the hash of their text.  The driver sees those as ordered cells of whole groups, ``2 ** bits`` of
them at first.  A binary search finds the smallest capacity for which a greedy pass needs no more
than the given number of shards.  A smaller one could only do by a cut inside a cell, so the cells where
the greedy pass at the next smaller capacity stops are split further, until they are single groups: then the
capacity is the smallest there is, and the driver has seen no more than ``shards * 2 ** bits`` sizes a round.
Only DataFrame functions touch rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .work import Work, utf8


def _greedy(sizes: list[int], shards: int, capacity: int) -> list[int] | None:
    """First atom of each shard when each is filled up to ``capacity``; None if they don't suffice."""
    starts, room = [0], capacity
    for i, size in enumerate(sizes):
        if size > capacity:
            return None
        if size > room:
            if len(starts) == shards:
                return None
            starts.append(i)
            room = capacity
        room -= size
    return starts


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """The least size of the largest shard."""
    low, high = max(max(sizes), -(-sum(sizes) // shards)), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if _greedy(sizes, shards, mid) else (mid + 1, high)
    return low


def stops(sizes: list[int], shards: int, capacity: int) -> list[int]:
    """Atoms that a greedy pass at this capacity finds too large for what room is left, up to the first that fits no shard."""
    out, room = [], capacity
    for i, size in enumerate(sizes):
        if size > room:
            out.append(i)
            if size > capacity or len(out) == shards:
                break
            room = capacity
        room -= size
    return out


def minimax_cuts(sizes: list[int], shards: int) -> list[int]:
    """Shard of each atom, in order, so that the largest shard is as small as it can be.

    Greedy filling at that capacity leaves the last shard short, so among the cuts that respect it
    each shard is closed where it comes nearest to an even share of what is left.
    """
    if not sizes:
        return []
    low = smallest_capacity(sizes, shards)
    # need[i]: shards that atoms from i on take at this capacity, greedily.
    n = len(sizes)
    need = [0] * (n + 1)
    end, load = n, 0
    reach = [n] * n
    for i in range(n - 1, -1, -1):
        load += sizes[i]
        while load > low:
            end -= 1
            load -= sizes[end]
        reach[i] = end
        need[i] = 1 + need[end]
    out, shard, load, left = [], 0, 0, sum(sizes)
    target = left / shards
    for i, size in enumerate(sizes):
        can = shard + 1 < shards and need[i] <= shards - shard - 1
        if load and can and (load + size > low or abs(load - target) <= abs(load + size - target)):
            left -= load
            shard, load = shard + 1, 0
            target = left / (shards - shard)
        load += size
        out.append(shard)
    return out


PREFIX = 48


def _cells(groups: DataFrame, splits: list[tuple[int, int]], bits: int) -> dict[tuple[int, int], list[tuple[int, int, int, int]]]:
    """(first, depth) of each cell to its parts: first prefix, depth, size and number of groups, in order."""
    out: dict[tuple[int, int], list[tuple[int, int, int, int]]] = {x: [] for x in splits}
    for depth in sorted({d for _, d in splits}):
        mine = [first for first, d in splits if d == depth]
        part = min(PREFIX, depth + bits)
        whole = F.shiftleft(F.shiftright("prefix", PREFIX - depth), PREFIX - depth) if depth else F.lit(0).cast("long")
        found = groups.where(whole.isin(mine)).groupBy(whole.alias("cell"), F.shiftright("prefix", PREFIX - part).alias("part")).agg(F.sum("size").alias("size"), F.count("*").alias("n"))
        for r in found.collect():  # at most 2 ** bits rows a cell
            out[(r["cell"], depth)].append((r["part"] << (PREFIX - part), part, r["size"], r["n"]))
    return {k: sorted(v) for k, v in out.items()}


def shard(docs: DataFrame, shards: int = 8, bits: int = 12, share: float = 1 / 1024, per_slice: int = 100_000, rounds: int = 24) -> DataFrame:
    """Shard and slot of every document, equal texts together, the largest shard as small as can be.

    Input: doc_id, text; other columns are ignored.  Null text: no bytes, and one group with the
    empty text.  Repeated rows count each; rows without doc_id are sharded like any other.  An atom heavier than what an even share of the rest
    would be takes a shard of its own.  An empty table gives no rows.  Cells are split in ``rounds`` rounds at most; where that
    ends it, the largest shard is larger than need be by less than a cell.
    Output: doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).
    """
    spark = docs.sparkSession
    work = Work(spark, "sharding")
    raw = utf8(F.col("text"))
    rows = work.put(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.unhex(F.sha2(raw, 256)).alias("key"), F.monotonically_increasing_id().alias("uid")), "rows")
    prefix = F.conv(F.substring(F.hex("key"), 1, PREFIX // 4), 16, 10).cast("long")
    groups = work.put(rows.groupBy("key").agg(F.sum("size").alias("size")).withColumn("prefix", prefix), "groups")
    total, n_rows = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    floor = max(1, int(total * share))
    # At most 1 / share groups can each hold more than that share of all bytes.
    heavy = [(bytes(r["key"]), r["size"]) for r in groups.where(F.col("size") > floor).orderBy(F.desc("size"), "key").collect()]
    light = groups.where(F.col("size") <= floor)
    heavy_shard: list[int] = []
    left, first = total, 0
    for _, size in heavy:  # those that no even split can hold
        if first < shards - 1 and size * (shards - first) >= left:
            heavy_shard.append(first)
            left, first = left - size, first + 1
        else:
            break
    ahead, cells = [s for _, s in heavy[first:]], _cells(light, [(0, 0)], bits)[(0, 0)]
    for _ in range(rounds):
        sizes = ahead + [c[2] for c in cells]
        if not sizes:
            break
        at = stops(sizes, shards - first, smallest_capacity(sizes, shards - first) - 1)
        split = [(c[0], c[1]) for c in (cells[i - len(ahead)] for i in at if i >= len(ahead)) if c[3] > 1 and c[1] < PREFIX]
        if not split:
            break
        parts = _cells(light, split, bits)
        cells = [x for c in cells for x in parts.get((c[0], c[1]), [c])]
    cuts = [first + x for x in minimax_cuts(ahead + [c[2] for c in cells], shards - first)]
    heavy_shard += cuts[: len(ahead)]
    by_cell = cuts[len(ahead) :]
    begin = by_cell[0] if by_cell else first
    # Where each further shard begins among the prefixes; a shard that no cell is in begins with the next.
    bounds = [next((c[0] for c, x in zip(cells, by_cell, strict=True) if x >= k), 1 << PREFIX) for k in range(begin + 1, shards)]
    marks = spark.createDataFrame([(k, x) for (k, _), x in zip(heavy, heavy_shard, strict=True)], "key binary, own int")
    tagged = rows.join(F.broadcast(marks), "key", "left")
    passed = F.lit(begin)
    for x in bounds:
        passed = passed + (prefix >= x).cast("int")
    slices = parts_for_rows(n_rows, per_slice)
    placed = tagged.select("doc_id", "size", "text_crc32", F.coalesce("own", passed).cast("int").alias("shard"), "uid", F.pmod(F.xxhash64("uid"), F.lit(slices)).cast("int").alias("slice"))
    counts = placed.groupBy("shard", "slice").agg(F.count("*").alias("n"))
    bases = counts.withColumn("base", F.sum("n").over(W.partitionBy("shard").orderBy("slice")) - F.col("n")).drop("n")
    nth = F.row_number().over(W.partitionBy("shard", "slice").orderBy("uid"))
    out = placed.withColumn("nth", nth).join(bases, ["shard", "slice"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("nth") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def parts_for_rows(n: int, each: int) -> int:
    return max(1, -(-n // each))
