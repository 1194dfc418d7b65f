"""Repeated-substring removal: every byte covered by a ``width``-byte string that also starts in an earlier document.

The suffix-array form of this operator is ``suffixes.repeated_windows``; it works on what fits one
process and is the check for this one.  The distributed form compares the same ``width``-byte windows
by hash.  Each window is owned by the smallest of its ``GRAM``-byte hashes, its anchor, so equal
windows have equal anchors and consecutive windows mostly share one.  Three rounds go between blocks
of documents and hash buckets, each block sending every key once, however often it holds it:

1. anchors: which occur outside their document at all;
2. for those, the run of windows an anchor owns, as one hash: where all runs are equal, all windows
   in them are settled at once;
3. for anchors whose runs differ, the single windows.

Answers are one or two bits a key.  Blocks are frozen in a table bucketed by block, so answers are
joined to texts without moving texts.  A bucket holds a fixed share of the keys: the number of
buckets follows the input, and a key met in a third of all documents is there once a block.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byteprint import RangeHash, mix, window_min
from .work import Work, parts_for, utf8

GRAM = 24
_SALT = np.uint64(0x51ED2701A3B7C4D9)
_LOW48 = np.uint64((1 << 48) - 1)


def _anchors(data: np.ndarray, sizes: np.ndarray, width: int, each: int = 1 << 20) -> Iterator[tuple]:
    """(key, first window, end of windows, document, byte base, hasher) of the runs of each part of a block."""
    ends = np.cumsum(sizes)
    i = 0
    while i < len(sizes):
        base = int(ends[i] - sizes[i])
        j = max(i + 1, int(np.searchsorted(ends, base + each, "right")))
        part = data[base : int(ends[j - 1])]
        if len(part) >= width:
            h = RangeHash(part)
            least = window_min(h.rolling(GRAM), width - GRAM + 1)
            doc = np.repeat(np.arange(i, j), sizes[i:j])[: len(least)]
            stop = ends[doc] - base - width + 1  # windows of a document end here
            new = np.ones(len(least), bool)
            new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
            edge = np.append(np.flatnonzero(new), len(least))
            start, stop_of = edge[:-1], edge[1:]
            inside = start < stop[start]
            start, stop_of = start[inside], stop_of[inside]
            yield mix(least[start] ^ _SALT), start, np.minimum(stop_of, stop[start]), doc[start], base, h
        i = j


def _runs(block: dict, width: int) -> tuple[np.ndarray, ...]:
    """key, run hash, first window and end in the block's bytes, document of all runs of a block."""
    found = [(k, h(a, z - 1 + width), a + base, z + base, d) for k, a, z, d, base, h in _anchors(block["data"], block["sizes"], width)]
    kinds = (np.uint64, np.uint64, np.int64, np.int64, np.int64)
    return tuple(np.concatenate([np.zeros(0, t), *(x[i] for x in found)]) for i, t in enumerate(kinds))


def _grouped(key: np.ndarray, doc_id: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, where each row's key stands among them, the smallest and largest doc_id of each."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    head = np.flatnonzero(np.diff(k, prepend=k[:1] ^ np.uint64(1)) != 0) if len(k) else np.zeros(0, np.int64)
    where = np.empty(len(k), np.int64)
    where[order] = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(k))))
    d = doc_id[order]
    if not len(head):
        return k, where, d, d
    return k[head], where, np.minimum.reduceat(d, head), np.maximum.reduceat(d, head)


def _bucket_bounds(keys: np.ndarray, bits: int) -> np.ndarray:
    """Ends of the buckets in sorted keys; a key's bucket is its top bits."""
    return np.searchsorted(keys >> np.uint64(64 - bits) if bits else np.zeros(len(keys), np.uint64), np.arange(1 << bits, dtype=np.uint64), "right")


def _short(keys: np.ndarray, bits: int) -> bytes:
    """The 48 bits after the bucket's."""
    return ((keys >> np.uint64(16 - bits)) & _LOW48).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _long(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


MESSAGE = "bucket int, block long, keys binary, runs binary, docs binary"


def _send(block: int, keys: np.ndarray, bits: int, runs: np.ndarray | None, docs: np.ndarray | None) -> pa.RecordBatch:
    rows, at = [], 0
    for b, end in enumerate(_bucket_bounds(keys, bits)):
        if end > at:
            rows.append((b, block, _short(keys[at:end], bits), None if runs is None else _short(runs[at:end], 16), None if docs is None else zlib.compress(docs[at:end].astype("<i8").tobytes(), 1)))
            at = end
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), *[pa.binary()] * 3), strict=True)], ["bucket", "block", "keys", "runs", "docs"])


ANSWER = "block long, bucket int, a binary, b binary"


def _answer(table: pa.Table) -> pa.Table:
    """One bucket: per key of each block, bit a (round 1: elsewhere too; 2: runs differ) and bit b (a smaller document elsewhere)."""
    blocks = table.column("block").to_pylist()
    raw = [x.as_py() for x in table.column("keys")]
    n = np.array([len(x) // 6 for x in raw], np.int64)
    keys = _long(b"".join(raw))
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    head = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    size = np.diff(np.append(head, len(k)))
    a, b = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    first = table.column("docs")[0].as_py()
    if first is None:
        a[order] = np.repeat(size > 1, size)
    else:
        docs = np.concatenate([np.frombuffer(zlib.decompress(x.as_py()), "<i8") for x in table.column("docs")])[order]
        b[order] = np.repeat(np.minimum.reduceat(docs, head), size) < docs
        if table.column("runs")[0].as_py() is not None:
            runs = _long(b"".join(x.as_py() for x in table.column("runs")))[order]
            many = (np.minimum.reduceat(runs, head) != np.maximum.reduceat(runs, head)) | (runs[head] == _MANY)
            a[order] = np.repeat(many, size)
    at = np.concatenate([[0], np.cumsum(n)])
    pack = lambda x: [np.packbits(x[i:j]).tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]
    return pa.table([pa.array(blocks, pa.int64()), table.column("bucket").cast(pa.int32()), pa.array(pack(a), pa.binary()), pa.array(pack(b), pa.binary())], ["block", "bucket", "a", "b"])


#: Stands for "this block holds several different runs of the anchor".
_MANY = _LOW48


def _received(answers: list[dict] | None, keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    by = {x["bucket"]: x for x in answers or []}
    a, b, at = np.zeros(len(keys), bool), np.zeros(len(keys), bool), 0
    for k, end in enumerate(_bucket_bounds(keys, bits)):
        if end > at:
            for out, name in ((a, "a"), (b, "b")):
                out[at:end] = np.unpackbits(np.frombuffer(by[k][name], np.uint8), count=end - at)
            at = end
    return a, b


class _Block:
    """What a block works out again in every round, and what the answers so far say of it."""

    def __init__(self, row: dict, width: int, bits: int):
        self.width, self.bits = width, bits
        self.data = np.frombuffer(zlib.decompress(row["data"]), np.uint8)
        self.sizes = np.frombuffer(row["sizes"], "<i8")
        self.doc_ids = np.frombuffer(row["doc_ids"], "<i8")
        self.key, self.run, self.start, self.stop, self.doc = _runs({"data": self.data, "sizes": self.sizes}, width)
        self.keys, self.where, self.low, self.high = _grouped(self.key, self.doc_ids[self.doc])
        self.row = row

    def shared(self) -> np.ndarray:
        """Among distinct keys, those that some other document holds."""
        return _received(self.row["one"], self.keys, self.bits)[0] | (self.low != self.high)

    def second(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shared keys, their run hash (or that there are several), their smallest document."""
        some = self.shared()
        _, _, least, most = _grouped(self.key, self.run.view(np.int64))
        runs = np.where(least == most, least.view(np.uint64), np.uint64(0))
        return self.keys[some], np.where(least[some] == most[some], np.minimum(runs[some] & _LOW48, _MANY - np.uint64(1)), _MANY), self.low[some]

    def settled(self) -> tuple[np.ndarray, np.ndarray]:
        """Per run: must its windows be compared one by one; is it settled as repeated."""
        some = self.shared()
        keys, _, low = self.second()
        differ, smaller = _received(self.row["two"], keys, self.bits)
        single, lower = np.zeros(len(some), bool), np.zeros(len(some), bool)
        single[some], lower[some] = differ, smaller
        rest = some & ~single
        own = self.doc_ids[self.doc]
        return single[self.where], rest[self.where] & ((own > self.low[self.where]) | lower[self.where])

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, first byte and document of every window to be compared by itself."""
        single, _ = self.settled()
        a, z, d = self.start[single], self.stop[single], self.doc[single]
        n = z - a
        at = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else a, n) + np.arange(n.sum())
        out, doc = np.zeros(len(at), np.uint64), np.repeat(d, n)
        for _, _, _, docs, base, h in _anchors(self.data, self.sizes, self.width):
            here = slice(*np.searchsorted(doc, [docs[0], docs[-1] + 1])) if len(docs) else slice(0, 0)
            x = at[here] - base
            out[here] = mix(h(x, x + self.width) ^ _SALT)
        return out, at, doc

    def covered(self) -> np.ndarray:
        """Whether each byte of the block is to go."""
        _, whole = self.settled()
        diff = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(diff, self.start[whole], 1)
        np.add.at(diff, self.stop[whole] - 1 + self.width, -1)
        key, at, doc = self.windows()
        keys, where, low, _ = _grouped(key, self.doc_ids[doc])
        _, smaller = _received(self.row["three"], keys, self.bits)
        gone = at[(self.doc_ids[doc] > low[where]) | smaller[where]]
        np.add.at(diff, gone, 1)
        np.add.at(diff, gone + self.width, -1)
        return np.cumsum(diff[:-1]) > 0


def _rows(batches) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


KEPT = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"


def remove_repeats(docs: DataFrame, width: int = 50, block_bytes: int = 6 << 20) -> DataFrame:
    """Per document: removed byte spans and the bytes that stay.

    Input: doc_id, text; other columns are ignored.  Null and empty texts have no bytes.  Rows with equal
    doc_id don't count against each other, as none has the smaller doc_id; both meet all others.
    Rows without doc_id come before and after none: they lose nothing and count against no other.
    Texts shorter than ``width`` lose nothing.  An empty table gives no rows.  Windows are
    compared by 48 bits of a 64-bit hash within a bucket.
    Output: doc_id, n_bytes, n_removed, spans (start, end; in bytes, maximal), kept (binary).
    """
    if width <= GRAM:
        raise ValueError(f"width must be over {GRAM}")
    spark = docs.sparkSession
    work = Work(spark, "repeats")
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text").cast("string")).alias("data"))
    raw = every.where("doc_id is not null")
    total = raw.agg(F.sum(F.octet_length("data"))).first()[0]
    n_blocks = parts_for(total, block_bytes)
    bits = min(16, max(0, (n_blocks - 1).bit_length()))
    types = [pa.int64(), *[pa.binary()] * 3]

    def freeze(batches):
        ids, parts, size = [], [], 0

        def out():
            row = (uuid.uuid4().int >> 66, np.array(ids, "<i8").tobytes(), np.array([len(p) for p in parts], "<i8").tobytes(), zlib.compress(b"".join(parts), 1))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], ["block", "doc_ids", "sizes", "data"])

        for b in batches:
            for doc, data in zip(b.column("doc_id").to_pylist(), b.column("data"), strict=True):
                ids.append(doc)
                parts.append(data.as_py())
                size += len(parts[-1])
                if size >= block_bytes:
                    yield out()
                    ids, parts, size = [], [], 0
        if ids:
            yield out()

    # Names of blocks are made once: from here on only the written table is read.
    name = f"marginalia_repeats_{uuid.uuid4().hex}"
    slots = min(4096, max(n_blocks, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    frozen = raw.mapInArrow(freeze, "block long, doc_ids binary, sizes binary, data binary")
    frozen.write.bucketBy(slots, "block").option("compression", "none").option("path", work.path("blocks")).saveAsTable(name)
    blocks = spark.table(name)

    def joined(*answers: DataFrame) -> DataFrame:
        out = blocks
        for column, df in zip(("one", "two", "three"), answers, strict=False):
            mine = df.repartition(slots, "block").groupBy("block").agg(F.collect_list(F.struct("bucket", "a", "b")).alias(column))
            out = out.join(mine.hint("shuffle_hash"), "block", "left")
        for column in ("one", "two", "three")[len(answers) :]:
            out = out.withColumn(column, F.lit(None).cast("array<struct<bucket:int,a:binary,b:binary>>"))
        return out

    def ask(k: int, *answers: DataFrame) -> DataFrame:
        def send(batches):
            for row in _rows(batches):
                block = _Block(row, width, bits)
                if k == 1:
                    yield _send(row["block"], block.keys, bits, None, None)
                elif k == 2:
                    yield _send(row["block"], *block.second()[:1], bits, *block.second()[1:])
                else:
                    key, _, doc = block.windows()
                    keys, _, low, _ = _grouped(key, block.doc_ids[doc])
                    yield _send(row["block"], keys, bits, None, low)

        sent = joined(*answers).mapInArrow(send, MESSAGE)
        return work.put(sent.groupBy("bucket").applyInArrow(_answer, ANSWER), f"answers-{k}")

    one = ask(1)
    two = ask(2, one)
    three = ask(3, one, two)

    def finish(batches):
        kinds = [*[pa.int64()] * 3, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]

        def out(rows):
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "spans", "kept"])

        for row in _rows(batches):
            block = _Block(row, width, bits)
            gone, at, rows = block.covered(), 0, []
            for doc, n in zip(block.doc_ids.tolist(), block.sizes.tolist(), strict=True):
                g, data = gone[at : at + n], block.data[at : at + n]
                edges = np.flatnonzero(np.diff(np.concatenate([[False], g, [False]]).astype(np.int8))).reshape(-1, 2)
                rows.append((doc, n, int(g.sum()), [{"start": a, "end": z} for a, z in edges.tolist()], data[~g].tobytes()))
                at += n
            yield out(rows)

    done = joined(one, two, three).mapInArrow(finish, KEPT)
    size, none = F.octet_length("data").cast("long"), F.array().cast("array<struct<start:long,end:long>>")
    whole = every.where("doc_id is null").select("doc_id", size.alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), none.alias("spans"), F.col("data").alias("kept"))
    return done.unionByName(whole)
