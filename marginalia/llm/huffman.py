"""Token-id files: canonical length-limited Huffman code of ids from global counts.

File format: a table of rows, each an independent block of consecutive documents.  A block has the
doc_ids and id counts of its documents, its ids as one bit string, and a checkpoint every
``STEP`` ids: the bit offset at which the ids from there on start.  ``codes`` holds the code length
of every id; canonical codes follow from the lengths alone.  Reading decodes all checkpoint segments of a block
side by side through one table of ``2 ** LIMIT`` entries.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tokens import default_vocabulary, encoder
from .work import Work, parts_for

LIMIT, STEP = 20, 64


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (package-merge); 0 for ids that never occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) == 1:
        lengths[used] = 1
    if len(used) < 2:
        return lengths
    if len(used) > 1 << limit:
        raise ValueError("too many symbols for the length limit")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(object) if counts.sum() > 2**62 // limit else counts[order].astype(np.int64)
    n = len(order)
    # taken[level]: is the i-th cheapest item of that level a package (or a symbol)?
    packages, levels = weight[:0], []
    for _ in range(limit):
        merged = np.concatenate([weight, packages])
        is_package = np.arange(len(merged)) >= n
        by = np.argsort(merged, kind="stable")
        merged, is_package = merged[by], is_package[by]
        levels.append(is_package)
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
    # Take the 2n-2 cheapest items of the last level; packages among them ask for two of the level below.
    want = 2 * n - 2
    for is_package in reversed(levels):
        packs = int(is_package[:want].sum())
        lengths[order[: want - packs]] += 1
        want = 2 * packs
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id), each the next number at its length."""
    codes = np.zeros(len(lengths), np.uint64)
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    code, last = 0, 0
    per = np.bincount(lengths[order], minlength=1)
    at = 0
    for size in range(1, len(per)):
        code <<= size - last
        last = size
        codes[order[at : at + per[size]]] = np.arange(code, code + per[size], dtype=np.uint64)
        code, at = code + int(per[size]), at + int(per[size])
    return codes


def decode_table(lengths: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """Id and code length for every value of the next ``limit`` bits."""
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    runs = (1 << (limit - lengths[order].astype(np.int64))).astype(np.int64)
    ids, sizes = np.zeros(1 << limit, np.uint32), np.ones(1 << limit, np.uint8)
    n = int(runs.sum())
    ids[:n], sizes[:n] = np.repeat(order, runs), np.repeat(lengths[order], runs)
    return ids, sizes


def encode_bits(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, step: int = STEP) -> tuple[bytes, np.ndarray]:
    """Bit string (most significant bit first) and the bit offset of every ``step``-th id."""
    if not len(ids):
        return b"", np.zeros(0, np.uint32)
    size = lengths[ids].astype(np.int64)
    end = np.cumsum(size)
    start = end - size
    code = codes[ids]
    word, used = start >> 5, (start & 31) + size  # a code of up to 32 bits touches two 32-bit words
    wide = code << (64 - used).astype(np.uint64)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    out = np.zeros(int(word[-1]) + 2, np.uint32)
    joined = np.bitwise_or.reduceat(wide, first)
    out[word[first]] |= (joined >> np.uint64(32)).astype(np.uint32)
    out[word[first] + 1] |= (joined & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return out.astype(">u4").tobytes(), start[::step].astype(np.uint32)


def decode_bits(bits: bytes, checkpoints: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray], limit: int = LIMIT, step: int = STEP) -> np.ndarray:
    """The ``n`` ids of a block; all segments advance together, one id a round."""
    ids, sizes = table
    words = np.concatenate([np.frombuffer(bits, ">u4").astype(np.uint64), np.zeros(2, np.uint64)])
    pair = (words[:-1] << np.uint64(32)) | words[1:]
    out = np.zeros((step, len(checkpoints)), np.uint32)
    at = checkpoints.astype(np.int64)
    mask = np.uint64((1 << limit) - 1)
    last = len(pair) - 1
    for k in range(step):
        peek = (pair[np.minimum(at >> 5, last)] >> (64 - limit - (at & 31)).astype(np.uint64)) & mask
        out[k] = ids[peek]
        at += sizes[peek]
    return out.T.ravel()[:n]


_BLOCK = "shard int, block int, first long, n_nulls int, doc_ids binary, n_ids binary, checkpoints binary, bits binary, ids_total long"
#: Shards are at most so many, so one number a shard is always small.
MOST_SHARDS = 100_000
TOKENS = "doc_id long, tie long, nth long, n long, ids binary, id int, met long"


def _batch(schema: str, cols: list) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    names = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, kinds[t]) for c, (_, t) in zip(cols, names, strict=True)], [n for n, _ in names])


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary column of consecutive pieces of an array."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _joined(column: pa.Array, width: str) -> np.ndarray:
    """The bytes of all rows of a binary column one after another, as numbers."""
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0] : at[-1]].view(width)


def _tokenise(vocabulary: str, end_id: int):
    """A row per document with its ids, and at the end a row per id with the times it was met."""

    def run(batches):
        enc, nth = encoder(vocabulary), 0
        wide = len(enc.size) > 1 << 16
        total = np.zeros(max(len(enc.size), end_id + 1), np.int64)
        for b in batches:
            for i, j, ids, n in enc.encode(b.column("text"), end_id):
                total += np.bincount(ids, minlength=len(total))
                none = pa.nulls(j - i, pa.int32()), pa.nulls(j - i, pa.int64())
                raw = ids.astype("<u4" if wide else "<u2")
                yield _batch(TOKENS, [b.column("doc_id").slice(i, j - i), b.column("tie").slice(i, j - i), nth + np.arange(j - i), n, _binary(raw, n * raw.itemsize), *none])
                nth += j - i
        used = np.flatnonzero(total)
        none = pa.nulls(len(used), pa.int64())
        yield _batch(TOKENS, [none, none, none, none, pa.nulls(len(used), pa.binary()), used.astype(np.int32), total[used]])

    return run


def _pack(lengths: np.ndarray, codes: np.ndarray, width: str, block_ids: int):
    """Rows of one shard in order to blocks of about ``block_ids`` ids; a document is in one block."""

    def run(batches):
        from pyspark import TaskContext

        shard, k, first, held, size = TaskContext.get().partitionId(), 0, 0, [], 0

        def block():
            ids = np.concatenate([x for x, _, _ in held])
            n = np.concatenate([x for _, x, _ in held])
            docs = pa.concat_arrays([x for _, _, x in held])
            bits, marks = encode_bits(ids, lengths, codes)
            raw = docs.fill_null(0).to_numpy().astype("<i8").tobytes()
            return _batch(_BLOCK, [[x] for x in (shard, k, first, docs.null_count, raw, n.astype("<u8").tobytes(), marks.astype("<u4").tobytes(), bits, len(ids))])

        for b in batches:
            n = b.column("n").to_numpy()
            ends, ids, i = np.cumsum(n), _joined(b.column("ids"), width), 0
            while i < len(n):
                before = int(ends[i] - n[i])
                j = min(len(n), int(np.searchsorted(ends, before + block_ids - size)) + 1)
                held.append((ids[before : int(ends[j - 1])], n[i:j], b.column("doc_id").slice(i, j - i)))
                size += int(ends[j - 1]) - before
                i = j
                if size >= block_ids:
                    yield block()
                    first, k, held, size = first + size, k + 1, [], 0
        if held:
            yield block()

    return run


def write(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = 2, shard_bytes: int = 8 << 20, block_ids: int = 1 << 19) -> None:
    """Write the ids of all documents, each followed by ``end_id``, in ascending doc_id order.

    Input: doc_id, text; other columns are ignored.  Null text: empty, so the end id alone.  Rows without doc_id
    come first.  Rows with equal doc_id follow each other, ordered by a 64-bit hash of the text, equal texts being the
    same ids.  An empty table gives files with no block.  Shards are ranges of rows in that order: their number
    grows with the bytes up to ``MOST_SHARDS``, then their size does; a row is never split.
    """
    spark, vocabulary = docs.sparkSession, vocabulary or default_vocabulary()
    work = Work(spark, "token-ids")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    shards = min(MOST_SHARDS, parts_for(rows.agg(F.sum(F.octet_length("text"))).first()[0], shard_bytes))
    width = "<u4" if len(encoder(vocabulary).size) > 1 << 16 else "<u2"
    both = work.put(rows.mapInArrow(_tokenise(vocabulary, end_id), TOKENS), "tokens")
    found = both.where("id is not null").groupBy("id").agg(F.sum("met").alias("n")).collect()  # one row per vocabulary entry at most
    counts = np.zeros(max((r["id"] for r in found), default=0) + 1, np.int64)
    for r in found:
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts)
    spark.createDataFrame([(bytearray(lengths.tobytes()), LIMIT, STEP)], "lengths binary, max_bits int, step int").write.parquet(f"{path}/codes")
    order = ["doc_id", "tie", "nth"]
    ordered = both.where("id is null").select(*order, "n", "ids").repartitionByRange(shards, *order).sortWithinPartitions(*order)
    blocks = ordered.mapInArrow(_pack(lengths, canonical_codes(lengths), width, block_ids), _BLOCK)
    blocks.write.option("compression", "none").parquet(f"{path}/blocks")
    work.drop("tokens")


def read(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """Documents of files that ``write`` made: doc_id, start, n_tokens, and the ids or their crc32.

    ``start`` counts the ids of all documents before; it comes from one total per shard, of which there are
    at most ``MOST_SHARDS``.
    """
    blocks = spark.read.parquet(f"{path}/blocks")
    head = spark.read.parquet(f"{path}/codes").first()
    lengths, limit, step = np.frombuffer(bytes(head["lengths"]), np.uint8), head["max_bits"], head["step"]
    totals = blocks.groupBy("shard").agg(F.sum("ids_total").alias("n"))
    bases = totals.select("shard", (F.sum("n").over(W.orderBy("shard")) - F.col("n")).alias("base"))

    def decode(batches):
        table = decode_table(lengths, limit)
        for b in batches:
            for k in range(b.num_rows):
                r = b.slice(k, 1).to_pylist()[0]
                ids = decode_bits(r["bits"], np.frombuffer(r["checkpoints"], "<u4"), r["ids_total"], table, limit, step).astype("<u4")
                n = np.frombuffer(r["n_ids"], "<u8").astype(np.int64)
                ends = np.cumsum(n)
                starts = ends - n
                docs = pa.array(np.frombuffer(r["doc_ids"], "<i8"), mask=np.arange(len(n)) < r["n_nulls"])
                if digest:
                    last, kind = pa.array([zlib.crc32(ids[a:z]) for a, z in zip(starts.tolist(), ends.tolist(), strict=True)], pa.int64()), "ids_crc32"
                else:
                    last, kind = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids.astype(np.int64))), "ids"
                yield pa.RecordBatch.from_arrays([docs, pa.array(starts + r["base"] + r["first"]), pa.array(n), last], ["doc_id", "start", "n_tokens", kind])

    kept = blocks.select("shard", "first", "n_nulls", "doc_ids", "n_ids", "checkpoints", "bits", "ids_total")
    return kept.join(F.broadcast(bases), "shard").mapInArrow(decode, f"doc_id long, start long, n_tokens long, {'ids_crc32 long' if digest else 'ids array<long>'}")
