"""Line dedup: exact set-similarity join of lines.

A line is the set of its words.  It goes if an earlier line (smaller doc_id, then smaller line
number) has Jaccard similarity ``THRESHOLD`` or more with it; lines are judged on the input.  Tokens are
ordered by rarity; similar sets share a token among their rarest ones (prefix filter), at
positions that leave enough room (positional filter), and have similar sizes (length filter).  A
128-bit parity signature of each set bounds the symmetric difference from below and thins the candidates.

Equal sets are settled by one aggregation, on 128 bits.  Of the rest, the postings go to buckets of tokens, packed as columns of
numbers; the number of buckets follows the postings.  A token with many lines is streamed there run by run, others come sorted
together.  Each line is compared with the first ``HELD`` different lines of the token and gives its candidates if they are few, else the
``PAIRS`` likeliest, so a token shared by a large group of near copies costs time in proportion to its lines.  Candidates are verified on
whole sets.  Lines that had more, or stand further down a longer list, and found no match are then joined with all other lines of the list.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .byteprint import RangeHash, mix
from .marks import marked, marks_of
from .work import Work, tidied

THRESHOLD = (4, 5)
#: Lines of a word that others are compared with; candidates of a line that has more than ``FEW`` times as many.
HELD, PAIRS, FEW = 1024, 8, 2
SLOT_BITS, SLICE_BITS = 20, 12
#: A word whose slot counts more sets than this is sent by itself, run by run; bytes of postings in a bucket of other words.
MANY, BUCKET_BYTES, POSTING_BYTES = 4096, 12 << 20, 48
#: Documents whose ids are sent to every task.
FEW_DOCS = 1 << 15
#: Postings that a task sends at once.
FLUSH = 300_000
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def _words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a byte array that ends in a blank."""
    edge = np.flatnonzero(np.diff(_BLANK[raw], prepend=True))
    return edge[::2], edge[1::2]


class Chunk:
    """Documents in order, joined by line breaks: their words and, on demand, the word sets of their lines."""

    def __init__(self, ids: list[int], ties: list[int], parts: list[bytes]):
        order = sorted(range(len(ids)), key=lambda k: (ids[k], ties[k]))
        parts = [parts[k] for k in order]
        self.ids, self.ties = np.array(ids, np.int64)[order], np.array(ties, np.int32)[order]
        self.raw = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
        self.breaks = np.flatnonzero(self.raw == 10)
        self.starts = np.concatenate([[0], self.breaks[:-1] + 1])
        self.ends = np.cumsum([len(p) + 1 for p in parts])
        self.hash = RangeHash(self.raw)

    def word_hashes(self) -> np.ndarray:
        return self.hash(*_words(self.raw))

    def line_hashes(self) -> np.ndarray:
        """Of the bytes of every line."""
        return self.hash(self.starts, self.breaks)

    def sets(self, rarity: np.ndarray | None = None, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(line, first, words): the lines that have words, where each begins, and their distinct words, rarest first."""
        start, end = _words(self.raw)
        line = np.searchsorted(self.breaks, start)
        if only is not None:
            some = only[line]
            start, end, line = start[some], end[some], line[some]
        h = self.hash(start, end)
        rare = np.zeros(len(h), np.uint64) if rarity is None else rarity[(h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)].astype(np.uint64)
        new = np.diff(line, prepend=-1) > 0
        nth = np.cumsum(new) - 1
        low = (rare << np.uint64(40)) | (h & np.uint64((1 << 40) - 1))
        if len(nth) and nth[-1] < 1 << 16:
            packed = (nth.astype(np.uint64) << np.uint64(48)) | low
            order = np.argsort(packed)
            packed, h = packed[order], h[order]
            same = packed[1:] == packed[:-1]
            if (same & (h[1:] != h[:-1])).any():  # different words of equal lower bits
                order = np.lexsort((h, packed))
                packed, h = packed[order], h[order]
                same = packed[1:] == packed[:-1]
            nth = (packed >> np.uint64(48)).astype(np.int64)
        else:
            order = np.lexsort((h, low, nth))
            nth, h = nth[order], h[order]
            same = nth[1:] == nth[:-1]
        fresh = np.append(True, ~same | (h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
        nth, h = nth[fresh], h[fresh]
        return line[new], np.append(np.flatnonzero(np.diff(nth, prepend=-1)), len(nth)), h

    def place(self, line: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """doc_id, tie and number within its document of each line."""
        doc = np.searchsorted(self.ends, self.starts[line], "right")
        first = np.searchsorted(self.starts, self.ends[doc] - np.diff(self.ends, prepend=0)[doc])
        return self.ids[doc], self.ties[doc], (line - first).astype(np.int32)


def _chunks(batches, each: int = 1 << 20) -> Iterator[Chunk]:
    """Documents in runs of about ``each`` bytes."""
    ids, ties, parts, size = [], [], [], 0
    for b in batches:
        for doc, tie, data in zip(b.column("doc_id").to_pylist(), b.column("tie").to_pylist(), b.column("data"), strict=True):
            ids.append(doc)
            ties.append(tie)
            parts.append(data.as_py())
            size += len(parts[-1])
            if size >= each:
                yield Chunk(ids, ties, parts)
                ids, ties, parts, size = [], [], [], 0
    if ids:
        yield Chunk(ids, ties, parts)


def _batch(cols: list, kinds: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)


LINES = "doc_id long, tie int, line int, key long, key2 long, text long, slice int, tally binary"


def _keys(batches) -> Iterator[pa.RecordBatch]:
    """A row per line that has words, with the hashes of its set and of its bytes; at the end word counts by hash slot, in slices."""
    names, kinds = [x.split()[0] for x in LINES.split(", ")], [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    total, held = np.zeros(1 << SLOT_BITS, np.int64), []
    for c in _chunks(batches):
        line, at, h = c.sets()
        if len(line):
            held.append(_slot(h).astype(np.int32))
            if sum(map(len, held)) > len(total):
                total += np.bincount(np.concatenate(held), minlength=len(total))
                held = []
            none = np.full(len(line), None)
            yield _batch([*c.place(line), _key(at, h).view(np.int64), _key(at, h, 1).view(np.int64), c.line_hashes()[line].view(np.int64), none, none], kinds, names)
    if held:
        total += np.bincount(np.concatenate(held), minlength=len(total))
    parts = total.reshape(-1, 1 << SLICE_BITS)
    used = np.flatnonzero(parts.any(1))
    none = np.full(len(used), None)
    yield _batch([*[none] * 6, used.astype(np.int32), [zlib.compress(parts[k].astype("<i8").tobytes(), 1) for k in used]], kinds, names)


def _summed(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(zlib.decompress(x.as_py()), "<i8") for x in table.column("tally"))
    return pa.table({"slice": table.column("slice")[:1], "tally": pa.array([total.tobytes()], pa.binary())})


def tallied(tallies: DataFrame) -> np.ndarray:
    """Per slot, the number of sets that hold its words, counted once a word; the driver gets 2 ** SLOT_BITS numbers."""
    total = np.zeros(1 << SLOT_BITS, np.int64)
    for r in tallies.groupBy("slice").applyInArrow(_summed, "slice int, tally binary").collect():
        total[r["slice"] << SLICE_BITS : (r["slice"] + 1) << SLICE_BITS] = np.frombuffer(r["tally"], "<i8")
    return total


def rarities(total: np.ndarray) -> np.ndarray:
    """Eight bits that grow with a slot's tally: 0 none, 1 a single set, over ``MANY`` where ``_rank(MANY)`` is passed."""
    return np.where(total > 0, _rank(total), 0).astype(np.uint8)


def _rank(n):
    return np.minimum(1 + 7 * np.log2(np.maximum(n, 1)), 255).astype(np.int64)


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _key(at: np.ndarray, h: np.ndarray, half: int = 0) -> np.ndarray:
    return mix(np.add.reduceat(mix(h + np.uint64(half * 0x9E3779B97F4A7C15)), at[:-1]) + np.diff(at).astype(np.uint64))


WIDE, SMALL = ("word", "key", "sign", "more"), ("doc", "tie", "line", "n", "pos")
COLUMNS = dict.fromkeys(WIDE, np.dtype(np.uint64)) | {"doc": np.dtype(np.int64)} | dict.fromkeys(SMALL[1:], np.dtype(np.int32))
#: A posting of a word that is sent by itself.
ALONE = np.dtype([("key", "<u8"), ("sign", "<u8"), ("more", "<u8"), ("n", "<i4"), ("pos", "<i4")])


def _postings(c: Chunk, rarity: np.ndarray, words: np.ndarray | None) -> dict[str, np.ndarray] | None:
    """The rarest words of every line of a run of documents, but words met once; a line met twice there counts once.

    ``words``: marks of the words to keep to.  Sets too small for a different set to be similar have no postings.
    """
    a, b = THRESHOLD
    line, at, h = c.sets(rarity)
    if not len(line):
        return None
    n, key = np.diff(at), _key(at, h)
    first = np.zeros(len(line), bool)
    first[np.unique(key, return_index=True)[1]] = True
    first &= b * n >= a * (n + 1)
    owner = np.repeat(np.arange(len(line)), n)
    pos = np.arange(len(h)) - at[:-1][owner]
    take = first[owner] & (pos < (n - (a * n + b - 1) // b + 1)[owner])
    take[take] = rarity[_slot(h[take])] > 1  # met once: no partner
    if words is not None:
        take[take] = marked(words, h[take])
    bit = mix(h) >> np.uint64(57)  # of two 64-bit halves
    one = np.uint64(1) << (bit & np.uint64(63))
    sign, more = (np.bitwise_xor.reduceat(np.where(half, one, np.uint64(0)), at[:-1]) for half in (bit < 64, bit >= 64))
    o, (doc, tie, number) = owner[take], c.place(line)
    return {"word": h[take], "key": key[o], "sign": sign[o], "more": more[o], "doc": doc[o], "tie": tie[o], "line": number[o], "n": n[o].astype(np.int32), "pos": pos[take].astype(np.int32)}


PACKED = "bucket int, word long, doc long, tie int, line int, data binary"


def _packed(rarity: np.ndarray, buckets: int):
    """Postings by bucket in rows of packed columns; a posting of a word that many sets hold is a row of its own."""
    many = int(_rank(MANY))

    def out(rows: dict) -> pa.RecordBatch:
        n, kinds = len(rows["data"]), [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        names = ["bucket", "word", "doc", "tie", "line", "data"]
        return _batch([rows.get(k, [None] * n) for k in names], kinds, names)

    def send(held: list[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        got = {k: np.concatenate([x[k] for x in held]) for k in COLUMNS}
        bucket, alone = (got["word"] % np.uint64(buckets)).astype(np.int32), rarity[_slot(got["word"])] > many
        if alone.any():
            one = np.zeros(int(alone.sum()), ALONE)
            for k in ALONE.names:
                one[k] = got[k][alone]
            rows = {k: got[k][alone] for k in ("doc", "tie", "line")} | {"word": got["word"][alone].view(np.int64), "bucket": bucket[alone]}
            yield out(rows | {"data": [x.tobytes() for x in one]})
        some = np.flatnonzero(~alone)
        some = some[np.argsort(bucket[some], kind="stable")]
        got, bucket = {k: v[some] for k, v in got.items()}, bucket[some]
        at = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket)).tolist()
        data = [
            b"".join([(j - i).to_bytes(4, "little"), *(got[k][i:j].tobytes() for k in WIDE), zlib.compress(b"".join(got[k][i:j].tobytes() for k in SMALL), 1)])
            for i, j in zip(at[:-1], at[1:], strict=True)
        ]
        yield out({"bucket": bucket[at[:-1]], "data": data})

    def run(batches) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for c in _chunks(batches):
            got = _postings(c, rarity, None)
            if got is not None:
                held.append(got)
                size += len(got["n"])
            if size >= FLUSH:
                yield from send(held)
                held, size = [], 0
        if held:
            yield from send(held)

    return run


def _unpacked(parts: list[bytes]) -> dict[str, np.ndarray]:
    """Columns of all rows of a bucket, by word and, within it, in order of lines."""
    out: dict[str, list[np.ndarray]] = {k: [] for k in COLUMNS}
    for data in parts:
        n = int.from_bytes(data[:4], "little")
        for i, k in enumerate(WIDE):
            out[k].append(np.frombuffer(data, COLUMNS[k], n, 8 * n * i + 4))
        rest, at = zlib.decompress(memoryview(data)[4 + 8 * n * len(WIDE) :]), 0
        for k in SMALL:
            out[k].append(np.frombuffer(rest, COLUMNS[k], n, at))
            at += n * COLUMNS[k].itemsize
    got = {k: np.concatenate(v) for k, v in out.items()}
    place = (got["line"], got["tie"], got["doc"]) if got["tie"].any() else (got["line"], got["doc"])
    order = np.lexsort((*place, got["word"]))
    return {k: got[k][order] for k in (*WIDE, "n", "pos")}


POSTINGS = "word long, key long, sign long, more long, n int, pos int"


def _listed(rarity: np.ndarray, words: np.ndarray):
    """Postings of the words whose mark is set, a row each."""
    names, kinds = [x.split()[0] for x in POSTINGS.split(", ")], [*[pa.int64()] * 4, pa.int32(), pa.int32()]

    def run(batches) -> Iterator[pa.RecordBatch]:
        for c in _chunks(batches):
            got = _postings(c, rarity, words)
            if got is not None:
                yield _batch([got[k].view(np.int64) if got[k].dtype == np.uint64 else got[k] for k in names], kinds, names)

    return run


def fits(n, pos, sign, more, m, at, other, others):
    """Length, positional and signature filter for sets of n and m words that share the word at pos and at; how far the signatures are apart."""
    a, b = THRESHOLD
    if isinstance(n, Column):
        rest, differ = F.least(n - pos, m - at), F.bit_count(sign.bitwiseXOR(other)) + F.bit_count(more.bitwiseXOR(others))
    else:
        rest, differ = np.minimum(n - pos, m - at), np.bitwise_count(sign ^ other).astype(np.int64) + np.bitwise_count(more ^ others)
    return (b * m >= a * n) & (b * n >= a * m) & ((a + b) * rest >= a * (n + m)) & ((a + b) * differ <= (b - a) * (n + m)), differ


#: Pairs (x, y); lines that may have other partners (x, word, alone); all lines of the lists of such, but of words sent alone.
CANDIDATES = "x long, y long, word long, alone boolean, sign long, more long, n int, pos int"
_NONE = np.iinfo(np.int64).max


class _List:
    """The lines of one word so far: the first different ones are held."""

    def __init__(self, held: int, pairs: int, word: int | None = None):
        self.held, self.pairs, self.word, self.seen = held, pairs, word, 0
        self.rows = [np.zeros(0, t) for t in (np.uint64, np.uint64, np.uint64, np.int32, np.int32)]

    def add(self, rows: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(x, y, lines that need a complete comparison) for further lines (key, sign, more, n, pos) of the word."""
        new = np.sort(np.unique(rows[0], return_index=True)[1])
        new = new[~np.isin(rows[0][new], self.rows[0])] if len(self.rows[0]) else new
        rows, base = [x[new] for x in rows], len(self.rows[0])
        self.rows = [np.append(h, x[: self.held - base]) for h, x in zip(self.rows, rows, strict=True)]
        hk, hs, hm, hn, hp = self.rows
        key, sign, more, n, pos = rows
        step = max(1, (1 << 17) // max(1, len(hk)))
        for i in range(0, len(key), step):
            z = slice(i, min(i + step, len(key)))
            width = min(len(hk), base + z.stop)
            mine = base + np.arange(z.start, z.stop)
            ok, differ = fits(n[z, None], pos[z, None], sign[z, None], more[z, None], hn[None, :width], hp[None, :width], hs[None, :width], hm[None, :width])
            ok &= np.arange(width)[None, :] < mine[:, None]
            met = ok.sum(1)
            some = np.flatnonzero(met)
            likely = np.where(ok[some], (differ[some] << 32) | np.arange(width), _NONE)
            few = FEW * self.pairs
            if few < width:
                likely = np.sort(np.partition(likely, few - 1, axis=1)[:, :few], axis=1)
                likely[met[some] > few, self.pairs :] = _NONE
            r, c = np.nonzero(likely != _NONE)
            rest = (met > few) | ((self.seen + np.arange(z.start, z.stop) > self.held) if width else False)
            yield key[z][some[r]], hk[likely[r, c] & 0xFFFFFFFF], key[z][rest]
        self.seen += len(key)


def _short(got: dict[str, np.ndarray], inside: np.ndarray, rank: np.ndarray, pairs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidates of words with few lines, all words at once: each line with the k-th earlier one of its word."""
    key, sign, more, n, pos = (got[k] for k in ("key", "sign", "more", "n", "pos"))
    met, best = np.zeros(len(key), np.int32), np.full((min(FEW * pairs, int(rank[inside].max(initial=0))), len(key)), _NONE)
    a, b = THRESHOLD
    for k in range(1, int(rank[inside].max(initial=0)) + 1):
        i = np.flatnonzero(inside & (rank >= k))
        i = i[(b * n[i - k] >= a * n[i]) & (b * n[i] >= a * n[i - k])]  # most pairs end here or at the next
        i = i[(a + b) * np.minimum(n[i] - pos[i], n[i - k] - pos[i - k]) >= a * (n[i] + n[i - k])]
        i = i[key[i] != key[i - k]]
        ok, differ = fits(n[i], pos[i], sign[i], more[i], n[i - k], pos[i - k], sign[i - k], more[i - k])
        i, value = i[ok], (differ[ok] << 32) | (i[ok] - k)
        met[i] += 1
        for slot in best:  # the likeliest come first
            had = slot[i]
            slot[i] = np.minimum(had, value)
            value = np.maximum(had, value)
    rest = np.flatnonzero(met > FEW * pairs)
    best[pairs:, rest] = _NONE
    _, i = np.nonzero(best != _NONE)
    return key[i], key[best[best != _NONE] & 0xFFFFFFFF], rest


def _matched(held: int, pairs: int, small: int = 48):
    """Packed postings by bucket, word and order of documents to candidates, and to (x, null, word) for lines that may have others."""
    names = [x.split()[0] for x in CANDIDATES.split(", ")]
    kinds = [*[pa.int64()] * 3, pa.bool_(), *[pa.int64()] * 2, *[pa.int32()] * 2]

    def out(xs, ys, rest, words, alone: bool, lists: dict[str, np.ndarray] | None = None) -> pa.RecordBatch:
        x, y, r, w = (np.concatenate([np.zeros(0, np.uint64), *v]).view(np.int64) for v in (xs, ys, rest, words))
        got = lists or {k: np.zeros(0, COLUMNS[k]) for k in (*WIDE, "n", "pos")}
        sizes = np.array([len(x), len(r), len(got["n"])])
        part = np.repeat(np.arange(3), sizes)

        def column(which: int, values: np.ndarray) -> pa.Array:
            full = np.zeros(len(part), values.dtype if values.dtype != np.uint64 else np.int64)
            full[part == which] = values.view(np.int64) if values.dtype == np.uint64 else values
            return pa.array(full, mask=part != which)

        first = [np.concatenate([x, r, got["key"].view(np.int64)]), column(0, y), pa.array(np.concatenate([x, w, got["word"].view(np.int64)]), mask=part == 0)]
        return _batch([*first, column(1, np.full(len(r), alone)), *(column(2, got[k]) for k in ("sign", "more", "n", "pos"))], kinds, names)

    def bucket(parts: list[bytes]) -> Iterator[pa.RecordBatch]:
        got = _unpacked(parts)
        word = got["word"]
        edge = np.append(np.flatnonzero(np.append(True, word[1:] != word[:-1])), len(word))
        size = np.diff(edge)
        quick = size <= min(small, held)
        inside, rank = np.repeat(quick, size), np.arange(len(word)) - np.repeat(edge[:-1], size)
        x, y, i = _short(got, inside, rank, pairs)
        xs, ys, rest, words = [x], [y], [got["key"][i]], [word[i]]
        for g in np.flatnonzero(~quick):
            z = slice(edge[g], edge[g + 1])
            for x, y, r in _List(held, pairs).add([got[k][z] for k in ("key", "sign", "more", "n", "pos")]):
                xs.append(x)
                ys.append(y)
                rest.append(r)
                words.append(np.full(len(r), word[z.start]))
        whole = np.isin(word, np.concatenate(words))
        yield out(xs, ys, rest, words, False, {k: v[whole] for k, v in got.items()})

    def run(batches) -> Iterator[pa.RecordBatch]:
        at, parts, now = None, [], _List(held, pairs)
        for b in batches:
            rows = zip(b.column("bucket").to_pylist(), b.column("word").to_pylist(), b.column("data").to_pylist(), strict=True)
            for (number, word), mine in groupby(rows, itemgetter(0, 1)):
                if parts and (number != at or word is not None):
                    yield from bucket(parts)
                    parts = []
                at = number
                if word is None:
                    parts += (x for _, _, x in mine)
                    continue
                if word != now.word:
                    now = _List(held, pairs, word)
                got = np.frombuffer(b"".join(x for _, _, x in mine), ALONE)
                for x, y, r in now.add([got[k] for k in ALONE.names]):
                    yield out([x], [y], [r], [np.full(len(r), word, np.int64).view(np.uint64)], True)
        if parts:
            yield from bucket(parts)

    return run


def _marked(docs: np.ndarray, marks: np.ndarray):
    """Word sets of the lines whose bytes have their hash marked, of the documents that are marked."""
    kinds, names = [pa.int64(), pa.int64(), pa.list_(pa.int64())], ["key", "key2", "words"]

    def run(batches):
        some = (b.filter(pa.array(marked(docs, b.column("mark").to_numpy().view(np.uint64)))) for b in batches)
        for c in _chunks(some):
            only = marked(marks, c.line_hashes())
            if not only.any():
                continue
            line, at, h = c.sets(only=only)
            if not len(line):
                continue
            key = _key(at, h)
            one = np.unique(key, return_index=True)[1]
            n = np.diff(at)[one]
            ends = np.cumsum(n)
            words = h[np.repeat(at[one] - ends + n, n) + np.arange(ends[-1])].view(np.int64)
            yield _batch([key[one].view(np.int64), _key(at, h, 1)[one].view(np.int64), pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(words))], kinds, names)

    return run


def removed_keys(rows: DataFrame, first: DataFrame, total: np.ndarray, work: Work, held: int, most: int) -> DataFrame:
    """(key, key2) of sets that are similar to the set of an earlier line.

    Lists of candidates name a set by the first half of its key; sets that share it are all looked at.
    """
    a, b = THRESHOLD
    rarity = rarities(total)

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """Of (x, y) pairs of keys, the later key of each pair that is similar."""
        pairs = work.put(pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), f"pairs-{name}")
        need = work.put(pairs.select(F.col("x").alias("key")).union(pairs.select("y")).distinct().join(first.drop("n"), "key"), f"need-{name}")
        docs = need.select(F.col("first.doc_id").alias("doc_id")).distinct()
        few = docs.limit(FEW_DOCS + 1).count() <= FEW_DOCS  # their ids go to every task, else all texts go to the bitmap
        marks = marks_of(need.select(F.xxhash64("first.doc_id").alias("doc")), "doc"), marks_of(need.select("first.text"), "text")
        some = rows.join(F.broadcast(docs), "doc_id", "left_semi").select(*rows.columns) if few else rows
        sets = some.mapInArrow(tidied(_marked(*marks)), "key long, key2 long, words array<long>").groupBy("key", "key2").agg(F.first("words").alias("words"))
        sets = work.put(need.join(sets, ["key", "key2"]), f"sets-{name}")
        left, right = (sets.select(F.col("key").alias(k), F.col("key2").alias(f"{k}2"), F.col("words").alias(f"{k}w"), F.col("first").alias(f"{k}f")) for k in "xy")
        both = pairs.join(left, "x").join(right, "y")
        same = F.size(F.array_intersect("xw", "yw"))
        similar = b * same >= a * (F.size("xw") + F.size("yw") - same)
        later = F.when(F.col("xf") < F.col("yf"), F.struct(F.col("y").alias("key"), F.col("y2").alias("key2"))).otherwise(F.struct(F.col("x").alias("key"), F.col("x2").alias("key2")))
        out = work.put(both.where(similar).select(later.alias("k")).select("k.*").distinct(), f"gone-{name}")
        work.drop(f"pairs-{name}", f"need-{name}", f"sets-{name}")
        return out

    # A quarter of a set's words are sent at most, and one more.
    buckets = max(1, -(-int(total.sum()) * POSTING_BYTES // (4 * BUCKET_BYTES)))
    sent = rows.mapInArrow(tidied(_packed(rarity, buckets)), PACKED).repartition(max(2, -(-buckets // 2)), "bucket").sortWithinPartitions("bucket", "word", "doc", "tie", "line")
    found = work.put(sent.mapInArrow(tidied(_matched(held, most)), CANDIDATES), "candidates")
    gone = verified(found.where("y is not null").select("x", "y"), "held")
    left = work.put(found.where("alone is not null").select(F.col("x").alias("key"), "word", "alone").distinct().join(gone, "key", "left_anti"), "left")
    if left.isEmpty():
        work.drop("candidates", "left")
        return gone
    columns = POSTINGS.replace(" long", "").replace(" int", "").split(", ")
    some = found.where("n is not null").select("word", F.col("x").alias("key"), "sign", "more", "n", "pos")
    alone = left.where("alone")
    if not alone.isEmpty():
        some = some.unionByName(rows.mapInArrow(tidied(_listed(rarity, marks_of(alone, "word"))), POSTINGS))
    some = work.put(some.join(left.select("word").distinct(), "word", "left_semi").distinct(), "lists")
    left = left.drop("alone")
    work.drop("candidates")
    mine = some.join(left, ["word", "key"], "left_semi").select(*(F.col(c).alias(f"my_{c}") for c in columns))
    near, _ = fits(*(F.col(c) for c in ("my_n", "my_pos", "my_sign", "my_more", "n", "pos", "sign", "more")))
    pairs = mine.join(some, (F.col("my_word") == F.col("word")) & (F.col("key") != F.col("my_key")) & near)
    pairs = verified(pairs.select(F.col("my_key").alias("x"), F.col("key").alias("y")), "rest")
    work.drop("lists", "left")
    return gone.union(pairs).distinct()


def dedup_lines(docs: DataFrame, held: int = HELD, pairs: int = PAIRS) -> DataFrame:
    """All columns of the input, with n_lines, removed (line numbers from 0) and kept_text.

    Input: doc_id, text and any others.  Lines are split at \\n; words at ASCII blanks; lines without words
    stay.  Null and empty texts stay as they are, and so do rows without doc_id, which no line is compared with.
    Rows of equal doc_id are ordered by the hash of
    their text; rows equal in both share their fate.  An empty table gives no rows.  Columns named like
    the three new ones are replaced.
    """
    text = F.col("text").cast("string")
    n_lines = F.coalesce(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    out = _judged(docs.drop("n_lines", "removed", "kept_text"), held, pairs).withColumn("n_lines", n_lines).withColumn("kept_text", F.col("__kept"))
    return out.withColumn("removed", F.coalesce("__removed", F.array().cast("array<int>"))).drop("__removed", "__kept")


def without_repeats(docs: DataFrame) -> DataFrame:
    """The input with its own columns, whatever their names, text without the lines that ``dedup_lines`` removes."""
    return _judged(docs, HELD, PAIRS).withColumn("text", F.col("__kept")).select(*docs.columns)


def _judged(docs: DataFrame, held: int, pairs: int) -> DataFrame:
    """The input's columns, __removed (line numbers, or null) and __kept (the text without them)."""
    work = Work(docs.sparkSession, "lines")
    repeated = not docs.groupBy("doc_id").count().where("count > 1").isEmpty()  # else there's nothing to break ties of
    tie = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int") if repeated else F.lit(0)
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), tie.alias("tie"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("data"), F.xxhash64(F.col("doc_id").cast("long")).alias("mark"))
    both = work.put(rows.mapInArrow(tidied(_keys), LINES), "lines")
    lines = both.where("line is not null").select("doc_id", "tie", "line", "key", "key2", "text")
    where = F.struct("doc_id", "tie", "line")
    first = work.put(lines.groupBy("key", "key2").agg(F.min(F.struct("doc_id", "tie", "line", "text")).alias("first"), F.count("*").alias("n")), "first")
    gone = removed_keys(rows, first, tallied(both.where("slice is not null").select("slice", "tally")), work, held, pairs).withColumn("gone", F.lit(True))
    fate = first.join(gone, ["key", "key2"], "left").where("gone or n > 1").select("key", "key2", "gone", F.struct("first.doc_id", "first.tie", "first.line").alias("first"))
    lost = lines.drop("text").join(fate, ["key", "key2"]).where(F.col("gone") | (where > F.col("first")))
    lost = work.put(lost.groupBy("doc_id", "tie").agg(F.sort_array(F.collect_set("line")).alias("removed")), "removed")
    # A bitmap of fixed size tells which documents may lose lines; only their texts go through the join.
    marks = marks_of(lost.select(F.xxhash64("doc_id").alias("doc")), "doc")

    @F.pandas_udf("boolean")
    def may_lose(h: pd.Series) -> pd.Series:
        return pd.Series(marked(marks, h.to_numpy().view(np.uint64)))

    given = docs.withColumn("__tie", tie).withColumn("__maybe", may_lose(F.xxhash64(F.col("doc_id").cast("long"))))
    keyed = lost.select(F.col("doc_id").alias("__doc"), F.col("tie").alias("__tie2"), F.col("removed").alias("__removed")).hint("shuffle_hash")
    some = given.where("__maybe").join(keyed, (F.col("doc_id") == F.col("__doc")) & (F.col("__tie") == F.col("__tie2")), "left").drop("__doc", "__tie2")
    out = some.unionByName(given.where("not __maybe").withColumn("__removed", F.lit(None).cast("array<int>"))).drop("__tie", "__maybe")
    text = F.col("text").cast("string")
    kept = F.array_join(F.filter(F.split(text, "\n", -1), lambda _, i: ~F.array_contains("__removed", i)), "\n")
    return out.withColumn("__kept", F.when(F.col("__removed").isNull(), text).otherwise(kept))
