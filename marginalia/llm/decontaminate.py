"""Benchmark decontamination: template canonicalisation, window hash join, slot consistency.

Words become typed tokens: a number, a unit after a number, and a capitalised word that isn't a common
one turn into placeholders (so do a currency sign beside a number, and names in a row as one), all others are compared in lower case.  Windows of ``WINDOW`` tokens of
both sides meet by hash.  Matches of a document and an item on one diagonal, or a few side by side, are a copy of the
template; it counts if the values in the item's slots stand for one value each in the document, a
misspelt or changed place aside, so that a question with new names and numbers is caught and chance agreement isn't.  Windows of the
plain words in one case meet as well, so that a copy in any case is caught (what is a placeholder
hangs on the case of a word), and a copy of an item whose windows are short of literals.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .marks import marked, marks_of
from .quality import STOP_WORDS
from .work import Work, tidied

WINDOW, LITERALS, LEAST = 8, 4, 3
_TOKEN = re.compile(r"[^\W\d_]+|\d+(?:[.,]\d+)*|[%$€£]")
UNITS = frozenset("% $ € £ mm cm m km mg g kg t ml l s ms min h hr hrs hour hours minute minutes second seconds day days week weeks month months year years meter meters metre metres kilometer kilometers mile miles foot feet inch inches pound pounds ounce ounces gram grams kilogram kilograms liter liters litre litres dollar dollars euro euros cent cents percent degree degrees kmh mph".split())
_COMMON = frozenset(STOP_WORDS) | frozenset("i if so we he she they you his her has have had do does did can could would will how what when where who why each every then than there these those were been more most many much".split())
NUMBER, UNIT, NAME, SIGN = 1, 2, 3, 4
_PRIME = np.uint64(0x9E3779B97F4A7C15)


#: Kinds of windows: of canonical tokens, and of plain words.
TEMPLATE, PLAIN = 0, 1
#: Tokens that are put together before they are hashed.
CHUNK = 200_000
#: One slot in so many may hold another value than the item's repeated value has elsewhere.
ODD = 8
#: Diagonals that are summed, so many words more or fewer; share of the item's tokens that makes a copy of two windows or more.
BAND, COVERED = 4, 0.8


def _hash(word: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(word.encode(), 7) | 15  # small numbers are placeholders


class _Tokens(dict):
    """Word to its place in the columns: literal hash, which is its value in a slot too, and kind of placeholder or 0."""

    def __init__(self):
        self.hashes, self.kinds = array("Q"), array("b")

    def __missing__(self, word: str) -> int:
        low = word.lower()
        kind = NUMBER if word[0].isdigit() else SIGN if word in "$€£" else UNIT if low in UNITS else NAME if word[0].isupper() and low not in _COMMON else 0
        self.hashes.append(_hash(word.casefold()))
        self.kinds.append(kind)
        made = self[word] = len(self.kinds) - 1
        return made


_tokens = _Tokens()


class Canonical:
    """Tokens of some texts one after another.

    word: hash of each word whatever its case.  bounds: where each text starts, and the end of the last.
    token: canonical hashes, where names in a row are one token.  slot: which are placeholders.  value: what
    each stands for.  start: its first word.  template_bounds: the bounds of the texts among these tokens.
    """

    def __init__(self, texts: list[str | None]):
        global _tokens
        if len(_tokens) > 500_000:
            _tokens = _Tokens()
        found = [np.fromiter(map(_tokens.__getitem__, _TOKEN.findall(t or "")), np.int64) for t in texts]
        self.bounds = np.cumsum([0] + [len(x) for x in found])
        at = np.concatenate([*found, np.zeros(0, np.int64)])
        if not len(at):
            self.word = self.token = self.value = np.zeros(0, np.uint64)
            self.slot, self.start, self.template_bounds = np.zeros(0, bool), np.zeros(0, np.int64), self.bounds
            return
        self.word = np.frombuffer(_tokens.hashes, np.uint64)[at]
        kind = np.frombuffer(_tokens.kinds, np.int8)[at]
        same = np.diff(self._text(self.bounds)) == 0  # a token and the next are of one text
        number = kind == NUMBER
        after, before = np.append(False, number[:-1] & same), np.append(number[1:] & same, False)
        kind = np.where((kind == UNIT) & ~after, 0, kind)
        kind = np.where(kind == SIGN, np.where(after | before, UNIT, 0), kind)
        name = kind == NAME
        keep = np.append(True, ~(name[1:] & name[:-1] & same))
        self.start = np.flatnonzero(keep)
        along = np.arange(len(at)) - self.start[np.cumsum(keep) - 1]
        self.value = np.add.reduceat(self.word * (2 * along + 1).astype(np.uint64), self.start)
        kind = kind[self.start]
        self.slot = kind > 0
        self.token = np.where(self.slot, kind.astype(np.uint64), self.word[self.start])
        self.template_bounds = np.searchsorted(self.start, self.bounds)

    @staticmethod
    def _text(bounds: np.ndarray) -> np.ndarray:
        return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))

    def of(self, which: int) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of a kind, and the bounds of the texts among them."""
        return (self.word, self.bounds) if which == PLAIN else (self.token, self.template_bounds)

    def windows(self, which: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Position and hash of the windows within a text: of plain words, or of tokens with enough literals."""
        token, bounds = self.of(which)
        n = len(token) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = np.full(n, which, np.uint64)
        for k in range(size):
            h = (h ^ token[k : k + n]) * _PRIME
            h ^= h >> np.uint64(29)
        text = self._text(bounds)
        ok = text[size - 1 :] == text[:n]
        if which == TEMPLATE:
            literal = np.concatenate([[0], np.cumsum(~self.slot)])
            ok &= literal[size:] - literal[:-size] >= min(LITERALS, size)
        at = np.flatnonzero(ok)
        return at, h[at]


def _chunks(batches) -> Iterator[tuple[list, list]]:
    """Keys and texts of some rows; a chunk ends where its texts are long enough."""
    for b in batches:
        keys, texts, size = [], [], 0
        for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            keys.append(key)
            texts.append(text.as_py())
            size += len(texts[-1] or "")
            if size > 6 * CHUNK:
                yield keys, texts
                keys, texts, size = [], [], 0
        yield keys, texts


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 10
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["key", "kind", "size", "at", "word_at", "total", "length", "hash", "slots", "given"])


def _rows(keys: list, c: Canonical, which: int, size: int, at: np.ndarray, h: np.ndarray, total: np.ndarray) -> Iterator[tuple]:
    """Windows of one kind and size as rows; total holds the windows of each text."""
    bounds = c.of(which)[1]
    text, length = np.searchsorted(bounds, at, "right") - 1, np.diff(bounds)
    for i, d, x in zip(at.tolist(), text.tolist(), h.view(np.int64).tolist(), strict=True):
        s = np.flatnonzero(c.slot[i : i + size]) if which == TEMPLATE else np.zeros(0, np.int64)
        word_at = (i if which == PLAIN else int(c.start[i])) - int(c.bounds[d])
        yield keys[d], which, size, i - int(bounds[d]), word_at, int(total[d]), int(length[d]), x, s.tolist(), c.value[i + s].view(np.int64).tolist() if len(s) else []


def _emit(sizes: list[tuple[int, int]], marks: np.ndarray):
    """Map (id, text) to the windows, of the kinds and sizes given, whose mark is set."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for keys, texts in _chunks(batches):
            c, rows = Canonical(texts), []
            none = np.zeros(len(keys), np.int64)
            for which, size in sizes:
                at, h = c.windows(which, size)
                hit = marked(marks, h)
                rows += _rows(keys, c, which, size, at[hit], h[hit], none)
            yield _batch(rows)

    return run


def _wanted(batches) -> Iterator[pa.RecordBatch]:
    """All windows of the items; one shorter than a window is a window of its own size."""
    for keys, texts in _chunks(batches):
        rows: list[tuple] = []
        for key, text in zip(keys, texts, strict=True):
            c = Canonical([text])
            for which, least in ((TEMPLATE, LITERALS), (PLAIN, LEAST)):
                size = min(WINDOW, len(c.of(which)[0]))
                if size < least:
                    continue
                at, h = c.windows(which, size)
                rows += _rows([key], c, which, size, at, h, np.array([len(at)]))
        yield _batch(rows)


WINDOWS = "key long, kind int, size int, at long, word_at long, total long, length long, hash long, slots array<int>, given array<long>"
FOUND = "doc_id long, item_id long, n_windows long, item_windows long, first_token long"


class Copy:
    """What the windows of one kind on one diagonal, or some neighbouring ones, say.

    A value of the item stands for what it most often is in the document; windows that say otherwise don't
    count.  Where more than one place, and more than one in ``ODD``, says otherwise, it's chance agreement.
    """

    def __init__(self, rows: list[dict]):
        said: dict[int, dict[int, set[int]]] = {}  # where in the item a value stands for which
        for r in rows:
            for slot, given, has in zip(r["slots"], r["given"], r["has"], strict=True):
                said.setdefault(given, {}).setdefault(has, set()).add(r["at"] + slot)
        means = {given: max(x, key=lambda h: (len(x[h]), h == given, h)) for given, x in said.items()}
        agree = [r for r in rows if all(means[g] == h for g, h in zip(r["given"], r["has"], strict=True))]
        self.all, self.n, self.total = len({r["at"] for r in rows}), len({r["at"] for r in agree}), rows[0]["total"]
        self.first = min(r["word_at"] for r in agree or rows)
        self.last = max(r["word_at"] for r in agree or rows)
        self.covered = len({k for r in agree for k in range(r["at"], r["at"] + r["size"])}) / rows[0]["length"]
        places = [set().union(*x.values()) for x in said.values()]
        odd = sum(len(at - said[given][means[given]]) for given, at in zip(said, places, strict=True))
        self.sound = odd <= max(1, sum(map(len, places)) // ODD)

    def enough(self, share: float, run: int) -> bool:
        n = self.n if self.sound else self.all
        return n >= run or n >= share * self.total or (self.sound and n > 1 and self.covered >= COVERED)

    def rank(self) -> tuple[int, int]:
        return self.n, -self.first


def _bands(rows: list[dict]) -> Iterator[tuple[bool, Copy]]:
    """Each diagonal of rows that are sorted by it, and each with those up to ``BAND`` behind it; whether it's one."""
    shifts = [r["shift"] for r in rows]
    a = 0
    while a < len(rows):
        z, far = bisect_right(shifts, shifts[a]), bisect_right(shifts, shifts[a] + BAND)
        yield True, Copy(rows[a:z])
        if far > z:
            yield False, Copy(rows[a:far])
        a = z


def _judge(rows: list[dict], share: float, run: int) -> Copy | None:
    """The best copy that the windows of one document and one item show."""
    good: list[Copy] = []
    bad: list[Copy] = []
    for kind, mine in groupby(sorted(rows, key=itemgetter("kind", "shift")), itemgetter("kind")):
        for one, c in _bands(list(mine)):
            if not c.enough(share, run):
                continue
            # Part of a template whose slots disagree isn't evidence by its words alone; the whole is.
            if kind == PLAIN and c.n < c.total and any(b.first < c.last + WINDOW and c.first < b.last + WINDOW for b in bad):
                continue
            if c.sound:
                good.append(c)
            elif one:
                bad.append(c)
    return max(good, key=Copy.rank, default=None)


def _pairs(share: float, run: int):
    """Rows come sorted by document and item; those of one pair are held."""

    def judge(batches) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in b.to_pylist())
        out = []

        def made():
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else [[]] * 5)], [x.split()[0] for x in FOUND.split(", ")])

        for (doc, item), mine in groupby(rows, itemgetter("doc_id", "item_id")):
            best = _judge(list(mine), share, run)
            if best:
                out.append((doc, item, best.n, best.total, best.first))
            if len(out) >= 10_000:
                yield made()
                out.clear()
        yield made()

    return judge


def contaminated(docs: DataFrame, items: DataFrame, share: float = 0.5, run: int = 6) -> DataFrame:
    """(doc_id, item_id) pairs where a document holds a template of the item, slots consistent, or its words.

    A pair counts if, on ``BAND`` + 1 neighbouring diagonals, ``share`` of the item's windows, ``run`` of them,
    or windows that hold ``COVERED`` of its tokens match with the values
    that most of the copy has; windows of
    canonical tokens and of plain words are counted apart.
    Input: doc_id, text and item_id, text; other columns are ignored.  Null and empty texts match nothing.
    Items of fewer than ``WINDOW`` tokens are one window; as a template only with ``LITERALS`` literals, as words
    from ``LEAST`` tokens on: one or two words are no item and match nothing.
    Repeated rows give one pair.  Where either table is empty there are no pairs.
    Output: doc_id, item_id, n_windows, item_windows, first_token (where the best copy starts).
    """
    spark = docs.sparkSession
    work = Work(spark, "decontaminate")
    given = items.select(F.col("item_id").cast("long").alias("key"), F.col("text").cast("string").alias("text"))
    wanted = work.put(given.mapInArrow(_wanted, WINDOWS), "windows")
    sizes = sorted((r[0], r[1]) for r in wanted.select("kind", "size").distinct().collect())  # at most 2 * WINDOW
    # A bitmap of fixed size says which windows are worth sending to the join.
    marks = marks_of(wanted, "hash")
    mine = docs.select(F.col("doc_id").cast("long").alias("key"), F.col("text").cast("string").alias("text"))
    met = work.put(mine.mapInArrow(tidied(_emit(sizes, marks)), WINDOWS).select(F.col("key").alias("doc_id"), "kind", "size", F.col("at").alias("doc_at"), "word_at", "hash", F.col("given").alias("has")), "met")
    pairs = met.join(wanted.select(F.col("key").alias("item_id"), "kind", "size", "at", "total", "length", "hash", "slots", "given"), ["kind", "size", "hash"])
    pairs = pairs.select("doc_id", "item_id", "kind", "size", (F.col("doc_at") - F.col("at")).alias("shift"), "word_at", "at", "total", "length", "slots", "given", "has")
    return pairs.repartition("doc_id", "item_id").sortWithinPartitions("doc_id", "item_id").mapInArrow(tidied(_pairs(share, run)), FOUND)
