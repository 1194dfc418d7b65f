"""Byte-level BPE ids through the ``tokenizers`` library, each distinct word given to it once.

The library splits a text into words by a fixed pattern and merges within each word alone, so the ids of
a text are the ids of its words one after the other.  Texts made only of ``PLAIN`` characters are split here by
that pattern, many texts at once on their bytes, and words are looked up by their own bytes in a table of fixed size; the
library sees only words the table lacks.  Any other text, and one that holds a control string, goes to the library whole.
The table is emptied when it is half full; a worker process keeps one, of some 60 MB at most.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

SLOTS = 1 << 21
#: Bytes of texts that are split at once; a longer text is cut between two words that a single blank parts.
EACH = 1 << 20
#: Distinct words that the library gets as one string.
JOINED = 64
_SEP, _BREAK, _BLANK, _LETTER, _DIGIT, _OTHER, _ODD = range(7)


def _classes() -> np.ndarray:
    """Class of each byte of a text of tabs, line ends, ASCII, and Latin letters up to U+017F (the PLAIN characters)."""
    out = np.full(256, _ODD, np.uint8)
    out[0] = _SEP
    out[[9, 10, 13]] = _BREAK
    out[32] = _BLANK
    out[33:127] = _OTHER
    out[ord("0") : ord("9") + 1] = _DIGIT
    out[ord("A") : ord("Z") + 1] = out[ord("a") : ord("z") + 1] = _LETTER
    out[0x80:0xC0] = out[0xC3:0xC6] = _LETTER
    return out


CLASS = _classes()
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Letters after an apostrophe that are a word with it: their number by the first, and the second where there is one.
_SHORT = {ord("s"): (1, 0), ord("t"): (1, 0), ord("m"): (1, 0), ord("d"): (1, 0), ord("r"): (2, ord("e")), ord("v"): (2, ord("e")), ord("l"): (2, ord("l"))}


def split(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of plain texts, each of which a zero byte ends."""
    kind = CLASS[data]
    run = np.where(kind == _BLANK, np.uint8(_BREAK), kind)
    edge = np.append(True, run[1:] != run[:-1])
    start = np.flatnonzero(edge)
    what, end = run[start], np.append(start[1:], len(data))
    edge = np.append(edge, True)
    zero = data == 0
    edge[:-1] |= zero
    edge[1:] |= zero
    # The last sign of a run of white space stands alone before a word, and a blank there is part of that word.
    white = np.flatnonzero((what == _BREAK) & (run[np.minimum(end, len(data) - 1)] != _SEP))
    edge[end[white] - 1] = True
    blank = end[white[data[end[white] - 1] == 32]]
    edge[blank] = False
    short = start[(what == _OTHER) & (end - start == 1)]
    short = short[(data[short] == 39) & edge[short]]
    for first, (n, second) in _SHORT.items():
        at = short[data[short + 1] == first]
        if n == 2:
            at = at[data[at + 2] == second]
        edge[at + 1] = False
        edge[at + 1 + n] = True
    at = np.flatnonzero(edge)
    a, z = at[:-1], at[1:]
    real = data[a] != 0
    return a[real], z[real]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


class Words:
    """Ids of words met so far: words of up to 16 bytes by their two halves in an open table, others by their bytes."""

    def __init__(self, slots: int):
        self.slots, self.full = slots, slots // 2
        self.clear()

    def clear(self) -> None:
        self.n = self.used = self.placed = 0
        self.entry = np.full(self.slots, -1, np.int32)
        self.low, self.high = (np.zeros(1 << 10, np.uint64) for _ in range(2))
        self.at, self.ids = np.zeros(1 << 10, np.int64), np.zeros(1 << 12, np.uint32)
        self.long: dict[bytes, int] = {}

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Entry of each word, -1 where there is none."""
        slot = (_mix(low ^ _mix(high ^ np.uint64(77))) & np.uint64(self.slots - 1)).astype(np.int64)
        out, todo = np.full(len(low), -1, np.int64), np.arange(len(low))
        while len(todo):
            e = self.entry[slot[todo]]
            todo, e = todo[e >= 0], e[e >= 0]
            same = (self.low[e] == low[todo]) & (self.high[e] == high[todo])
            out[todo[same]] = e[same]
            todo = todo[~same]
            slot[todo] = (slot[todo] + 1) & (self.slots - 1)
        return out

    def add(self, sizes: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Entries for further words, by how many ids each has."""
        n, used = self.n + len(sizes), self.used + len(ids)
        for name, need in (("at", n + 1), ("low", n), ("high", n), ("ids", used)):
            old = getattr(self, name)
            if need > len(old):
                new = np.zeros(max(need, 2 * len(old)), old.dtype)
                new[: len(old)] = old
                setattr(self, name, new)
        self.ids[self.used : used] = ids
        self.at[self.n + 1 : n + 1] = self.used + np.cumsum(sizes)
        out = np.arange(self.n, n)
        self.n, self.used = n, used
        return out

    def put(self, low: np.ndarray, high: np.ndarray, entry: np.ndarray) -> None:
        """Make distinct words found under their entries, as long as the table has room."""
        room = self.slots * 7 // 8 - self.placed
        low, high, entry = low[:room], high[:room], entry[:room]
        self.placed += len(low)
        self.low[entry], self.high[entry] = low, high
        slot = (_mix(low ^ _mix(high ^ np.uint64(77))) & np.uint64(self.slots - 1)).astype(np.int64)
        todo = np.arange(len(low))
        while len(todo):
            free = todo[self.entry[slot[todo]] < 0]
            self.entry[slot[free]] = entry[free]  # of words for one slot the last stays
            todo = todo[self.entry[slot[todo]] != entry[todo]]
            slot[todo] = (slot[todo] + 1) & (self.slots - 1)


class Encoder:
    """``encode`` gives the ids of many texts; ``special_as_text`` makes control strings in a text ordinary text."""

    def __init__(self, path: str, special_as_text: bool = False, slots: int = SLOTS):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = special_as_text
        made = json.loads(self.tok.to_str())
        split_as_here = made["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        self.by_word = split_as_here and made["normalizer"] is None and made["model"]["type"] == "BPE" and not made["model"].get("dropout")
        added = self.tok.get_added_tokens_decoder()
        self.controls = [] if special_as_text and all(t.special for t in added.values()) else [t.content.encode() for t in added.values()]
        self.size = np.zeros(self.tok.get_vocab_size(), np.int64)
        for token, k in self.tok.get_vocab().items():
            self.size[k] = len(token)  # a sign a byte
        self.words = Words(slots)

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[bytes], apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Order in which the words are given, number of ids of each, and the ids; words ``apart`` part from each other when joined."""
        some, alone = np.flatnonzero(apart), np.flatnonzero(~apart)
        mine = [words[i] for i in some.tolist()]
        ids = np.concatenate([np.zeros(0, np.uint32), *self._library([b"".join(mine[i : i + JOINED]).decode() for i in range(0, len(mine), JOINED)])])
        ends, have = np.cumsum(np.array([len(w) for w in mine], np.int64)), np.cumsum(self.size[ids])
        cut = np.searchsorted(have, ends) + 1
        if len(mine) and not (cut[-1] == len(ids) and (have[cut - 1] == ends).all()):
            some, alone, ids, cut = some[:0], np.arange(len(words)), ids[:0], cut[:0]
        rest = self._library([words[i].decode() for i in alone.tolist()])
        sizes = np.concatenate([np.diff(cut, prepend=0), np.array([len(x) for x in rest], np.int64)])
        return np.concatenate([some, alone]), sizes, np.concatenate([ids, *rest])

    def _plain(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain texts that lie in ``data`` with a zero byte after each, and how many each has."""
        a, z = split(data) if len(data) else (ends, ends)
        if not len(a):
            return np.zeros(0, np.uint32), np.zeros(len(ends), np.int64)
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
        n = z - a
        low, high = eight[a] & _MASK[np.minimum(n, 8)], eight[a + 8] & _MASK[np.clip(n - 8, 0, 8)]
        if self.words.n > self.words.full or self.words.used > 8 * self.words.full:
            self.words.clear()
        entry = self.words.find(low, high)
        long = np.flatnonzero(n > 16)
        bytes_of = data.tobytes()
        if len(long):
            entry[long] = [self.words.long.get(bytes_of[i:j], -1) for i, j in zip(a[long].tolist(), z[long].tolist(), strict=True)]
        new = np.flatnonzero(entry < 0)
        if len(new):
            texts = [bytes_of[i:j] for i, j in zip(a[new].tolist(), z[new].tolist(), strict=True)]
            number = {w: k for k, w in enumerate(dict.fromkeys(texts))}
            where = np.fromiter(map(number.__getitem__, texts), np.int64, len(texts))
            distinct = list(number)
            first = np.zeros(len(distinct), np.int64)
            first[where] = new
            order, sizes, learnt = self._learn(distinct, (data[a[first]] == 32) & (data[np.minimum(a[first] + 1, len(data) - 1)] > 32) & (n[first] > 1))
            made = np.zeros(len(distinct), np.int64)
            made[order] = self.words.add(sizes, learnt)
            entry[new] = made[where]
            small = n[first] <= 16
            self.words.put(low[first[small]], high[first[small]], made[small])
            for k in np.flatnonzero(~small & (n[first] <= 64)).tolist():
                self.words.long[distinct[k]] = int(made[k])
        start, count = self.words.at[entry], self.words.at[entry + 1] - self.words.at[entry]
        upto = np.cumsum(count)
        ids = self.words.ids[np.repeat(start - upto + count, count) + np.arange(upto[-1])]
        until = np.append(0, upto)[np.searchsorted(a, ends)]
        return ids, np.diff(until, prepend=0)

    def encode(self, texts: pa.Array, end_id: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, next row, ids, number of ids of each row) for runs of the rows of a string column; ``end_id`` ends every row."""
        texts = texts.cast(pa.large_string())
        if texts.null_count:
            texts = texts.fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + EACH, "right")) - 1)
            yield i, j, *self._some(raw, offsets[i : j + 1], end_id)
            i = j

    def _some(self, raw: np.ndarray, offsets: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        data = raw[offsets[0] : offsets[-1]]
        at = offsets - offsets[0]
        odd = np.zeros(len(at) - 1, bool)
        if len(data):
            wrong = (CLASS[data] == _ODD) | (data == 0)
            wrong[:-1] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))  # × and ÷ are no letters
            odd[np.searchsorted(at, np.flatnonzero(wrong), "right") - 1] = True
            whole = data.tobytes()
            for c in self.controls if self.by_word else []:
                k = whole.find(c)
                while k >= 0:
                    odd[np.searchsorted(at, k, "right") - 1] = True
                    k = whole.find(c, k + 1)
        if not self.by_word:
            odd[:] = True
        sizes = np.diff(at)
        mine = ~odd & (sizes <= 2 * EACH)
        part = data if mine.all() else data[np.repeat(mine, sizes)]
        ends = np.cumsum(sizes[mine]) + np.arange(mine.sum())  # of the texts, each with a zero byte after it
        joined = np.zeros(len(part) + len(ends), np.uint8)
        text = np.ones(len(joined), bool)
        text[ends] = False
        joined[text] = part
        ids, some = self._plain(joined, ends)
        n = np.zeros(len(sizes), np.int64)
        n[mine] = some
        if not mine.all():
            found: list[np.ndarray] = [ids[:0]] * len(sizes)
            for k, x in zip(np.flatnonzero(mine).tolist(), np.split(ids, np.cumsum(some)[:-1]), strict=False):
                found[k] = x
            for k in np.flatnonzero(~mine).tolist():
                raw_text = data[at[k] : at[k + 1]]
                found[k] = self._library([raw_text.tobytes().decode()])[0] if odd[k] else np.concatenate([self._plain(np.append(x, np.uint8(0)), np.array([len(x)]))[0] for x in _parts(raw_text)])
            n, ids = np.array([len(x) for x in found], np.int64), np.concatenate(found)
        if end_id is None:
            return ids, n
        out = np.full(len(ids) + len(n), end_id, np.uint32)
        out[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
        return out, n + 1


def _parts(text: np.ndarray) -> Iterator[np.ndarray]:
    """A text in parts that end between two words."""
    while len(text) > 2 * EACH:
        near = CLASS[text[: 2 * EACH]]
        cut = np.flatnonzero((near[1:-1] == _BLANK) & (near[:-2] == _LETTER) & (near[2:] == _LETTER))
        if not len(cut):
            break
        yield text[: cut[-1] + 1]
        text = text[cut[-1] + 1 :]
    yield text


_made: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process; another vocabulary takes the place of the last."""
    if path not in _made:
        _made.clear()
        _made[path] = Encoder(path)
    return _made[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
