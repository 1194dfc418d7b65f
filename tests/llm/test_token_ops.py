"""Packing, token files and sharding against direct computation."""

import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest
from marginalia.llm import huffman, packing, sharding
from marginalia.llm.tokens import default_vocabulary
from marginalia.llm.work import Work


@lru_cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_vocabulary())


def ids_of(text, end):
    return [*tokenizer().encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing(documents, texts):
    rows = packing.pack(documents, 64, per_bucket=10).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert by_doc.keys() == texts.keys()
    for doc, pieces in by_doc.items():
        ids, at = ids_of(texts[doc], 1), 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids))
            assert p.ids_crc32 == crc(ids[at : at + p.length])
            at += p.length
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 64
    assert sum(r.length for r in rows) / 64 / len(by_seq) > 0.95


def test_patterns_use_every_length_once():
    histogram = {k: 1 + 977 // k for k in range(1, 256)}
    used = Counter()
    for lengths, n in packing.shortest_pack_first(histogram, 256):
        assert sum(lengths) <= 256
        for k in lengths:
            used[k] += n
    assert used == Counter(histogram)


def test_packing_nothing(nothing):
    assert packing.pack(nothing).count() == 0


def test_packing_repeated_rows(spark):
    rows = packing.pack(spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None)], "doc_id long, text string"), 8).collect()
    assert sorted((r.doc_id, r.length) for r in rows) == [(1, 3), (1, 3), (2, 1)]


@pytest.mark.parametrize("block", [100, 1 << 19])
def test_token_files(spark, documents, texts, block):
    path = Work(spark, "t").path("x")
    huffman.write(documents, path, shard_bytes=5000, block_ids=block)
    at = 0
    plain = {r.doc_id: r.ids for r in huffman.read(spark, path).collect()}
    for r in huffman.read(spark, path, digest=True).orderBy("doc_id").collect():
        ids = ids_of(texts[r.doc_id], 2)
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), crc(ids))
        assert plain[r.doc_id] == ids
        at += len(ids)
    assert plain.keys() == texts.keys()


def test_token_files_nothing(spark, nothing):
    path = Work(spark, "t").path("x")
    huffman.write(nothing, path)
    assert huffman.read(spark, path, digest=True).count() == 0


@pytest.mark.parametrize(("n", "limit"), [(1, 20), (2, 20), (5, 3), (300, 9), (3000, 12)])
def test_huffman_round_trip(n, limit):
    counts = np.zeros(n + 4, np.int64)
    counts[4:] = (1e6 / np.arange(1, n + 1) ** 1.3).astype(int) + 1
    lengths = huffman.code_lengths(counts, limit)
    assert lengths.max() <= limit and (lengths > 0).sum() == n
    assert sum(2.0 ** -int(x) for x in lengths if x) <= 1
    ids = np.random.default_rng(1).choice(np.flatnonzero(counts), 5001)
    bits, marks = huffman.encode_bits(ids, lengths, huffman.canonical_codes(lengths))
    assert (huffman.decode_bits(bits, marks, len(ids), huffman.decode_table(lengths)) == ids).all()


def brute_minimax(sizes, shards):
    total = [0]
    for x in sizes:
        total.append(total[-1] + x)
    best = [0] + [10**18] * len(sizes)
    for _ in range(shards):
        best = [0] + [min(best[i], *(max(best[j], total[i] - total[j]) for j in range(i))) for i in range(1, len(best))]
    return best[-1]


def test_minimax_is_smallest():
    rng = np.random.default_rng(3)
    for _ in range(60):
        sizes, shards = rng.integers(1, 60, rng.integers(1, 40)).tolist(), int(rng.integers(1, 9))
        cuts = sharding.minimax_cuts(sizes, shards)
        load = Counter()
        for s, c in zip(sizes, cuts, strict=True):
            load[c] += s
        assert cuts == sorted(cuts) and max(load.values()) == brute_minimax(sizes, shards)


def test_sharding(documents, texts):
    rows = sharding.shard(documents, 8, per_slice=7).collect()
    assert Counter(r.doc_id for r in rows) == Counter(texts.keys())
    by_text, slots = defaultdict(set), defaultdict(list)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        by_text[raw].add(r.shard)
        slots[r.shard].append(r.slot)
    assert all(len(x) == 1 for x in by_text.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and slots.keys() <= set(range(8))


@pytest.mark.parametrize(("bits", "n"), [(2, 300), (12, 300), (1, 40)])
def test_sharding_is_minimax_over_groups(spark, bits, n):
    """However coarse the first cells are, the largest shard is that of the best cut between any two groups."""
    import hashlib
    import random

    r = random.Random(bits)
    texts = ["x" * r.choice([3, 40, 200, 900]) + str(r.randrange(10**6)) for _ in range(n)]
    df = spark.createDataFrame([(i, texts[i // 2 if i % 7 == 0 else i]) for i in range(n)], "doc_id long, text string")
    rows = sharding.shard(df, 5, bits=bits, share=1.0).collect()
    size, load = Counter(), Counter()
    for r in df.collect():
        size[hashlib.sha256(r.text.encode()).digest()] += len(r.text) + 1
    for r in rows:
        load[r.shard] += r.size
    assert len(rows) == n and max(load.values()) == brute_minimax([size[k] for k in sorted(size)], 5)


def test_sharding_equal_rows_and_hot_text(spark, nothing):
    assert sharding.shard(nothing).count() == 0
    rows = [(i, "hot " * 50 if i % 3 == 0 else f"text number {i} " * 11) for i in range(300)] + [(5, "again"), (5, "again")]
    load = Counter()
    for r in sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect():
        load[r.shard] += r.size
    hot = max(load.values())
    rest = [v for v in load.values() if v != hot]
    assert len(rest) == 7 and max(rest) - min(rest) <= 400


def encoded(enc, texts):
    import pyarrow as pa

    out = []
    for i, j, ids, n in enc.encode(pa.array(texts, pa.string()).slice(1), None):
        assert len(n) == j - i
        out += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
    return out


@pytest.mark.parametrize("special_as_text", [False, True])
def test_encoder_is_the_library(special_as_text):
    import random

    from marginalia.llm.tokens import Encoder

    r, enc = random.Random(4), Encoder(default_vocabulary(), special_as_text, slots=1 << 12)
    signs = ["a", "the", "Thing", "\u00e9t\u00e9", "\u0178", " ", " ", " ", "  ", "\n", "\n\n", "\t", ".", ",", "'s", "'", "'ll", "'l", "'re", "'S", "12", "\r\n", "#", "<|endoftext|>", "averyverylongwordthatgoeson", "w%d"]
    some = ["".join(r.choice(signs).replace("%d", str(r.randrange(5000))) for _ in range(r.randint(0, 30))) for _ in range(4000)]
    some += ["\u65e5\u672c x", " lead", "trail ", "\n", " ", "", None, "a\u00d7b", "a\u00f7", "x\u0000y", "\u0180", "a \n'd", "''s", " 's", "\x7f"]
    plain = Tokenizer_with(special_as_text)
    want = [plain.encode(x or "", add_special_tokens=False).ids for x in some]
    assert encoded(enc, ["sliced off", *some]) == want
    assert encoded(enc, ["sliced off", *some[::-1]]) == want[::-1]


def Tokenizer_with(special_as_text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_vocabulary())
    t.encode_special_tokens = special_as_text
    return t


def test_long_texts_are_cut_between_words(monkeypatch):
    import random

    from marginalia.llm import tokens

    monkeypatch.setattr(tokens, "EACH", 200)
    r, enc = random.Random(5), tokens.Encoder(default_vocabulary())
    some = [" ".join(r.choice(["one", "two's", "12 ,", "\n", "\u00e9"]) for _ in range(k)) for k in (1000, 3, 0, 2000)] + ["7" * 3000, "a\n" * 900, "\u65e5 " * 500]
    assert encoded(enc, ["", *some]) == [tokenizer().encode(x, add_special_tokens=False).ids for x in some]


def test_token_files_order_nulls_and_ties(spark):
    path = Work(spark, "t").path("x")
    rows = [(None, "none a"), (3, "c c"), (3, "a"), (3, "a"), (-1, None), (None, ""), (2, "<|endoftext|>")]
    huffman.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), path, shard_bytes=4)
    got = huffman.read(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, -1, 2, 3, 3, 3]
    assert sorted((r.doc_id is None, r.doc_id or 0, r.ids) for r in got) == sorted((d is None, d or 0, ids_of(x, 2)) for d, x in rows)
    same = [r.ids for r in got if r.doc_id == 3]
    assert same in ([ids_of("a", 2)] * 2 + [ids_of("c c", 2)], [ids_of("c c", 2)] + [ids_of("a", 2)] * 2)
    at = 0
    for r in got:
        assert (r.start, r.n_tokens) == (at, len(r.ids))
        at += r.n_tokens
