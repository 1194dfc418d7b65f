"""Repeat removal and its suffix array against direct computation."""

import random
from collections import defaultdict

import pytest
from marginalia.llm.repeats import remove_repeats
from marginalia.llm.suffixes import repeated_windows, suffix_array


def brute(texts, width):
    first, docs = {}, {i: (x or "").encode() for i, x in texts.items()}
    for i in sorted(docs):
        for a in range(len(docs[i]) - width + 1):
            first.setdefault(docs[i][a : a + width], i)
    gone = {}
    for i, d in docs.items():
        g = [False] * len(d)
        for a in range(len(d) - width + 1):
            if first[d[a : a + width]] < i:
                g[a : a + width] = [True] * width
        gone[i] = g
    return gone


def spans(g):
    out, a = [], None
    for i, x in enumerate([*g, False]):
        if x and a is None:
            a = i
        elif not x and a is not None:
            out.append((a, i))
            a = None
    return out


def test_suffix_array():
    r = random.Random(1)
    for _ in range(300):
        t = [r.randint(0, r.choice([0, 1, 2, 25])) for _ in range(r.randint(0, 40))]
        assert suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])
    assert suffix_array(b"ab" * 300 + b"a") == sorted(range(601), key=lambda i: (b"ab" * 300 + b"a")[i:])


def test_suffix_array_finds_what_brute_force_finds(texts):
    some = {i: x for i, x in texts.items() if len(x or "") < 900}
    got = repeated_windows([(some[i] or "").encode() for i in sorted(some)], 50)
    assert dict(zip(sorted(some), got, strict=True)) == brute(some, 50)


def made_passages(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 7)))
    passages = [" ".join(word() for _ in range(r.randint(5, 30))) for _ in range(8)]
    out = {}
    for i in range(80):
        parts = [r.choice(passages)[r.randint(0, 9) :] if r.random() < 0.5 else " ".join(word() for _ in range(r.randint(0, 20))) for _ in range(r.randint(0, 5))]
        out[3 * i - 40] = " é ".join(parts)
    out[900] = "ab" * 90
    out[901] = "zab" + "ab" * 70
    return out


@pytest.mark.parametrize(("seed", "block"), [(1, 300), (2, 2000), (3, 1 << 20)])
def test_remove_repeats(spark, seed, block):
    texts = made_passages(seed)
    df = spark.createDataFrame([(i, x, 1, b"") for i, x in texts.items()], "doc_id long, text string, block int, data binary").repartition(6)
    want = brute(texts, 50)
    rows = remove_repeats(df, 50, block).collect()
    assert {r.doc_id for r in rows} == texts.keys()
    for r in rows:
        raw, g = texts[r.doc_id].encode(), want[r.doc_id]
        assert [(s.start, s.end) for s in r.spans] == spans(g), r.doc_id
        assert (r.n_bytes, r.n_removed, bytes(r.kept)) == (len(raw), sum(g), bytes(b for b, x in zip(raw, g, strict=True) if not x))


def test_edge_texts(spark, documents, texts, nothing):
    want = brute(texts, 50)
    got = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in remove_repeats(documents, 50, 4000).collect()}
    assert got == {i: spans(g) for i, g in want.items()}
    assert remove_repeats(nothing).count() == 0


def test_equal_ids_do_not_count_against_each_other(spark):
    rows = [(1, "x y z " * 20), (1, "x y z " * 20), (2, "x y z " * 20), (None, "x y z " * 20), (None, None)]
    found = defaultdict(list)
    for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found[r.doc_id].append(r.n_removed)
    assert found == {1: [0, 0], 2: [120], None: [0, 0]}
