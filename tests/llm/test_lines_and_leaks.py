"""Line dedup, decontamination and the pipeline against direct computation."""

import random

import pytest
from marginalia.llm import decontaminate, lines, quality
from pyspark.sql import functions as F

import corpus_pipeline
from marginalia.llm.work import table


def brute_lines(texts):
    """Removed line numbers per document."""
    seen, out = [], {}
    for doc in sorted(texts):
        gone = []
        for k, line in enumerate((texts[doc] or "").split("\n")):
            words = frozenset(line.encode().split())
            if not words:
                continue
            if any(5 * len(words & s) >= 4 * len(words | s) for s in seen if 4 * len(words) <= 5 * len(s) and 4 * len(s) <= 5 * len(words)):
                gone.append(k)
            seen.append(words)
        out[doc] = gone
    return out


def made_lines(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["the", "of", "and"] * 5
    base = [[r.choice(vocabulary) for _ in range(r.choice([3, 12, 25, 40]))] for _ in range(12)]
    out = {}
    for i in range(90):
        mine = []
        for _ in range(r.randint(0, 6)):
            line = list(r.choice(base)) if r.random() < 0.6 else [r.choice(vocabulary) for _ in range(r.randint(0, 30))]
            for _ in range(r.choice([0, 1, 1, 2, 4])):
                if line:
                    line[r.randrange(len(line))] = f"new{r.randrange(3000)}"
            mine.append(" ".join(line))
        out[i * 2 - 30] = "\n".join(mine)
    return out


@pytest.mark.parametrize(("seed", "held", "most", "many"), [(1, 64, 3, 4096), (2, 2, 3, 4096), (3, 64, 1, 2), (4, 2, 1, 1), (5, 3, 1, 4096)])
def test_lines(spark, monkeypatch, seed, held, most, many):
    monkeypatch.setattr(lines, "MANY", many)
    monkeypatch.setattr(lines, "BUCKET_BYTES", 20_000)
    texts = made_lines(seed)
    df = spark.createDataFrame([(i, x, 3, "k") for i, x in texts.items()], "doc_id long, text string, removed int, key string").repartition(5)
    want = brute_lines(texts)
    rows = lines.dedup_lines(df, held, most).collect()
    assert {r.doc_id: list(r.removed) for r in rows} == want
    for r in rows:
        assert r.key == "k" and r.n_lines == texts[r.doc_id].count("\n") + 1
        assert r.kept_text == "\n".join(x for k, x in enumerate(texts[r.doc_id].split("\n")) if k not in want[r.doc_id])


def packed(word, keys, n=10):
    """A row of postings of one word, of sets that agree in all that is compared."""
    import zlib

    import numpy as np

    k = len(keys)
    wide = [np.full(k, word, np.uint64), np.array(keys, np.uint64), np.zeros(k, np.uint64), np.zeros(k, np.uint64)]
    rest = [np.array(keys, np.int64), *(np.full(k, x, np.int32) for x in (0, 0, n, 0))]
    return k.to_bytes(4, "little") + b"".join(x.tobytes() for x in wide) + zlib.compress(b"".join(x.tobytes() for x in rest))


def single(key, n=10):
    import numpy as np

    return np.array([(key, 0, 0, n, 0)], lines.ALONE).tobytes()


@pytest.mark.parametrize("alone", [True, False])
@pytest.mark.parametrize("small", [8, 100])
def test_matches_compare_first_lines_and_report_the_rest(alone, small):
    import pyarrow as pa

    n = 60
    for cuts in ([0, 60], [0, 5, 30, 60], [0, 1, 2, 59, 60]):
        for most in (3, 100):
            rows = [{"bucket": 1, "word": None, "data": packed(7, range(a, b))} for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            if alone:
                rows = [{"bucket": 1, "word": 7, "data": single(k)} for k in range(n)]
            rows.append({"bucket": 2, "word": None, "data": packed(8, [500])})
            batch = pa.RecordBatch.from_pylist(rows, pa.schema([("bucket", pa.int32()), ("word", pa.int64()), ("data", pa.binary())]))
            got = pa.Table.from_batches(list(lines._matched(24, most, small)([batch.slice(0, cuts[1]), batch.slice(cuts[1])]))).to_pylist()
            few = lines.FEW * most  # so many are given whole; of more, the likeliest
            assert {r["x"] for r in got if r["n"] is not None} == (set() if alone else set(range(n)))
            got = [r for r in got if r["n"] is None]
            assert {(r["x"], r["y"]) for r in got if r["word"] is None} == {(x, y) for x in range(n) for y in range(min(x, 24) if min(x, 24) <= few else most)}
            assert {r["x"] for r in got if r["word"] == 7} == set(range(min(few, 24) + 1, n))


def test_lines_edges(spark, documents, texts, nothing):
    got = {r.doc_id: list(r.removed) for r in lines.dedup_lines(documents).collect()}
    assert got == brute_lines(texts)
    assert lines.dedup_lines(nothing).count() == 0
    twice = spark.createDataFrame([(1, "a b\na b\nc"), (1, "a b\na b\nc"), (2, None), (3, ""), (None, "a b\na b")], "doc_id long, text string")
    got = lines.dedup_lines(twice).collect()
    assert sorted((r.doc_id or 0, r.kept_text) for r in got if r.doc_id != 2) == [(0, "a b\na b"), (1, "a b\nc"), (1, "a b\nc"), (3, "")]
    assert [list(r.removed) for r in got if r.doc_id is None] == [[]]


@pytest.mark.parametrize("few", [0, 1 << 15])
def test_lines_read_only_the_texts_of_candidates_again(spark, monkeypatch, few):
    """Few documents that hold candidates are picked before their texts leave the JVM; of many, a bitmap tells them."""
    texts = made_lines(6) | {1000 + i: f"alone{i} as{i} can{i} be{i} here{i} now{i}" for i in range(50)}
    made = lines._marked

    def watched(docs, marks):
        inner, most = made(docs, marks), few

        def run(batches):
            def seen():
                for b in batches:
                    if most and not lines.marked(docs, b.column("mark").to_numpy().view("u8")).all():
                        raise AssertionError("texts without candidates were sent")
                    yield b

            return inner(seen())

        return run

    monkeypatch.setattr(lines, "_marked", watched)
    monkeypatch.setattr(lines, "FEW_DOCS", few, raising=False)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    assert {r.doc_id: list(r.removed) for r in lines.dedup_lines(df).collect()} == brute_lines(texts)


def test_lines_counted_and_hashed_in_bytes(spark, sf_dir, tmp_path):
    from hashlib import sha256

    from marginalia.llm import queries

    texts = {1: "é ü\nß\né ü\n", 2: None, 3: "", 4: "\n\n", 5: "日本 語\nß\n\U0001f600"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_lines, r.removed, r.kept_sha256) for r in queries.op3_line_dedup(spark, str(tmp_path)).collect()}
    kept = {1: "é ü\nß\n", 3: "", 4: "\n\n", 5: "日本 語\n\U0001f600"}
    want = {i: sha256(x.encode()).hexdigest() for i, x in kept.items()}
    assert got == {1: (4, "2", want[1]), 2: (0, "", None), 3: (1, "", want[3]), 4: (3, "", want[4]), 5: (3, "1", want[5])}


ITEM = "If Alice has 3 apples and buys 12 more apples at 5 km from home, how many apples does Alice carry back to Bob after 3 days?"


def pairs(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS size")
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id")
    return {(r.doc_id, r.item_id) for r in decontaminate.contaminated(d, i).collect()}


def test_copies_and_new_parameters_are_caught(spark):
    other = ITEM.replace("Alice", "Dora").replace("Bob", "Emil").replace("12", "44").replace("3", "9").replace(" 5 km", " 8 miles")
    mixed = ITEM.replace("Alice has", "Dora has").replace("3 apples", "9 apples")  # Alice and 3 stand for two values each
    docs = [(1, "Intro text here. " + ITEM + " And more."), (2, "Also " + other), (3, mixed), (4, "nothing of the sort at all in this one"), (5, None), (6, ""), (7, ITEM.lower() + " " + ITEM), (7, ITEM)]
    assert pairs(spark, docs, [(10, ITEM), (11, None), (12, ""), (13, "two words")]) == {(1, 10), (2, 10), (7, 10)}
    assert pairs(spark, docs, []) == set() and pairs(spark, [], [(10, ITEM)]) == set()


def test_short_items(spark):
    docs = [(1, "we say zebra crossing ahead often"), (2, "we say zebra often")]
    assert pairs(spark, docs, [(1, "zebra crossing ahead often"), (2, "zebra crossing")]) == {(1, 1)}


def test_leaks_of_given_tables(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    texts = {r.doc_id: " ".join((r.text or "").split()) for r in docs.collect()}
    passages = {r.item_id: " ".join(r.text.split()) for r in items.collect()}
    want = {(d, i) for d, x in texts.items() for i, p in passages.items() if p in x}
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()}
    assert want and got == want


def test_copies_in_any_case_are_caught(spark):
    prose = "Eaea ndorea as erthndly edst threeain for heed thheha thatnd the thnt estion ntes a onenble lyndre thintion reed"
    docs = [(1, "before " + prose.upper() + " after"), (2, prose.title()), (3, "X " + ITEM.lower()), (4, "all of " + ITEM.upper())]
    assert pairs(spark, docs, [(1, prose), (2, ITEM)]) == {(1, 1), (2, 1), (3, 2), (4, 2)}


def test_items_of_few_literals_are_found_word_for_word(spark):
    items = ["What is 12 times 7?", "12 14 16 18 20 22 24 26 28 30 32 34", "Anna Berta Carla Dora Emma Frida Greta Hanna Ida Jana", "12 + 7 = 19", "COMPUTE THE SUM OF ALL ODD PRIMES BELOW TWENTY NOW"]
    docs = [(i, f"before it {x} after") for i, x in enumerate(items)] + [(9, "What is 13 times 8? 12 15 16 19 20 23")]
    assert pairs(spark, docs, list(enumerate(items))) == {(i, i) for i in range(len(items))}


def test_one_odd_slot_does_not_hide_a_copy(spark):
    item = "At noon Paris had 3 old bridges over its river, and by night Paris lit them all with lamps that burn oil, so people walk from far to see Paris glow."
    renamed = item.replace("Paris", "Rome")
    docs = [(1, item.replace("Paris had", "Pariss had")), (2, renamed.replace("see Rome", "see Romme")), (3, ITEM.replace("does Alice", "does Alicia"))]
    assert pairs(spark, docs, [(1, item), (2, ITEM)]) == {(1, 1), (2, 1), (3, 2)}


def test_copies_of_another_length_are_caught(spark):
    prose = "Eaea ndorea as erthndly edst threeain for heed thheha thatnd the thnt estion ntes a onenble lyndre thintion"
    price = "If Anna pays $5 to Otto for each old lamp then what is left of $90 when Otto sells her 7"
    docs = [
        (1, prose.replace("heed", "heed zzword")), (2, prose.upper().replace("HEED", "HEED ZZWORD")), (3, prose.replace("thheha ", "") + " end"),
        (4, ITEM.replace("Alice", "Mary Ann").replace("Bob", "Van Dyke")), (5, price.replace("$", "€").replace("Anna", "Eva").replace("Otto", "Jan Smit")),
    ]
    assert pairs(spark, docs, [(1, prose), (2, ITEM), (3, price)]) == {(1, 1), (2, 1), (3, 1), (4, 2), (5, 3)}


def test_leaks_of_given_tables_in_any_case(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    passages = {r.item_id: " ".join(r.text.casefold().split()) for r in items.collect()}
    loud = items.selectExpr("item_id + 1000000 AS doc_id", "upper(text) AS text").unionByName(items.selectExpr("item_id + 2000000 AS doc_id", "lower(text) AS text"))
    both = docs.select("doc_id", "text").unionByName(loud)
    texts = {r.doc_id: " ".join((r.text or "").casefold().split()) for r in both.collect()}
    want = {(d, i) for d, x in texts.items() for i, p in passages.items() if p in x}
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(both, items).collect()} == want


def test_near_copies_stage_links_similar_shingles(spark, sf_dir):
    r = random.Random(11)
    texts = {}
    for i in range(0, 80, 4):
        words = [f"w{r.randrange(500)}" for _ in range(r.choice([3, 30, 120, 300]))]
        for k in range(4):
            texts[i + k] = " ".join(words)
            for _ in range(r.choice([1, 2, 4])):
                words[r.randrange(len(words))] = f"new{r.randrange(3000)}"
    texts |= {90: None, 91: " ", 92: texts[3].upper()}

    def brute(x):
        w = (x or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, up = {i: brute(x) for i, x in texts.items()}, {i: i for i in texts}
    for _ in texts:
        for a in texts:
            for b in texts:
                if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                    up[a] = up[b] = min(up[a], up[b])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["simhash near-dedup"](spark, docs, sf_dir).collect()}
    assert kept == {i for i, c in up.items() if i == c} and 20 < len(kept) < len(texts)


def test_near_copies_stage_links_close_fingerprints(spark, sf_dir, monkeypatch):
    """Without MinHash, the SimHash step alone joins what is similar within its reach, and nothing else."""
    import numpy as np
    from marginalia.llm import copies, simhash

    r = random.Random(5)
    texts = {}
    for i in range(0, 60, 3):
        words = [f"w{r.randrange(500)}" for _ in range(r.choice([60, 200, 400]))]
        texts |= {i: " ".join(words), i + 1: " ".join([*words, "new"]), i + 2: " ".join(["old", *words[:-1]])}
    texts |= {90: "a b c d e", 91: "a b c d f", 92: None}
    sets = {i: copies.shingles(x, 5) for i, x in texts.items()}
    prints = {i: simhash.majority(s) if len(s) else 0 for i, s in sets.items()}
    monkeypatch.setattr(copies, "bands", lambda hashes: np.zeros(0, np.int64))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    found = {r.doc_id: r.component_id for r in copies.near_copies(docs, 5, 0.8).collect()}
    assert found.keys() == texts.keys()
    want = {i: min(j for j in texts if j == i or (i < 90 and j // 3 == i // 3)) for i in texts}
    near = {(i, j) for i in texts for j in texts if i != j and (prints[i] ^ prints[j]).bit_count() <= simhash.REACH}
    assert all(copies.similar(sets[i], sets[j], 0.8) for i, j in near) and any((prints[i] ^ prints[j]).bit_count() > simhash.RADIUS for i, j in near)
    for i, j in near:
        assert found[i] == found[j] == want[i]
    assert all(found[i] == i for i in texts if not any(i == a for a, _ in near))
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["simhash near-dedup"](spark, docs, sf_dir).collect()}
    assert kept == {i for i, c in found.items() if i == c} and len(kept) < len(texts) - 20


def test_fingerprints_of_unlike_sets_are_no_link(spark):
    from marginalia.llm import copies
    from marginalia.llm.work import Work

    texts = {1: (0, "abcdefghi"), 2: (0, "abcdefgh"), 3: (0, "xyz"), 4: (31, "abcdefghij"), 5: (63, "klmnopqrs")}  # given fingerprints
    rows = spark.createDataFrame([(i, " ".join(x)) for i, (_, x) in texts.items()], "doc_id long, text string").withColumn("mark", F.xxhash64("doc_id"))
    nodes = [(i, bytes(copies._key(copies.shingles(" ".join(x), 5))), fp) for i, (fp, x) in texts.items()]
    nodes = spark.createDataFrame(nodes, "node long, key binary, fp long")
    got = {(r.x, r.y) for r in copies.by_fingerprint(nodes, rows, 5, 0.8, Work(spark, "test")).collect()}
    assert got == {(1, 2), (1, 4)}


def near_groups(texts):
    """Smallest doc_id that links of similar five-word shingle sets reach, by comparing all pairs that share a shingle."""
    from collections import defaultdict

    def shingles(x):
        w = (x or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, up, having = {i: shingles(x) for i, x in texts.items()}, {i: i for i in texts}, defaultdict(list)

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, s in sets.items():
        for x in s or {None}:
            having[x].append(i)
    seen = set()
    for group in having.values():
        for a in group:
            for b in group:
                if a < b and (a, b) not in seen:
                    seen.add((a, b))
                    if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and root(a) != root(b):
                        up[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in texts}


def test_pipeline(spark, sf_dir):
    """Every stage on its own input, odd rows and columns of clashing names among it; what it drops is what direct computation says."""
    from .test_text_ops import brute_quality
    from .test_token_ops import crc, ids_of

    given = table(spark, sf_dir, "documents").limit(10**9)
    odd = [(10**6 + k, x) for k, x in enumerate([None, "", " \n ", "one two", "a b c d e\n" * 30])]
    more = spark.createDataFrame(odd, "doc_id long, text string")
    docs = given.unionByName(more, allowMissingColumns=True)
    for name in ("n_lines", "removed", "kept_text", "key", "tie", "__row2"):
        docs = docs.withColumn(name, F.lit(name))
    columns, stage = docs.columns, dict(corpus_pipeline.STAGES)
    before = {r.doc_id: r.text for r in docs.collect()}
    one = stage["quality rules"](spark, docs, sf_dir)
    after = {r.doc_id: r.text for r in one.collect()}
    failed = {i for i, x in before.items() if brute_quality(x)[-1]}
    judged = {r.doc_id: r.kept for r in quality.score(docs).collect()}
    assert one.columns == columns and after == {i: x for i, x in before.items() if judged[i]} and not failed & after.keys()
    two = stage["line dedup"](spark, docs, sf_dir)
    lost = brute_lines(before)
    shown = {r.doc_id: (r.text, r.n_lines, r.n_chars) for r in two.collect()}
    kept = {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in lost[i]) for i, t in before.items()}
    assert two.columns == columns and shown == {i: (t, "n_lines", None if t is None else len(t)) for i, t in kept.items()}
    three = stage["simhash near-dedup"](spark, docs, sf_dir)
    assert three.columns == columns and {r.doc_id for r in three.collect()} == {i for i, c in near_groups(before).items() if i == c}
    four = stage["benchmark decontamination"](spark, docs, sf_dir)
    passages = [" ".join(r.text.casefold().split()) for r in table(spark, sf_dir, "benchmark").collect()]
    whole = {i for i, x in before.items() if any(p in " ".join((x or "").casefold().split()) for p in passages)}
    assert four.columns == columns and {r.doc_id for r in four.collect()} == before.keys() - whole
    pieces: dict = {}
    for r in stage["packing"](spark, docs, sf_dir).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    assert pieces.keys() == before.keys()
    for i, mine in pieces.items():
        ids, at = ids_of(before[i], 1), 0
        for r in sorted(mine, key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == crc(ids[at : at + r.length])
            at += r.length
        assert at == len(ids)


def test_pipeline_stages_take_an_empty_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0, name


def test_pipeline_runs_whole(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir)
    assert rows.count() > 0 and rows.columns[-2:] == ["sequence_id", "offset"]
