"""Quality rules, SimHash, chat formatting and WARC against direct computation."""

import base64
import gzip
import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from marginalia.llm import chat, quality, simhash, warc
from marginalia.llm.work import Work

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_quality(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    covered = {j for i, w in enumerate(windows) if w in twice for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_quality(documents, texts):
    for r in quality.score(documents).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(texts[r.doc_id]), texts[r.doc_id]
        assert not (r.base_failed and r.kept)


def test_quality_has_no_shuffle_or_python(documents, nothing):
    plan = quality.score(documents.select("doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "hashpartitioning" not in plan
    assert quality.score(nothing).count() == 0


def brute_fingerprint(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = WORD.findall(words)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    ids, up = sorted(prints), {i: i for i in prints}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash(documents, texts):
    prints = {i: brute_fingerprint(x) for i, x in texts.items()}
    groups = brute_components(prints)
    rows = simhash.near_duplicates(documents).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (f"{prints[i]:016x}", groups[i]) for i in texts}


def test_simhash_links_chains(spark, nothing):
    assert simhash.near_duplicates(nothing).count() == 0
    rng = np.random.default_rng(5)
    prints, at = {}, 1000
    for _ in range(12):  # walks of up to 4 bits a step, so ends are far apart
        fp = int(rng.integers(0, 2**63))
        for _ in range(40):
            prints[at] = fp
            at -= 1
            for b in rng.choice(64, rng.integers(0, 6), replace=False):
                fp ^= 1 << int(b)
    df = spark.createDataFrame([(i, fp - (fp >> 63 << 64)) for i, fp in prints.items()], "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in simhash.grouped(df, Work(spark, "t")).collect()}
    assert got == brute_components(prints)


@given(st.lists(st.integers(0, 2**64 - 1), min_size=2, max_size=2))
@settings(max_examples=50, deadline=None)
def test_manhattan_is_a_lower_bound(pair):
    a, b = np.array(pair, np.uint64)
    assert simhash.manhattan(simhash.unary(a), simhash.unary(b)) <= (int(a) ^ int(b)).bit_count()


SIGNS = st.text(st.sampled_from("<s>/[]INST\\\n\t a"), max_size=14)


@given(st.lists(st.tuples(SIGNS, SIGNS | st.sampled_from(["</s>[INST] ok [/INST]", "<s>", "\\</s>"])), max_size=5))
@settings(max_examples=150, deadline=None)
def test_chat_round_trip(turns):
    template = chat.BracketTemplate()
    turns = [*turns, ("assistant", "x"), ("assistant", "")]
    text, spans, rewrites = chat.render_spans(template, turns)
    assert not rewrites and chat.read_turns(text) == turns
    loss = chat.loss_spans(template, turns, spans, text)
    assert [chat.unescape(text[a:b]) for a, b in loss] == [t for r, t in turns if r == "assistant"]
    for _, t in turns:
        assert not any(c in chat.escape(t) for c in chat.CONTROL)


def test_chat_detects_rewritten_history():
    last_only = lambda turns: "".join(t if i == len(turns) - 1 else t[:1] for i, (_, t) in enumerate(turns))
    assert chat.render_spans(last_only, [("user", "abc"), ("assistant", "def")])[2]


def test_chat_flags_texts_that_the_output_lacks():
    strips = lambda turns: "".join(f"<{r}>{t.strip()}" for r, t in turns)
    for turns, want in (([("user", "q"), ("assistant", " a ")], None), ([("user", "q"), ("assistant", "a")], None), ([("user", "q"), ("assistant", "zz")], [(18, 20)])):
        text, spans, rewrites = chat.render_spans(strips, turns)
        assert not rewrites and chat.loss_spans(strips, turns, spans, text) == want


def test_warc_members_cost_their_own_size():
    import time

    one = gzip.compress(record(1, "body"))
    took = []
    for n in (1000, 8000):
        began = time.process_time()
        assert sum(f[0] == "record" for f in warc.salvage(one * n)) == n
        took.append(time.process_time() - began)
    assert took[1] < 20 * took[0]


def test_chat_table(spark):
    rows = [(1, 2, "assistant", "b", 0), (1, 1, "user", None, 0), (2, 1, None, "q", 0), (2, 1, None, "q", 0), (3, None, "assistant", "</s>", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns int")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (got[1].n_turns, got[1].turns_sha256, got[1].loss_chars, got[1].loss_sha256) == (2, sha("user\n\nassistant\nb\n"), 1, sha("b"))
    assert (got[2].n_turns, got[2].turns_sha256, got[2].loss_sha256) == (2, sha("\nq\n\nq\n"), sha(""))
    assert (got[3].loss_chars, got[3].loss_sha256) == (4, sha("</s>"))
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_warc_round_trip(spark):
    html = [None, "", "<p>a</p>", "x" * 70_000, "<p>a</p>", "\r\n\r\nWARC/1.1\r\nfoo", "é" * 9, "<p>a</p>", None]
    rows = [(i, f"http://x/{i}\r\nevil: 1" if i == 2 else None, h, 1) for i, h in enumerate(html)] + [(2, "again", "<p>a</p>", 1)]
    path = Work(spark, "t").path("w")
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string, hash int"), path, file_bytes=50_000)
    first = {}
    for i, h in enumerate(html):
        first.setdefault(h or "", i)
    want = Counter()
    for i, _, h, _ in rows:
        same = first[h or ""] == i
        want[(i, len((h or "").encode()), digest(h), "response" if same else "revisit", None if same else first[h or ""])] += 1
    assert Counter(map(tuple, warc.read_pages(spark, path).collect())) == want


def test_warc_nothing(spark):
    path = Work(spark, "t").path("w")
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_pages(spark, path).count() == 0


def record(i, body):
    return f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nWARC-Payload-Digest: sha1:{digest(body)}\r\nContent-Length: {len(body)}\r\n\r\n{body}\r\n\r\n".encode()


@pytest.mark.parametrize("pack", [lambda x: x, gzip.compress])
def test_warc_salvage(pack):
    parts = [pack(record(i, f"body {i} " * 20)) for i in range(6)]
    broken = bytearray(parts[2])
    broken[len(broken) // 2] ^= 0xFF
    data = b"junk" + parts[0] + parts[1] + bytes(broken) + parts[3] + parts[4][:-9] + parts[5]
    found = list(warc.salvage(data))
    assert [f[3]["warc-record-id"] for f in found if f[0] == "record"] == [f"<urn:page:{i}>" for i in (0, 1, 3, 5)]
    gaps = [(f[1], f[2]) for f in found if f[0] == "gap"]
    a = 4 + len(parts[0]) + len(parts[1])
    b = a + len(broken) + len(parts[3])
    assert gaps == [(0, 4), (a, a + len(broken)), (b, b + len(parts[4]) - 9)]
    assert sum(f[2] - f[1] for f in found) == len(data)


def test_warc_keeps_long_urls_and_pages_without_id(spark, tmp_path):
    rows = [(1, "data:," + "x" * 200_000, "<p>one"), (None, "http://a/", "<p>two"), (None, None, "<p>one"), (2, "http://b/", "<p>one")]
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), f"{tmp_path}/out")
    assert warc.read(spark, f"{tmp_path}/out").where("kind = 'gap'").count() == 0
    got = [(r.page_id, r.record_type, r.payload_bytes, r.refers_to) for r in warc.read_pages(spark, f"{tmp_path}/out").collect()]
    assert sorted(got, key=str) == sorted([(1, "response", 6, None), (None, "response", 6, None), (None, "response", 6, None), (2, "revisit", 6, 1)], key=str)
