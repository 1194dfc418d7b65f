import random

import pytest

WORDS = "the of and river stone lamp seven cold Paris walks under a bright été niño straße 42 | ### don't".split()


def made_documents(seed: int = 7, n: int = 60) -> list[tuple]:
    """Null, empty, blank, tiny, very long and repetitive texts, exact and near copies, repeated rows."""
    r = random.Random(seed)
    text = lambda k: " ".join(r.choice(WORDS) for _ in range(k)) + r.choice(["", "\n", ".\nThe end"])
    rows = [None, "", "   \n\t", "a", "a b", "a b c", "x" * 49, "x" * 50, "x" * 51, "x" * 400, "ab" * 120, "日本 語 text", "<|endoftext|> is text", "\u00a0\u2003odd\u0085blanks"]
    rows += [text(r.randint(1, 120)) for _ in range(n)]
    rows += [rows[20], rows[20], rows[20] + " more", rows[25].replace("the", "THE"), "line one is here\nline two\nline one is here\n" * 9, text(6000)]
    out = [(i, x) for i, x in enumerate(rows)]
    r.shuffle(out)
    return out


@pytest.fixture(scope="session")
def documents(spark):
    """With columns whose names clash with those the operators make inside."""
    rows = [(i, x, f"s{i % 3}", i, "b", 1, 2) for i, x in made_documents()]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, bucket int, key string, shard int, n long").repartition(5)


@pytest.fixture(scope="session")
def texts():
    return dict(made_documents())


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string")
