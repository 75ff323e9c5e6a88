import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and long texts, repeated rows, a clashing column; about 120 documents."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(30, 90))) for _ in range(20)]
    rows = []
    for i in range(100):
        t = base[i % 20].split(" ")
        if i >= 40:
            t[rng.randrange(len(t))] = "neu" + str(i)
        if i % 7 == 0:
            t.insert(3, "X\nY.\tZ ")
        rows.append((i, " ".join(t), rng.choice(["en", "fr", None]), None if i % 5 else "src0", len(t)))
    rows += [(100, None, None, None, None), (101, "", "en", "s", 0), (102, " \n\t ", "fr", "s", 4), (103, "one two", "en", "s", 7), (104, "One TWO", "en", "s", 7)]
    rows += [(105, " ".join(words * 60), "de", "s", 9), (106, "word " * 3000, "de", "s", 9), (107, "日本語 テキスト です。 " * 8, None, "s", 9), (None, base[0], "en", None, 1), (3, rows[3][1], "en", "s", 2)]
    return spark.createDataFrame([(*r, "mine", "theirs") for r in rows], SCHEMA + ", score string, cls string")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
