import random

import pytest

WORDS = "the of and to in is that it was for on are with as his they be at one have this from or had by hot but some what there".split()


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) + rnd.choice(["", "", "s", "ing", "."]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """doc_id, text: nulls, empty, short, long, equal and near-equal texts, ties and repeated rows."""
    rnd = random.Random(5)
    base = [prose(rnd, 120) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, base[i]) for i in range(4)]
    rows += [(110, base[5] + " tail"), (111, "head " + base[6]), (112, base[7][:300]), (113, base[8][100:400] + " x " + base[9][50:250])]
    rows += [(120, None), (121, ""), (122, " \n\t"), (123, "one two"), (124, "é" * 60), (125, "\x00\x00" + base[1][:80])]
    rows += [(130, "word " * 4000), (131, "a" * 30000), (None, base[2]), (None, "only here"), (5, base[5]), (5, "other text for five")]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd rows with the columns of documents and some whose names clash with those that operators add."""
    rows = [(i, t, "en", None if n % 5 == 0 else f"s{n % 3}", len(t or ""), "x", "y", 1, "z") for n, (i, t) in enumerate(odd_rows)]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, size string, _group string, score int, pii string"
    ).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
