import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, norm string, row int, key int, size int, level int, bucket int, node long, tokens string, label int, term string"


def frame(spark, pairs, sources=None):
    """documents with further columns whose names the operators use inside; all of those are null."""
    rows = [(d, t, None, sources[i] if sources else None, None, *[None] * 11) for i, (d, t) in enumerate(pairs)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def words(seed, n, kinds=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))


BASE = words(1, 120)
LONG = words(2, 60_000, 5000)
#: Nulls, empty and blank texts, ties, repeated rows, near copies, a very long text and one very long word.
ODD = [
    (1, "a b c d e f g"), (2, None), (3, ""), (4, " \t\n "), (5, "a b c d e f g"), (6, "one line\nrepeated"), (6, "one line\nrepeated"), (None, "no id here at all"), (None, None), (None, "a b c d e f g"),
    (8, "A b C d e f g"), (9, "a  b c\td e f g"), (10, BASE), (11, BASE + " end"), (12, "start " + BASE), (13, BASE.replace("w1", "x1")), (14, LONG), (15, "y" * 70_000), (16, "é ß 漢字 ﬁn"), (17, "b c"), (18, "b c"), (19, "c b"),
]


@pytest.fixture(scope="session")
def odd(spark):
    return frame(spark, ODD, [None if i % 5 == 0 else f"s{i % 3}" for i in range(len(ODD))]).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, []).where("false")
