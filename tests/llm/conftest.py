import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank long, region string, group string, n_words int, size int, _salt int, pos int, mix_copy string, distance double, piece string"


def row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, None if text is None else len(text), 7, "r", "g", 1, 2, 3, 4, "m", 0.5, "p")


@pytest.fixture(scope="session")
def awkward(spark):
    """Null and empty texts, a very long one, repeated rows, ties, null keys, a row without an id, clashing names."""
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7)))
    line = lambda: " ".join(word() for _ in range(rnd.randint(6, 40)))
    base = ["\n".join(line() for _ in range(rnd.randint(1, 8))) for _ in range(24)]
    long = "\n".join(line() for _ in range(3000))
    rows = [row(i, t, lang=rnd.choice(["en", "de"]), source=rnd.choice(["a", "b"])) for i, t in enumerate(base)]
    rows += [row(100 + i, t + " tail") for i, t in enumerate(base[:6])]  # near copies
    rows += [row(200 + i, base[0]) for i in range(9)]  # exact copies
    rows += [row(300, None), row(301, ""), row(302, " \n\t "), row(303, long), row(304, long + "\n" + line())]
    rows += [row(305, "ÀÉ Straße ﬁ x"), row(306, "one"), row(307, "one"), row(308, "a\U0001f600b ***"), row(309, base[1], None, None), row(310, None, None, None)]
    rows += [row(2, base[2])] * 2  # rows twice more
    rows += [row(None, base[3]), row(None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(awkward):
    return awkward.filter("false")


@pytest.fixture(scope="session")
def unique(awkward):
    """The rows that have an id of their own."""
    return awkward.filter("doc_id is not null").dropDuplicates(["doc_id"])
