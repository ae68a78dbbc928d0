import random

import pytest

CLASHING = "id mark text2 size shard slot hash tie fp digest n_chars score row n length piece kept grp at".split()


@pytest.fixture(scope="session")
def documents(spark):
    """A table of (doc_id, text) rows with extra columns whose names operators also use."""

    def make(rows):
        columns = ", ".join(f"{c} string" for c in CLASHING)
        extra = ["x", *[None] * (len(CLASHING) - 1)]
        return spark.createDataFrame([(i, t, *extra) for i, t in rows], f"doc_id long, text string, {columns}")

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, ties, repeated rows, a null id and one very long text."""
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "eps", "Zeta", "eta,", "theta.", "ß", "ñandú"]
    say = lambda n: " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(n))
    passage, long = say(70), say(12_000)
    return [
        (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, say(30) + " " + passage), (6, passage + "\n" + say(25)),
        (7, "same text here"), (8, "same  text\nhere"), (9, "sametext here"), (9, "sametext here"), (None, "no id at all"),
        (10, long), (11, long + " more"), (12, passage + " " + passage), (13, "x" * 40_000), (14, "!!!! $$$ 123 456"),
        (15, " wide spaces  é é ǅ İ"), (2**53 + 1, say(40)), (-7, say(40)),
    ]
