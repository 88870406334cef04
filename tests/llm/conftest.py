import random

import pytest

LONG = "x" * 200_000
STEMS = ["the", "of", "and", "run", "ner", "tal", "Mo", "ß", "ción", "q1", "-", "."]


def prose(seed: int, words: int) -> str:
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice(STEMS) for _ in range(rnd.randint(1, 4))) for _ in range(words))


COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, node bigint, spans string, _row int, _hash string, size int, label int"


def as_rows(pairs):
    """Documents with extra columns named like those that operators make for themselves."""
    return [(i, t, "en", None if i is None or i % 5 == 0 else f"s{i % 3}", None, 7, "s", 1, "h", 2, 3) for i, t in pairs]


@pytest.fixture(scope="session")
def odd_pairs():
    base = prose(1, 300)
    near = base.split()
    near[150] = "changed"
    return [
        (None, "a row without an id"), (1, None), (1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, prose(2, 20_000)),
        (6, base), (6, base), (7, base), (8, " ".join(near)), (9, prose(3, 400) + " " + base), (10, "one"), (11, "One"), (12, "two words"),
        (13, "a b c " * 500), (14, "line\n" * 300), (15, prose(4, 50)), (15, prose(5, 50)), (16, "   x\x1cy\x0bz  ▁ 語語🎉"),
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_pairs):
    return spark.createDataFrame(as_rows(odd_pairs), COLUMNS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)
