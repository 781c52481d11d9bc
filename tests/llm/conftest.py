"""Small documents with copies, near copies, long, empty and missing texts."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words int, key string, node int"


def invented(seed: int, count: int, vocabulary: int = 400) -> list[str]:
    rng = random.Random(seed)
    return [f"w{int(rng.random() ** 2 * vocabulary)}é" if rng.random() < 0.1 else f"W{int(rng.random() ** 2 * vocabulary)}"
            for _ in range(count)]


def lines(words: list[str], per_line: int = 12) -> str:
    return "\n".join(" ".join(words[i:i + per_line]) for i in range(0, len(words), per_line))


@pytest.fixture(scope="session")
def texts() -> list[tuple[int, str | None]]:
    rng = random.Random(5)
    found: list[tuple[int, str | None]] = [(i, lines(invented(i, rng.randint(1, 150)))) for i in range(60)]
    base = invented(900, 120)
    for i in range(60, 90):  # a family of near copies, some under the threshold
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10 ** 6)}"
        found.append((i, lines(w)))
    found += [(i, found[3][1]) for i in range(90, 96)]
    found += [(96, None), (97, ""), (98, " \n\t "), (99, "one two"), (100, "ONE two"), (101, lines(invented(7, 6000)))]
    found += [(102, "\n".join(["same line of several words here"] * 5 + ["a b c d e f g h a b c d e f g h"]))]
    return found


@pytest.fixture(scope="session")
def documents(spark, texts):
    """Extra columns have names that operators use inside."""
    return spark.createDataFrame([(i, t, "en", ["b", "a", None, "c", "é"][i % 5], len(t or ""), -1, "k", -2) for i, t in texts],
                                 SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd_rows(spark):
    """Null ids, null everything, repeated rows and repeated ids of different texts."""
    text = lines(invented(3, 40))
    return spark.createDataFrame([(None, text, None, None, None, None, None, None), (None,) * 8,
                                  (1, text, "en", "a", 1, 1, "k", 1), (1, text, "en", "a", 1, 1, "k", 1),
                                  (1, lines(invented(4, 40)), "en", "a", 1, 1, "k", 1), (2, None, "en", None, 0, 0, "k", 0)], SCHEMA)
