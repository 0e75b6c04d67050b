from __future__ import annotations

import random

import pytest

SCHEMA = "text string, key long, component string, doc_id long, anchor int, lang string, source string, n_chars long, `hits` int, label int"


def rows() -> list[tuple]:
    """Texts with copies, near copies, shared passages, and every awkward case."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(300)]

    def words(n: int) -> list[str]:
        return [rng.choice(vocabulary) for _ in range(n)]

    passage, line = words(60), words(12)
    texts: list[str | None] = []
    for _ in range(30):
        texts.append(" ".join(words(rng.randint(1, 120))))
    for _ in range(12):  # a shared passage in different surroundings
        texts.append(" ".join(words(rng.randint(0, 30)) + passage + words(rng.randint(0, 30))))
    texts += [texts[3]] * 6 + [texts[4].upper(), texts[4] + "\n"]
    base = words(200)
    for k in range(14):  # near copies
        near = list(base)
        for _ in range(k % 5):
            near[rng.randrange(200)] = rng.choice(vocabulary)
        texts.append("  ".join(near))
    texts += [" ".join(line * 12), " ".join(line * 3), "same " * 90, "same " * 36]
    texts += [None, "", " \n\t ", "one", "two words", "!!! 123 ...", "é É ñ 漢字  x", "\x1c\x0b\x00a"]
    texts.append(" ".join(words(6000)))
    return [(t, k % 3, "c", k, None, ("en", "fr", None)[k % 3], "s", None if t is None else len(t), 1, k % 2) for k, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with clashing extra columns, over several partitions."""
    return spark.createDataFrame(rows(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def texts():
    return {r[3]: r[0] for r in rows()}


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Rows without an id and rows that repeat one."""
    body = " ".join(f"w{k}" for k in range(80))
    return spark.createDataFrame([(None, body), (1, body), (1, body), (2, None), (None, None), (3, "other text"), (3, "another")], "doc_id long, text string")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
