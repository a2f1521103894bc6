from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, fp string, flags int, row string, key int, rank int, score string"


@pytest.fixture(scope="session")
def words():
    rng = random.Random(5)
    return ["".join(rng.choice(("ka", "lo", "mi", "ther", "ing", "é", "st")) for _ in range(rng.randint(1, 4))) for _ in range(400)]


@pytest.fixture(scope="session")
def corpus(words):
    """Rows with copies, near copies, shared passages, nulls, empty and very long texts, repeated ids."""
    rng = random.Random(9)
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, base = text(70), text(120)
    rows = [(i, text(rng.randint(1, 150))) for i in range(40)]
    for i in range(40, 60):
        near = base.split()
        for _ in range(rng.randint(0, 2)):
            near[rng.randrange(len(near))] = rng.choice(words)
        rows.append((i, " ".join(near)))
    rows += [(i, f"{text(20)}\n{passage}\t {text(15)}") for i in range(60, 75)]
    rows += [(75, None), (76, ""), (77, " \t\n"), (78, rows[3][1]), (79, rows[3][1]), (80, text(9000)), (81, text(3)), (81, text(3)), (82, rows[5][1]), (82, rows[5][1]), (None, rows[3][1]), (None, None)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """With columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "xx", "f", 1, "r", 2, 3, "s") for i, t in corpus], DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
