from __future__ import annotations

import random

import pytest

FIELDS = "doc_id long, text string, lang string, source string, n_chars long, rep long, tile string, component long, size int"


@pytest.fixture(scope="session")
def edges(spark):
    """Documents with every awkward case: nulls, blanks, ties, copies, very long texts, columns named like our own."""
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "the", "of", "and", "É", "x.y", "42"]
    prose = lambda n: " ".join(rng.choice(words) + (str(rng.randint(0, 99)) if rng.random() < 0.5 else "") for _ in range(n))
    base, passage = prose(120), prose(40)
    rows = [(None, base), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (6, "One TWO three"), (7, base), (7, base), (8, base.replace(" ", "\n ")),
            (9, base + " tail"), (10, prose(30) + " " + passage), (11, passage + " " + prose(30)), (12, "é" * 5000), (13, prose(20_000)), (14, "日本語 текст"),
            (15, "mail a@b.co or +1 (555) 123-4567, 4111 1111 1111 1111, 10.0.0.1"), (16, "1234 !!"), (2**62, prose(13)), (-5, prose(13))]
    rows += [(100 + k, " ".join(w if rng.random() > 0.01 else "edit" for w in base.split(" "))) for k in range(30)]
    rows += [(200 + k, prose(rng.randint(1, 60))) for k in range(30)]
    data = [(i, t, rng.choice([None, "en", "de"]), rng.choice([None, "", "a", "b"]), None if t is None else len(t), 1, "t", 2, 3) for i, t in rows]
    return spark.createDataFrame(data, FIELDS).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], FIELDS)
