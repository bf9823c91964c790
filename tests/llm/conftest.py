from __future__ import annotations

import random

import pytest

WORDS = [a + b for a in ("ra", "lo", "mi", "tu", "ke", "so", "vi", "po") for b in ("n", "s", "t", "la", "ri", "me", "dor", "x")]


def prose(draw: random.Random, n: int) -> str:
    out = [draw.choice(WORDS) for _ in range(n)]
    for k in range(12, n, 13):
        out[k] = "\n" + out[k]
    return " ".join(out)


def awkward_rows() -> list[tuple]:
    """Texts with nulls, repeats, copies, near copies, shared passages, odd spaces, other scripts and very long ones."""
    draw = random.Random(11)
    base = [prose(draw, n) for n in (5, 60, 80, 120, 200, 400)]
    near = []
    for k in range(6):
        w = base[3].split(" ")
        w[7 + 9 * k] = "zz"
        near.append(" ".join(w))
    passage = prose(draw, 55)
    texts = [
        None, "", " \n\t ", "one", "one two", "ONE two", "a b c d", *base, *base[:4], *near, prose(draw, 30) + " " + passage + " " + prose(draw, 30), prose(draw, 20) + " " + passage, base[4] + " x", "To " * 80,
        "été 中文 한국 'll don't  two  spaces nbsp \U0001f600 tab\there", prose(draw, 6000), "password = \"abcdefghijkl\" AKIA" + "B2" * 8 + " " + "0f" * 12 + " user=bob Xy9" + "aB3" * 9,
        base[2].upper(), passage,
    ]
    rows = [(k, t, "en", None if k % 7 == 3 else f"s{k % 3}", None if t is None else len(t)) for k, t in enumerate(texts)]
    rows += [rows[8], rows[8], (None, base[1], None, None, None), (3, base[5], "fr", "s1", 1)]
    return [(*r, "k", 1, "h", 2, "w") for r in rows]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, size int, text_hash string, row int, _spans string"


@pytest.fixture(scope="session")
def rows():
    return awkward_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
