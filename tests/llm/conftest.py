import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from conftest_llm import documents  # noqa: E402


@pytest.fixture(scope="session", autouse=True)
def checkpoint(spark, tmp_path_factory):
    """The shared folder of a local session."""
    spark.sparkContext.setCheckpointDir("file://" + str(tmp_path_factory.mktemp("shared")))


@pytest.fixture(scope="session")
def docs(spark):
    """Odd documents: nulls, empty, blank and long texts, repeated rows, ties, copies and shared passages."""
    import random

    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefghijklmnopqrstuvwxyzäé") for _ in range(r.randint(1, 9))) for _ in range(400)]
    words = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage, base = words(60), words(120)
    near = base.split()
    near[50] = "changed"
    rows = [
        (None, None, None, None), (1, None, "en", "a"), (2, "", "en", None), (3, " \t\n ", None, "a"), (4, "one two", "en", "a"), (5, "One TWO", "en", "b"),
        (6, base, "en", "a"), (7, base, "en", "a"), (8, " ".join(near), "en", "b"), (9, words(40) + " " + passage + " " + words(30), "en", "b"), (10, passage + "\n" + words(20), "de", "b"),
        (11, passage, "de", "c"), (12, "na na " * 200, "de", "c"), (13, words(3000) + passage, "de", "c"), (14, words(30), "en", "a"), (14, words(30), "en", "a"), (15, base, "en", "c"), (None, base, "en", "c"),
        (16, "x" * 5000, "en", "a"), (17, "é" * 80 + " ende", "fr", "a"), (18, "é" * 80 + " fin", "fr", "a"), *[(100 + i, words(r.randint(20, 90)), "en", "a") for i in range(30)],
    ]
    rows += [rows[14]]  # an exact repetition of a row
    return documents(spark, rows), [(x[0], x[1]) for x in rows]
