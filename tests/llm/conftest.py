import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def doc_rows():
    """(doc_id, text): nulls, empty and blank texts, repeated rows and ids, copies, near copies, a very long text."""
    rng = random.Random(5)
    words = [w for w in "alpha beta gamma delta épsilon Zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()]
    text = lambda n: " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(n))
    base = text(120)
    near = base.split()
    near[60] = "changed"
    passage = text(70)
    rows = [(1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, " \n\t "), (7, "one"), (8, "one"), (9, "two words"),
            (10, text(40) + "\n" + passage + "\n" + text(50)), (11, text(30) + "\n" + passage), (12, "a" * 700), (None, base),
            (13, text(4000)), (14, "x y z " * 60), (14, "x y z " * 60), (14, text(90)), (15, text(5) + "\n\n" + text(5)),
            (16, "the Last LINE\n" * 5), (None, None)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, doc_rows):
    """The rows with columns that clash with names the operators use."""
    rows = [(i, t, "en", None if k % 7 == 0 else f"src{k % 2}", len(t or ""), "keep", 1.5) for k, (i, t) in enumerate(doc_rows)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, "
                                       "kept string, score double").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")

