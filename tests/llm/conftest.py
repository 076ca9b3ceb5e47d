import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside, on columns that mean something else.
CLASHES = {"component_id": 1, "kept": "x", "n": 2.5, "_text": None, "sig": 3, "bytes": 4, "block": 5, "_row": 6}


def words(rng, n, kinds=5000):
    return " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))


@pytest.fixture
def corpus():
    """Rows of a small corpus with near copies, exact copies, shared passages, repeated rows, nulls, and a very long text."""
    rng = random.Random(7)
    rows, passage = [], words(rng, 60)
    for i in range(40):
        text = "\n".join(words(rng, rng.randint(20, 60)) for _ in range(rng.randint(2, 6)))
        rows.append(text)
        if i % 4 == 0:
            rows.append(text)
        if i % 3 == 0:
            near = text.split(" ")
            near[len(near) // 2] = "changed"
            rows.append(" ".join(near))
        if i % 5 == 0:
            rows.append(words(rng, 200) + "\n" + passage)
    family = words(rng, 400).split(" ")
    for i in range(60):
        near = list(family)
        near[rng.randrange(len(near))] = f"own{i}"
        rows.append(" ".join(near))
    rows += ["", " \t\n ", "one", "one two three", "ONE two three", words(rng, 30_000), "É" * 100, "a" * 5000]
    out = [(k * 3 + 5, t, rng.choice(["en", "de", None]), rng.choice(["src0", "src0", "src7", None, "other"]), len(t)) for k, t in enumerate(rows)]
    out += [(None, "no id " + passage, "en", "src0", None), (2, None, None, None, None), (1, None, "en", "src1", 0), out[0], out[0]]
    rng.shuffle(out)
    return out


@pytest.fixture
def docs(spark, corpus):
    from pyspark.sql import functions as F

    return spark.createDataFrame(corpus, DOCS).withColumns({k: F.lit(v) for k, v in CLASHES.items()}).repartition(5)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture
def scratch(spark):
    from echolattice.llm.common import Scratch, ship

    ship(spark)
    return Scratch(spark, "test")
