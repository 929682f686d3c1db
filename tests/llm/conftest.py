import random

import pytest

#: Columns of documents and others whose names the operators use inside.
EXTRA = "uid long, fp long, digit string, n int, copies int, line string, _w_id int, shard_id int, _bits int"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty and very long texts, ties, repeated rows, copies and near copies."""
    rng = random.Random(5)
    base = words(rng, 60)
    texts = [base, base, base.upper(), base + " x", None, "", " \t\n", "É" + base, words(rng, 30_000), "a", "a", "A"]
    texts += [words(rng, rng.randint(1, 80)) for _ in range(30)]
    rows = [(i, t, ["en", "fr", None][i % 3], ["src0", "src1", "src2", None, "x"][i % 5], 1) for i, t in enumerate(texts)]
    rows += [(3, base, "en", "src0", 1), (3, base, "en", "src0", 1), (None, base, None, None, None), (None, None, None, None, None), (None, "zz top", "fr", "src1", None)]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(odd_rows, SCHEMA)
    for c in EXTRA.split(", "):
        name, kind = c.split()
        docs = docs.withColumn(name, F.lit("7").cast(kind))
    return docs


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
