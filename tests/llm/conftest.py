import random

import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# names that operators use inside: an input may have them as well
CLASHES = ("key", "size", "n", "score", "bin", "offset", "part", "digest", "sig", "cls", "line", "words", "slot",
           "shard", "first", "_n", "kind", "place", "look", "ids", "piece")


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n)]
    return " ".join(w + ("." if i % 9 == 8 else "") for i, w in enumerate(words))


def with_clashes(df):
    from pyspark.sql import functions as F

    for c in CLASHES:
        df = df.withColumn(c, F.lit("x"))
    return df


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties and repeated rows."""
    long = prose(1, 30_000)
    same = prose(2, 120)
    texts = [(1, same), (2, None), (3, ""), (None, prose(3, 60)), (4, long), (5, same), (5, same), (6, "one"), (7, " \n "),
             (8, same + " tail words here"), (None, None), (9, "a b c"), (9, prose(4, 40)), (10, prose(5, 200))]
    return [(i, t, None if i == 3 else "en", "src0", None if t is None else len(t)) for i, t in texts]


@pytest.fixture(scope="session")
def odd_documents(spark, odd_rows):
    return with_clashes(spark.createDataFrame(odd_rows, DOC_SCHEMA))


@pytest.fixture(scope="session")
def no_documents(spark):
    return with_clashes(spark.createDataFrame([], DOC_SCHEMA))
