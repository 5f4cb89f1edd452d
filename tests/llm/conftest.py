import sys
from pathlib import Path

import pytest
from pyspark.sql import types as T

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

WORDS = ("the of and river stone light paper over under house garden winter summer road bridge cloud field horse "
         "music letter window silver market engine captain island forest morning evening shadow").split()


def prose(seed, n):
    import random
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


BASE = prose(1, 120)
LONG = prose(2, 60_000)
#: Nulls, empty and odd texts, copies, near copies, repeats inside a text, and one very long text.
TEXTS = [
    (1, BASE), (2, BASE), (3, BASE + " one more word"), (4, None), (5, ""), (6, " \n\t "), (7, "word"),
    (8, "a b c d"), (9, "a b c d"), (10, prose(3, 30) + "\n" + prose(1, 120) + "\n" + prose(4, 30)),
    (11, "x y z " * 60), (12, LONG), (13, "café naïve 日本語 \U0001f600 it's we've <|endoftext|> <s>  two"),
    (14, prose(5, 200)), (15, "\n".join([prose(6, 12)] * 6)), (None, prose(7, 80)), (16, prose(5, 200)),
    (17, "  leading and  double  spaces \n"), (18, "### *** $$$ " * 40), (19, BASE), (19, BASE),
    (20, "tab\tand\x0bvertical\x0cform\rreturn   nbsp em ▁ mark"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every awkward case, and extra columns whose names operators also use."""
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()), T.StructField("n_words", T.StringType()),
        T.StructField("key", T.StringType()), T.StructField("score", T.StringType()),
        T.StructField("uid", T.StringType()), T.StructField("failed", T.StringType())])
    rows = [(i, t, None, "s", len(t) if t else None, "w", "k", None, "u", "f") for i, t in TEXTS]
    return spark.createDataFrame(rows, schema).repartition(3).cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
