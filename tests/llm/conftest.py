import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that operators use inside
        T.StructField("h", T.LongType()),
        T.StructField("tk", T.StringType()),
        T.StructField("kept", T.StringType()),
        T.StructField("_h", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("id", T.StringType()),
    ]
)


def words(seed: int, n: int, pool: str = "abcdefgh") -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choice(pool) for _ in range(draw.randint(2, 6))) for _ in range(n))


#: Copies, copies but for white space, ties, repeated rows, nulls in any column, empty, letterless and long texts.
TEXTS = [
    (1, words(1, 200)), (2, words(1, 200)), (3, " ".join(words(1, 200).split()) + "\n\t "), (4, words(2, 120)), (5, words(2, 120)),
    (6, None), (7, ""), (8, " \n\t"), (9, "123 456 !!"), (10, words(3, 400) + words(4, 120)), (11, words(5, 50) + words(4, 120)),
    (12, "é" * 900), (12, "é" * 900), (None, words(6, 90)), (None, words(6, 90)), (None, None), (13, words(7, 30_000)),
    (14, "ÀÉÎ ünïcode text \U0001f642 " * 40), (15, "The " + words(8, 30)), (16, "x"), (17, words(9, 60) + " me@mail.example.com, +1 (555) 010-9999, 4111 1111 1111 1111, 10.0.0.255"),
]


@pytest.fixture(scope="session")
def rows():
    langs = ["en", "de", None]
    return [(i, t, langs[k % 3], None if k % 4 == 0 else f"s{k % 2}", None if t is None else len(t), 0, "x", "y", None, "/p", "q") for k, (i, t) in enumerate(TEXTS)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
