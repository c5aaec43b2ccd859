import random

import pytest
from pyspark.sql import types as T

from rallyline.plans.registry import QUERIES  # noqa: F401  the rest imports without this package's help


@pytest.fixture(scope="session")
def words():
    rng = random.Random(5)
    return ["".join(rng.choice(["er", "on", "th", "an", "re", "ti", "st", "ng", "ea"]) for _ in range(rng.randint(1, 4))) for _ in range(3000)]


@pytest.fixture(scope="session")
def table_of(spark):
    """Documents from (doc_id, text) pairs, with columns whose names may clash with an operator's own."""

    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("key", T.StringType()),
        T.StructField("sha", T.StringType()), T.StructField("size", T.StringType()), T.StructField("row", T.StringType()),
        T.StructField("__sha", T.StringType()), T.StructField("__KEY", T.StringType()), T.StructField("maybe", T.StringType()), T.StructField("label", T.StringType()),
    ])

    def make(pairs, partitions=3):
        rows = [(i, t, None, "src0", None if t is None else len(t), "k", None, "s", "r", "h", None, "m", "l") for i, t in pairs]
        return spark.createDataFrame(rows, schema).repartition(partitions)

    return make


@pytest.fixture(scope="session")
def odd():
    """Null and empty texts, null and repeated ids, repeated rows, white space, a very long text and long words."""
    long = "lorem ipsum dolor sit amet " * 20_000
    return [
        (1, None), (2, ""), (3, "  \n\t "), (4, "one"), (4, "one"), (None, "one two three four five six seven"), (None, None),
        (5, "one two three four five six seven"), (6, "onetwothree four five  six seven"), (7, long), (8, "x" * 30_000),
        (9, "a\x00b   c　d <|endoftext|> \U0001f600́ ﬁ ▁ <s>"), (10, "ONE!! TWO!! THREE!!\nONE!! TWO!! THREE!!"),
    ]
