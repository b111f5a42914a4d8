"""Small tables with every awkward case."""

import pytest
from pyspark.sql import types as T

WORDS = "the quick brown fox jumps over lazy dogs while seven wise owls watch from an old oak tree near our quiet village pond at dawn".split()


def prose(seed, n):
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(300)) for _ in range(n))


#: Names that operators use inside, as extra columns with other types.
EXTRA = ["row_key", "kinds", "path", "host", "template", "component_id", "lang"]


def rows():
    base = prose(1, 120)
    texts = [
        None, "", "   \n\t ", "one", "a b c", base, base, base + " extra", base.replace("fox", "cat", 1), prose(2, 6000), prose(3, 60) + "\n" + prose(3, 60),
        "\n".join(["the same line again and again for good measure"] * 6), "é日😀 é日😀 é日😀 " * 20, "x" * 5000, prose(4, 40).upper(),
        f"token = \"{'ab12' * 8}\" and AKIA{'Z' * 16} password: 'short' secret==={'q' * 14}", "AKIA" + "B" * 20 + "😀 api_key:" + "c" * 12 + " 0123456789abcdef0",
        prose(5, 30) + "\nLicensed under the Apache License, Version 2.0.\n" + prose(6, 30), prose(7, 9), "\x0b\x0c\r\n", "#*$%&|<>" * 4 + " " + prose(8, 25),
    ]
    found = [(i, t) for i, t in enumerate(texts)]
    return found + [(None, "a row without an id " + base), (None, None), (5, base), (3, "one"), (70, prose(9, 200)), (71, prose(9, 200).replace("owls", "bats"))]


@pytest.fixture(scope="session")
def texts():
    return rows()


def frame(spark, data):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType())] + [T.StructField(c, T.DoubleType()) for c in EXTRA])
    return spark.createDataFrame([(i, t, None if i is None else f"src{(i or 0) % 3}", *[1.5] * len(EXTRA)) for i, t in data], schema)


@pytest.fixture(scope="session")
def docs(spark, texts):
    return frame(spark, texts).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])
