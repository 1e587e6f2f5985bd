import random

import pytest
from pyspark.sql import types as T

WORDS = "the of and to a in is on that by this with from or as at it an be are tion ment lorem ipsum dolor".split()


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with every odd case: nulls in each column, empty, blank, short and very long texts, ties and repeated rows, null and
    repeated ids, extra columns with names that operators use."""
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))
    base = text(120)
    long = text(30_000)
    rows = [
        (1, base, "en", "a", 10, 1.0, "x"),
        (2, base, "en", "a", 10, 1.0, "x"),
        (3, base.replace("the", "teh", 1), None, None, None, None, None),
        (4, None, "en", "b", 0, None, None),
        (5, "", "en", "b", 0, 0.0, ""),
        (6, " \t\n\x0b\f\r ", "en", "b", 0, 0.0, ""),
        (7, "One two", "en", None, 2, 0.0, ""),
        (8, "one TWO", "en", None, 2, 0.0, ""),
        (9, long, "en", "c", 1, 2.0, "y"),
        (10, base + " " + text(60), "en", "c", 1, 2.0, "y"),
        (11, "Éa été ß  <|endoftext|> <|im_end|> 中文 \U0001f600 Licensed under CC BY-NC.", "fr", "c", 1, 2.0, "y"),
        (7, "One two", "en", None, 2, 0.0, ""),
        (12, "same id other text " + text(30), "en", "c", 1, 2.0, "y"),
        (12, text(40), "en", "c", 1, 2.0, "y"),
        (None, base, "en", "c", 1, 2.0, "y"),
        (None, None, None, None, None, None, None),
    ]
    schema = T.StructType(
        [
            T.StructField("doc_id", T.LongType()),
            T.StructField("text", T.StringType()),
            T.StructField("lang", T.StringType()),
            T.StructField("source", T.StringType()),
            T.StructField("n_chars", T.LongType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("doc", T.StringType()),
        ]
    )
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
