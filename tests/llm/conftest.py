import pytest
from pyspark.sql import functions as F

# Names that the operators or their digests use themselves.
CLASHING = tuple("kept spans size n_words row pattern hash component _row _n _quality copies".split())

ODD = [
    (1, None, "en", "a"),
    (2, "", "en", "a"),
    (3, " \t\n", None, "a"),
    (4, "one", "en", None),
    (5, "one two", "en", None),
    (6, "the same text twice over here", "en", "b"),
    (6, "the same text twice over here", "en", "b"),
    (7, "the same text twice over here", None, "c"),
    (8, "été \U0001f600 naïve word\x0bx\x0cy\rz", "fr", "c"),
    (9, "a" * 60_000, "en", "c"),
    (10, "lorem ipsum dolor sit amet " * 4_000, "la", "d"),
    (None, "no id at all", "en", "d"),
    (11, "<s> [INST] <|endoftext|> </s> \\ \\n", "en", "d"),
]


@pytest.fixture(scope="module")
def odd_rows():
    return list(ODD)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, very long and repeated texts, and extra columns with clashing names."""
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string")
    docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    return docs.select("*", *[F.lit(None).cast("string").alias(c) for c in CLASHING])


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(6, 1, 0), (7, 1, 0), (8, None, None), (None, 1, 0), (10, 0, 0), (10, 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
