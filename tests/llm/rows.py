"""Fixtures that the tests here import."""

import pytest
from pyspark.sql import functions as F

COLUMNS = ("doc_id long, text string, lang string, source string, n_chars long, score double, token string, id long, key long, "
           "component long, batch int, slot int, votes string, a long, b long, tag int, h string, row string")


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and extra columns with names that operators use."""
    long = " ".join(f"Word{i % 977} the" for i in range(30_000))
    texts = [(1, "The cat sat on the mat and the dog lay by the door."), (2, "The cat sat on the mat and the dog lay by the door."),
             (2, "The cat sat on the mat and the dog lay by the door."), (3, None), (None, None), (None, "No id here."), (4, ""), (5, "   \n\t "), (6, "x"),
             (7, long), (8, long + " end"), (9, "naïve ▁ café \u0000 日本語 🤗\r\n"), (10, "x"), (11, "a" * 5000), (12, "Licensed under the Apache License, Version 2.0."),
             (13, "Mail a.b@c.de or +1 (386) 555-3733, Mr. John Doe.")]
    extra = (None, None, None, 1.5, "t", 3, 4, 5, 6, 7, "v", 8, 9, 1, "h", "r")
    return spark.createDataFrame([(*t, *extra) for t in texts], COLUMNS).withColumn("n_chars", F.length("text").cast("long"))


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
