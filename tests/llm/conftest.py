"""Fixtures of the operators' tests."""

import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty, repeated, tied and very long texts, with columns whose names operators use themselves."""
    line = "The very same line of text stands here"
    texts = [(1, None), (2, ""), (3, "x"), (3, "x"), (None, line), (4, f"{line}\n{line}\n short \nanother line, only once"), (5, f"  {line.upper()}\t\nown words of five\n"), (6, "word " * 30_000), (7, line), (8, " \n\t"), (9, "ä" * 9 + "\n" + "ä" * 9), (10, "ä" * 9)]
    df = spark.createDataFrame([(i, t, "en", "src", None if t is None else len(t)) for i, t in texts], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for c in ("runs", "part", "place", "seq", "fp", "length"):
        df = df.withColumn(c, F.lit("own"))
    return df
