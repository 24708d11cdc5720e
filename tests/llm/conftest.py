"""What the operators' tests share."""

import pytest
from pyspark.sql import functions as F


def documents(spark, rows):
    """doc_id, text with further columns whose names the operators use inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long"), "key": F.lit(1), "label": F.lit("x"), "block": F.lit(0), "score": F.lit(2)})


@pytest.fixture
def docs(spark):
    return lambda rows, parts=3: documents(spark, rows).repartition(parts)


#: Texts that every operator must take.
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (4, "a"), (None, "a b c d e f g"), (5, "é" * 40), (6, "word " * 20000), (7, "x" * 60000), (8, "1 " * 300), (9, "\x00\x01 \x02 end.")]
