"""one_hot makes a column of every category or none."""

import pytest
from pyspark.sql import functions as F
from tessera.operators import features as M


def test_too_many_categories_are_an_error(spark):
    df = spark.range(1001).select("id", F.col("id").cast("string").alias("s"))
    assert len(M.one_hot(df.where("id < 1000"), "s").columns) == 1001
    with pytest.raises(ValueError, match="more than 1000"):
        M.one_hot(df, "s")
