"""Working tables of a passing() block go with it; what it settled stays."""

from pathlib import Path

from tessera.llm import shared


def test_settled_keeps_only_its_rows(spark):
    made = []

    def make():
        df = shared.materialize(spark.range(100), "between")
        made.append(df.inputFiles()[0].removeprefix("file://"))
        return df.where("id % 2 = 0")

    got = shared.settled(spark, "kept", make)
    assert got.count() == 50 and not Path(made[0]).parent.exists()
    assert all(Path(f.removeprefix("file://")).exists() for f in got.inputFiles())


def test_tables_outside_a_block_stay(spark):
    df = shared.materialize(spark.range(10), "outside")
    with shared.passing(spark):
        shared.materialize(spark.range(10), "inside")
    assert df.count() == 10


def test_no_rows(spark):
    assert shared.settled(spark, "none", lambda: spark.range(0)).columns == ["id"]
