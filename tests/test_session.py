import os

from pyspark.sql import functions as F

from stewardry import session


def test_checkpoint_folder_comes_from_the_session(spark):
    root = session.checkpoint_root(spark)
    assert root == spark.sparkContext.getCheckpointDir()
    assert session.scratch_path(spark, "x").startswith(root)


def test_scratch_is_removed(spark):
    with session.scratch_removed():
        df = session.materialize(spark.range(10))
        folder = df.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:").replace("///", "/")
        assert os.path.isdir(folder)
    assert not os.path.exists(folder)


def test_materialized_positions_stay(spark):
    df = session.materialize(spark.range(1000).repartition(7).withColumn("p", F.monotonically_increasing_id()))
    assert df.collect() == df.collect() and df.inputFiles()[0].endswith(".parquet")
