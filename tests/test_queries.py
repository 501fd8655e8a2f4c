"""Every registered query against its oracle SQL, and the shape of the plans."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as spark_entry
from stewardry.registry.oracle import ORACLES
from stewardry.registry.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(row[i] for i in order)) for row in rows)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(spark_entry.queries()) and set(ORACLES) <= set(spark_entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    cursor = con.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    got, want = df.collect(), cursor.fetchall()
    assert canonical([tuple(r) for r in got], df.columns) == canonical(want, columns)
    assert got
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    df = QUERIES["visible_applications"](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert not any("o_orderpriority" in s.split("ReadSchema")[-1] for s in scans)
    assert any("PushedFilters: [IsNotNull" in s for s in scans)


def test_adaptive_execution_splits_a_hot_join_key(spark):
    """A third of the rows on one key: the lookup join splits them over tasks."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1000",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        from stewardry.operators.validate import validate
        from stewardry.sources.tables import conform_table

        apps = conform_table(
            spark.range(0, 60000, 1, 8).select(
                F.col("id").cast("string").alias("id"),
                F.concat(F.lit("some name "), F.col("id").cast("string")).alias("material_name"),
                F.when(F.col("id") % 3 == 0, "hot")
                .otherwise(F.concat(F.lit("c"), (F.col("id") % 500).cast("string")))
                .alias("classification_id"),
                F.lit("raw").alias("material_type"),
            ),
            "material_applications",
        )
        classes = spark.range(500).select(
            F.concat(F.lit("c"), F.col("id").cast("string")).alias("id"), F.lit("n").alias("name")
        ).unionByName(spark.sql("select 'hot' as id, 'h' as name"))
        templates = spark.sql(
            "select 't' as id, 'hot' as classification_id, 'g' as field_name, 'G' as field_label, "
            "true as is_required, 1 as sort_order"
        )
        df = validate(apps, classes, templates)
        assert df.filter("validation_passed").count() == 40000
        df.write.format("noop").mode("overwrite").save()
        df.collect()
        assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
