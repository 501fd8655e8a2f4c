"""Reading, conforming and writing governance tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import DEFAULTS, TABLES


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A governance table with its declared schema; columns added later read as null."""
    return spark.read.schema(TABLES[name]).parquet(path)


def read_evolved(spark: SparkSession, path: str) -> DataFrame:
    """Old and new file generations of one table under their merged schema."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def conform(df: DataFrame, schema: T.StructType, defaults: dict | None = None) -> DataFrame:
    """Project onto ``schema``: add missing columns, fill defaults, cast, fix the order."""
    defaults = defaults or {}
    columns = []
    for field in schema.fields:
        value = F.col(field.name) if field.name in df.columns else F.lit(None)
        value = value.cast(field.dataType)
        if field.name in defaults:
            value = F.coalesce(value, F.lit(defaults[field.name]).cast(field.dataType))
        columns.append(value.alias(field.name))
    return df.select(columns)


def conform_table(df: DataFrame, name: str) -> DataFrame:
    """:func:`conform` to a governance table's schema and defaults."""
    return conform(df, TABLES[name], DEFAULTS[name])


def append_rows(df: DataFrame, path: str, name: str) -> None:
    """Insert: conform and append to a governance table."""
    conform_table(df, name).write.mode("append").parquet(path)


def write_version(df: DataFrame, root: str, version: int) -> str:
    """Write a whole new version next to the old ones; readers switch by path.

    A failed job leaves the previous version as it was.
    """
    path = f"{root.rstrip('/')}/v{version:08d}"
    df.write.mode("overwrite").parquet(path)
    return path


def load_rows(spark: SparkSession, rows: list[dict], name: str) -> DataFrame:
    """Seed rows given as dictionaries, with the table's defaults filled in."""
    schema = TABLES[name]
    defaults = DEFAULTS[name]
    data = [
        tuple(row.get(f.name, defaults.get(f.name)) for f in schema.fields) for row in rows
    ]
    return spark.createDataFrame(data, schema)


def add_missing_columns(old: DataFrame, new: DataFrame) -> DataFrame:
    """Schema evolution: rows of both generations, columns of either filled with null."""
    return old.unionByName(new, allowMissingColumns=True)
