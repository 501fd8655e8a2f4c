"""Guarded backfills of classifications and templates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import CLASSIFICATIONS, DEFAULTS
from ..sources.tables import conform


def backfill_level(classifications: DataFrame, seed: DataFrame, level: int = 3) -> DataFrame:
    """Rows of ``seed`` to add: none if the level is in use, else those whose parent exists."""
    used = classifications.filter(F.col("level") == level).agg(F.count("*")).scalar()
    parents = classifications.select(F.col("id").alias("parent_id"))
    rows = seed.withColumn("level", F.lit(level)).filter(used == 0)
    rows = rows.join(parents, "parent_id", "left_semi")
    return conform(rows, CLASSIFICATIONS, DEFAULTS["material_classifications"])


def copy_templates(templates: DataFrame, targets: DataFrame) -> DataFrame:
    """Templates to add: each source class's templates for targets that have none.

    ``targets`` has ``source_id, target_id``; copies get the id ``{id}-{target_id}``. Of
    several sources of one target the lowest that has templates is used.
    """
    taken = templates.select(F.col("classification_id").alias("target_id"))
    open_targets = targets.join(taken, "target_id", "left_anti")
    sources = templates.select(F.col("classification_id").alias("source_id")).distinct()
    first = open_targets.join(sources, "source_id", "left_semi").groupBy("target_id").agg(
        F.min("source_id").alias("source_id")
    )
    copies = first.join(
        templates.withColumnRenamed("classification_id", "source_id"), "source_id"
    )
    return (
        copies.withColumn("id", F.concat_ws("-", "id", "target_id"))
        .withColumnRenamed("target_id", "classification_id")
        .select(templates.columns)
    )
