"""Classification tree: parents, paths, flat and nested trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import NO_PARENT_CODE
from ..functions.text import blank_to_null, is_filled
from ..session import materialize


def major_codes(classifications: DataFrame) -> DataFrame:
    """``id, code, name, major_code``: the parent's code, a root's own code, else ``00``."""
    parents = classifications.select(
        F.col("id").alias("parent_id"), F.col("code").alias("parent_code")
    )
    has_parent = is_filled(F.col("parent_id"))
    major = F.when(has_parent, F.col("parent_code")).when(F.col("level") == 1, F.col("code"))
    return classifications.join(parents, "parent_id", "left").select(
        "id",
        "code",
        "name",
        F.coalesce(blank_to_null(major), F.lit(NO_PARENT_CODE)).alias("major_code"),
    )


def paths(classifications: DataFrame) -> DataFrame:
    """``id, path, complete``: root-first names and codes, joined by `` / ``.

    Climbs to the root, however deep, by joining half-built paths to each other, which
    doubles their length each round. A class below a cycle never gets there: rounds end
    when they finish no further class, and such a class has ``complete`` false and no path.
    An unknown parent ends the path.
    """
    step = F.concat(F.col("name"), F.lit(" ("), F.col("code"), F.lit(")"))
    nodes = classifications.select(
        "id", blank_to_null(F.col("parent_id")).alias("next_id"), step.alias("path")
    )
    known = classifications.select(F.col("id").alias("next_id"), F.lit(True).alias("_known"))
    found = nodes.join(known, "next_id", "left").select(
        "id", F.when(F.col("_known"), F.col("next_id")).alias("next_id"), "path"
    )
    unfinished = None
    while True:
        found = materialize(found)
        left = found.filter(F.col("next_id").isNotNull()).count()
        if left in (0, unfinished):
            break
        unfinished = left
        above = found.select(
            F.col("id").alias("next_id"), F.col("next_id").alias("beyond_id"),
            F.col("path").alias("upper"),
        )
        climbed = found.filter(F.col("next_id").isNotNull()).join(above, "next_id").select(
            "id", F.col("beyond_id").alias("next_id"), F.concat_ws(" / ", "upper", "path").alias("path")
        )
        found = found.filter(F.col("next_id").isNull()).unionByName(climbed)
    complete = F.col("next_id").isNull()
    return found.select("id", F.when(complete, F.col("path")).alias("path"), complete.alias("complete"))


def tree_flat(classifications: DataFrame) -> DataFrame:
    """One row per (root, middle, leaf); only roots are checked for being active."""
    level = lambda name: classifications.select(
        F.col("id").alias(f"{name}_id"),
        F.col("code").alias(f"{name}_code"),
        F.col("parent_id").alias(f"{name}_parent"),
    )
    roots = classifications.filter((F.col("level") == 1) & F.col("is_active")).select(
        F.col("id").alias("root_id"), F.col("code").alias("root_code")
    )
    middle, leaf = level("middle"), level("leaf")
    return (
        roots.join(middle, F.col("root_id") == F.col("middle_parent"), "left")
        .join(leaf, F.col("middle_id") == F.col("leaf_parent"), "left")
        .select("root_code", "middle_code", "leaf_code")
    )


def tree_nested(classifications: DataFrame) -> DataFrame:
    """Roots with nested child arrays in code order, built bottom-up.

    An array holds one parent's children, the size of a menu; use :func:`tree_flat`
    for trees whose fan-out has no such limit.
    """
    leaves = classifications.groupBy("parent_id").agg(
        F.sort_array(F.collect_list(F.struct("code", "id", "name", "level"))).alias("children")
    )
    attach = leaves.withColumnRenamed("parent_id", "id")
    middle = (
        classifications.join(attach, "id", "left")
        .groupBy("parent_id")
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct(
                        "code", "id", "name", "level",
                        F.coalesce("children", F.array()).alias("children"),
                    )
                )
            ).alias("children")
        )
        .withColumnRenamed("parent_id", "id")
    )
    return (
        classifications.filter((F.col("level") == 1) & F.col("is_active"))
        .join(middle, "id", "left")
        .select("id", "code", "name", "level", "children")
        .orderBy("code")
    )
