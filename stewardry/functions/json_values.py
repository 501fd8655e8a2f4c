"""Presence rules for values held in free-form JSON objects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def object_entries(json: Column) -> Column:
    """JSON object text as ``map<string, variant>``; null for anything else."""
    return F.try_variant_get(F.try_parse_json(json), "$", "map<string,variant>")


def attribute_count(json: Column) -> Column:
    """Number of keys of a JSON object, 0 when there is none."""
    return F.coalesce(F.size(F.json_object_keys(json)), F.lit(0))


def typed(value: Column) -> Column:
    """``value, kind``: a variant with the name of its JSON type."""
    return F.struct(value.alias("value"), F.schema_of_variant(value).alias("kind"))


def is_present(item: Column) -> Column:
    """Whether a :func:`typed` value counts as given.

    False for null, empty text, zero, false and empty containers. The text ``"0"`` is
    present while the number ``0`` is not, so the JSON type decides.
    """
    kind, value = item.kind, item.value
    present = (
        F.when(kind == "STRING", F.try_variant_get(value, "$", "string") != "")
        .when(kind == "VOID", F.lit(False))
        .when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
        .when(kind.startswith("ARRAY"), F.to_json(value) != "[]")
        .when(kind.startswith("OBJECT"), F.to_json(value) != "{}")
        .otherwise(F.try_variant_get(value, "$", "double") != 0.0)
    )
    return F.coalesce(present, F.lit(False))


def value_text(item: Column) -> Column:
    """A :func:`typed` value as shown: bare text for scalars, ``True`` for true, else JSON.

    A number written with a fraction of zero, like ``2.0``, keeps it.
    """
    kind, value = item.kind, item.value
    whole = kind.rlike(r"^DECIMAL\(([0-9]|1[0-8]),0\)$")
    return (
        F.when(kind == "BOOLEAN", F.initcap(F.to_json(value)))
        .when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), F.to_json(value))
        .when(whole, F.concat(F.try_variant_get(value, "$", "string"), F.lit(".0")))
        .otherwise(F.try_variant_get(value, "$", "string"))
    )
