"""Application validation: row-wise checks over two lookups."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.json_values import is_present, object_entries, typed, value_text
from ..functions.rows import let, unfold
from ..functions.text import is_filled

REQUIRED_FIELDS = ["material_name", "classification_id", "material_type"]


class ExtraCheck(NamedTuple):
    """A user-defined check: name, predicate over the application row, error text."""

    name: str
    predicate: Column
    message: str


def _check(name: Column | str, passed: Column, message: Column, error: Column) -> Column:
    name = F.lit(name) if isinstance(name, str) else name
    return F.struct(
        name.alias("check"),
        passed.alias("passed"),
        message.alias("message"),
        F.when(~passed, error).alias("error"),
    )


def _required(field: str) -> Column:
    filled = is_filled(F.col(field))
    message = F.when(filled, F.lit(field + C.MSG_REQUIRED_OK)).otherwise(
        F.lit(field + C.MSG_REQUIRED_EMPTY)
    )
    return _check(f"required_{field}", filled, message, F.lit(C.MSG_REQUIRED_MISSING + field))


def _name_length() -> Column:
    size = F.coalesce(F.length("material_name"), F.lit(0))
    short = (size > 0) & (size < C.NAME_MIN)
    long = size > C.NAME_MAX
    shown = lambda bound: F.concat(F.lit(C.MSG_NAME_LENGTH), size.cast("string"), F.lit(bound))
    message = (
        F.when(short, shown(f" < {C.NAME_MIN}"))
        .when(long, shown(f" > {C.NAME_MAX}"))
        .otherwise(F.lit(C.MSG_NAME_OK))
    )
    error = F.when(short, F.lit(C.MSG_NAME_TOO_SHORT)).otherwise(F.lit(C.MSG_NAME_TOO_LONG))
    return _check("name_length", ~(short | long), message, error)


def _class_exists() -> Column:
    known = F.col("_class.id").isNotNull()
    message = F.when(known, F.concat(F.lit(C.MSG_CLASS_OK), F.col("_class.name"))).otherwise(
        F.lit(C.MSG_CLASS_MISSING)
    )
    return _check("classification_exists", known, message, F.lit(C.MSG_CLASS_UNKNOWN))


def _type_valid() -> Column:
    kind = F.col("material_type")
    valid = ~is_filled(kind) | kind.isin(C.MATERIAL_TYPES)
    shown = F.coalesce(kind, F.lit("None"))
    message = F.when(valid, F.concat(F.lit(C.MSG_TYPE_OK), shown)).otherwise(
        F.concat(F.lit(C.MSG_TYPE_INVALID), shown)
    )
    return _check("material_type", valid, message, F.concat(F.lit(C.MSG_TYPE_UNKNOWN), shown))


def _attribute(template: Column) -> Column:
    """The check of one required attribute; its value is looked up and typed once."""
    found = typed(F.element_at(F.col("_values"), template.field_name))
    judged = lambda v: F.struct(
        is_present(v).alias("present"),
        F.concat(template.field_label, F.lit(": "), value_text(v)).alias("shown"),
    )
    return let(
        let(found, judged),
        lambda j: _check(
            F.concat(F.lit("attr_"), template.field_name),
            j.present,
            F.when(j.present, j.shown).otherwise(
                F.concat(template.field_label, F.lit(C.MSG_ATTRIBUTE_EMPTY))
            ),
            F.concat(F.lit(C.MSG_ATTRIBUTE_MISSING), template.field_label),
        ),
    )


def required_by_class(templates: DataFrame) -> DataFrame:
    """Required fields of each class as one array in form order (a form's worth of rows)."""
    return (
        templates.filter(F.col("is_required"))
        .groupBy("classification_id")
        .agg(
            F.sort_array(
                F.collect_list(F.struct("sort_order", "id", "field_name", "field_label"))
            ).alias("_required")
        )
    )


def validate(
    applications: DataFrame,
    classifications: DataFrame,
    templates: DataFrame,
    extra: list[ExtraCheck] = (),
) -> DataFrame:
    """Add ``validation_result`` and ``validation_passed`` to every application.

    Both lookups are N:1 on the class, so with dimension tables below Spark's broadcast
    threshold no application row is shuffled; above it AQE splits hot classes.
    """
    kept = [c for c in applications.columns if c not in ("validation_result", "validation_passed")]
    known = classifications.select(
        F.col("id").alias("classification_id"), F.struct("id", "name").alias("_class")
    )
    rows = (
        applications.select(kept)
        .join(known, "classification_id", "left")
        .join(required_by_class(templates), "classification_id", "left")
        .withColumn("_values", object_entries(F.col("attribute_values")))
    )
    has_class = is_filled(F.col("classification_id"))
    fixed = F.array(*[_required(f) for f in REQUIRED_FIELDS], _name_length())
    class_row = F.filter(F.array(_class_exists()), lambda _: has_class)
    attributes = F.when(
        has_class & F.col("_required").isNotNull(), F.transform("_required", _attribute)
    )
    added = [
        F.array(
            _check(
                e.name,
                F.coalesce(e.predicate, F.lit(False)),
                F.when(e.predicate, F.lit(e.name)).otherwise(F.lit(e.message)),
                F.lit(e.message),
            )
        )
        for e in extra
    ]
    nothing = F.filter(F.array(_type_valid()), lambda _: F.lit(False))
    all_checks = F.concat(
        fixed, class_row, F.array(_type_valid()), F.coalesce(attributes, nothing), *added
    )
    failed = F.transform(F.filter("_checks", lambda c: ~c.passed), lambda c: c.error)
    rows = rows.withColumn("_checks", all_checks).withColumn("_errors", failed)
    errors = F.col("_errors")
    checks = F.transform(
        "_checks",
        lambda c: F.struct(
            c["check"].alias("check"), c.passed.alias("passed"), c.message.alias("message")
        ),
    )
    passed = F.size(errors) == 0
    return rows.select(
        *kept,
        F.struct(
            passed.alias("passed"), checks.alias("checks"), errors.alias("errors")
        ).alias("validation_result"),
        passed.alias("validation_passed"),
    )


def check_rows(validated: DataFrame, key: str = "id") -> DataFrame:
    """One row per check, in check order."""
    checks = validated.select(key, F.col("validation_result.checks").alias("checks"))
    return unfold(checks, "checks", [key]).select(
        key, "position", "item.check", "item.passed", "item.message"
    )
