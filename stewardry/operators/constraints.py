"""Declared field constraints and key audits."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (
    APPLICATION_STATUSES, FIELD_TYPES, GOLDEN_STATUSES, MATERIAL_TYPES, STATUS_LABELS, STEP_LABELS,
)


class Constraint(NamedTuple):
    """One rule on one column; unset parts are not checked, null passes unless required."""

    column: str
    required: bool = False
    max_length: int | None = None
    low: int | None = None
    high: int | None = None
    pattern: str | None = None
    allowed: list[str] | None = None

    def violations(self) -> list[Column]:
        value = F.col(self.column)
        rules = []
        if self.required:
            rules.append(("required", value.isNull()))
        if self.max_length is not None:
            rules.append(("max_length", F.length(value) > self.max_length))
        if self.low is not None:
            rules.append(("range", ~value.between(self.low, self.high)))
        if self.pattern is not None:
            rules.append(("pattern", ~value.rlike(self.pattern)))
        if self.allowed is not None:
            rules.append(("allowed", ~value.isin(self.allowed)))
        return [F.when(bad, F.lit(f"{self.column}:{name}")) for name, bad in rules]


CONSTRAINTS = {
    "material_classifications": [
        Constraint("code", required=True, max_length=10),
        Constraint("name", required=True, max_length=100),
        Constraint("level", required=True, low=1, high=3),
    ],
    "attribute_templates": [
        Constraint("classification_id", required=True),
        Constraint("field_name", required=True, max_length=50),
        Constraint("field_label", required=True, max_length=100),
        Constraint("field_type", required=True, pattern=f"^({'|'.join(FIELD_TYPES)})$"),
        Constraint("default_value", max_length=200),
    ],
    "material_applications": [
        Constraint("material_name", required=True, max_length=200),
        Constraint("classification_id", required=True),
        Constraint("material_type", required=True, allowed=MATERIAL_TYPES),
        Constraint("status", allowed=APPLICATION_STATUSES),
        Constraint("material_code", max_length=50),
        Constraint("app_no", max_length=20),
        Constraint("created_by", max_length=50),
    ],
    "code_rules": [
        Constraint("name", required=True, max_length=100),
        Constraint("pattern", required=True, max_length=200),
        Constraint("prefix", max_length=10),
        Constraint("suffix", max_length=10),
    ],
    "golden_records": [
        Constraint("material_code", required=True, max_length=50),
        Constraint("material_name", required=True, max_length=200),
        Constraint("classification_id", required=True),
        Constraint("material_type", required=True, allowed=MATERIAL_TYPES),
        Constraint("status", allowed=GOLDEN_STATUSES),
        Constraint("classification_path", max_length=200),
        Constraint("btp_sync_id", max_length=50),
        Constraint("om_entity_fqn", max_length=200),
    ],
    "audit_logs": [
        Constraint("step_id", required=True, max_length=20),
        Constraint("step_name", required=True, allowed=list(STEP_LABELS)),
        Constraint("executed_by", required=True, max_length=50),
        Constraint("status", required=True, max_length=20, allowed=list(STATUS_LABELS)),
        Constraint("step_label", max_length=50),
        Constraint("executed_by_name", max_length=100),
    ],
    "external_system_logs": [
        Constraint("system_name", required=True, max_length=20),
        Constraint("operation", required=True, max_length=50),
        Constraint("entity_type", max_length=50),
        Constraint("entity_id", max_length=50),
        Constraint("status", required=True, max_length=20),
    ],
}


def with_violations(df: DataFrame, constraints: list[Constraint]) -> DataFrame:
    """Add ``violations``: names of broken rules in declared order, empty for clean rows."""
    found = [column for rule in constraints for column in rule.violations()]
    return df.withColumn("violations", F.array_compact(F.array(*found)))


def quarantine(df: DataFrame, constraints: list[Constraint]) -> tuple[DataFrame, DataFrame]:
    """Split into clean rows and rejected rows with their violations."""
    checked = with_violations(df, constraints)
    bad = F.size("violations") > 0
    return checked.filter(~bad).drop("violations"), checked.filter(bad)


def orphans(child: DataFrame, column: str, parent: DataFrame, parent_key: str = "id") -> DataFrame:
    """Child rows whose non-null reference has no parent row.

    A left join with a marker: an anti join would be pushed into every part of a union.
    """
    keys = parent.select(F.col(parent_key).alias(column), F.lit(True).alias("_found"))
    return (
        child.filter(F.col(column).isNotNull())
        .join(keys, column, "left")
        .filter(F.col("_found").isNull())
        .select(child.columns)
    )


def repeated_keys(df: DataFrame, column: str) -> DataFrame:
    """Values of a unique column that occur more than once, pre-counted before the shuffle."""
    return repeated_values(_key_values([("", df, column)])).drop("key")


def repeated_values(values: DataFrame) -> DataFrame:
    """``key, value, copies`` of values that occur more than once under their key."""
    return (
        values.groupBy("key", "value")
        .agg(F.count("*").alias("copies"))
        .filter(F.col("copies") > 1)
    )


def _key_values(keys: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """``key, value`` of all non-null keys of several tables."""
    parts = [
        table.filter(F.col(column).isNotNull()).select(
            F.lit(name).alias("key"), F.col(column).alias("value")
        )
        for name, table, column in keys
    ]
    return reduce(DataFrame.unionByName, parts)


def _references(relations: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """``relation, id, value`` of all references that point into one table."""
    parts = [
        child.select(F.lit(name).alias("relation"), "id", F.col(column).alias("value"))
        for name, child, column in relations
    ]
    return reduce(DataFrame.unionByName, parts)


def referential_audit(
    classifications: DataFrame,
    templates: DataFrame,
    applications: DataFrame,
    golden: DataFrame,
    rules: DataFrame,
    logs: DataFrame,
) -> DataFrame:
    """``relation, id, value`` of every dangling reference; one anti join per target table."""
    to_class = _references(
        [
            ("classification.parent", classifications, "parent_id"),
            ("template.classification", templates, "classification_id"),
            ("application.classification", applications, "classification_id"),
            ("golden.classification", golden, "classification_id"),
            ("rule.classification", rules, "classification_id"),
        ]
    )
    to_application = _references(
        [("golden.application", golden, "application_id"), ("audit.application", logs, "application_id")]
    )
    to_golden = _references([("audit.golden", logs, "golden_record_id")])
    return (
        orphans(to_class, "value", classifications)
        .unionByName(orphans(to_application, "value", applications))
        .unionByName(orphans(to_golden, "value", golden))
    )


def uniqueness_audit(
    classifications: DataFrame, applications: DataFrame, golden: DataFrame
) -> DataFrame:
    """``key, value, copies`` of every repeated business key, all keys in one aggregate."""
    return repeated_values(
        _key_values(
            [
                ("classification.code", classifications, "code"),
                ("application.app_no", applications, "app_no"),
                ("golden.material_code", golden, "material_code"),
                ("golden.application_id", golden, "application_id"),
            ]
        )
    )


def orphans_after(
    found: DataFrame, relation: str, children: DataFrame, column: str, targets: DataFrame,
    changed: DataFrame, added: DataFrame, removed: DataFrame,
) -> DataFrame:
    """``relation, id, value`` of one relation after a batch, from the findings before it.

    ``children`` and ``targets`` are the tables after the batch; ``changed`` holds the ``id`` of
    every child row that the batch wrote or took out, ``added`` and ``removed`` those of
    targets. What the batch touched is looked up anew: changed children, and children of
    removed targets. All other findings stay, unless their target was added.
    """
    rows = children.select("id", F.col(column).alias("value"))
    ids = changed.select("id").distinct()
    kept = (
        found.filter(F.col("relation") == relation).join(ids, "id", "left_anti")
        .join(added.select(F.col("id").alias("value")), "value", "left_anti")
    )
    gone = removed.select(F.col("id").alias("value")).distinct()
    touched = rows.join(ids, "id", "left_semi").unionByName(
        rows.join(gone, "value", "left_semi").join(ids, "id", "left_anti").select("id", "value")
    )
    new = orphans(touched, "value", targets).withColumn("relation", F.lit(relation))
    # of a removed target that dangled before as well, the findings are in both parts
    return kept.select("relation", "id", "value").unionByName(new.select("relation", "id", "value")).distinct()


def repeats_after(found: DataFrame, key: str, table: DataFrame, column: str, touched: DataFrame) -> DataFrame:
    """``key, value, copies`` of one unique column after a batch: values in ``touched`` (what
    changed rows held before and after, as ``value``) are counted anew, other findings stay."""
    values = touched.select("value").filter("value is not null").distinct()
    kept = found.filter(F.col("key") == key).join(values, "value", "left_anti")
    now = table.select(F.lit(key).alias("key"), F.col(column).alias("value")).join(values, "value", "left_semi")
    return kept.select("key", "value", "copies").unionByName(repeated_values(now).select("key", "value", "copies"))
