"""Code-to-label mapping with the raw value as fall-back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C


def label(value: Column, texts: dict) -> Column:
    """Label of ``value``, or ``value`` itself when it has none."""
    pairs = [F.lit(part) for item in texts.items() for part in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), value), value.cast("string"))


def step_label(step: Column) -> Column:
    return label(step, C.STEP_LABELS)


def status_label(status: Column) -> Column:
    return label(status, C.STATUS_LABELS)


def application_status_label(status: Column) -> Column:
    return label(status, C.APPLICATION_STATUS_LABELS)


def level_label(level: Column) -> Column:
    return label(level, C.LEVEL_LABELS)
