"""Golden-record quality tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.text import is_filled


def _test(name: str, passed: Column, message: Column) -> Column:
    return F.struct(
        F.lit(name).alias("test_name"), passed.alias("passed"), message.alias("message")
    )


def quality_results() -> Column:
    """The three tests of a golden record as an array of results."""
    has_code = is_filled(F.col("material_code"))
    has_class = is_filled(F.col("classification_id"))
    size = F.coalesce(F.length("material_name"), F.lit(0))
    either = lambda flag, yes, no: F.when(flag, F.lit(yes)).otherwise(F.lit(no))
    return F.array(
        _test(C.TEST_CODE, has_code, either(has_code, C.MSG_CODE_OK, C.MSG_CODE_EMPTY)),
        _test(
            C.TEST_NAME,
            size.between(C.NAME_MIN, C.NAME_MAX),
            F.concat(F.lit(C.MSG_TEST_NAME), size.cast("string")),
        ),
        _test(
            C.TEST_CLASS,
            has_class,
            either(has_class, C.MSG_TEST_CLASS_OK, C.MSG_TEST_CLASS_BAD),
        ),
    )


def run_quality_tests(golden: DataFrame) -> DataFrame:
    """Add ``quality_results`` and ``all_passed``."""
    return golden.withColumn("quality_results", quality_results()).withColumn(
        "all_passed", F.forall("quality_results", lambda t: t.passed)
    )


def quality_rows(golden: DataFrame) -> DataFrame:
    """One row per golden record and test."""
    return run_quality_tests(golden).select(
        "id", "material_code", "all_passed", F.inline("quality_results")
    )
