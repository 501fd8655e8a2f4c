"""Business codes and application numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.rows import once
from ..functions.text import is_filled, pad_number
from .hierarchy import major_codes
from .lookup import rule_of_class
from .numbering import number_within


def _issued_by_stem(values: DataFrame, column: str, pattern: str) -> DataFrame:
    """``stem, issued, highest`` of running numbers already handed out as text."""
    return (
        once(
            values.select(column),
            stem=F.regexp_extract(column, pattern, 1),
            number=F.expr(f"try_cast(regexp_extract({column}, '{pattern}', 2) AS bigint)"),
        )
        .filter(F.col("stem") != "")
        .groupBy("stem")
        .agg(F.count("*").alias("issued"), F.max("number").alias("highest"))
    )


def application_numbers(
    new: DataFrame, existing: DataFrame, numbering: str = "max"
) -> DataFrame:
    """Add ``app_no`` (``SQ-YYYY-NNNNN``) to new applications by ``created_at, id``.

    ``numbering="max"`` continues after the highest number of the year, ``"count"`` after
    the number of existing ones, which repeats numbers once rows were deleted. Without a
    creation time there is no year, and ``app_no`` stays null.
    """
    if numbering not in ("max", "count"):
        raise ValueError("numbering must be 'max' or 'count'")
    used = F.col("highest") if numbering == "max" else F.col("issued")
    issued = _issued_by_stem(existing, "app_no", "^(.+-)([0-9]+)$").select("stem", used.alias("used"))
    stem = F.concat(F.lit(C.APP_NO_PREFIX + "-"), F.year("created_at").cast("string"), F.lit("-"))
    numbered = number_within(
        new.drop("app_no").withColumn("stem", stem), ["stem"], ["created_at", "id"]
    )
    number = F.coalesce("used", F.lit(0)) + F.col("n")
    return (
        numbered.join(issued, "stem", "left")
        .withColumn("app_no", F.concat("stem", pad_number(number, C.APP_NO_WIDTH)))
        .drop("stem", "used", "n")
    )


def fill_pattern(
    pattern: Column, major: Column, minor: Column, number: Column, kind: Column, year: Column
) -> Column:
    """Slots are filled one after the other, so a filled-in text may hold a later slot."""
    fills = [
        (C.SLOT_MAJOR, major),
        (C.SLOT_MINOR, minor),
        (C.SLOT_SEQUENCE, number),
        (C.SLOT_TYPE, F.upper(F.substring(kind, 1, 3))),
        (C.SLOT_YEAR, F.substring(year.cast("string"), -2, 2)),
    ]
    return reduce(lambda text, fill: F.replace(text, F.lit(fill[0]), fill[1]), fills, pattern)


def _rules_for(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """Requests with the rule in force: the named one even if inactive, else the class rule."""
    body = F.struct("id", "pattern", "prefix", "suffix", "current_seq", "seq_length")
    of_class = rule_of_class(rules).select("classification_id", body.alias("_class_rule"))
    by_class = requests.join(of_class, "classification_id", "left")
    if "code_rule_id" not in requests.columns:
        return by_class.withColumnRenamed("_class_rule", "_rule")
    named = rules.select(F.col("id").alias("code_rule_id"), body.alias("_named_rule"))
    chosen = F.when(is_filled(F.col("code_rule_id")), F.col("_named_rule")).otherwise(
        F.col("_class_rule")
    )
    return (
        by_class.join(named, "code_rule_id", "left")
        .withColumn("_rule", chosen)
        .drop("_class_rule", "_named_rule")
    )


def default_bases(classifications: DataFrame, golden: DataFrame, issued: DataFrame) -> DataFrame:
    """``classification_id, base``: the number the next default code of a class follows.

    The larger of the class's golden-record count and the highest number already in a
    code with the class's stem, so codes still waiting for approval are not reused.
    """
    counted = golden.groupBy("classification_id").agg(F.count("*").alias("records"))
    codes = golden.select("material_code").unionByName(issued.select("material_code"))
    highest = _issued_by_stem(codes, "material_code", "^(.+-)([0-9]+)$").select("stem", "highest")
    stems = major_codes(classifications).select(
        F.col("id").alias("classification_id"),
        F.concat_ws("-", "major_code", "code", F.lit("")).alias("stem"),
    )
    base = F.greatest(F.coalesce("records", F.lit(0)), F.coalesce("highest", F.lit(0)))
    return (
        stems.join(counted, "classification_id", "left")
        .join(highest, "stem", "left")
        .select("classification_id", base.alias("base"))
    )


def generate_codes(
    requests: DataFrame,
    classifications: DataFrame,
    rules: DataFrame,
    golden: DataFrame,
    issued: DataFrame,
    year: int,
    order: list[str],
) -> DataFrame:
    """Add ``material_code``, ``rule_id`` and ``seq`` to code requests.

    ``requests`` has ``id, classification_id, material_type`` and optionally
    ``code_rule_id``; ``issued`` holds codes given to applications so far. Numbers run per
    rule (shared by all material types) or per class without rule, in ``order``. A request
    with an unknown class gets a null code.
    """
    classes = major_codes(classifications).select(
        F.col("id").alias("classification_id"), F.col("code").alias("_minor"),
        F.col("major_code").alias("_major"),
    )
    known = _rules_for(requests, rules).join(classes, "classification_id", "left")
    counter = (
        F.when(F.col("_minor").isNull(), F.lit("unknown"))
        .when(F.col("_rule").isNotNull(), F.concat(F.lit("rule "), F.col("_rule.id")))
        .otherwise(F.concat(F.lit("class "), F.col("classification_id")))
    )
    numbered = number_within(known.withColumn("_counter", counter), ["_counter"], order)
    bases = default_bases(classifications, golden, issued)
    seq = F.coalesce("_rule.current_seq", "base", F.lit(0)) + F.col("n")
    from_rule = F.concat(
        F.coalesce("_rule.prefix", F.lit("")),
        fill_pattern(
            F.col("_rule.pattern"), F.col("_major"), F.col("_minor"),
            pad_number(F.col("seq"), F.col("_rule.seq_length")),
            F.col("material_type"), F.lit(year),
        ),
        F.coalesce("_rule.suffix", F.lit("")),
    )
    default = F.concat_ws(
        "-", "_major", "_minor", pad_number(F.col("seq"), C.DEFAULT_SEQUENCE_WIDTH)
    )
    code = F.when(F.col("_rule").isNotNull(), from_rule).otherwise(default)
    known_class = F.col("_minor").isNotNull()
    return (
        numbered.join(bases, "classification_id", "left")
        .withColumn("seq", seq)
        .select(
            *requests.columns,
            F.when(known_class, code).alias("material_code"),
            F.when(known_class, F.col("_rule.id")).alias("rule_id"),
            F.when(known_class, F.col("seq")).alias("seq"),
        )
    )


def advance_rules(rules: DataFrame, coded: DataFrame) -> DataFrame:
    """The next version of the rules, with the counters the codes have used."""
    used = (
        coded.filter(F.col("rule_id").isNotNull())
        .groupBy(F.col("rule_id").alias("id"))
        .agg(F.max("seq").alias("_seq"))
    )
    return (
        rules.join(used, "id", "left")
        .withColumn("current_seq", F.coalesce("_seq", "current_seq"))
        .select(rules.columns)
    )
