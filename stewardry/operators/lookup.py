"""Filters, point lookups, pages and small listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import ANY_ROLES, LEVEL_LABELS, PAGE_LIMIT, PAGE_MAX
from ..functions.text import matches_any
from ..session import scratch_path

APPLICATION_SEARCH = ["material_name", "app_no", "material_code"]
GOLDEN_SEARCH = ["material_name", "material_code"]
CATALOG_SEARCH = ["material_name", "material_code", "om_entity_fqn"]
TRACE_SEARCH = ["app_no", "material_name", "material_code"]


def by_id(df: DataFrame, value: str, column: str = "id") -> DataFrame:
    """Zero or one row; the predicate reaches the file scan."""
    return df.filter(F.col(column) == value)


def by_keys(df: DataFrame, keys: DataFrame, column: str = "id") -> DataFrame:
    """Every requested key with its row, or nulls when there is none."""
    return keys.select(column).join(df, column, "left")


def by_code(golden: DataFrame, code: str) -> DataFrame:
    return by_id(golden, code, "material_code")


def check_page(skip: int, limit: int) -> None:
    """Reject page bounds before any plan is built."""
    if skip < 0:
        raise ValueError("skip must be >= 0")
    if not 1 <= limit <= PAGE_MAX:
        raise ValueError(f"limit must be between 1 and {PAGE_MAX}")


def page(
    df: DataFrame, order: str | Column, skip: int = 0, limit: int = PAGE_LIMIT, tie: str = "id"
) -> DataFrame:
    """Newest first, then offset and limit; a top-k per task, no full sort."""
    check_page(skip, limit)
    newest = F.col(order).desc() if isinstance(order, str) else order
    return df.orderBy(newest, F.col(tie).asc()).offset(skip).limit(limit)


def page_after(
    df: DataFrame, order: str, after: tuple | None = None, limit: int = PAGE_LIMIT, tie: str = "id"
) -> DataFrame:
    """Newest first, the rows that follow ``after``: the last page's (``order``, ``tie``) values.

    However deep the page, a task keeps ``limit`` rows; the first page has no ``after``. Rows
    without a value of ``order`` come last, by ``tie``.
    """
    check_page(0, limit)
    if after is not None:
        at, last = F.lit(after[0]), F.lit(after[1])
        if after[0] is None:
            df = df.filter(F.col(order).isNull() & (F.col(tie) > last))
        else:
            same = (F.col(order) == at) & (F.col(tie) > last)
            df = df.filter((F.col(order) < at) | F.col(order).isNull() | same)
    return df.orderBy(F.col(order).desc(), F.col(tie).asc()).limit(limit)


class RankedPages:
    """Pages by offset over a sorted copy of a table: newest first, rows without a value last.

    The copy is range-sorted over the cluster and every row keeps its place in its range, so a
    page is the rows of a few places of one or two ranges: however deep, it reads the files of
    those and holds ``limit`` rows. Made anew for a new version of the table.
    """

    _BITS = 33  # a row's place in its range is below this bit of its position

    def __init__(self, df: DataFrame, order: str, tie: str = "id"):
        self.spark, self.order, self.tie = df.sparkSession, order, tie
        sort = [F.col(order).desc_nulls_last(), F.col(tie).asc()]
        ranged = df.repartitionByRange(*sort).sortWithinPartitions(*sort)
        position = F.monotonically_increasing_id()
        placed = ranged.withColumn("_range", F.shiftright(position, self._BITS).cast("int"))
        placed = placed.withColumn("_place", position.bitwiseAND(F.lit((1 << self._BITS) - 1)))
        path = scratch_path(self.spark, "pages")
        placed.write.partitionBy("_range").parquet(path)
        schema = f"{df.schema.toDDL()}, _place long, _range int" if df.columns else "_place long, _range int"
        self.rows = self.spark.read.schema(schema).parquet(path)
        counts = self.rows.groupBy("_range").agg(F.count("*").alias("rows")).orderBy("_range")
        #: first rank and rows of each range: a few numbers for each sorting task
        self.ranges: list[tuple[int, int, int]] = []
        first = 0
        for r in counts.collect():
            self.ranges.append((r["_range"], first, r["rows"]))
            first += r["rows"]

    def page(self, skip: int = 0, limit: int = PAGE_LIMIT) -> DataFrame:
        check_page(skip, limit)
        wanted = F.lit(False)
        for number, first, rows in self.ranges:
            low, high = max(skip - first, 0), min(skip + limit - first, rows)
            if low < high:
                wanted = wanted | ((F.col("_range") == number) & (F.col("_place") >= low) & (F.col("_place") < high))
        return self.rows.filter(wanted).orderBy("_range", "_place").drop("_range", "_place")


def applications_where(
    df: DataFrame, status: str | None = None, created_by: str | None = None
) -> DataFrame:
    if status:
        df = df.filter(F.col("status") == status)
    if created_by:
        df = df.filter(F.col("created_by") == created_by)
    return df


def search(df: DataFrame, query: str, columns: list[str]) -> DataFrame:
    return df.filter(matches_any(query, columns))


def active_classifications(
    df: DataFrame, level: int | None = None, parent_id: str | None = None
) -> DataFrame:
    if level and level not in LEVEL_LABELS:
        raise ValueError("level must be 1, 2 or 3")
    df = df.filter(F.col("is_active"))
    if level:
        df = df.filter(F.col("level") == level)
    if parent_id is not None:
        df = df.filter(F.col("parent_id") == parent_id)
    return df.orderBy("code")


def class_templates(templates: DataFrame, classification_id: str | None = None) -> DataFrame:
    """Templates in form order, of one class or of all; classes inherit nothing."""
    if classification_id is not None:
        templates = templates.filter(F.col("classification_id") == classification_id)
    return templates.orderBy("classification_id", "sort_order", "id")


def active_rules(rules: DataFrame, classification_id: str | None = None) -> DataFrame:
    rules = rules.filter(F.col("is_active"))
    if classification_id:
        rules = rules.filter(F.col("classification_id") == classification_id)
    return rules


def rule_of_class(rules: DataFrame) -> DataFrame:
    """The one active rule each class uses: the lowest id."""
    whole = F.struct(*[F.col(c) for c in rules.columns])
    return (
        active_rules(rules)
        .filter(F.col("classification_id").isNotNull())
        .groupBy("classification_id")
        .agg(F.min_by(whole, F.col("id")).alias("rule"))
        .select("rule.*")
    )


def visible_to(applications: DataFrame, user_id: str, role: str) -> DataFrame:
    """Applications one principal may list."""
    if role == "applicant":
        return applications.filter(F.col("created_by") == user_id)
    if role in ("admin", "data_admin"):
        return applications
    return applications.filter(F.lit(False))


def own_applications(applications: DataFrame, principals: DataFrame) -> DataFrame:
    """(principal, application) for every applicant; sees-all roles need no pairing."""
    applicants = principals.filter(F.col("role") == "applicant").select("user_id")
    return applications.join(applicants, applications.created_by == applicants.user_id)


def visible_counts(applications: DataFrame, principals: DataFrame) -> DataFrame:
    """How many applications each principal sees, without pairing admins with every row."""
    known = principals.filter(F.col("role").isin(ANY_ROLES))
    own = applications.groupBy(F.col("created_by").alias("user_id")).agg(
        F.count("*").alias("own")
    )
    total = applications.agg(F.count("*").alias("total")).scalar()
    seen = (
        F.when(F.col("role") == "applicant", F.coalesce("own", F.lit(0)))
        .when(F.col("role").isin("admin", "data_admin"), total)
        .otherwise(F.lit(0))
    )
    return known.join(own, "user_id", "left").select(
        "user_id", "role", seen.cast("bigint").alias("visible")
    )
