"""Outgoing feeds: payload rows a sender can pick up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import PUBLISH_TARGETS
from ..functions.text import blank_to_null
from ..schemas import DEFAULTS, EXTERNAL_LOGS
from .tables import conform

FQN_PREFIX = "catalog.Material"


def publish_feed(golden: DataFrame, targets: list[str] = PUBLISH_TARGETS) -> DataFrame:
    """One publish payload per golden record."""
    details = F.struct(
        "material_code",
        "material_name",
        F.lit("published").alias("status"),
        "version",
        "revision",
    )
    return golden.select(
        F.col("id").alias("golden_record_id"),
        F.to_json(details).alias("payload"),
        F.array(*[F.lit(t) for t in targets]).alias("target_systems"),
    )


def entity_fqn(code, prefix: str = FQN_PREFIX):
    """Catalog name of a material: ``prefix.code``."""
    return F.concat_ws(".", F.lit(prefix), code)


def catalog_feed(golden: DataFrame, prefix: str = FQN_PREFIX) -> DataFrame:
    """One catalog entity per golden record."""
    return golden.select(
        F.col("id").alias("golden_record_id"),
        "material_code",
        entity_fqn(F.col("material_code"), prefix).alias("entity_fqn"),
    )


def stored_or_derived_fqn(prefix: str = FQN_PREFIX):
    """The stored catalog name, else the derived one."""
    return F.coalesce(
        blank_to_null(F.col("om_entity_fqn")), entity_fqn(F.col("material_code"), prefix)
    )


def write_feed(feed: DataFrame, path: str) -> None:
    """Append a feed as JSON lines for a sender to pick up."""
    feed.write.mode("append").json(path)


def external_log(df: DataFrame) -> DataFrame:
    """Interaction rows in the layout of the external log table."""
    return conform(df, EXTERNAL_LOGS, DEFAULTS["external_system_logs"])
