import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from stewardry.session import tune  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield tune(session)
    session.stop()


@pytest.fixture(scope="session")
def classes(spark):
    from stewardry.sources.tables import load_rows

    return load_rows(
        spark,
        [
            {"id": "cls-parent", "code": "M01", "name": "原材料", "level": 1},
            {"id": "cls-child", "code": "0101", "name": "金属材料", "level": 2, "parent_id": "cls-parent"},
            {"id": "cls-leaf", "code": "010101", "name": "钢板", "level": 3, "parent_id": "cls-child"},
            {"id": "cls-off", "code": "0102", "name": "Off", "level": 2, "parent_id": "cls-parent", "is_active": False},
            {"id": "cls-lost", "code": "0901", "name": "Lost", "level": 2, "parent_id": "nowhere"},
        ],
        "material_classifications",
    )


@pytest.fixture(scope="session")
def templates(spark):
    from stewardry.sources.tables import load_rows

    row = lambda i, name, label, kind, need: {
        "id": f"tpl-{i}", "classification_id": "cls-child", "field_name": name,
        "field_label": label, "field_type": kind, "is_required": need, "sort_order": i,
    }
    return load_rows(
        spark,
        [
            row(1, "material_grade", "材质等级", "select", True),
            row(2, "thickness", "厚度(mm)", "number", True),
            row(3, "width", "宽度(mm)", "number", False),
        ],
        "attribute_templates",
    )


@pytest.fixture(scope="session")
def rules(spark):
    from stewardry.sources.tables import load_rows

    return load_rows(
        spark,
        [
            {"id": "rule-1", "name": "r", "pattern": "{大类}-{小类}-{流水}", "prefix": "M", "classification_id": "cls-child"},
            {"id": "rule-2", "name": "spare", "pattern": "X{流水}", "classification_id": "cls-child"},
            {"id": "rule-0", "name": "old", "pattern": "{类型}{年份}{流水}", "suffix": "-Z", "seq_length": 2,
             "current_seq": 98, "classification_id": "cls-child", "is_active": False},
        ],
        "code_rules",
    )
