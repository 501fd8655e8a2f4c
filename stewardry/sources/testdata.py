"""Governance tables derived from the star-schema test tables.

Each table is one SQL text over the given tables that means the same in Spark and in
ANSI engines, so results can be compared with an independent query on the same rows.
``{name}`` stands for a table; literal braces are doubled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
]

# Chains of customers, each below the one of a third of its number; some are their own parent.
DEEP_CLASSES = """
SELECT 'K' || c_custkey AS id,
       'K' || CASE WHEN c_custkey % 97 = 0 THEN c_custkey ELSE CAST(floor(c_custkey / 3.0) AS BIGINT) END
         AS parent_id,
       'k' || c_custkey AS code, c_mktsegment AS name, 1 AS level, TRUE AS is_active
FROM {customer}
"""

# Three levels: region -> nation -> supplier.
CLASSIFICATIONS = """
SELECT 'R' || r_regionkey AS id, CAST(NULL AS VARCHAR(10)) AS parent_id,
       'R' || r_regionkey AS code, r_name AS name, 1 AS level, TRUE AS is_active
FROM {region}
UNION ALL
SELECT 'N' || n_nationkey, 'R' || n_regionkey, 'N' || n_nationkey, n_name, 2,
       n_regionkey <> 3
FROM {nation}
UNION ALL
SELECT 'S' || s_suppkey, 'N' || s_nationkey, 'S' || s_suppkey, s_name, 3, s_acctbal >= 0
FROM {supplier}
"""

# Two required fields and an optional one per nation.
TEMPLATES = """
SELECT 'T' || n_nationkey || '-grade' AS id, 'N' || n_nationkey AS classification_id,
       'grade' AS field_name, 'Grade' AS field_label, 'select' AS field_type,
       TRUE AS is_required, 1 AS sort_order
FROM {nation}
UNION ALL
SELECT 'T' || n_nationkey || '-weight', 'N' || n_nationkey, 'weight', 'Weight (kg)', 'number',
       n_regionkey <> 2, 2
FROM {nation}
UNION ALL
SELECT 'T' || n_nationkey || '-color', 'N' || n_nationkey, 'color', 'Color',
       CASE WHEN n_regionkey = 4 THEN 'colour' ELSE 'text' END, FALSE, 3
FROM {nation}
"""

# Rules differ by region; region 4 has none and region 3 an inactive one as well.
RULES = """
SELECT 'rule-b-N' || n_nationkey AS id, 'Rule of ' || n_name AS name,
       CASE n_regionkey WHEN 0 THEN '{{大类}}-{{小类}}-{{流水}}'
                        WHEN 1 THEN '{{类型}}{{年份}}{{流水}}'
                        ELSE '{{小类}}/{{流水}}' END AS pattern,
       CASE WHEN n_regionkey = 1 THEN 'P' ELSE '' END AS prefix,
       CASE WHEN n_regionkey = 2 THEN '-X' END AS suffix,
       CAST(n_nationkey * 10 AS BIGINT) AS current_seq,
       CASE WHEN n_regionkey = 2 THEN 2 ELSE 5 END AS seq_length,
       'N' || n_nationkey AS classification_id, TRUE AS is_active
FROM {nation} WHERE n_regionkey <> 4
UNION ALL
SELECT 'rule-a-N' || n_nationkey, 'Old rule of ' || n_name, 'OLD-{{流水}}', NULL, NULL,
       CAST(0 AS BIGINT), 5, 'N' || n_nationkey, FALSE
FROM {nation} WHERE n_regionkey = 3
UNION ALL
SELECT 'rule-c-N' || n_nationkey, 'Spare rule of ' || n_name, 'NEW-{{流水}}', NULL, NULL,
       CAST(0 AS BIGINT), 5, 'N' || n_nationkey, TRUE
FROM {nation} WHERE n_regionkey = 0
"""

# Every part is a golden record.
GOLDEN = """
SELECT 'G' || p_partkey AS id,
       CASE WHEN p_size = 1 THEN NULL
            WHEN p_size = 2 THEN 'gone-' || p_partkey
            ELSE 'A' || p_partkey END AS application_id,
       'M-' || lpad(CAST(p_partkey AS VARCHAR(20)), 8, '0') AS material_code,
       CASE WHEN p_brand IN ('Brand#7', 'Brand#8') THEN upper(p_name) ELSE p_name END
         || ' ' || lower(p_type) || ' size ' || p_size AS material_name,
       'N' || (p_partkey % 25) AS classification_id,
       CASE WHEN p_size = 4 THEN 'stored / path' WHEN p_size = 5 THEN '' END
         AS classification_path,
       CASE WHEN p_size = 3 THEN NULL WHEN p_size = 6 THEN '[1, 2]' WHEN p_size = 7 THEN '{{}}'
            ELSE '{{"brand": "' || p_brand || '", "size": ' || p_size || '}}' END
         AS attribute_values,
       CASE p_type WHEN 'ECONOMY' THEN 'raw' WHEN 'SMALL' THEN 'semi' WHEN 'LARGE' THEN 'spare'
                   ELSE 'finished' END AS material_type,
       CASE WHEN p_size = 50 THEN 'obsolete' ELSE 'active' END AS status,
       1 AS version, 1 AS revision,
       p_size < 30 AS btp_published, p_size BETWEEN 10 AND 40 AS om_synced,
       CASE WHEN p_size = 8 THEN '' WHEN p_size > 45 THEN 'stored.' || p_partkey END
         AS om_entity_fqn,
       TIMESTAMP '2024-01-01 00:00:00' + p_partkey * INTERVAL '1' MINUTE AS created_at
FROM {part}
"""

# Every order is an application for the part numbered like its customer; the priority
# decides how the wanted name differs from the registered one, the price how the
# other fields look.
APPLICATIONS = """
SELECT 'A' || o_orderkey AS id,
       'SQ-' || year(o_orderdate) || '-' || lpad(CAST(o_orderkey AS VARCHAR(20)), 8, '0') AS app_no,
       CASE CAST(floor(o_totalprice) AS BIGINT) % 40
         WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'ab' WHEN 3 THEN '   ab '
         WHEN 4 THEN repeat(p_name, 30) WHEN 5 THEN substr(p_name, 1, 4)
         ELSE CASE substr(o_orderpriority, 1, 1)
           WHEN '1' THEN '  ' || upper(p_name) || ' ' || p_type || ' size ' || p_size || ' '
           WHEN '2' THEN p_name || ' ' || lower(p_type) || ' size ' || p_size || ' spare'
           WHEN '3' THEN p_name || ' ' || lower(p_type) || ' size ' || (p_size + 1)
           WHEN '4' THEN p_name || ' ' || p_brand
           ELSE lower(p_type) || ' ' || p_name || ' size ' || p_size END
       END AS material_name,
       CAST(NULL AS VARCHAR(10)) AS material_desc,
       CASE CAST(floor(o_totalprice) AS BIGINT) % 50
         WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'X1' WHEN 3 THEN 'R' || (o_custkey % 5)
         ELSE 'N' || (o_custkey % 25) END AS classification_id,
       CASE CAST(floor(o_totalprice) AS BIGINT) % 30
         WHEN 0 THEN NULL WHEN 1 THEN 'bogus' WHEN 2 THEN 'raw' WHEN 3 THEN 'semi'
         WHEN 4 THEN 'auxiliary' WHEN 5 THEN 'spare' ELSE 'finished' END AS material_type,
       CASE CAST(floor(o_totalprice) AS BIGINT) % 20
         WHEN 0 THEN NULL
         WHEN 1 THEN '{{"grade": "", "weight": 1}}'
         WHEN 2 THEN '{{"grade": "0", "weight": 0}}'
         WHEN 3 THEN '{{"grade": [], "weight": 0.0}}'
         WHEN 4 THEN '{{"grade": {{}}, "weight": false}}'
         WHEN 5 THEN '{{"grade": null, "weight": true}}'
         WHEN 6 THEN '{{"weight": -2.5}}'
         WHEN 7 THEN 'not json'
         WHEN 8 THEN '["grade"]'
         WHEN 9 THEN '{{"grade": "x", "weight": 2.0}}'
         ELSE '{{"grade": "' || p_brand || '", "weight": ' || p_size || '}}' END
         AS attribute_values,
       CASE WHEN o_orderstatus = 'F' THEN 'F-' || lpad(CAST(o_orderkey AS VARCHAR(20)), 6, '0')
            WHEN o_orderstatus = 'P' AND o_totalprice < 100000
              THEN 'R4-N' || (o_custkey % 25) || '-' || lpad(CAST(o_custkey AS VARCHAR(20)), 5, '0')
            WHEN o_orderstatus = 'P' THEN 'Q-' || o_orderkey
       END AS material_code,
       CASE WHEN o_orderstatus = 'O' AND o_totalprice < 250000 THEN 'draft'
            WHEN o_orderstatus = 'O' THEN 'pending_admin'
            WHEN o_orderstatus = 'P' AND o_totalprice >= 250000 THEN 'pending_dept'
            WHEN o_orderstatus = 'P' THEN 'approved'
            WHEN o_totalprice < 100000 THEN 'rejected' ELSE 'published' END AS status,
       'C' || o_custkey AS created_by, 'Customer ' || o_custkey AS created_by_name,
       CAST(o_orderdate AS TIMESTAMP) AS created_at
FROM {orders} JOIN {part} ON p_partkey = o_custkey
"""

PRINCIPALS = """
SELECT 'C' || c_custkey AS user_id, c_name AS name, c_mktsegment AS department,
       CASE c_mktsegment WHEN 'MACHINERY' THEN 'dept_approver' WHEN 'BUILDING' THEN 'admin'
            WHEN 'HOUSEHOLD' THEN 'guest' ELSE 'applicant' END AS role
FROM {customer}
"""

# Every event is an audit row of the application numbered like its user.
LOGS = """
SELECT CAST(event_id AS VARCHAR(20)) AS id,
       'A' || user_id || '-S' || event_id AS step_id,
       CASE WHEN value < 1 THEN NULL ELSE 'A' || user_id END AS application_id,
       CASE event_type WHEN 'signup' THEN 'submit' WHEN 'view' THEN 'validate'
            WHEN 'click' THEN 'om_test' WHEN 'purchase' THEN 'publish_btp'
            ELSE 'archive' END AS step_name,
       'U' || user_id AS executed_by,
       CAST(ts AS TIMESTAMP) AS executed_at,
       CASE WHEN event_type = 'error' THEN 'failed' WHEN value > 50 THEN 'odd' ELSE 'success' END
         AS status,
       CASE WHEN value > 40 THEN NULL
            WHEN event_type = 'view' AND value > 20 THEN '{{"passed": true, "errors": []}}'
            WHEN event_type = 'view' AND value > 2
              THEN '{{"passed": false, "errors": ["e' || user_id || '", "low value"]}}'
            WHEN event_type = 'view' THEN '{{}}'
            WHEN event_type = 'click' AND value > 5
              THEN '{{"results": [{{"test_name": "t1", "passed": true, "message": "ok"}}, '
                   || '{{"passed": false, "message": "bad"}}]}}'
            WHEN event_type = 'click' THEN '{{"results": []}}'
            ELSE props END AS details
FROM {events}
"""

# Every line item is an older audit row of the order's application.
OLD_LOGS = """
SELECT 'SQ-' || year(o_orderdate) || '-' || lpad(CAST(o_orderkey AS VARCHAR(20)), 8, '0')
         || '-S' || l_linenumber AS step_id
FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey
"""

# Every event is an action on the application of its user and week.
ACTIONS = """
SELECT 'U' || user_id || '-' || CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR(10)) AS app_id,
       CAST(event_id AS VARCHAR(20)) AS event_id, CAST(ts AS TIMESTAMP) AS at,
       CASE event_type WHEN 'signup' THEN 'submit' WHEN 'view' THEN 'admin_approve'
            WHEN 'click' THEN 'dept_approve' WHEN 'purchase' THEN 'publish'
            WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'admin_reject' ELSE 'dept_reject' END END AS action,
       'C' || (event_id % 97) AS acted_by
FROM {events}
"""

# Every line item is a decision on the order's application.
DECISIONS = """
SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey
         || '-' || l_quantity || '-' || l_extendedprice AS decision_id,
       'A' || l_orderkey AS application_id,
       CASE WHEN l_returnflag = 'N' THEN 'dept' ELSE 'admin' END AS stage,
       CASE WHEN l_linenumber < 6 THEN l_linestatus = 'O' END AS approved, 'line ' || l_linenumber AS comment,
       'C' || l_suppkey AS acted_by, 'Supplier ' || l_suppkey AS acted_by_name,
       CAST(l_shipdate AS TIMESTAMP) AS at
FROM {lineitem}
"""

# Every order is a request to submit its application, a third of them by someone else.
REQUESTS = """
SELECT 'S' || o_orderkey AS id, 'A' || o_orderkey AS application_id,
       'C' || CASE WHEN o_orderkey % 3 = 0 THEN o_custkey + 1 ELSE o_custkey END AS acted_by,
       'Customer ' || o_custkey AS acted_by_name, CAST(o_orderdate AS TIMESTAMP) AS at
FROM {orders}
UNION ALL
SELECT 'S-' || c_custkey, 'A-' || c_custkey, 'C' || c_custkey, c_name, TIMESTAMP '2024-01-01 00:00:00' FROM {customer}
"""

# What the receivers answered about the records of approved orders; some never did.
RESULTS = """
SELECT 'b' || o_orderkey AS result_id, 'gr-A' || o_orderkey AS golden_record_id, 'btp' AS system,
       CAST(floor(o_totalprice) AS BIGINT) % 4 <> 0 AS success, 'REF-' || o_orderkey AS reference,
       CAST(NULL AS VARCHAR(10)) AS response,
       CASE WHEN CAST(floor(o_totalprice) AS BIGINT) % 4 = 0 THEN 'unreachable' END AS error_message,
       CAST(o_orderdate AS TIMESTAMP) AS at
FROM {orders} WHERE o_orderstatus = 'P' AND CAST(floor(o_totalprice) AS BIGINT) % 7 <> 0
UNION ALL
SELECT 'c' || o_orderkey, 'gr-A' || o_orderkey, 'openmetadata',
       CAST(floor(o_totalprice) AS BIGINT) % 5 <> 0, 'catalog.' || o_orderkey, NULL, NULL,
       CAST(o_orderdate AS TIMESTAMP) + INTERVAL '1' DAY
FROM {orders} WHERE o_orderstatus = 'P' AND CAST(floor(o_totalprice) AS BIGINT) % 9 <> 0
UNION ALL
SELECT 'd' || o_orderkey, 'gr-A' || o_orderkey, 'btp', TRUE, 'again-' || o_orderkey, NULL, NULL,
       CAST(o_orderdate AS TIMESTAMP) + INTERVAL '2' DAY
FROM {orders} WHERE o_orderstatus = 'P' AND CAST(floor(o_totalprice) AS BIGINT) % 8 = 0
"""

# Line items as files uploaded to the order's application.
UPLOADS = """
SELECT 'A' || l_orderkey AS application_id,
       'F' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey
         || '-' || l_quantity || '-' || l_extendedprice AS id,
       CASE l_linenumber WHEN 1 THEN 'dir/sub/plan ' || l_partkey || '.pdf'
            WHEN 2 THEN 'c:' || chr(92) || 'temp' || chr(92) || l_partkey || '.dwg'
            WHEN 3 THEN '' WHEN 4 THEN 'folder/' ELSE 'part-' || l_partkey END AS file_name,
       CASE WHEN l_returnflag = 'R' THEN '' WHEN l_returnflag = 'A' THEN 'application/pdf' END
         AS content_type,
       CAST(l_quantity * 100 AS BIGINT) AS size, 'C' || l_suppkey AS uploaded_by,
       CAST(NULL AS VARCHAR(10)) AS uploaded_by_name, CAST(l_shipdate AS TIMESTAMP) AS uploaded_at
FROM {lineitem}
"""

# Customers' line items as patches of the order's draft.
PATCHES = """
SELECT 'A' || l_orderkey AS id, l_linenumber AS line, l_suppkey AS supp, l_partkey AS part,
       l_extendedprice AS price,
       CASE WHEN l_returnflag = 'R' THEN 'renamed ' || l_partkey || ' ' || l_suppkey END
         AS material_name,
       CASE WHEN l_returnflag = 'A' THEN 'note ' || l_linenumber || ' ' || l_partkey END
         AS material_desc,
       CASE WHEN l_linestatus = 'O' THEN 'spare' END AS material_type
FROM {lineitem}
"""

SQL = {
    "classifications": CLASSIFICATIONS,
    "templates": TEMPLATES,
    "rules": RULES,
    "golden": GOLDEN,
    "deep_classes": DEEP_CLASSES,
    "applications": APPLICATIONS,
    "principals": PRINCIPALS,
    "logs": LOGS,
    "old_logs": OLD_LOGS,
    "actions": ACTIONS,
    "decisions": DECISIONS,
    "requests": REQUESTS,
    "results": RESULTS,
    "uploads": UPLOADS,
    "patches": PATCHES,
}


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bind(spark: SparkSession, sf_dir: str, name: str, **replaced: DataFrame) -> DataFrame:
    """A derived governance table; ``replaced`` swaps given tables, e.g. for streams."""
    text = SQL[name]
    used = [t for t in TABLES if f"{{{t}}}" in text]
    frames = {t: replaced.get(t) or given(spark, sf_dir, t) for t in used}
    return spark.sql(text, **frames)


def as_cte(*names: str) -> str:
    """``WITH`` list of derived tables for an engine that has the given tables as views."""
    parts = [f"{n} AS ({SQL[n].format(**{t: t for t in TABLES}).strip()})" for n in names]
    return "WITH " + ",\n".join(parts) + "\n"
