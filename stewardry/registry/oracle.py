"""Independent ANSI SQL for the registered queries, run on the same given tables.

The derived tables come from the shared bindings; everything after them is written
apart from the library: brute-force joins, ``row_number`` and recursive queries.
"""

from __future__ import annotations

from stewardry import constants as C
from stewardry.sources.testdata import as_cte

ORACLES: dict[str, str] = {}


def oracle(name: str, tables: str, sql: str, ctes: str = "") -> None:
    """Register ``sql`` over derived ``tables``; ``ctes`` are further WITH entries."""
    head = as_cte(*tables.split()) if tables else ""
    if ctes:
        head = (head.rstrip() + ",\n" if head else "WITH ") + ctes.strip() + "\n"
    ORACLES[name] = head + sql.strip()


def case_label(column: str, texts: dict) -> str:
    whens = " ".join(
        f"WHEN {k if isinstance(k, int) else repr(k)} THEN '{v}'" for k, v in texts.items()
    )
    return f"CASE {column} {whens} ELSE CAST({column} AS VARCHAR) END"


def iso(column: str) -> str:
    """ISO text, with microseconds when there are any."""
    return (
        f"CASE WHEN {column} = date_trunc('second', {column}) "
        f"THEN strftime({column}, '%Y-%m-%dT%H:%M:%S') "
        f"ELSE strftime({column}, '%Y-%m-%dT%H:%M:%S.%f') END"
    )


STEP = case_label("step_name", C.STEP_LABELS)
STATUS = case_label("status", C.STATUS_LABELS)

# ---- lists and lookups ------------------------------------------------------------

oracle("classification_list", "classifications", f"""
SELECT id, code, name, level, {case_label('level', C.LEVEL_LABELS)} AS level_label
FROM classifications WHERE is_active""")

oracle("classification_children", "classifications", """
SELECT id, code, name FROM classifications WHERE is_active AND level = 2 AND parent_id = 'R1'""")

CLIMB = """
climb AS (
  SELECT id, parent_id, name || ' (' || code || ')' AS path, [id] AS seen, FALSE AS looped FROM {0}
  UNION ALL
  SELECT c.id, p.parent_id, p.name || ' (' || p.code || ') / ' || c.path, list_append(c.seen, p.id),
         list_contains(c.seen, p.id)
  FROM climb c JOIN {0} p ON p.id = c.parent_id WHERE NOT c.looped),
paths AS (
  SELECT id, CASE WHEN NOT bool_or(looped) THEN arg_max(path, len(seen)) END AS path,
         NOT bool_or(looped) AS complete
  FROM climb GROUP BY id)"""
PATHS = CLIMB.format("classifications")
oracle("classification_path", "classifications", "SELECT * FROM paths", PATHS)
oracle("classification_path_deep", "deep_classes", "SELECT * FROM paths", CLIMB.format("deep_classes"))

oracle("classification_tree_flat", "classifications", """
SELECT a.code AS root_code, b.code AS middle_code, c.code AS leaf_code
FROM classifications a LEFT JOIN classifications b ON b.parent_id = a.id
LEFT JOIN classifications c ON c.parent_id = b.id
WHERE a.level = 1 AND a.is_active""")

oracle("classification_tree_nested", "classifications", """
SELECT a.code AS root_code, row_number() OVER (PARTITION BY a.id ORDER BY b.code, b.id) - 1 AS nth, b.code AS middle_code,
       coalesce((SELECT string_agg(c.code, ',' ORDER BY c.code, c.id) FROM classifications c WHERE c.parent_id = b.id), '') AS leaf_codes
FROM classifications a JOIN classifications b ON b.parent_id = a.id
WHERE a.level = 1 AND a.is_active""")

MAJOR = """
majors AS (
  SELECT c.id, c.code, CASE WHEN c.parent_id IS NOT NULL THEN coalesce(p.code, '00')
                            WHEN c.level = 1 THEN c.code ELSE '00' END AS major_code
  FROM classifications c LEFT JOIN classifications p ON c.parent_id = p.id)"""
oracle("parent_codes", "classifications", "SELECT id, code, major_code FROM majors", MAJOR)

oracle("class_templates", "templates", "SELECT * FROM templates")

RULE_OF_CLASS = """
class_rule AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY classification_id ORDER BY id) AS pick
                 FROM rules WHERE is_active) WHERE pick = 1)"""
oracle("class_rules", "rules", "SELECT classification_id, id, pattern FROM class_rule", RULE_OF_CLASS)

oracle("application_page", "applications", f"""
SELECT id, app_no, status, {iso('created_at')} AS created_at
FROM (SELECT *, row_number() OVER (ORDER BY created_at DESC, id) AS place
      FROM applications WHERE status = 'pending_admin')
WHERE place BETWEEN 21 AND 120""")

oracle("application_page_after", "applications", """
SELECT id, app_no FROM applications
WHERE status = 'pending_admin' AND (created_at < TIMESTAMP '1996-01-01 00:00:00'
  OR (created_at = TIMESTAMP '1996-01-01 00:00:00' AND id > 'A5'))
ORDER BY created_at DESC, id LIMIT 100""")

oracle("applications_of_creator", "applications",
       "SELECT id, status FROM applications WHERE created_by = 'C7'")

oracle("application_search", "applications", """
SELECT id FROM applications
WHERE position('ring e' IN lower(coalesce(material_name, ''))) > 0
   OR position('ring e' IN lower(app_no)) > 0
   OR position('ring e' IN lower(coalesce(material_code, ''))) > 0""")

oracle("golden_search", "golden", """
SELECT id, material_name FROM golden
WHERE position('anvil' IN lower(material_name)) > 0 OR position('anvil' IN lower(material_code)) > 0""")

FQN = "coalesce(nullif(om_entity_fqn, ''), 'catalog.Material.' || material_code)"
oracle("catalog_search", "golden", f"""
SELECT id, {FQN} AS om_entity_fqn FROM golden
WHERE position('stored.1' IN lower(material_name || ' ' || material_code || ' ' || {FQN})) > 0""")

oracle("trace_search", "applications", """
SELECT id AS application_id, app_no FROM applications
WHERE position('sq-1998' IN lower(app_no)) > 0
   OR position('sq-1998' IN lower(coalesce(material_name, ''))) > 0
   OR position('sq-1998' IN lower(coalesce(material_code, ''))) > 0""")

oracle("golden_by_code", "golden",
       "SELECT id, material_code, material_name FROM golden WHERE material_code = 'M-00000042'")

oracle("golden_by_codes", "golden", """
SELECT k.code AS material_code, g.id, g.status
FROM (SELECT 'M-' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS code FROM orders) k
LEFT JOIN golden g ON g.material_code = k.code""")

oracle("visible_applications", "applications principals", """
SELECT user_id, id, status FROM applications JOIN principals ON created_by = user_id
WHERE role = 'applicant'""")

oracle("visible_to_applicant", "applications", "SELECT id, status FROM applications WHERE created_by = 'C7'")
oracle("visible_to_admin", "applications", "SELECT id, status FROM applications")
oracle("visible_counts", "applications principals", """
SELECT user_id, role, CASE WHEN role = 'applicant'
         THEN (SELECT count(*) FROM applications WHERE created_by = user_id)
         WHEN role = 'admin' THEN (SELECT count(*) FROM applications) ELSE 0 END AS visible
FROM principals WHERE role <> 'guest'""")

for indexed in ("application_search", "golden_search", "trace_search"):
    ORACLES[f"{indexed}_index"] = ORACLES[indexed]
ORACLES["application_page_ranked"] = ORACLES["application_page"]
oracle("referential_delta", "golden applications", """
SELECT 'golden.application' AS relation, id, application_id AS value FROM golden
WHERE application_id IS NOT NULL AND application_id NOT IN (SELECT id FROM applications WHERE status <> 'draft')""")
oracle("uniqueness_delta", "golden", """
SELECT 'golden.material_name' AS key, material_name AS value, count(*) AS copies FROM golden
WHERE material_name IS NOT NULL GROUP BY material_name HAVING count(*) > 1""")
oracle("golden_search_index_short", "golden", """
SELECT id FROM golden WHERE contains(lower(material_name), '42') OR contains(lower(material_code), '42')""")

# ---- constraints and validation ---------------------------------------------------

oracle("constraint_violations", "classifications templates applications logs", """
SELECT 'material_classifications' AS source, id, 'code:max_length' AS violation
FROM classifications WHERE length(code) > 10
UNION ALL SELECT 'material_classifications', id, 'name:max_length'
FROM classifications WHERE length(name) > 100
UNION ALL SELECT 'attribute_templates', id, 'field_type:pattern' FROM templates
WHERE field_type NOT IN ('text', 'number', 'date', 'select', 'boolean')
UNION ALL SELECT 'material_applications', id, 'material_name:required' FROM applications
WHERE material_name IS NULL
UNION ALL SELECT 'material_applications', id, 'material_name:max_length' FROM applications
WHERE length(material_name) > 200
UNION ALL SELECT 'material_applications', id, 'classification_id:required' FROM applications
WHERE classification_id IS NULL
UNION ALL SELECT 'material_applications', id, 'material_type:required' FROM applications
WHERE material_type IS NULL
UNION ALL SELECT 'material_applications', id, 'material_type:allowed' FROM applications
WHERE material_type NOT IN ('raw', 'semi', 'finished', 'auxiliary', 'spare')
UNION ALL SELECT 'audit_logs', id, 'step_name:allowed' FROM logs WHERE step_name = 'archive'
UNION ALL SELECT 'audit_logs', id, 'status:allowed' FROM logs WHERE status = 'odd'""")

oracle("referential_audit", "classifications templates applications golden rules logs", """
SELECT 'classification.parent' AS relation, id, parent_id AS value FROM classifications
WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT id FROM classifications)
UNION ALL SELECT 'template.classification', id, classification_id FROM templates
WHERE classification_id NOT IN (SELECT id FROM classifications)
UNION ALL SELECT 'application.classification', id, classification_id FROM applications
WHERE classification_id IS NOT NULL AND classification_id NOT IN (SELECT id FROM classifications)
UNION ALL SELECT 'golden.classification', id, classification_id FROM golden
WHERE classification_id NOT IN (SELECT id FROM classifications)
UNION ALL SELECT 'golden.application', id, application_id FROM golden
WHERE application_id IS NOT NULL AND application_id NOT IN (SELECT id FROM applications)
UNION ALL SELECT 'rule.classification', id, classification_id FROM rules
WHERE classification_id NOT IN (SELECT id FROM classifications)
UNION ALL SELECT 'audit.application', id, application_id FROM logs
WHERE application_id IS NOT NULL AND application_id NOT IN (SELECT id FROM applications)""")

oracle("uniqueness_audit", "classifications applications golden", """
SELECT * FROM (
  SELECT 'classification.code' AS key, code AS value, count(*) AS copies
  FROM classifications GROUP BY code
  UNION ALL SELECT 'application.app_no', app_no, count(*) FROM applications GROUP BY app_no
  UNION ALL SELECT 'golden.material_code', material_code, count(*) FROM golden GROUP BY material_code
  UNION ALL SELECT 'golden.application_id', application_id, count(*) FROM golden
  WHERE application_id IS NOT NULL GROUP BY application_id
  UNION ALL SELECT 'golden.material_name', material_name, count(*) FROM golden GROUP BY material_name)
WHERE copies > 1""")

CHECKS = f"""
app AS (
  SELECT a.*, length(coalesce(material_name, '')) AS name_size, c.id AS known_class,
         c.name AS class_name, coalesce(a.classification_id, '') <> '' AS has_class
  FROM applications a LEFT JOIN classifications c ON a.classification_id = c.id),
attr AS (
  SELECT id, sort_order, field_name, field_label,
         CASE WHEN json_valid(attribute_values) THEN
           CASE WHEN json_type(attribute_values) = 'OBJECT'
             THEN json_extract(attribute_values, '$.' || field_name) END END AS v
  FROM (SELECT a.id, t.sort_order, t.field_name, t.field_label, a.attribute_values
        FROM applications a JOIN templates t USING (classification_id) WHERE t.is_required)),
attr_ok AS (
  SELECT *, coalesce(CASE json_type(v) WHEN 'NULL' THEN FALSE WHEN 'VARCHAR' THEN json_extract_string(v, '$') <> ''
       WHEN 'BOOLEAN' THEN CAST(v AS VARCHAR) = 'true' WHEN 'ARRAY' THEN CAST(v AS VARCHAR) <> '[]'
       WHEN 'OBJECT' THEN CAST(v AS VARCHAR) <> '{{}}' ELSE CAST(json_extract_string(v, '$') AS DOUBLE) <> 0 END,
       FALSE) AS ok,
       CASE json_type(v) WHEN 'BOOLEAN' THEN 'True' ELSE json_extract_string(v, '$') END AS shown
  FROM attr),
rows_ AS (
  SELECT id, 1 AS rank, 'required_material_name' AS check_name,
         coalesce(material_name, '') <> '' AS passed,
         CASE WHEN coalesce(material_name, '') <> '' THEN 'material_name 已填写' ELSE 'material_name 不能为空' END AS message,
         '必填字段缺失: material_name' AS error FROM app
  UNION ALL SELECT id, 2, 'required_classification_id', has_class,
         CASE WHEN has_class THEN 'classification_id 已填写' ELSE 'classification_id 不能为空' END,
         '必填字段缺失: classification_id' FROM app
  UNION ALL SELECT id, 3, 'required_material_type', material_type IS NOT NULL,
         CASE WHEN material_type IS NOT NULL THEN 'material_type 已填写' ELSE 'material_type 不能为空' END,
         '必填字段缺失: material_type' FROM app
  UNION ALL SELECT id, 4, 'name_length', name_size = 0 OR name_size BETWEEN 5 AND 200,
         CASE WHEN name_size BETWEEN 1 AND 4 THEN '名称长度 ' || name_size || ' < 5'
              WHEN name_size > 200 THEN '名称长度 ' || name_size || ' > 200' ELSE '名称长度合规' END,
         CASE WHEN name_size < 5 THEN '物料名称太短（至少5个字符）' ELSE '物料名称太长（最多200个字符）' END FROM app
  UNION ALL SELECT id, 5, 'classification_exists', known_class IS NOT NULL,
         CASE WHEN known_class IS NOT NULL THEN '分类: ' || class_name ELSE '分类不存在' END,
         '所选分类不存在' FROM app WHERE has_class
  UNION ALL SELECT id, 6, 'material_type', coalesce(material_type, 'raw') <> 'bogus',
         CASE WHEN material_type = 'bogus' THEN '无效类型: ' ELSE '类型: ' END || coalesce(material_type, 'None'),
         '无效的物料类型: bogus' FROM app
  UNION ALL SELECT id, 6 + sort_order, 'attr_' || field_name, ok,
         CASE WHEN ok THEN field_label || ': ' || shown ELSE field_label || ' 必填' END,
         '必填属性缺失: ' || field_label FROM attr_ok),
summary AS (
  SELECT id, bool_and(passed) AS validation_passed, count(*) AS checks,
         coalesce(string_agg(error, '; ' ORDER BY rank) FILTER (WHERE NOT passed), '') AS errors
  FROM rows_ GROUP BY id)"""
CHECK_TABLES = "applications classifications templates"
oracle("validate_checks", CHECK_TABLES, """
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY rank) - 1 AS INTEGER) AS position,
       check_name AS "check", passed, message FROM rows_""", CHECKS)
oracle("validate_summary", CHECK_TABLES, "SELECT * FROM summary", CHECKS)
oracle("stream_validate", CHECK_TABLES, "SELECT id, validation_passed, errors FROM summary", CHECKS)

QUALITY = """
tests AS (
  SELECT id, material_code, 'material_code_not_null' AS test_name, TRUE AS passed,
         '物料编码非空' AS message FROM golden
  UNION ALL SELECT id, material_code, 'material_name_length', length(material_name) BETWEEN 5 AND 200,
         '名称长度: ' || length(material_name) FROM golden
  UNION ALL SELECT id, material_code, 'classification_valid', TRUE, '分类有效' FROM golden)"""
oracle("golden_quality", "golden", """
SELECT id, material_code, bool_and(passed) OVER (PARTITION BY id) AS all_passed,
       test_name, passed, message FROM tests""", QUALITY)

# ---- duplicate detection ----------------------------------------------------------

SPACE = r"[\s\x1c-\x1f\x85\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
# two decimals as the binary value of the score decides; halves are m/200
ROUNDED = "CASE CAST(round(score * 200, 9) AS VARCHAR) " + " ".join(
    f"WHEN '{m}.0' THEN {round(m / 200, 2)}::DOUBLE" for m in range(101, 200, 2)
) + " ELSE round_even(score, 2) END"
DEDUP = f"""
named AS (
  SELECT id, regexp_replace(lower(coalesce(material_name, '')), '^{SPACE}|{SPACE}$', '', 'g') AS n
  FROM applications),
names AS (SELECT DISTINCT n FROM named WHERE length(n) >= 3),
live AS (SELECT id, material_code AS code, material_name AS raw, lower(material_name) AS low
         FROM golden WHERE status = 'active'),
exact AS (
  SELECT n, code, raw FROM (
    SELECT n, code, raw, row_number() OVER (PARTITION BY n ORDER BY code) AS place
    FROM names JOIN live ON low = n) WHERE place <= 5),
words AS (SELECT low, list_distinct(regexp_split_to_array(low, '{SPACE}')) AS b FROM (SELECT DISTINCT low FROM live)),
pairs AS (
  SELECT n, low, CAST(len(list_intersect(a, b)) AS DOUBLE) / greatest(len(a), len(b)) AS score
  FROM (SELECT n, list_distinct(regexp_split_to_array(n, '{SPACE}')) AS a FROM names WHERE length(n) >= 4)
  JOIN words ON contains(low, substr(n, 1, 4)) AND low <> n),
scored AS (SELECT n, code, raw, score FROM pairs JOIN live USING (low) WHERE score >= 0.5),
near AS (
  SELECT n, code, raw, score FROM (
    SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, code) AS place FROM scored) WHERE place <= 5),
hits AS (
  SELECT n, code, raw, 1.0::DOUBLE AS similarity, '名称完全相同' AS reason, 0 AS src FROM exact
  UNION ALL
  SELECT n, code, raw, {ROUNDED}, '关键词重叠 ' || CAST(trunc(score * 100) AS INTEGER) || '%', 1 FROM scored),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n ORDER BY similarity DESC, src, code) AS place FROM (
    SELECT *, row_number() OVER (PARTITION BY n, code ORDER BY similarity DESC, src) AS copy
    FROM hits) WHERE copy = 1),
flags AS (
  SELECT id, coalesce(bool_or(similarity >= 0.8 AND place <= 3), FALSE) AS is_duplicate,
         coalesce(max(similarity), 0.0) AS confidence
  FROM named LEFT JOIN ranked USING (n) GROUP BY id)"""
oracle("dedup_exact", "applications golden",
       "SELECT id, code AS material_code FROM named JOIN exact USING (n)", DEDUP)
oracle("dedup_containment", "applications golden",
       "SELECT id, code AS material_code, round(score, 6) AS score FROM named JOIN near USING (n)", DEDUP)
oracle("dedup_result", "applications golden", """
SELECT id, place AS rank, code AS material_code, raw AS material_name, similarity, reason
FROM named JOIN ranked USING (n) WHERE place <= 5""", DEDUP)
oracle("dedup_flags", "applications golden", "SELECT * FROM flags", DEDUP)
oracle("stream_dedup", "applications golden", "SELECT * FROM flags", DEDUP)

# ---- numbers and codes ------------------------------------------------------------


def padded(number: str, width: str) -> str:
    return (f"CASE WHEN length(CAST({number} AS VARCHAR)) >= {width} THEN CAST({number} AS VARCHAR) "
            f"ELSE lpad(CAST({number} AS VARCHAR), {width}, '0') END")


def app_numbers(used: str) -> str:
    return f"""
SELECT id, 'SQ-' || y || '-' || {padded('n', '5')} AS app_no FROM (
  SELECT id, y, row_number() OVER (PARTITION BY y ORDER BY created_at, id) + coalesce(used, 0) AS n
  FROM (SELECT id, created_at, year(created_at) AS y FROM applications
        WHERE status NOT IN ('rejected', 'published'))
  LEFT JOIN (SELECT year(created_at) AS y, {used} AS used FROM applications
             WHERE status IN ('rejected', 'published') GROUP BY 1) USING (y))"""


oracle("app_numbers", "applications", app_numbers("max(CAST(split_part(app_no, '-', 3) AS BIGINT))"))
oracle("app_numbers_counted", "applications", app_numbers("max(CAST(split_part(app_no, '-', 3) AS BIGINT))"))
oracle("counters_after", "applications", """
SELECT stem, count(*) AS issued, max(n) AS highest FROM (
  SELECT 'SQ-' || year(created_at) || '-' AS stem, CAST(split_part(app_no, '-', 3) AS BIGINT) AS n
  FROM applications WHERE status IN ('rejected', 'published')
  UNION ALL
  SELECT 'SQ-' || year(created_at) || '-', row_number() OVER (PARTITION BY year(created_at) ORDER BY created_at, id) + coalesce(used, 0)
  FROM (SELECT * FROM applications WHERE status NOT IN ('rejected', 'published'))
  LEFT JOIN (SELECT year(created_at) AS y, max(CAST(split_part(app_no, '-', 3) AS BIGINT)) AS used FROM applications
             WHERE status IN ('rejected', 'published') GROUP BY 1) ON y = year(created_at)) GROUP BY stem""")
BATCHES = """
placed AS (
  SELECT id, 'SQ-' || year(created_at) || '-' AS stem,
         row_number() OVER (PARTITION BY year(created_at) ORDER BY status <> 'draft', created_at, id) AS n FROM applications)"""
oracle("create_batches", "applications", f"SELECT id, stem || {padded('n', '5')} AS app_no FROM placed", BATCHES)
oracle("create_counters", "applications", "SELECT stem, count(*) AS issued, max(n) AS highest FROM placed GROUP BY stem", BATCHES)
oracle("app_numbers_by_count", "applications", app_numbers("count(*)"))

STEPS = f"""
numbered AS (
  SELECT l.id, coalesce(a.app_no, 'UNKNOWN') AS app_no, l.step_name, l.status,
         row_number() OVER (PARTITION BY coalesce(a.app_no, 'UNKNOWN') ORDER BY executed_at, l.id)
         + coalesce(old, 0) AS n
  FROM logs l LEFT JOIN applications a ON a.id = l.application_id
  LEFT JOIN (SELECT regexp_extract(step_id, '^(.*)-S', 1) AS no, count(*) AS old
             FROM old_logs GROUP BY 1) ON no = a.app_no)"""
STEP_TABLES = "applications logs old_logs"
oracle("step_ids", STEP_TABLES, "SELECT id, app_no || '-S' || n AS step_id FROM numbered", STEPS)
oracle("step_ids_counted", STEP_TABLES, "SELECT id, app_no || '-S' || n AS step_id FROM numbered", STEPS)
oracle("audit_records", STEP_TABLES, f"""
SELECT id, app_no || '-S' || n AS step_id, step_name, {STEP} AS step_label, status,
       {STATUS} AS status_label FROM numbered""", STEPS)


def code_ctes(requests: str, issued: str = "applications") -> str:
    """Codes of ``requests (id, classification_id, material_type, created_at, named)``."""
    return f"""{MAJOR},{RULE_OF_CLASS},
requests AS ({requests}),
resolved AS (
  SELECT q.*, m.code AS minor, m.major_code AS major,
         CASE WHEN q.named IS NOT NULL THEN r.id ELSE c.id END AS rule_id
  FROM requests q LEFT JOIN majors m ON m.id = q.classification_id
  LEFT JOIN rules r ON r.id = q.named
  LEFT JOIN class_rule c ON c.classification_id = q.classification_id),
stems AS (
  SELECT regexp_extract(material_code, '^(.+-)([0-9]+)$', 1) AS stem,
         max(CAST(nullif(regexp_extract(material_code, '^(.+-)([0-9]+)$', 2), '') AS BIGINT)) AS top
  FROM (SELECT material_code FROM golden
        UNION ALL SELECT material_code FROM {issued} WHERE material_code IS NOT NULL) GROUP BY 1),
based AS (
  SELECT s.*, t.pattern, t.prefix, t.suffix, t.seq_length,
         CASE WHEN s.rule_id IS NOT NULL THEN t.current_seq
              ELSE greatest(coalesce(top, 0), (SELECT count(*) FROM golden g
                                               WHERE g.classification_id = s.classification_id)) END
         + row_number() OVER (PARTITION BY coalesce(s.rule_id, 'class ' || s.classification_id)
                              ORDER BY s.created_at, s.id) AS seq
  FROM resolved s LEFT JOIN rules t ON t.id = s.rule_id
  LEFT JOIN stems ON stem = s.major || '-' || s.minor || '-'
  WHERE s.minor IS NOT NULL),
codes AS (
  SELECT id, rule_id, seq, CASE WHEN rule_id IS NULL
    THEN major || '-' || minor || '-' || {padded('seq', '5')}
    ELSE coalesce(prefix, '') || replace(replace(replace(replace(replace(pattern,
      '{{大类}}', major), '{{小类}}', minor), '{{流水}}', {padded('seq', 'seq_length')}),
      '{{类型}}', upper(substr(material_type, 1, 3))), '{{年份}}', '26') || coalesce(suffix, '')
    END AS material_code FROM based
  UNION ALL SELECT id, NULL, NULL, NULL FROM resolved WHERE minor IS NULL)"""


ALL_CODES = code_ctes("""SELECT id, classification_id, material_type, created_at,
  CASE WHEN status = 'rejected' AND classification_id IS NOT NULL
       THEN 'rule-a-' || classification_id END AS named
  FROM applications WHERE material_type IS NOT NULL""")
CODE_TABLES = "applications classifications golden rules"
NEXT = """SELECT id, greatest(current_seq, coalesce(
  (SELECT max(seq) FROM codes WHERE codes.rule_id = rules.id), 0)) AS current_seq FROM rules"""
oracle("rule_codes", CODE_TABLES,
       "SELECT id, material_code, rule_id, seq FROM codes WHERE rule_id IS NOT NULL", ALL_CODES)
oracle("default_codes", CODE_TABLES,
       "SELECT id, material_code, rule_id, seq FROM codes WHERE rule_id IS NULL", ALL_CODES)
oracle("next_rules", CODE_TABLES, NEXT, ALL_CODES)

# ---- audit ------------------------------------------------------------------------

oracle("label_audit", "applications", f"""
SELECT id, status, {case_label('status', C.APPLICATION_STATUS_LABELS)} AS status_label
FROM applications""")

TRACE = f"""
trace AS (
  SELECT a.id AS application_id, a.app_no, a.material_name, a.material_code, a.status,
         coalesce(l.steps, 0) AS step_count, l.last_step, l.last_status, l.last_at
  FROM applications a LEFT JOIN (
    SELECT application_id, steps, step_label AS last_step, status AS last_status, executed_at AS last_at
    FROM (SELECT *, {STEP} AS step_label, count(*) OVER (PARTITION BY application_id) AS steps,
                 row_number() OVER (PARTITION BY application_id ORDER BY executed_at DESC, id DESC) AS place
          FROM logs WHERE application_id IS NOT NULL) WHERE place = 1) l
  ON l.application_id = a.id)"""
oracle("trace_summary", "applications logs", f"""
SELECT application_id, app_no, material_name, material_code, status, step_count, last_step,
       last_status, {iso('last_at')} AS last_executed_at FROM trace""", TRACE)

oracle("audit_trace", "logs", f"""
SELECT application_id, step_id, step_name, {STEP} AS step_label, executed_by,
       CAST(NULL AS VARCHAR) AS executed_by_name, {iso('executed_at')} AS executed_at, status,
       {STATUS} AS status_label, CAST(NULL AS VARCHAR) AS error_message FROM logs""")

LATEST = """
latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY application_id, step_name
                                              ORDER BY executed_at DESC, id DESC) AS place
                 FROM logs WHERE application_id IS NOT NULL) WHERE place = 1)"""
oracle("latest_step", "logs", f"""
SELECT application_id, step_name, id, status, {iso('executed_at')} AS at FROM latest""", LATEST)

# ---- lifecycle --------------------------------------------------------------------

# the machine and its roles, written out apart from the library's tables
MACHINE = """machine(source, action, target) AS (VALUES
  ('draft', 'submit', 'pending_admin'), ('pending_admin', 'admin_approve', 'pending_dept'),
  ('pending_admin', 'admin_reject', 'rejected'), ('pending_dept', 'dept_approve', 'approved'),
  ('pending_dept', 'dept_reject', 'rejected'), ('approved', 'publish', 'published')),
may(action, role) AS (VALUES
  ('submit', 'applicant'), ('submit', 'admin'), ('submit', 'data_admin'),
  ('admin_approve', 'admin'), ('admin_approve', 'data_admin'),
  ('admin_reject', 'admin'), ('admin_reject', 'data_admin'),
  ('dept_approve', 'dept_approver'), ('dept_approve', 'admin'), ('dept_approve', 'data_admin'),
  ('dept_reject', 'dept_approver'), ('dept_reject', 'admin'), ('dept_reject', 'data_admin'),
  ('publish', 'admin'), ('publish', 'data_admin'))"""
ALLOWED = """coalesce(
  (action, (SELECT role FROM principals WHERE user_id = acted_by)) IN (SELECT (action, role) FROM may), FALSE)"""


WALK = f"""{MACHINE},
seq AS (
  SELECT app_id, event_id, action, {ALLOWED} AS allowed,
         row_number() OVER (PARTITION BY app_id ORDER BY "at", event_id) AS n FROM actions),
walked AS (
  SELECT app_id, CAST(NULL AS VARCHAR) AS event_id, CAST(NULL AS VARCHAR) AS action, TRUE AS allowed,
         CAST(0 AS BIGINT) AS n, 'draft' AS source, 'draft' AS target, FALSE AS taken
  FROM (SELECT DISTINCT app_id FROM actions)
  UNION ALL
  SELECT s.app_id, s.event_id, s.action, s.allowed, s.n, w.target,
         CASE WHEN s.allowed AND m.target IS NOT NULL THEN m.target ELSE w.target END,
         s.allowed AND m.target IS NOT NULL
  FROM walked w JOIN seq s ON s.app_id = w.app_id AND s.n = w.n + 1
  LEFT JOIN machine m ON m.source = w.target AND m.action = s.action)"""


def recursive(name: str) -> None:
    ORACLES[name] = ORACLES[name].replace("WITH ", "WITH RECURSIVE ", 1)


oracle("lifecycle_state", "actions principals", """
SELECT app_id, arg_max(target, n) AS status, count(*) FILTER (WHERE taken) AS taken
FROM walked GROUP BY app_id""", WALK)
oracle("lifecycle_taken", "actions principals", """
SELECT app_id, event_id, action, source, target FROM walked WHERE taken""", WALK)
oracle("refused_actions", "actions principals", """
SELECT app_id, event_id, action, source AS status,
       CASE WHEN allowed THEN 'status' ELSE 'role' END AS reason
FROM walked WHERE n > 0 AND NOT taken""", WALK)
oracle("stream_lifecycle", "actions principals", """
SELECT app_id, event_id, action, source, target, taken FROM walked WHERE n > 0""", WALK)
for walked in ("lifecycle_state", "lifecycle_taken", "refused_actions", "stream_lifecycle"):
    recursive(walked)

# ---- dashboard and overview -------------------------------------------------------

oracle("dashboard_stats", "applications golden classifications", """
SELECT (SELECT count(*) FROM applications) AS total_applications,
  (SELECT count(*) FROM applications WHERE status = 'pending_admin') AS pending_admin,
  (SELECT count(*) FROM applications WHERE status = 'pending_dept') AS pending_dept,
  (SELECT count(*) FROM applications WHERE status = 'approved') AS approved,
  (SELECT count(*) FROM applications WHERE status = 'rejected') AS rejected,
  (SELECT count(*) FROM applications WHERE status = 'published') AS published,
  (SELECT count(*) FROM golden) AS total_golden_records,
  (SELECT count(*) FROM classifications WHERE is_active) AS total_classifications,
  (SELECT count(*) FROM applications WHERE status LIKE 'pending%') AS pending""")

oracle("recent_applications", "applications", """
SELECT id, app_no, status FROM applications ORDER BY created_at DESC, id LIMIT 5""")
oracle("recent_audit", "logs", """
SELECT id, step_name, status FROM logs ORDER BY executed_at DESC, id LIMIT 10""")

oracle("catalog", "golden classifications", f"""
SELECT golden.id, application_id, material_code, material_name, material_type,
       coalesce(nullif(classification_path, ''), path, '') AS classification_path,
       CASE WHEN attribute_values LIKE '{{"brand"%' THEN 2 ELSE 0 END AS attribute_count,
       status, version, revision, btp_published, CAST(NULL AS VARCHAR) AS btp_published_at,
       om_synced, CAST(NULL AS VARCHAR) AS om_synced_at, {FQN} AS om_entity_fqn,
       {iso('created_at')} AS created_at
FROM golden LEFT JOIN paths ON paths.id = classification_id""", PATHS)

NODES = """
nodes AS (
  SELECT 'source-applications' AS id, '物料申请' AS label, 'source' AS type, CAST(NULL AS VARCHAR) AS subtitle
  UNION ALL SELECT 'btp', 'BTP', 'external', NULL
  UNION ALL SELECT 'openmetadata', 'OpenMetadata', 'external', NULL
  UNION ALL SELECT 'app-' || application_id, coalesce(a.app_no, application_id), 'application',
    CASE WHEN a.id IS NULL THEN g.material_name ELSE a.material_name END
  FROM golden g LEFT JOIN applications a ON a.id = g.application_id WHERE application_id IS NOT NULL
  UNION ALL SELECT 'gr-' || id, material_code, 'golden_record', material_name FROM golden),
edges AS (
  SELECT 'app-' || application_id AS "from", 'gr-' || id AS "to", '审批通过后生成' AS label
  FROM golden WHERE application_id IS NOT NULL
  UNION ALL SELECT 'gr-' || id, 'btp', '发布' FROM golden WHERE btp_published
  UNION ALL SELECT 'gr-' || id, 'openmetadata', '同步元数据' FROM golden
  WHERE om_synced OR coalesce(om_entity_fqn, '') <> '')"""
oracle("lineage_nodes", "golden applications", "SELECT * FROM nodes", NODES)
oracle("lineage_edges", "golden applications", "SELECT * FROM edges", NODES)
oracle("lineage_view", "golden applications", """
SELECT e."from", e."to", e.label, f.label AS from_label, coalesce(f.subtitle, f.type) AS from_subtitle,
       t.label AS to_label, coalesce(t.subtitle, t.type) AS to_subtitle
FROM edges e LEFT JOIN nodes f ON f.id = e."from" LEFT JOIN nodes t ON t.id = e."to" """, NODES)

HISTORY = LATEST + f""",
history AS (
  SELECT 'validate-' || g.id AS id, material_code, '申请质量校验' AS test_name,
    CASE WHEN l.details LIKE '%"passed": true%' THEN 'passed' ELSE 'failed' END AS status,
    CASE WHEN l.details LIKE '%"errors": []%' THEN '质量规则通过'
         ELSE replace(l.executed_by, 'U', 'e') || '; low value' END AS message,
    {iso('l.executed_at')} AS executed_at, 'validator' AS source
  FROM golden g JOIN latest l USING (application_id)
  WHERE l.step_name = 'validate' AND l.details IS NOT NULL AND l.details <> '{{}}'
  UNION ALL
  SELECT 'om-' || g.id || '-' || i, material_code, CASE i WHEN 0 THEN 't1' ELSE 'OpenMetadata质量测试' END,
    CASE i WHEN 0 THEN 'passed' ELSE 'failed' END, CASE i WHEN 0 THEN 'ok' ELSE 'bad' END,
    {iso('l.executed_at')}, 'OpenMetadata'
  FROM golden g JOIN latest l USING (application_id), (VALUES (0), (1)) two(i)
  WHERE l.step_name = 'om_test' AND l.details LIKE '%"t1"%')"""
oracle("quality_history", "golden logs", "SELECT * FROM history", HISTORY)
oracle("overview_summary", "golden logs applications", """
SELECT (SELECT count(*) FROM golden) AS metadata_assets,
  (SELECT count(*) FROM golden WHERE om_synced) AS om_synced,
  (SELECT count(*) FROM golden WHERE btp_published) AS btp_published,
  (SELECT count(*) FROM history) AS quality_tests,
  (SELECT count(*) FROM applications WHERE id IN (SELECT application_id FROM logs)) AS traceable_applications
""", HISTORY)

# ---- batch jobs -------------------------------------------------------------------

SUBMIT_TABLES = "applications classifications templates golden rules old_logs"
SUBMIT = CHECKS + "," + DEDUP + "," + code_ctes("""
  SELECT id, classification_id, material_type, created_at, CAST(NULL AS VARCHAR) AS named
  FROM applications JOIN summary USING (id) WHERE status = 'draft' AND validation_passed""") + """,
done AS (
  SELECT a.id, a.app_no, a.created_by, s.validation_passed, c.material_code,
         f.is_duplicate, f.confidence
  FROM applications a JOIN summary s USING (id) LEFT JOIN codes c USING (id)
  LEFT JOIN flags f USING (id) WHERE a.status = 'draft')"""
oracle("submit_batch", SUBMIT_TABLES, """
SELECT id, CASE WHEN validation_passed THEN 'pending_admin' ELSE 'draft' END AS status,
       material_code, validation_passed, validation_passed AND is_duplicate AS is_duplicate,
       CASE WHEN validation_passed THEN confidence END AS confidence,
       CASE WHEN validation_passed THEN '2026-05-01T12:00:00' END AS submitted_at
FROM done""", SUBMIT)
oracle("submit_rules", SUBMIT_TABLES, NEXT, SUBMIT)

OLD = """(SELECT count(*) FROM old_logs WHERE regexp_extract(step_id, '^(.*)-S', 1) = {0}.app_no)"""
oracle("submit_audit", SUBMIT_TABLES, f"""
SELECT app_no || '-S' || (place + old) AS step_id, id AS application_id, step_name,
       {STEP} AS step_label, CASE place WHEN 4 THEN created_by ELSE 'system' END AS executed_by,
       CASE WHEN validation_passed THEN 'success' ELSE 'failed' END AS status
FROM (SELECT *, {OLD.format('done')} AS old FROM done),
     (VALUES (1, 'validate'), (2, 'dedup_check'), (3, 'code_generate'), (4, 'submit')) s(place, step_name)
WHERE validation_passed OR place = 1""", SUBMIT)

JUDGED = """
judged_requests AS (
  SELECT r.*, CASE WHEN a.id IS NULL THEN 'unknown'
    WHEN p.role IS NULL OR p.role NOT IN ('applicant', 'admin', 'data_admin')
      OR (p.role = 'applicant' AND a.created_by <> acted_by) THEN 'role'
    WHEN a.status <> 'draft' THEN 'not_draft' END AS reason
  FROM requests r LEFT JOIN applications a ON a.id = r.application_id LEFT JOIN principals p ON p.user_id = acted_by)"""
oracle("submit_refused", "applications principals requests", """
SELECT id, application_id, acted_by, reason FROM judged_requests WHERE reason IS NOT NULL""", JUDGED)
oracle("submit_by_actor", "applications classifications templates principals requests old_logs", f"""
SELECT application_id, app_no || '-S' || (4 + {OLD.format('a')}) AS step_id, acted_by AS executed_by,
       acted_by_name AS executed_by_name
FROM judged_requests r JOIN applications a ON a.id = r.application_id JOIN summary s ON s.id = a.id
WHERE reason IS NULL AND s.validation_passed""", CHECKS + "," + JUDGED)
oracle("draft_audit", "applications principals requests old_logs", f"""
SELECT application_id, app_no || '-S' || (n + {OLD.format('r')}) AS step_id, 'save_draft' AS step_name, acted_by AS executed_by,
       'success' AS status
FROM (SELECT j.*, app_no, row_number() OVER (PARTITION BY application_id ORDER BY "at", j.id) AS n
      FROM judged_requests j JOIN applications a ON a.id = application_id WHERE reason IS NULL) r""", JUDGED)
oracle("draft_saved_as", "applications principals requests", """
SELECT a.id, (SELECT arg_max('by ' || acted_by, r."at") FROM judged_requests r WHERE r.application_id = a.id AND reason IS NULL) AS material_desc
FROM applications a""", JUDGED)
oracle("draft_refused_as", "applications principals requests", """
SELECT id AS save_id, application_id, acted_by, reason FROM judged_requests WHERE reason IS NOT NULL""", JUDGED)
oracle("create_audit", "applications old_logs", f"""
SELECT id AS application_id, app_no || '-S' || (1 + {OLD.format('a')}) AS step_id, 'create_draft' AS step_name,
       created_by AS executed_by, created_by_name AS executed_by_name, '{{"app_no":"' || app_no || '"}}' AS details
FROM applications a""")
oracle("upload_audit", "applications uploads old_logs", f"""
SELECT application_id, app_no || '-S' || (n + {OLD.format('u')}) AS step_id, 'save_draft' AS step_name, uploaded_by AS executed_by
FROM (SELECT u.*, app_no, row_number() OVER (PARTITION BY application_id ORDER BY uploaded_at, u.id) AS n
      FROM uploads u JOIN applications a ON a.id = application_id WHERE a.status = 'draft') u""")

PUBLISH = PATHS + """,
judged AS (
  SELECT a.*, path, CASE
    WHEN id IN (SELECT application_id FROM golden WHERE application_id IS NOT NULL) THEN 'recorded'
    WHEN coalesce(material_code, '') = '' THEN 'no_code'
    WHEN material_code IN (SELECT material_code FROM golden)
      OR id <> (SELECT min(id) FROM applications b WHERE b.status = 'approved' AND b.material_code = a.material_code)
      THEN 'code_taken'
    WHEN NOT complete THEN 'no_path' END AS reason
  FROM applications a LEFT JOIN (SELECT id AS pid, path, complete FROM paths) ON pid = classification_id
  WHERE status = 'approved'),
fresh AS (SELECT * FROM judged WHERE reason IS NULL)"""
PUBLISH_TABLES = "applications classifications golden old_logs"
oracle("publish_batch", PUBLISH_TABLES, """
SELECT 'gr-' || id AS id, id AS application_id, material_code, path AS classification_path,
       'active' AS status, 1 AS version, FALSE AS btp_published, FALSE AS om_synced FROM fresh""", PUBLISH)
oracle("publish_applications", PUBLISH_TABLES, """
SELECT id, 'published' AS status, '2026-05-01T12:00:00' AS updated_at FROM fresh""", PUBLISH)
oracle("publish_audit", PUBLISH_TABLES, f"""
SELECT app_no || '-S' || (1 + {OLD.format('fresh')}) AS step_id, 'gr-' || id AS golden_record_id,
       'create_gr' AS step_name, 'success' AS status FROM fresh""", PUBLISH)
oracle("publish_refused_audit", PUBLISH_TABLES, f"""
SELECT app_no || '-S' || (1 + {OLD.format('judged')}) AS step_id, id AS application_id, 'publish' AS step_name,
       'C1' AS executed_by, 'failed' AS status, reason AS error_message FROM judged WHERE reason IS NOT NULL""", PUBLISH)
oracle("publish_refused", PUBLISH_TABLES,
       "SELECT id, material_code, reason FROM judged WHERE reason IS NOT NULL", PUBLISH)

ANSWERS = PUBLISH + """,
last_answer AS (
  SELECT * FROM (SELECT r.*, row_number() OVER (PARTITION BY golden_record_id, system
                                                ORDER BY "at" DESC, result_id DESC) AS place FROM results r)
  WHERE place = 1),
heard AS (
  SELECT f.*, 'gr-' || f.id AS gid, b.success AS b_ok, b.reference AS b_ref, b."at" AS b_at, b.error_message AS b_error,
         o.success AS o_ok, o.reference AS o_ref, o."at" AS o_at
  FROM fresh f LEFT JOIN last_answer b ON b.golden_record_id = 'gr-' || f.id AND b.system = 'btp'
  LEFT JOIN last_answer o ON o.golden_record_id = 'gr-' || f.id AND o.system = 'openmetadata')"""
RESULT_TABLES = PUBLISH_TABLES + " results"
oracle("publish_results", RESULT_TABLES, f"""
SELECT gid AS id, coalesce(b_ok, FALSE) AS btp_published, CASE WHEN b_ok THEN b_ref END AS btp_sync_id,
       CASE WHEN b_ok THEN {iso('b_at')} END AS btp_published_at, coalesce(o_ok, FALSE) AS om_synced,
       CASE WHEN o_ok THEN o_ref END AS om_entity_fqn,
       CASE WHEN b_ok OR o_ok THEN {iso('greatest(b_at, o_at)')} ELSE '2026-05-01T12:00:00' END AS updated_at
FROM heard""", ANSWERS)
oracle("publish_result_audit", RESULT_TABLES, f"""
SELECT id AS application_id, gid AS golden_record_id,
       app_no || '-S' || (1 + row_number() OVER (PARTITION BY id ORDER BY place)) AS step_id,
       step_name, CASE WHEN ok THEN 'success' ELSE 'failed' END AS status, error_message,
       {iso('t')} AS executed_at
FROM (SELECT id, gid, app_no, 1 AS place, 'publish_btp' AS step_name, b_ok AS ok, b_at AS t, b_error AS error_message
      FROM heard WHERE b_at IS NOT NULL
      UNION ALL SELECT id, gid, app_no, 2, 'sync_om', o_ok, o_at, NULL FROM heard WHERE o_at IS NOT NULL
      UNION ALL SELECT id, gid, app_no, 3, 'om_test', length(coalesce(material_name, '')) BETWEEN 5 AND 200
        AND coalesce(classification_id, '') <> '' AND coalesce(material_code, '') <> '', o_at, NULL
      FROM heard WHERE o_at IS NOT NULL)""", ANSWERS)
oracle("external_log", "results", f"""
SELECT 'ext-' || result_id AS id, system AS system_name,
       CASE system WHEN 'btp' THEN 'publish' ELSE 'sync' END AS operation, golden_record_id AS entity_id,
       CASE WHEN success THEN 'success' ELSE 'failed' END AS status, error_message, {iso('"at"')} AS executed_at
FROM results""")

DECIDED = f"""{MACHINE},
once AS (SELECT *, stage || CASE approved WHEN TRUE THEN '_approve' WHEN FALSE THEN '_reject' END AS action
         FROM decisions),
seq AS (SELECT *, {ALLOWED} AS allowed, row_number() OVER (PARTITION BY application_id ORDER BY "at", decision_id) AS n FROM once),
walked AS (
  SELECT id AS application_id, CAST(0 AS BIGINT) AS n, status AS source, status AS target,
         CAST(NULL AS VARCHAR) AS decision_id, FALSE AS taken FROM applications
  UNION ALL
  SELECT s.application_id, s.n, w.target, coalesce(m.target, w.target), s.decision_id, m.target IS NOT NULL
  FROM walked w JOIN seq s ON s.application_id = w.application_id AND s.n = w.n + 1
  LEFT JOIN machine m ON m.source = w.target AND m.action = s.action AND s.allowed),
effective AS (SELECT seq.* FROM seq JOIN walked USING (decision_id) WHERE taken),
final AS (SELECT application_id AS id, arg_max(target, n) AS status FROM walked GROUP BY 1)"""
oracle("approve_batch", "applications decisions principals", f"""
SELECT id, f.status, coalesce(a.approved, FALSE) AS admin_approved, a.acted_by AS admin_approved_by,
       a.comment AS admin_comment, coalesce(d.approved, FALSE) AS dept_approved,
       d.acted_by AS dept_approved_by, d.comment AS dept_comment,
       {iso('greatest(a."at", d."at")')} AS updated_at
FROM final f LEFT JOIN effective a ON a.application_id = id AND a.stage = 'admin'
LEFT JOIN effective d ON d.application_id = id AND d.stage = 'dept'""", DECIDED)
oracle("approve_audit", "applications decisions principals old_logs", f"""
SELECT application_id, app_no || '-S' || (old + place) AS step_id, step_name,
       {STEP} AS step_label, status FROM (
  SELECT application_id, app_no, stage || '_approve' AS step_name,
         CASE WHEN approved THEN 'success' ELSE 'failed' END AS status, {OLD.format('p')} AS old,
         row_number() OVER (PARTITION BY application_id ORDER BY "at", decision_id) AS place
  FROM effective JOIN applications p ON p.id = application_id)""", DECIDED)
oracle("approve_refused", "applications decisions principals", """
SELECT application_id AS app_id, decision_id AS event_id, action, source AS status,
       CASE WHEN action IS NULL THEN 'no_decision' WHEN allowed THEN 'status' ELSE 'role' END AS reason
FROM walked JOIN seq USING (application_id, decision_id) WHERE NOT taken""", DECIDED)
for walked in ("approve_batch", "approve_audit", "approve_refused"):
    recursive(walked)

# ---- table writes, schema evolution, feeds ----------------------------------------

FOLDED = "folded AS (SELECT id, " + ", ".join(
    f"arg_max({c}, (line, part, supp, price)) FILTER (WHERE {c} IS NOT NULL) AS new_{c[9:]}"
    for c in ("material_name", "material_desc", "material_type")) + " FROM patches GROUP BY id)"
oracle("draft_patch", "applications patches", f"""
SELECT id, CASE WHEN status = 'draft' THEN coalesce(new_name, material_name) ELSE material_name END AS material_name,
  CASE WHEN status = 'draft' THEN new_desc END AS material_desc,
  CASE WHEN status = 'draft' THEN coalesce(new_type, material_type) ELSE material_type END AS material_type,
  status, CASE WHEN status = 'draft' AND folded.id IS NOT NULL THEN '2026-05-01T12:00:00'
               ELSE {iso('created_at')} END AS updated_at
FROM applications LEFT JOIN folded USING (id)""", FOLDED)
oracle("draft_patch_refused", "applications patches", """
SELECT DISTINCT p.id, status, CASE WHEN status IS NULL THEN 'unknown' ELSE 'not_draft' END AS reason
FROM patches p LEFT JOIN applications a ON a.id = p.id WHERE status IS NULL OR status <> 'draft'""")

oracle("record_patch", "golden", f"""
SELECT id, CASE WHEN p_size BETWEEN 21 AND 40 THEN CASE WHEN p_size > 25 THEN p_brand END
                ELSE material_name END AS material_name,
       CASE WHEN p_size > 40 THEN 'obsolete' ELSE status END AS status,
       CASE WHEN p_size > 20 THEN '2026-05-01T12:00:00' ELSE {iso('created_at')} END AS updated_at
FROM golden JOIN part ON id = 'G' || p_partkey""")

FILES = """
files AS (
  SELECT u.*, CASE WHEN file_name = '' THEN 'attachment' WHEN file_name = 'folder/' THEN 'folder'
           ELSE replace(split_part(file_name, '/', -1), chr(92), '_') END AS safe
  FROM uploads u JOIN applications a ON a.id = u.application_id WHERE a.status = 'draft')"""
oracle("attachments_flat", "applications uploads", f"""
SELECT application_id, id AS attachment_id, safe AS original_name, id || '-' || safe AS stored_name,
       coalesce(nullif(content_type, ''), 'application/octet-stream') AS content_type, size,
       uploaded_by, uploaded_by_name, {iso('uploaded_at')} AS uploaded_at,
       '/api/applications/' || application_id || '/attachments/' || id AS download_url FROM files""", FILES)
oracle("attachments_appended", "applications uploads", """
SELECT application_id, id AS attachment_id, safe AS original_name, size FROM files""", FILES)
oracle("attachment_sizes", "applications uploads", """
SELECT a.id AS application_id, count(f.id) AS files, CAST(coalesce(sum(size), 0) AS BIGINT) AS total_size
FROM applications a LEFT JOIN files f ON f.application_id = a.id GROUP BY a.id""", FILES)
oracle("schema_evolve", "applications", """
SELECT id, app_no, status, CAST(CASE status WHEN 'draft' THEN 1 ELSE 0 END AS BIGINT) AS files,
       CASE status WHEN 'draft' THEN 'paper-' || id END AS first_file
FROM applications WHERE status IN ('draft', 'published')""")

oracle("backfill_templates", "templates", """
SELECT id || '-S' || s_suppkey AS id, 'S' || s_suppkey AS classification_id, field_name, is_required,
       sort_order FROM supplier JOIN templates ON classification_id = 'N' || s_nationkey""")
LEVEL = """SELECT 'K' || c_custkey AS id, 'N' || c_nationkey AS parent_id, 3 AS level, TRUE AS is_active
FROM customer WHERE c_mktsegment <> 'BUILDING'"""
oracle("backfill_level", "", LEVEL)
oracle("backfill_level_guarded", "classifications",
       LEVEL + " AND NOT EXISTS (SELECT 1 FROM classifications WHERE level = 3) UNION ALL "
       + LEVEL.replace("3 AS level", "4 AS level")
       + " AND NOT EXISTS (SELECT 1 FROM classifications WHERE level = 4)")

oracle("publish_feed", "golden", """
SELECT id AS golden_record_id, material_code, material_name, 'published' AS status,
       CAST(version AS BIGINT) AS version, 'SAP-S4HANA,SAP-Ariba' AS targets FROM golden""")
oracle("catalog_feed", "golden", """
SELECT id AS golden_record_id, material_code, 'catalog.Material.' || material_code AS entity_fqn
FROM golden""")

# ---- streams ----------------------------------------------------------------------

oracle("stream_audit_dedup", "logs", "SELECT id, step_name, status FROM logs")
oracle("stream_status_counts", "applications",
       "SELECT status, count(*) AS applications FROM applications GROUP BY status")
oracle("stream_step_counts", "logs",
       "SELECT step_name, status, count(*) AS steps FROM logs GROUP BY step_name, status")

for climbing in (
    "classification_path", "classification_path_deep", "catalog", "publish_batch", "publish_applications",
    "publish_audit", "publish_refused", "publish_refused_audit", "publish_results", "publish_result_audit",
):
    recursive(climbing)
