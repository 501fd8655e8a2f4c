"""Explicit table schemas, column defaults and field constraints."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, L, B, TS = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType(), T.TimestampType()


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


CHECKS = T.ArrayType(_schema(check=S, passed=B, message=S))
VALIDATION_RESULT = _schema(passed=B, checks=CHECKS, errors=T.ArrayType(S))
SIMILAR = T.ArrayType(
    _schema(material_code=S, material_name=S, similarity=T.DoubleType(), reason=S)
)
DEDUP_RESULT = _schema(is_duplicate=B, confidence=T.DoubleType(), similar_materials=SIMILAR)
ATTACHMENTS = T.ArrayType(
    _schema(
        id=S, original_name=S, stored_name=S, content_type=S, size=L,
        uploaded_by=S, uploaded_by_name=S, uploaded_at=S, download_url=S,
    )
)

CLASSIFICATIONS = _schema(
    id=S, parent_id=S, code=S, name=S, level=I, is_active=B, description=S,
    created_at=TS, updated_at=TS,
)
TEMPLATES = _schema(
    id=S, classification_id=S, field_name=S, field_label=S, field_type=S, is_required=B,
    default_value=S, options=T.ArrayType(S), sort_order=I, description=S,
)
APPLICATIONS = _schema(
    id=S, app_no=S, material_name=S, material_desc=S, classification_id=S, material_type=S,
    attribute_values=S, attachments=ATTACHMENTS, material_code=S, code_rule_id=S, status=S,
    validation_result=VALIDATION_RESULT, validation_passed=B, dedup_result=DEDUP_RESULT,
    is_duplicate=B, created_by=S, created_by_name=S, department=S, created_at=TS, updated_at=TS,
    submitted_at=TS, admin_approved_by=S, admin_approved_at=TS, admin_approved=B, admin_comment=S,
    dept_approved_by=S, dept_approved_at=TS, dept_approved=B, dept_comment=S,
)
CODE_RULES = _schema(
    id=S, name=S, pattern=S, prefix=S, suffix=S, current_seq=L, seq_length=I,
    classification_id=S, is_active=B, description=S,
)
GOLDEN_RECORDS = _schema(
    id=S, application_id=S, material_code=S, material_name=S, material_desc=S,
    classification_id=S, classification_path=S, attribute_values=S, material_type=S, status=S,
    version=I, revision=I, btp_published=B, btp_published_at=TS, btp_sync_id=S, om_synced=B,
    om_synced_at=TS, om_entity_fqn=S, created_by=S, created_at=TS, updated_by=S, updated_at=TS,
)
AUDIT_LOGS = _schema(
    id=S, step_id=S, application_id=S, golden_record_id=S, step_name=S, step_label=S,
    executed_by=S, executed_by_name=S, executed_at=TS, status=S, status_label=S, details=S,
    error_message=S,
)
EXTERNAL_LOGS = _schema(
    id=S, system_name=S, operation=S, entity_type=S, entity_id=S, request_payload=S,
    response_payload=S, status=S, status_code=I, error_message=S, executed_at=TS, duration_ms=I,
)
PRINCIPALS = _schema(user_id=S, name=S, department=S, role=S)

TABLES = {
    "material_classifications": CLASSIFICATIONS,
    "attribute_templates": TEMPLATES,
    "material_applications": APPLICATIONS,
    "code_rules": CODE_RULES,
    "golden_records": GOLDEN_RECORDS,
    "audit_logs": AUDIT_LOGS,
    "external_system_logs": EXTERNAL_LOGS,
    "principals": PRINCIPALS,
}

# Values an insert takes for columns it leaves out.
DEFAULTS = {
    "material_classifications": {"is_active": True},
    "attribute_templates": {"is_required": False, "sort_order": 0},
    "material_applications": {
        "status": "draft", "validation_passed": False, "is_duplicate": False,
        "admin_approved": False, "dept_approved": False,
    },
    "code_rules": {"current_seq": 0, "seq_length": 5, "is_active": True},
    "golden_records": {
        "status": "active", "version": 1, "revision": 1,
        "btp_published": False, "om_synced": False,
    },
    "audit_logs": {},
    "external_system_logs": {},
    "principals": {},
}
