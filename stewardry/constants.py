"""Texts and codes that results are defined by."""

# ---- enumerations -----------------------------------------------------------------
MATERIAL_TYPES = ["raw", "semi", "finished", "auxiliary", "spare"]
FIELD_TYPES = ["text", "number", "date", "select", "boolean"]
APPLICATION_STATUSES = [
    "draft", "pending_admin", "pending_dept", "approved", "rejected", "published",
]
GOLDEN_STATUSES = ["active", "obsolete"]

# ---- labels -----------------------------------------------------------------------
STEP_LABELS = {
    "create_draft": "创建草稿",
    "save_draft": "保存草稿",
    "submit": "提交申请",
    "validate": "质量校验",
    "dedup_check": "重复预检",
    "code_generate": "编码生成",
    "admin_approve": "管理员审批",
    "dept_approve": "使用部门审批",
    "create_gr": "创建Golden Record",
    "publish_btp": "BTP发布",
    "sync_om": "OpenMetadata同步",
    "om_test": "质量测试",
    "revoke": "撤销",
    "edit": "编辑",
    "revise": "修订",
}
STATUS_LABELS = {"success": "成功", "failed": "失败", "pending": "处理中"}
APPLICATION_STATUS_LABELS = {
    "draft": "草稿",
    "pending_admin": "待管理员审批",
    "pending_dept": "待部门审批",
    "approved": "已通过",
    "rejected": "已驳回",
    "published": "已发布",
}
LEVEL_LABELS = {1: "大类", 2: "中类", 3: "小类"}

# ---- validation texts -------------------------------------------------------------
NAME_MIN, NAME_MAX = 5, 200
MSG_REQUIRED_MISSING = "必填字段缺失: "
MSG_REQUIRED_EMPTY = " 不能为空"
MSG_REQUIRED_OK = " 已填写"
MSG_NAME_TOO_SHORT = "物料名称太短（至少5个字符）"
MSG_NAME_TOO_LONG = "物料名称太长（最多200个字符）"
MSG_NAME_LENGTH = "名称长度 "
MSG_NAME_OK = "名称长度合规"
MSG_CLASS_UNKNOWN = "所选分类不存在"
MSG_CLASS_MISSING = "分类不存在"
MSG_CLASS_OK = "分类: "
MSG_TYPE_UNKNOWN = "无效的物料类型: "
MSG_TYPE_INVALID = "无效类型: "
MSG_TYPE_OK = "类型: "
MSG_ATTRIBUTE_MISSING = "必填属性缺失: "
MSG_ATTRIBUTE_EMPTY = " 必填"

# ---- duplicate detection ----------------------------------------------------------
MIN_NAME_CHARS = 3
PREFIX_CHARS = 4
TOP_HITS, FLAG_HITS = 5, 3
KEEP_SCORE, FLAG_SCORE = 0.5, 0.8
REASON_EXACT = "名称完全相同"
REASON_OVERLAP = "关键词重叠 "

# ---- code patterns ----------------------------------------------------------------
SLOT_MAJOR, SLOT_MINOR, SLOT_SEQUENCE, SLOT_TYPE, SLOT_YEAR = (
    "{大类}", "{小类}", "{流水}", "{类型}", "{年份}",
)
NO_PARENT_CODE = "00"
DEFAULT_SEQUENCE_WIDTH = 5
APP_NO_PREFIX = "SQ"
APP_NO_WIDTH = 5
UNKNOWN_APP_NO = "UNKNOWN"

# ---- lifecycle --------------------------------------------------------------------
TRANSITIONS = [
    ("draft", "submit", "pending_admin"),
    ("pending_admin", "admin_approve", "pending_dept"),
    ("pending_admin", "admin_reject", "rejected"),
    ("pending_dept", "dept_approve", "approved"),
    ("pending_dept", "dept_reject", "rejected"),
    ("approved", "publish", "published"),
]
APPLICANT_ROLES = ["applicant", "admin", "data_admin"]
ADMIN_ROLES = ["admin", "data_admin"]
DEPT_ROLES = ["dept_approver", "admin", "data_admin"]
ANY_ROLES = ["applicant", "admin", "data_admin", "dept_approver"]
ACTION_ROLES = {
    "submit": APPLICANT_ROLES,
    "admin_approve": ADMIN_ROLES,
    "admin_reject": ADMIN_ROLES,
    "dept_approve": DEPT_ROLES,
    "dept_reject": DEPT_ROLES,
    "publish": ADMIN_ROLES,
}

# ---- golden-record quality tests --------------------------------------------------
TEST_CODE, TEST_NAME, TEST_CLASS = (
    "material_code_not_null", "material_name_length", "classification_valid",
)
MSG_CODE_OK, MSG_CODE_EMPTY = "物料编码非空", "物料编码为空"
MSG_TEST_NAME = "名称长度: "
MSG_TEST_CLASS_OK, MSG_TEST_CLASS_BAD = "分类有效", "分类无效"

# ---- overview ---------------------------------------------------------------------
NODE_SOURCE = ("source-applications", "物料申请", "source")
NODE_PUBLISH = ("btp", "BTP", "external")
NODE_CATALOG = ("openmetadata", "OpenMetadata", "external")
EDGE_CREATED, EDGE_PUBLISHED, EDGE_SYNCED = "审批通过后生成", "发布", "同步元数据"
HISTORY_VALIDATE_NAME = "申请质量校验"
HISTORY_VALIDATE_OK = "质量规则通过"
HISTORY_TEST_DEFAULT = "OpenMetadata质量测试"
HISTORY_TEST_SOURCE = "OpenMetadata"
PUBLISH_TARGETS = ["SAP-S4HANA", "SAP-Ariba"]
SYSTEM_USER, SYSTEM_USER_NAME = "system", "系统自动"

# ---- attachments ------------------------------------------------------------------
DEFAULT_FILE_NAME = "attachment"
DEFAULT_CONTENT_TYPE = "application/octet-stream"

# ---- paging -----------------------------------------------------------------------
PAGE_LIMIT, PAGE_MAX = 100, 500
RECENT_APPLICATIONS, RECENT_LOGS = 5, 10
