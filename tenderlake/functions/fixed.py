"""Fixed values that results depend on.

FIXED VALUES — these must stay equal to the behaviour being matched (word
lists, ranks, thresholds, patterns, texts).  They are data, not logic.
"""

from __future__ import annotations

# --- fixed values: source kinds and their display priority -----------------
SOURCE_PRIORITY = {
    "public_tender": 100,
    "procurement_platform": 90,
    "direct": 80,
    "broker": 70,
    "email_forwarded": 60,
    "forwarded": 50,
    "manual": 40,
    "unknown": 10,
}

# --- fixed values: review and gap statuses ---------------------------------
REVIEW_STATUSES = (
    "auto_accepted",
    "needs_review",
    "manually_merged",
    "manually_split",
    "ignored",
    "watch_only",
)
AUTOMATED_REVIEW_STATUSES = ("auto_accepted", "needs_review")
GAP_STATUSES = ("open", "acknowledged", "watch_only", "ignored")

# --- fixed values: extraction patterns (Python syntax of the original) -----
# title: "(oppdrag|assignment|rolle)[:\-]\s*(.+)"      case-insensitive
# deadline: "(frist|deadline)[:\-]\s*([^\n]+)"          case-insensitive
# url: "https?://[^\s)]+"                                case-sensitive
TITLE_REGEX = r"(?iUd)(oppdrag|assignment|rolle)[:\-]\s*(.+)"
DEADLINE_REGEX = r"(?iUd)(frist|deadline)[:\-]\s*([^\n]+)"
URL_REGEX = r"(?U)https?://[^\s)]+"

# --- fixed values: extraction confidences ----------------------------------
EMAIL_CONFIDENCE = 0.65
LISTING_CONFIDENCE = 0.9
NOTICE_CONFIDENCE = 0.85
DEFAULT_SIGNAL_CONFIDENCE = 0.6

# --- fixed values: cluster confidence and status ---------------------------
URL_CLUSTER_CONFIDENCE = 0.95
KEY_CLUSTER_CONFIDENCE = 0.7
AUTO_ACCEPT_MIN_CONFIDENCE = 0.9

# --- fixed values: match score weights -------------------------------------
MATCH_WEIGHT_URL = 0.6
MATCH_WEIGHT_TITLE = 0.2
MATCH_WEIGHT_CUSTOMER = 0.1
MATCH_WEIGHT_DEADLINE = 0.1
WEAK_MATCH = "weak-match"

# --- fixed values: agreement phrases ---------------------------------------
AGREEMENT_PHRASES = (
    "dps",
    "dynamic purchasing system",
    "frame",
    "frame agreement",
    "framework",
    "framework agreement",
    "ramme",
    "rammeavtale",
    "ramme avtale",
)

# --- fixed values: default role taxonomy -----------------------------------
DEFAULT_ROLE_TAXONOMY = {
    "data_engineering": [
        "data engineer", "data platform", "etl", "airflow", "spark", "dbt",
        "pipeline", "databricks",
    ],
    "backend": [
        "backend", "api", "python", "java", "golang", "microservice", "fastapi",
        "django", "spring",
    ],
    "frontend": [
        "frontend", "react", "typescript", "javascript", "angular", "vue", "ui",
    ],
    "cloud_devops": [
        "devops", "platform engineer", "kubernetes", "terraform", "aws", "azure",
        "gcp", "ci/cd",
    ],
    "security": [
        "security", "iam", "soc", "siem", "zero trust", "risk", "compliance",
    ],
    "project_management": [
        "project manager", "scrum master", "delivery lead", "program manager",
    ],
    "qa_test": [
        "qa", "test automation", "selenium", "cypress", "quality assurance",
    ],
}
GENERALIST = "generalist"
MAX_ROLE_TAGS = 3

# --- fixed values: relevance scoring ---------------------------------------
CONFIDENCE_WEIGHT = 0.5
ROLE_COMPONENT = 0.2
CAPACITY_BASE = 0.1
CAPACITY_STEP = 0.06
CAPACITY_CAP = 0.4
CAPACITY_PENALTY = -0.2
MODE_ADJUST = {"high_precision": -0.15, "high_recall": 0.1, "balanced": 0.0}
DEFAULT_MODE = "balanced"
DEFAULT_MIN_RELEVANCE = 0.35
DEFAULT_MIN_SOURCE_CONFIDENCE = 0.75

# --- fixed values: gaps ----------------------------------------------------
GAP_AUTO_CLOSE_NOTE = (
    "Auto-closed after matching agreement signal detected for this buyer."
)
GAP_RATIONALE = "Repeated buyer demand without matching DPS/frame agreement signal."
GAP_BASE_CONFIDENCE = 0.55
GAP_STEP_CONFIDENCE = 0.1
GAP_MAX_CONFIDENCE = 0.99
GAP_MIN_CLUSTER_HITS = 2
GAP_KEY_PREFIX = "buyer:"

# --- fixed values: listing ingestion defaults ------------------------------
FALLBACK_PREFIX = "fallback"
FALLBACK_PLATFORM = "unknown"
FALLBACK_TITLE = "untitled"
FALLBACK_COMPANY = "unknown-company"
FALLBACK_DEADLINE = "unknown-deadline"
UNKNOWN_SOURCE_NAME = "unknown"
MISSING_DUE_DATE = "Snarest"

# --- fixed values: digest / message texts ----------------------------------
MESSAGE_PREFIX = "Opportunity: "     # of our own; a parameter of the message
UNTITLED = "Untitled opportunity"
UNKNOWN_CUSTOMER = "Unknown customer"
UNKNOWN_DEADLINE = "Unknown deadline"
MESSAGE_LONG_LIMIT = 3000
MESSAGE_CUT = 1000
UNSPECIFIED_AGREEMENT = "unspecified"

# --- fixed values: analytics default limits --------------------------------
TREND_LIMIT = 10
SIGNAL_LIST_LIMIT = 50
RELEVANT_LIMIT = 100
