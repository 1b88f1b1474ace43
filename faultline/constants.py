"""Fixed values of the data model: patterns, word lists, defaults, messages and lookup tables.

Results depend on these exact texts; they are data, kept in one place and in natural order.
"""

# --- fixed values: raw log patterns (one capture group each; regex dialect: java.util.regex) ------------
LOG_TIMESTAMP = r"(?U)(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(?:[.,]\d{1,6})?(?:Z|[+-]\d{2}:\d{2})?)"
LOG_LEVEL = r"(?U)\b(INFO|WARN|ERROR|DEBUG|TRACE|FATAL)\b"
LOG_SERVICE = r"(?U)\bservice(?:_name)?[=:]\s*([A-Za-z0-9._-]+)"
LOG_STATUS = r"(?iU)\bstatus(?:Code)?[=:]\s*(\d{3})\b"
LOG_TRACE = r"(?U)\btrace(?:Id|_id)?[=:]\s*([A-Za-z0-9-]+)\b"
LOG_FAILURE = r"(?iU)\bfailure(?:Type)?[=:]\s*([A-Za-z0-9_-]+)\b"
LOG_MESSAGE = r"(?idU)\bmessage[=:]\s*(.+)"
LOG_EXCEPTION = r"(?U)\b([A-Za-z0-9_.]+(?:Exception|Error))\b"
LOG_DASH = " - "

# --- fixed values: failure types ------------------------------------------------------------------------
FAILURE_TYPES = [
    "TIMEOUT",
    "AUTHENTICATION_FAILURE",
    "PAYMENT_BLOCKED",
    "SERVER_ERROR",
    "CLIENT_ERROR",
    "APPLICATION_FAILURE",
]
SERVICES = [
    "user-service",
    "transaction-service",
    "payment-service",
    "incident-service",
    "log-parser-service",
    "log-generator-service",
]
UNKNOWN_CLASS = "UNKNOWN"

# --- fixed values: alert fields, first non-blank wins; $ is the payload, result and alert are nodes ------
ALERT_NAME = [
    "result.alertName", "$.alertName", "$.search_name",
    "alert.labels.alertname", "$.commonLabels.alertname",
]
ALERT_SERVICE = [
    "result.serviceName", "result.service_name", "$.serviceName",
    "alert.labels.service_name", "alert.labels.service",
    "$.commonLabels.service_name", "$.commonLabels.service",
]
ALERT_SEVERITY_FIRST = ["result.severity"]
ALERT_SEVERITY_LAST = ["$.severity", "alert.labels.severity", "$.commonLabels.severity"]
ALERT_STATUS = ["result.status", "alert.status", "$.status"]
ALERT_SOURCE = ["result.source", "$.source", "alert.labels.source", "$.commonLabels.source"]
ALERT_TRACE = [
    "result.traceId", "$.traceId", "$.sid",
    "alert.annotations.traceId", "$.commonAnnotations.traceId",
    "alert.labels.trace_id", "$.commonLabels.trace_id",
]
ALERT_STATUS_CODE = [
    "result.statusCode", "$.statusCode",
    "alert.annotations.statusCode", "$.commonAnnotations.statusCode",
    "alert.labels.status_code", "$.commonLabels.status_code",
]
ALERT_FAILURE = [
    "result.failureType", "$.failureType",
    "alert.annotations.failureType", "$.commonAnnotations.failureType",
    "alert.labels.failure_type", "$.commonLabels.failure_type",
]
ALERT_MESSAGE = [
    "result.errorMessage", "result.message", "$.errorMessage",
    "alert.annotations.description", "$.commonAnnotations.description",
    "alert.annotations.summary", "$.commonAnnotations.summary",
]
ALERT_STARTED = [
    "result.startsAt", "result.timestamp", "result.@timestamp", "alert.startsAt", "$.startsAt",
]
ALERT_RAW_LOG = [
    "result.rawLog", "result._raw", "$.rawLog",
    "alert.annotations.rawLog", "$.commonAnnotations.rawLog",
    "alert.annotations.log", "$.commonAnnotations.log",
]
DEFAULT_ALERT_NAME = "PlatformIncident"
DEFAULT_SERVICE = "unknown-service"
DEFAULT_SEVERITY = "warning"
DEFAULT_FAILURE = "APPLICATION_FAILURE"

# --- fixed values: incident life cycle ------------------------------------------------------------------
MANUAL_STATUSES = ["OPEN", "ACKNOWLEDGED", "RESOLVED", "FAILED"]
CLOSED_STATUSES = ["RESOLVED", "CLOSED"]
PARSER_WAITING = "Incident saved and waiting for parser response"
PARSER_DONE = "Parsed log stored successfully"
PARSER_FAILED = "Log parser call failed: "
NO_DETAILS = "No details returned"
SUMMARY_CHARS = 180
LOCAL_ZONE = "Europe/Dublin"

# --- fixed values: anomaly model ------------------------------------------------------------------------
FEATURES = ["status_code", "is_error", "service_idx", "failure_idx", "hour_of_day", "error_msg_length"]
ERROR_LEVELS = ["ERROR", "FATAL", "WARN"]
CONTAMINATION = 0.05
SMALL_CONTAMINATION = 0.01
SMALL_SAMPLE = 5
FOREST_SEED = 42
FOREST_TREES = 100
FOREST_SAMPLE = 256
MODEL_VERSION = "isolation-forest-v1"
REASON_NORMAL = "Log pattern is within the expected range"
REASON_STATISTICAL = "Statistical anomaly in log pattern"
REASON_PREFIX = "Anomaly flagged due to: "
REASON_LEVEL = "high-severity error level"
REASON_STATUS = "HTTP status code "
REASON_LENGTH = "unusually long stack trace/error message"
REASON_MISSING = "Incident parsed log not found"
REASON_UNTRAINED = "Model not trained"
LONG_MESSAGE = 500

# --- fixed values: similarity and recommendation --------------------------------------------------------
WORD = r"[\p{L}\p{N}_]{2,}"
VOCABULARY = 1200
BONUS = [
    ("service_name", 0.15),
    ("alert_name", 0.12),
    ("failure_type", 0.12),
    ("exception_type", 0.08),
    ("status_code", 0.06),
]
BONUS_NOTES = 0.08
RULES_MODEL = "rules-and-similarity"
ROOT_CAUSE_HEADING = "Root cause:"
FIX_HEADING = "Recommended fix:"
NOTES_HEADING = "resolution steps:"
NOTES_END = "verification:"
NO_MATCH_LINE = "No similar incident with usable notes was found."
CAUSE_SIMILAR = (
    "The incident is similar to a previous ",
    " incident. The past notes indicate the same operational pattern.",
)
CAUSE_PAYMENT = (
    "The payment flow is failing or blocking requests, likely due to payment-service "
    "or a downstream payment dependency."
)
FIX_PAYMENT = (
    "Check payment-service logs, restart it with 'docker compose up -d payment-service' if it is "
    "stopped, then verify the health endpoint and Grafana alert state."
)
CAUSE_AUTH = "Authentication failures are being detected from application logs."
FIX_AUTH = (
    "Check the failed login source, confirm whether it is test traffic, then stop the generator "
    "or fix credentials before resolving the incident."
)
CAUSE_SERVER = ("", " is returning server-side errors.")
FIX_SERVER = (
    "Inspect ",
    " logs, restart the container if unhealthy, verify dependencies, and confirm that 5xx errors stop.",
)
CAUSE_DEFAULT = ("", " is showing an incident pattern that needs service and log review.")
FIX_DEFAULT = (
    "Check container status for ",
    ", inspect the raw log and parsed log fields, then restart or fix the failing dependency "
    "before marking resolved.",
)
PROMPT_HEAD = (
    "You are helping an incident analyst. Use the current incident and similar past notes. "
    "Return two short sections exactly named 'Root cause:' and 'Recommended fix:'."
)

# --- fixed values: metric jobs and request paths --------------------------------------------------------
HTTP_JOBS = "user-service|transaction-service|payment-service"
ALL_JOBS = "user-service|transaction-service|payment-service|log-generator-service|api-gateway"
GATEWAY_JOB = "api-gateway"
GENERATOR_JOB = "log-generator-service"
USER_BATCH_URIS = "/api/users/create|/api/users/login|/api/users/.*/balance"
MONEY_JOBS = "transaction-service|payment-service"
MONEY_URIS = "/api/transactions/transfer|/api/payments/checkout"
ERROR_STATUS = "4..|5.."
HTTP_COUNT = "http_server_requests_seconds_count"
HTTP_SUM = "http_server_requests_seconds_sum"
GATEWAY_COUNT = "spring_cloud_gateway_requests_seconds_count"
GATEWAY_SUM = "spring_cloud_gateway_requests_seconds_sum"
ROUTES = [
    ("/api/users/", "user-service"),
    ("/api/transactions/", "transaction-service"),
    ("/api/payments/", "payment-service"),
]

# --- fixed values: alert rules --------------------------------------------------------------------------
LOG_RULES = [
    ("Payment Timeout", "PAYMENT_TIMEOUT", None),
    ("Database Failure", "Connection refused", None),
    ("Login Failure", "LOGIN_FAILED", None),
    ("Java Exception", "Exception", "ERROR"),
]
LOGIN_PHRASE = "Invalid login failed as expected"
LOGIN_ALERT = "Splunk Invalid Login Failure"
LOGIN_FAILURE = "AUTH_LOGIN_FAILURE"
LOGIN_STATUS = 401
DOWN_RULES = [
    ("UserServiceDown", "user-service", "User service is down"),
    ("PaymentServiceDown", "payment-service", "Payment service is down"),
    ("TransactionServiceDown", "transaction-service", "Transaction service is down"),
]
BLOCKED_LABELS = {
    "alertname": "PaymentServiceBlockedPayments",
    "severity": "critical",
    "service_name": "payment-service",
    "source": "prometheus",
    "failure_type": "PAYMENT_BLOCKED",
}
BLOCKED_ANNOTATIONS = {
    "summary": "Payment service returned blocked payment responses",
    "description": "Payment-service produced HTTP 400 responses that indicate blocked high-value payments.",
    "traceId": "payment-blocked-alert",
    "statusCode": "400",
    "failureType": "PAYMENT_BLOCKED",
    "rawLog": (
        "ERROR service=payment-service traceId=payment-blocked-alert status=400 failure=PAYMENT_BLOCKED "
        "java.lang.IllegalStateException: High value payment blocked for risk review"
    ),
}
TEAM = "incident-service"
RECEIVER = "incident-service-webhook"

# --- fixed values: payments, transfers and accounts -----------------------------------------------------
PAYMENT_LIMIT = 5000
PAYMENT_REJECTED = "Payment amount must be greater than zero"
PAYMENT_BLOCKED = "High value payment blocked for risk review"
PAYMENT_DONE = "Payment processed successfully"
TRANSFER_AMOUNT = "Amount must be greater than zero"
TRANSFER_ACCOUNTS = "Source and destination account numbers are required"
TRANSFER_SAME = "Source and destination account cannot be same"
TRANSFER_FAILED = "Transfer failed: "
ACCOUNT_MISSING = "Account not found"
ACCOUNT_INACTIVE = "Account is not active"
ACCOUNT_OVERDRAWN = "Insufficient balance"
ACCOUNT_UPDATED = "Balance updated successfully"

# --- fixed values: texts, tones and labels that are shown ------------------------------------------------
UNTITLED = "Untitled incident"
NO_RAW_LOG = "Raw log not available"
NOT_AVAILABLE = "Not available"
UNKNOWN_TEXT = "unknown"
UNSUPPORTED_STATUS = "Unsupported incident status: "
LOCAL_FORMAT = "dd/MM/yyyy, HH:mm:ss"
EVIDENCE_LINES = ("Current service: ", "Alert: ", "Failure type: ", "Status code: ")
BEST_MATCH = ("Best match: ", " with score ")
PROMPT_CURRENT = "\n\nCurrent incident:\n"
PROMPT_SIMILAR = "\n\nSimilar past incidents:\n"
PROMPT_ITEM = ("Incident ", " score=", "\nNotes:\n")
PROMPT_NO_NOTES = "No notes available"
PROMPT_NO_SIMILAR = "No similar incidents found."
SEVERITY_TONES = {"CRITICAL": "critical", "HIGH": "critical", "ERROR": "critical", "WARNING": "warning", "MEDIUM": "warning", "WARN": "warning"}
SEVERITY_TONE = "info"
PARSER_TONES = {"COMPLETED": "healthy", "FAILED": "critical"}
PARSER_TONE = "warning"
STATUS_TONES = {"RESOLVED": "healthy", "FAILED": "critical", "ACKNOWLEDGED": "warning"}
STATUS_TONE = "neutral"
# not checked, anomaly, normal
ANOMALY_LABELS = ("Not checked", "Anomaly", "Normal")
ANOMALY_TONES = ("neutral", "critical", "healthy")

# --- fixed values: dashboard bands and ranks ------------------------------------------------------------
MTTR_BANDS = [(None, "green"), (15, "yellow"), (45, "red")]
CRITICAL_BANDS = [(None, "green"), (1, "red")]
UP_BANDS = [(None, "red"), (1, "green")]
SEVERITY_RANK = {"CRITICAL": 2, "critical": 2, "ERROR": 2, "error": 2, "WARNING": 1, "warning": 1}
STATE_RANK = {
    "ACTIVE": 2, "active": 2, "ACKNOWLEDGED": 1, "acknowledged": 1, "RESOLVED": 0, "resolved": 0,
}
