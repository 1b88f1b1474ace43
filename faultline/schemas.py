"""Table and stream layouts as Spark DDL strings."""

LOG_EVENT = (
    "ts timestamp_ntz, level string, log_level string, logger_name string, service_name string, "
    "trace_id string, message string, exception string"
)
# Fields that only one of the two written layouts has.
LAYOUT_FIELDS = "context string, thread_name string, stack_trace string"
LOG_JSON = "`@timestamp` timestamp," + LOG_EVENT.split(",", 1)[1] + ", " + LAYOUT_FIELDS
ALERT_PAYLOAD = "payload_id bigint, payload string, received_at timestamp_ntz"
PARSE_REQUEST = (
    "incident_id bigint, raw_log string, service_name string, timestamp timestamp_ntz, trace_id string, "
    "status_code int, failure_type string, error_message string"
)
PARSED_LOG = (
    "id bigint, incident_id bigint, service_name string, log_level string, error_message string, "
    "exception_type string, status_code int, trace_id string, failure_type string, "
    "log_timestamp timestamp_ntz, raw_log string, created_at timestamp_ntz"
)
INCIDENT = (
    "id bigint, alert_name string, title string, description string, incident_number string, "
    "service_name string, severity string, status string, source string, raw_payload string, "
    "raw_log string, trace_id string, parser_status string, parser_message string, "
    "created_at timestamp_ntz, parsed_at timestamp_ntz, updated_at timestamp_ntz, "
    "resolved_at timestamp_ntz, notes string"
)
INCIDENT_UPDATE = (
    "incident_id bigint, changed_at timestamp_ntz, seq bigint, status string, notes string, resolved boolean"
)
ENCODER = "encoder string, class string, idx int"
FOREST_NODE = (
    "model_version string, tree int, node int, feature int, threshold double, left int, right int, "
    "size int, depth int"
)
FOREST_PARAMS = (
    "model_version string, contamination double, threshold double, n_trees int, sample_size int, seed bigint"
)
ANOMALY_RESULT = (
    "id bigint, incident_id bigint, is_anomaly boolean, anomaly_score double, reason string, "
    "model_version string, created_at timestamp_ntz, updated_at timestamp_ntz"
)
RECOMMENDATION = (
    "id bigint, incident_id bigint, similar_incident_id bigint, similarity_score double, "
    "recommended_root_cause string, recommended_fix string, evidence string, model_used string, "
    "created_at timestamp_ntz, updated_at timestamp_ntz"
)
METRIC_SAMPLE = "ts timestamp_ntz, metric string, labels map<string,string>, value double"
ACCOUNT = "account_number string, username string, full_name string, balance decimal(38,2), status string"
BALANCE_UPDATE = "account_number string, ts timestamp_ntz, seq bigint, amount decimal(38,2)"
TRANSFER = (
    "request_id bigint, source_account string, destination_account string, amount decimal(38,2), "
    "description string, ts timestamp_ntz"
)
PAYMENT_REQUEST = (
    "request_id bigint, account_number string, merchant_name string, amount decimal(38,2), ts timestamp_ntz"
)
NODE_TEXTS = "status string, startsAt string, labels map<string,string>, annotations map<string,string>"
ALERT_JSON = (
    "alertName string, search_name string, serviceName string, severity string, source string, "
    "traceId string, sid string, statusCode string, failureType string, errorMessage string, "
    f"rawLog string, {NODE_TEXTS}, "
    "commonLabels map<string,string>, commonAnnotations map<string,string>, "
    f"alerts array<struct<{NODE_TEXTS.replace(' string', ':string').replace(' map', ':map')}>>, "
    "result struct<alertName:string, serviceName:string, service_name:string, severity:string, level:string, "
    "status:string, source:string, traceId:string, statusCode:string, failureType:string, "
    "errorMessage:string, message:string, startsAt:string, timestamp:string, `@timestamp`:string, "
    "rawLog:string, _raw:string>"
)
