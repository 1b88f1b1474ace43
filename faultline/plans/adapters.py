"""The driver's tables mapped to the tables of this library.

Each mapping is one SELECT that Spark and the checking database read alike: constants, arithmetic and
text only, no clock and no random numbers. `{events}` and the like name the source tables.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.session import configure, spread

EVENT_AS_OF = "2024-01-31 00:00:00"
ORDER_AS_OF = "2001-08-01 00:00:00"

EVENT_FIELDS = """
select event_id, ts, user_id, event_type, value,
       cast(substr(props, 7, length(props) - 7) as int) as k,
       substr(cast(ts as string), 1, 19) as stamp,
       case user_id % 3 when 0 then 'user-service' when 1 then 'transaction-service' else 'payment-service' end as service,
       case when event_type = 'error' then
              case cast(substr(props, 7, length(props) - 7) as int) % 4 when 0 then 500 when 1 then 503 when 2 then 504 else 401 end
            when event_type = 'purchase' and value > 100 then 400
            else 200 end as status,
       case when event_type = 'error' then
              case when cast(substr(props, 7, length(props) - 7) as int) % 2 = 0 then 'ERROR' else 'FATAL' end
            when event_type = 'purchase' and value > 100 then 'WARN'
            else 'INFO' end as level
from {events}
"""

LOG_BODIES = f"""
select *,
       case when event_type = 'error' then
              case k % 5
                when 0 then 'java.net.SocketTimeoutException: Read timeout'
                when 1 then 'java.lang.IllegalStateException: Connection refused while connecting to postgres'
                when 2 then 'message=LOGIN_FAILED username=user-' || cast(user_id as string)
                when 3 then 'failure=payment-blocked message: High value payment blocked'
                else 'batch - Exception while processing batch' end
            else 'message=' || event_type || ' ok' end as body
from ({EVENT_FIELDS}) as e
"""

PARSE_REQUESTS = f"""
select event_id as incident_id,
       case event_id % 3 when 0 then stamp || ' ' when 1 then replace(stamp, ' ', 'T') || ' ' else '' end
         || level || ' service=' || service
         || case when k % 10 = 9 then '' else ' traceId=trace-' || cast(event_id as string) end
         || ' status=' || cast(status as string) || ' ' || body as raw_log,
       cast(null as string) as service_name,
       ts as timestamp,
       'none' as trace_id,
       cast(null as int) as status_code,
       cast(null as string) as failure_type,
       cast(null as string) as error_message
from ({LOG_BODIES}) as b
"""

LOG_EVENTS = f"""
select event_id, ts, level, cast(null as string) as log_level, 'com.bank.Service' as logger_name,
       service as service_name,
       case when k % 10 = 9 then null else 'trace-' || cast(event_id as string) end as trace_id,
       case when event_type = 'error' and k % 5 = 2 and user_id % 2 = 0 then 'Invalid login failed as expected for user-' || cast(user_id as string)
            when event_type = 'error' and k % 5 = 0 then 'PAYMENT_TIMEOUT service=payment-service'
            else body end as message,
       cast(null as string) as exception
from ({LOG_BODIES}) as b
"""

ALERT_PAYLOADS = f"""
select event_id as payload_id, ts as received_at,
       case event_id % 4
         when 0 then '{{{{"status":"firing","alerts":[{{{{"status":"firing","startsAt":"' || replace(stamp, ' ', 'T')
           || '+02:00","labels":{{{{"alertname":"Alert ' || cast(k as string) || '","service_name":"' || service
           || '","severity":"critical"}}}},"annotations":{{{{"description":"' || body || '","statusCode":"'
           || cast(status as string) || '","failureType":"' || event_type || '"}}}}}}}},{{{{"status":"resolved","labels":{{{{"alertname":"Second"}}}}}}}}]}}}}'
         when 1 then '{{{{"search_name":"Search ' || cast(k as string) || '","sid":"sid-' || cast(event_id as string)
           || '","result":{{{{"level":"' || level || '","service_name":" ' || service || ' ","_raw":"'
           || stamp || ' ' || level || ' status=' || cast(status as string) || ' ' || body
           || '","@timestamp":"' || replace(stamp, ' ', 'T') || 'Z","statusCode":"' || cast(status as string) || '.0"}}}}}}}}'
         when 2 then '{{{{"alertName":"Flat ' || cast(k as string) || '","serviceName":"' || service
           || '","severity":"  ","statusCode":' || cast(status as string) || ',"failureType":"flat","errorMessage":"'
           || body || '","startsAt":"' || stamp || '","status":"acknowledged","traceId":"t-' || cast(event_id as string) || '"}}}}'
         else '{{{{"alerts":[],"commonLabels":{{{{"service":"' || service || '","severity":"error","status_code":"'
           || cast(status as string) || '"}}}},"commonAnnotations":{{{{"summary":"' || body || '"}}}}}}}}' end as payload
from ({LOG_BODIES}) as b
"""

INCIDENTS = """
select o_orderkey as id,
       'Alert-' || cast(o_orderkey % 12 as string) as alert_name,
       'Alert-' || cast(o_orderkey % 12 as string) as title,
       'Incident of customer ' || cast(o_custkey as string) as description,
       case when o_orderkey % 5 = 0 then cast(null as string) else 'SVC-' || cast(o_orderkey as string) end as incident_number,
       case o_custkey % 4 when 0 then 'user-service' when 1 then 'transaction-service' when 2 then 'payment-service' else cast(null as string) end as service_name,
       case o_orderpriority when '1-URGENT' then 'critical' when '2-HIGH' then 'error' when '3-MEDIUM' then 'warning' when '5-LOW' then 'info' else cast(null as string) end as severity,
       case o_orderstatus when 'O' then 'OPEN' when 'P' then 'ACKNOWLEDGED' else 'RESOLVED' end as status,
       'grafana-webhook' as source,
       cast(null as string) as raw_payload,
       'ERROR service=svc-' || cast(o_custkey as string) || ' status=500' as raw_log,
       'trace-' || cast(o_orderkey as string) as trace_id,
       case o_orderkey % 10 when 0 then 'FAILED' when 1 then 'PENDING' else 'COMPLETED' end as parser_status,
       case o_orderkey % 10 when 0 then 'Log parser call failed: x' when 1 then cast(null as string) else 'Parsed log stored successfully' end as parser_message,
       o_orderdate as created_at,
       cast(null as timestamp_ntz) as parsed_at,
       o_orderdate + (o_orderkey % 240) * interval '1' minute as updated_at,
       case when o_orderstatus = 'F' then o_orderdate + (o_orderkey % 240 + 1) * interval '1' minute else cast(null as timestamp_ntz) end as resolved_at,
       case when o_orderstatus = 'F' and o_orderkey % 3 = 0
            then 'Summary: incident. Resolution steps: restart service ' || cast(o_orderkey % 7 as string) || '. Verification: ok.'
            else cast(null as string) end as notes
from {orders}
"""

INCIDENT_UPDATES = """
select l_orderkey as incident_id, l_shipdate as changed_at,
       (l_partkey * 100000 + l_suppkey) * 10 + l_linenumber as seq,
       case l_partkey % 6 when 0 then ' resolved ' when 1 then 'Acknowledged' when 2 then 'open' when 3 then 'reopened' else cast(null as string) end as status,
       case l_suppkey % 4 when 0 then '  note ' || cast(l_partkey as string) || ' ' when 1 then '  ' else cast(null as string) end as notes,
       case l_linenumber % 3 when 0 then true when 1 then false else cast(null as boolean) end as resolved
from {lineitem}
"""

# counter values grow with the event number and restart every 500 events
METRICS = {
    "http_server_requests_seconds_count": f"""
        select ts, 'http_server_requests_seconds_count' as metric, service as job, cast(status as string) as status,
               case user_id % 3 when 0 then case k % 2 when 0 then '/api/users/login' else '/api/users/' || cast(user_id as string) || '/balance' end
                                when 1 then '/api/transactions/transfer' else '/api/payments/checkout' end as uri,
               cast(null as string) as area, cast(null as string) as route, cast(null as string) as code,
               cast(event_id % 500 + 1 as double) as value
        from ({EVENT_FIELDS}) as e""",
    "http_server_requests_seconds_sum": f"""
        select ts, 'http_server_requests_seconds_sum' as metric, service as job, cast(status as string) as status,
               case user_id % 3 when 0 then case k % 2 when 0 then '/api/users/login' else '/api/users/' || cast(user_id as string) || '/balance' end
                                when 1 then '/api/transactions/transfer' else '/api/payments/checkout' end as uri,
               cast(null as string) as area, cast(null as string) as route, cast(null as string) as code,
               cast((event_id % 500 + 1) * (user_id % 3 + 1) as double) as value
        from ({EVENT_FIELDS}) as e""",
    "spring_cloud_gateway_requests_seconds_count": f"""
        select ts, 'spring_cloud_gateway_requests_seconds_count' as metric, 'api-gateway' as job, cast(null as string) as status,
               cast(null as string) as uri, cast(null as string) as area, service as route, cast(status as string) as code,
               cast(event_id % 500 + 1 as double) as value
        from ({EVENT_FIELDS}) as e""",
    "spring_cloud_gateway_requests_seconds_sum": f"""
        select ts, 'spring_cloud_gateway_requests_seconds_sum' as metric, 'api-gateway' as job, cast(null as string) as status,
               cast(null as string) as uri, cast(null as string) as area, service as route, cast(status as string) as code,
               cast((event_id % 500 + 1) * 2 as double) as value
        from ({EVENT_FIELDS}) as e""",
    "up": f"""
        select ts, 'up' as metric, service as job, cast(null as string) as status, cast(null as string) as uri,
               cast(null as string) as area, cast(null as string) as route, cast(null as string) as code,
               case when event_type = 'error' then 0.0e0 else 1.0e0 end as value
        from ({EVENT_FIELDS}) as e""",
    "process_uptime_seconds": f"""
        select ts, 'process_uptime_seconds' as metric, 'log-generator-service' as job, cast(null as string) as status,
               cast(null as string) as uri, cast(null as string) as area, cast(null as string) as route,
               cast(null as string) as code, cast(event_id * 15 as double) as value
        from ({EVENT_FIELDS}) as e""",
    "jvm_memory_used_bytes": f"""
        select ts, 'jvm_memory_used_bytes' as metric, service as job, cast(null as string) as status, cast(null as string) as uri,
               case when k % 3 = 0 then 'nonheap' else 'heap' end as area, cast(null as string) as route,
               cast(null as string) as code, cast((k + 1) * 1048576 as double) as value
        from ({EVENT_FIELDS}) as e""",
    "process_cpu_usage": f"""
        select ts, 'process_cpu_usage' as metric, service as job, cast(null as string) as status, cast(null as string) as uri,
               cast(null as string) as area, cast(null as string) as route, cast(null as string) as code,
               cast(k as double) / 128 as value
        from ({EVENT_FIELDS}) as e""",
    "jvm_threads_live_threads": f"""
        select ts, 'jvm_threads_live_threads' as metric, service as job, cast(null as string) as status, cast(null as string) as uri,
               cast(null as string) as area, cast(null as string) as route, cast(null as string) as code,
               cast(20 + k as double) as value
        from ({EVENT_FIELDS}) as e""",
}

LABELS = {"job": "job", "status": "status", "uri": "uri", "area": "area", "route": "routeId", "code": "httpStatusCode"}

ACCOUNTS = """
select 'ACC' || lpad(cast(c_custkey as string), 8, '0') as account_number,
       'user-' || cast(c_custkey as string) as username, c_name as full_name,
       cast(greatest(c_acctbal, 0) as decimal(38,2)) as balance,
       case c_custkey % 20 when 0 then 'BLOCKED' when 1 then 'CLOSED' else 'ACTIVE' end as status
from {customer}
"""

ACCOUNT_REQUESTS = """
select c_custkey as request_id, 'user-' || cast(c_custkey as string) as username,
       case c_custkey % 9 when 0 then '  ' when 1 then cast(null as string) else 'secret' end as password,
       case when c_custkey % 4 = 0 then cast(null as decimal(38,2)) else cast(greatest(c_acctbal, 0) as decimal(38,2)) end as balance
from {customer}
"""

PAYMENTS = """
select o_orderkey as request_id, 'ACC' || lpad(cast(o_custkey as string), 8, '0') as account_number,
       'Merchant-' || cast(o_orderkey % 50 as string) as merchant_name,
       case when o_orderkey % 97 = 0 then cast(null as decimal(38,2))
            when o_orderkey % 89 = 0 then cast(0 as decimal(38,2))
            else cast((cast(floor(o_totalprice) as bigint) % 400000) * 0.02 as decimal(38,2)) end as amount,
       o_orderdate as ts
from {orders}
"""

TRANSFERS = """
select o_orderkey as request_id, 'ACC' || lpad(cast(o_custkey as string), 8, '0') as source_account,
       case when o_orderkey % 101 = 0 then cast(null as string)
            else 'ACC' || lpad(cast((o_custkey * 7 + o_orderkey) % (select count(*) from {customer}) as string), 8, '0') end as destination_account,
       case when o_orderkey % 103 = 0 then cast(0 as decimal(38,2))
            else cast((cast(floor(o_totalprice) as bigint) % 120000) * 0.01 as decimal(38,2)) end as amount,
       'order ' || cast(o_orderkey as string) as description,
       o_orderdate as ts
from {orders}
"""

BALANCE_UPDATES = """
select o_orderkey as update_id,
       'ACC' || lpad(cast(case when o_orderkey % 50 = 0 then o_custkey + 10000000 else o_custkey end as string), 8, '0') as account_number,
       o_orderdate as ts, o_orderkey as seq,
       cast((cast(floor(o_totalprice) as bigint) % 120000) * (case when o_orderkey % 3 = 0 then 0.01 else -0.01 end) as decimal(38,2)) as amount
from {orders}
"""

SIMILARITY_INCIDENTS = """
select doc_id as id, source as alert_name, cast(null as string) as title, cast(null as string) as description,
       cast(null as string) as incident_number, lang as service_name, cast(null as string) as severity,
       case doc_id % 5 when 0 then 'RESOLVED' else 'OPEN' end as status, cast(null as string) as source,
       text as raw_log, case when doc_id % 10 = 0 then 'Resolution steps: fix ' || cast(doc_id % 7 as string) else cast(null as string) end as notes,
       case doc_id % 5 when 0 then cast('2024-01-01 00:00:00' as timestamp_ntz) + (doc_id % 1000) * interval '1' minute else cast(null as timestamp_ntz) end as resolved_at,
       cast('2024-01-02 00:00:00' as timestamp_ntz) + (doc_id % 100) * interval '1' minute as updated_at
from {documents}
union all
select -1 - item_id, cast(null as string), cast(null as string), cast(null as string), cast(null as string),
       'en', cast(null as string), 'OPEN', cast(null as string), text, cast(null as string),
       cast(null as timestamp_ntz), cast('2024-01-01 00:00:00' as timestamp_ntz)
from {benchmark}
"""

# each request path as a route test
REQUESTS = f"""
select event_id, case user_id % 4 when 0 then '/api/users/login' when 1 then '/api/transactions/transfer'
                                  when 2 then '/api/payments/checkout' else '/actuator/health' end as uri
from ({EVENT_FIELDS}) as e
"""

# stored model answers: a third of the incidents have one
ANSWERS = """
select o_orderkey as incident_id,
       case o_orderkey % 4
         when 0 then 'Root cause: cause ' || cast(o_custkey as string) || ' Recommended fix: - fix ' || cast(o_orderkey as string) || ' - '
         when 1 then 'RECOMMENDED FIX: fix first. root cause: cause later'
         when 2 then 'Root cause: only a cause'
         else 'no headings here' end as answer,
       'model-x' as model
from {orders}
"""

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def mapped(spark: SparkSession, folder: str, sql: str, heavy: bool = False) -> DataFrame:
    """One mapping as a DataFrame over the tables it names.

    `heavy` is for text work that costs more than reading: a table of fewer files than cores is spread.
    """
    configure(spark)
    used = {name: table(spark, folder, name) for name in TABLES if "{" + name + "}" in sql}
    if heavy:
        used = {name: spread(rows) for name, rows in used.items()}
    return spark.sql(sql, **used)


def metric_samples(spark: SparkSession, folder: str, *metrics: str) -> DataFrame:
    """Samples of the named metrics with their labels as a map; absent labels are left out."""
    result = None
    for metric in metrics:
        rows = mapped(spark, folder, METRICS[metric])
        pairs = [item for column, label in LABELS.items() for item in (F.lit(label), F.col(column))]
        labels = F.map_filter(F.create_map(*pairs), lambda _, value: value.isNotNull())
        rows = rows.select("ts", "metric", labels.alias("labels"), "value")
        result = rows if result is None else result.unionByName(rows)
    return result
