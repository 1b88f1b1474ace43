"""Queries over features, anomaly results, similarity and recommendations."""

from pyspark.sql import functions as F

from faultline import constants as C
from faultline import schemas
from faultline.functions import advice
from faultline.operators import features, forest, incidents, recommend, similarity
from faultline.plans import adapters as A
from faultline.plans.logs import parsed
from faultline.plans.registry import MAPPINGS, query
from faultline.session import scratch, spread, stage
from faultline.sources import results as saved
from faultline.sources import tables

STOP_WORDS = ["the", "of", "and", "to", "in", "le", "la", "les", "des", "der", "die", "und", "el", "los", "de"]
STOP_LIST = ", ".join(f"'{word}'" for word in STOP_WORDS)


# --- features ---------------------------------------------------------------------------------------------

def _values(words):
    return ", ".join(f"('{word}')" for word in words)


MAPPINGS["encoders"] = f"""
select encoder, class, cast(row_number() over (partition by encoder order by class) - 1 as int) as idx from (
  select distinct 'service' as encoder, class from (select service_name as class from {{parsed}} union all values {_values([*C.SERVICES, C.UNKNOWN_CLASS])}) s where class is not null
  union all
  select distinct 'failure_type', class from (select failure_type as class from {{parsed}} union all values {_values([*C.FAILURE_TYPES, C.UNKNOWN_CLASS])}) f where class is not null)
"""
MAPPINGS["matrix"] = """
select incident_id, cast(coalesce(status_code, 0) as float) as status_code,
       cast(case when upper(log_level) in ('ERROR', 'FATAL', 'WARN') then 1 else 0 end as float) as is_error,
       cast(coalesce(s.idx, (select idx from {encoders} where encoder = 'service' and class = 'UNKNOWN')) as float) as service_idx,
       cast(coalesce(f.idx, (select idx from {encoders} where encoder = 'failure_type' and class = 'UNKNOWN')) as float) as failure_idx,
       cast(coalesce(hour(log_timestamp), 0) as float) as hour_of_day,
       cast(length(coalesce(error_message, '')) as float) as error_msg_length
from {parsed} p
left join {encoders} s on s.encoder = 'service' and s.class = coalesce(nullif(p.service_name, ''), 'UNKNOWN')
left join {encoders} f on f.encoder = 'failure_type' and f.class = coalesce(nullif(p.failure_type, ''), 'UNKNOWN')
"""


def stored_logs(spark, folder):
    """The parsed log table, written once as the jobs that follow read it several times."""
    return stage(parsed(spark, folder), "parsed-logs")


def matrix(spark, folder):
    rows = parsed(spark, folder)
    return features.build_feature_matrix(rows, stage(features.fit_encoders(rows), "encoders"))


@query("select * from {encoders}")
def fit_encoders(spark, folder):
    return features.fit_encoders(parsed(spark, folder))


@query("select * from {matrix}")
def feature_matrix(spark, folder):
    return matrix(spark, folder)


@query("select service_idx as idx, count(*) as logs from {matrix} group by 1")
def encode_join(spark, folder):
    return matrix(spark, folder).groupBy(F.col("service_idx").alias("idx")).agg(F.count("*").alias("logs"))


@query("""
select class from (select distinct service_name as class from {parsed} where service_name is not null
union values ('extra'), ('UNKNOWN'))
""")
def union_defaults(spark, folder):
    from faultline.operators import keyed

    rows = parsed(spark, folder).select(F.col("service_name").alias("class"))
    return keyed.union_defaults(rows, "class", ["extra", C.UNKNOWN_CLASS])


@query("""
select incident_id, case when not flagged then 'Log pattern is within the expected range'
  when parts = '' then 'Statistical anomaly in log pattern' else 'Anomaly flagged due to: ' || parts end as reason
from (select incident_id, incident_id % 3 > 0 as flagged,
        concat_ws(', ', case when is_error = 1 then 'high-severity error level' end,
          case when status_code >= 500 then 'HTTP status code ' || cast(cast(status_code as int) as string) end,
          case when error_msg_length * 20 > 500 then 'unusually long stack trace/error message' end) as parts from {matrix})
""")
def anomaly_reason(spark, folder):
    col = F.col
    flagged = col("incident_id") % 3 > 0
    reason = forest.anomaly_reason(flagged, col("is_error"), col("status_code"), col("error_msg_length") * 20)
    return matrix(spark, folder).select("incident_id", reason.alias("reason"))


@query("select incident_id, greatest(0.0e0, least(1.0e0, 0.5e0 - (incident_id % 300 - 150) / 100.0e0)) as score from {parsed}")
def anomaly_score(spark, folder):
    decision = (F.col("incident_id") % 300 - 150) / F.lit(100.0)
    return parsed(spark, folder).select("incident_id", forest.anomaly_score(decision).alias("score"))


@query("select round(quantile_cont(cast(error_msg_length as double) * 1000 + incident_id % 1000, 0.05), 6) as value from {matrix}")
def score_threshold(spark, folder):
    rows = matrix(spark, folder).select(
        (F.col("error_msg_length").cast("double") * 1000 + F.col("incident_id") % 1000).alias("score")
    )
    value = forest.exact_quantile(rows, "score", C.CONTAMINATION)
    return spark.range(1).select(F.round(F.lit(value), 6).alias("value"))


MAPPINGS["asked"] = "select user_id * 37 as incident_id from {events}"


def asked(spark, folder):
    """Requested incident ids: with repeats, and some without a parsed log."""
    return A.table(spark, folder, "events").select((F.col("user_id") * 37).alias("incident_id"))


@query("""
select a.incident_id, p.incident_id is not null as found, p.failure_type from {asked} a left join {parsed} p on p.incident_id = a.incident_id
""")
def detect_batch_left_join(spark, folder):
    rows = forest.requested_logs(asked(spark, folder), parsed(spark, folder), ["log_timestamp"])
    return rows.select("incident_id", "found", "failure_type")


@query(f"""
select cast(tree as int) as tree, least({C.FOREST_SAMPLE}, n) as sample, true as is_binary, true as depth_fits
from range({C.FOREST_TREES}) as t(tree), (select count(*) as n from {{matrix}})
""")
def fit_isolation_forest(spark, folder):
    """What holds for every tree whatever the random numbers: rows in its leaves, two ways per split, its depth."""
    rows = spread(stage(matrix(spark, folder), "features"))
    nodes, _ = forest.fit_isolation_forest(rows)
    leaf = F.col("feature") < 0
    limit = F.ceil(F.log2(F.greatest(F.lit(2), F.sum(F.when(leaf, F.col("size"))))))
    return nodes.groupBy("tree").agg(
        F.sum(F.when(leaf, F.col("size"))).alias("sample"),
        (F.count("*") == 2 * F.count_if(leaf) - 1).alias("is_binary"), (F.max("depth") <= limit).alias("depth_fits"),
    )


# A small fixed forest over (status_code, is_error, service_idx, failure_idx, hour_of_day, error_msg_length).
FIXED_NODES = [
    # tree, node, feature, threshold, left, right, size, depth
    (0, 0, 0, 450.0, 1, 2, 64, 0), (0, 1, 4, 11.0, 3, 4, 40, 1), (0, 2, -1, 0.0, -1, -1, 24, 1),
    (0, 3, -1, 0.0, -1, -1, 2, 2), (0, 4, -1, 0.0, -1, -1, 38, 2),
    (1, 0, 5, 40.0, 1, 2, 64, 0), (1, 1, -1, 0.0, -1, -1, 1, 1), (1, 2, 1, 0.5, 3, 4, 63, 1),
    (1, 3, 2, 3.0, 5, 6, 33, 2), (1, 4, -1, 0.0, -1, -1, 30, 2), (1, 5, -1, 0.0, -1, -1, 3, 3), (1, 6, -1, 0.0, -1, -1, 30, 3),
]
FIXED_THRESHOLD, FIXED_SAMPLE = -0.5, 64
MAPPINGS["fixed_nodes"] = "select * from (values " + ", ".join(map(str, FIXED_NODES)) + (
    ") as n(tree, node, feature, threshold, lo, hi, size, depth)"
)


def _path_constant(size):
    return f"""case when {size} <= 1 then 0.0e0 when {size} = 2 then 1.0e0
      else 2 * (ln({size} - 1) + {forest.EULER}) - 2.0e0 * ({size} - 1) / {size} end"""


def _scores(matrix):
    """Decision and score of the fixed forest for the rows of a feature matrix, in SQL."""
    return f"""
with recursive walk as (
  select m.*, n.tree, n.node, n.feature, n.threshold, n.lo, n.hi, n.size, n.depth from {{{matrix}}} m join {{fixed_nodes}} n on n.node = 0
  union all
  select w.* exclude (tree, node, feature, threshold, lo, hi, size, depth), n.tree, n.node, n.feature, n.threshold, n.lo, n.hi, n.size, n.depth
  from walk w join {{fixed_nodes}} n on n.tree = w.tree and w.feature >= 0 and n.node = case
    when [status_code, is_error, service_idx, failure_idx, hour_of_day, error_msg_length][cast(w.feature as bigint) + 1] <= w.threshold then w.lo else w.hi end
), raw as (
  select incident_id, -pow(2.0e0, -sum(depth + {_path_constant("size")}) / (2 * ({_path_constant(str(FIXED_SAMPLE))}))) as raw_score
  from walk where feature < 0 group by 1
)
select incident_id, round(raw_score - {FIXED_THRESHOLD}, 6) as decision, raw_score - {FIXED_THRESHOLD} < 0 as is_anomaly,
       round(greatest(0.0e0, least(1.0e0, 0.5e0 - (raw_score - {FIXED_THRESHOLD}))), 6) as anomaly_score
from raw
"""


MAPPINGS["fixed_scores"] = _scores("matrix")


def fixed_model(spark):
    nodes = spark.createDataFrame([(C.MODEL_VERSION, *n) for n in FIXED_NODES], schemas.FOREST_NODE)
    params = spark.createDataFrame(
        [(C.MODEL_VERSION, C.CONTAMINATION, FIXED_THRESHOLD, 2, FIXED_SAMPLE, C.FOREST_SEED)], schemas.FOREST_PARAMS
    )
    return nodes, params


@query("select * from {fixed_scores}")
def score_isolation_forest(spark, folder):
    """The walk, decision and score of a forest that is known."""
    scored = forest.score_isolation_forest(matrix(spark, folder), *fixed_model(spark))
    return scored.select(
        "incident_id", F.round("decision", 6).alias("decision"), "is_anomaly", F.round("anomaly_score", 6).alias("anomaly_score")
    )


@query(f"""
select a.incident_id, p.incident_id is not null as found, true as reason_fits, true as score_fits, true as share_fits,
       case when p.incident_id is not null then '{C.MODEL_VERSION}' end as model_version
from {{asked}} a left join {{parsed}} p on p.incident_id = a.incident_id
""")
def detect_anomalies(spark, folder):
    """The trained path on logs of which half are repeated: one result per asked id, a reason that fits its flag, a score
    that fits it too, and no more flags among all logs than the contamination allows."""
    once = stored_logs(spark, folder)
    older = once.filter("incident_id % 2 = 0").withColumn("log_timestamp", F.expr("log_timestamp - interval '1' day"))
    _, encoders, model = forest.train_anomaly_model(once)
    results = stage(
        forest.detect_anomalies(asked(spark, folder), once.unionByName(older), encoders, model), "results"
    )
    col = F.col
    every = forest.detect_anomalies(once.select("incident_id"), once, encoders, model)
    share = every.agg(F.count_if("is_anomaly") <= C.CONTAMINATION * F.count("*")).scalar()
    reason = F.when(~col("found"), col("reason") == C.REASON_MISSING).otherwise(
        col("is_anomaly") == (col("reason") != C.REASON_NORMAL)
    )
    return results.select(
        "incident_id", "found", reason.alias("reason_fits"),
        F.when(col("is_anomaly"), col("anomaly_score") > 0.5).otherwise(col("anomaly_score") <= 0.5).alias("score_fits"),
        share.alias("share_fits"), "model_version",
    )


@query("""
select incident_id, is_anomaly, anomaly_score, reason, found from (
select a.incident_id, false as is_anomaly, 0.0e0 as anomaly_score,
       case when p.incident_id is null then 'Incident parsed log not found' else 'Model not trained' end as reason, p.incident_id is not null as found
from {asked} a left join {parsed} p on p.incident_id = a.incident_id)
""")
def detect_untrained(spark, folder):
    rows = stored_logs(spark, folder)
    encoders = stage(features.fit_encoders(rows), "encoders")
    results = forest.detect_anomalies(asked(spark, folder), rows, encoders, None)
    return results.drop("model_version")


@query("""
select count(*) as samples_trained, (select count(*) from {parsed}) as results_saved, 'success' as status from {parsed}
""")
def training_summary(spark, folder):
    rows = stored_logs(spark, folder)
    _, encoders, model = forest.train_anomaly_model(rows)
    results = forest.detect_anomalies(rows.select("incident_id"), rows, encoders, model)
    return forest.training_summary(rows, results)


@query("""
select 0.05e0 as contamination, true as encoders_loaded, true as model_trained, (select count(*) from {parsed}) as results_saved
""")
def anomaly_status(spark, folder):
    rows = stored_logs(spark, folder)
    path = scratch(spark, "model")
    forest.train_if_missing(spark, path, rows)
    encoders, model = tables.load_model(spark, path)
    results = forest.detect_anomalies(rows.select("incident_id"), rows, encoders, model)
    return forest.anomaly_status(results, model[1], encoders)


# --- similarity -------------------------------------------------------------------------------------------

MAPPINGS["doc_words"] = rf"""
select id, [w for w in regexp_extract_all(lower(concat_ws(' ', nullif(alert_name, ''), nullif(service_name, ''), nullif(status, ''), nullif(raw_log, ''), nullif(notes, ''))), '[\p{{{{L}}}}\p{{{{N}}}}_]{{{{2,}}}}')
            if w not in ({STOP_LIST})] as words
from {{doc_incidents}}
"""
MAPPINGS["doc_terms"] = """
select id, term, count(*) as n from (
  select id, unnest(words) as term from {doc_words}
  union all
  select id, words[i] || ' ' || words[i + 1] from (select id, words, unnest(range(1, len(words))) as i from {doc_words}))
group by 1, 2
"""
MAPPINGS["doc_vocabulary"] = """
select term, cast(sum(n) as bigint) as tf, count(*) as df from {doc_terms} group by 1 order by tf desc, term limit 1200
"""
MAPPINGS["doc_raw"] = """
select t.id, t.term, t.n * (ln((1 + (select count(*) from {doc_incidents})) / (1 + v.df)) + 1) as w
from {doc_terms} t join {doc_vocabulary} v on v.term = t.term
"""
MAPPINGS["doc_weights"] = """
select r.id, r.term, r.w / x.norm as weight from {doc_raw} r
join (select id, sqrt(sum(w * w)) as norm from {doc_raw} group by 1) x on x.id = r.id
"""
MAPPINGS["doc_scores"] = """
select q.id as query_id, c.id as incident_id,
       round(least(1.0, coalesce(d.dot, 0)
         + case when q.service_name = c.service_name and q.service_name <> '' then 0.15 else 0 end
         + case when q.alert_name = c.alert_name and q.alert_name <> '' then 0.12 else 0 end
         + case when upper(c.status) = 'RESOLVED' and c.notes <> '' then 0.08 else 0 end), 4) as similarity_score,
       c.resolved_at, c.updated_at, c.notes
from {doc_incidents} q join {doc_incidents} c on q.id < 0 and q.id <> c.id
left join (select a.id as q, b.id as c, sum(a.weight * b.weight) as dot from {doc_weights} a join {doc_weights} b on a.term = b.term and a.id < 0 group by 1, 2) d
  on d.q = q.id and d.c = c.id
"""
MAPPINGS["doc_ranked"] = """
select *, cast(row_number() over (partition by query_id order by similarity_score desc, resolved_at desc nulls first, updated_at desc nulls first, incident_id desc) as int) as rank
from {doc_scores}
"""


def doc_incidents(spark, folder):
    return A.mapped(spark, folder, A.SIMILARITY_INCIDENTS, heavy=True)


def doc_queries(spark, folder):
    return A.table(spark, folder, "benchmark").select((-1 - F.col("item_id")).alias("incident_id"))


def _words(spark, folder):
    return similarity.document_words(similarity.signatures(doc_incidents(spark, folder)), STOP_WORDS)


@query("select term, tf from {doc_vocabulary}")
def limit_vocabulary(spark, folder):
    return similarity.limit_vocabulary(_words(spark, folder))


@query("select id, cast(len(words) as bigint) as words, md5(array_to_string(words, ' ')) as digest from {doc_words}")
def tokenize(spark, folder):
    rows = doc_incidents(spark, folder)
    words = similarity.remove_stop_words(similarity.tokenize(similarity.incident_text(rows)), STOP_WORDS)
    split = rows.select("id", words.alias("w"))
    return split.select("id", F.size("w").cast("bigint").alias("words"), F.md5(F.concat_ws(" ", "w")).alias("digest"))


@query("select term, round(ln((1 + (select count(*) from {doc_incidents})) / (1 + df)) + 1, 6) as idf, df from {doc_vocabulary}")
def idf(spark, folder):
    words = _words(spark, folder)
    counted, numbered = similarity.document_terms(words, similarity.limit_vocabulary(words))
    return similarity.idf_table(counted, numbered).select("term", F.round("idf", 6).alias("idf"), "df")


@query("select id, term, round(weight, 5) as weight from {doc_weights}")
def tfidf(spark, folder):
    words = _words(spark, folder)
    counted, numbered = similarity.document_terms(words, similarity.limit_vocabulary(words))
    weights = similarity.tfidf_l2(counted, stage(similarity.idf_table(counted, numbered), "idf"))
    rows = weights.select("id", F.explode(F.arrays_zip("positions", "weights")).alias("entry"))
    rows = rows.select("id", F.col("entry.positions").alias("position"), F.col("entry.weights").alias("weight"))
    return rows.join(F.broadcast(numbered), "position").select("id", "term", F.round("weight", 5).alias("weight"))


def similar(spark, folder, k):
    return similarity.find_similar_incidents(
        doc_incidents(spark, folder), doc_queries(spark, folder), k, stop_words=STOP_WORDS
    )


@query("select query_id, rank, incident_id, similarity_score, notes from {doc_ranked} where rank <= 5")
def top_k_similar(spark, folder):
    return similar(spark, folder, 5).select("query_id", "rank", "incident_id", "similarity_score", "notes")


@query("select query_id, incident_id, similarity_score from {doc_ranked} where rank <= 20")
def similarity_pairs(spark, folder):
    return similarity.similarity_pairs(
        doc_incidents(spark, folder), doc_queries(spark, folder), k=20, stop_words=STOP_WORDS
    )


MAPPINGS["doc_dots"] = """
select a.id as q, b.id as c, sum(a.weight * b.weight) as dot from {doc_weights} a join {doc_weights} b on a.term = b.term group by 1, 2
"""


@query("""
select query_id, incident_id, similarity_score from (
  select *, row_number() over (partition by query_id order by similarity_score desc, resolved_at desc nulls first, updated_at desc nulls first, incident_id desc) as rank
  from (select q.id as query_id, c.id as incident_id, c.resolved_at, c.updated_at,
               round(least(1.0, coalesce(d.dot, 0)
                 + case when q.service_name = c.service_name and q.service_name <> '' then 0.15 else 0 end
                 + case when q.alert_name = c.alert_name and q.alert_name <> '' then 0.12 else 0 end
                 + case when upper(c.status) = 'RESOLVED' and c.notes <> '' then 0.08 else 0 end), 4) as similarity_score
        from {doc_incidents} q join {doc_incidents} c on q.id <> c.id left join {doc_dots} d on d.q = q.id and d.c = c.id))
where rank <= 3
""")
def similar_to_all(spark, folder):
    """The three best candidates of every incident."""
    every = doc_incidents(spark, folder)
    return similarity.similarity_pairs(every, every.select(F.col("id").alias("incident_id")), k=3, stop_words=STOP_WORDS)


@query("""
select a.id, round(case when a.service_name = b.service_name and a.service_name <> '' then 0.15 else 0 end
  + case when a.alert_name = b.alert_name and a.alert_name <> '' then 0.12 else 0 end
  + case when p.failure_type = r.failure_type and p.failure_type <> '' then 0.12 else 0 end
  + case when p.exception_type = r.exception_type and p.exception_type <> '' then 0.08 else 0 end
  + case when p.status_code = r.status_code and p.status_code <> 0 then 0.06 else 0 end
  + case when b.status = 'RESOLVED' and b.notes <> '' then 0.08e0 else 0 end, 4) as bonus
from {incidents} a join {incidents} b on b.id = a.id + 12
left join {parsed} p on p.incident_id = a.id left join {parsed} r on r.incident_id = b.id
""")
def structured_bonus(spark, folder):
    rows = incidents.incidents_with_parsed_logs(A.mapped(spark, folder, A.INCIDENTS), parsed(spark, folder))
    shape = F.struct(
        "service_name", "alert_name", "parsed_log.failure_type", "parsed_log.exception_type",
        "parsed_log.status_code", "status", "notes",
    )
    own = rows.select("id", shape.alias("current"))
    other = rows.select((F.col("id") - 12).alias("id"), shape.alias("candidate"))
    bonus = similarity.structured_bonus(F.col("current"), F.col("candidate"))
    return own.join(other, "id").select("id", F.round(bonus, 4).alias("bonus"))


# --- recommendations --------------------------------------------------------------------------------------

def advice_inputs(spark, folder):
    """Each incident with its parsed log and, as its best match, the next incident."""
    rows = incidents.incidents_with_parsed_logs(A.mapped(spark, folder, A.INCIDENTS), parsed(spark, folder))
    match = A.mapped(spark, folder, A.INCIDENTS).select(
        (F.col("id") - 1).alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("incident_id"),
        "incident_number", "notes", ((F.col("id") % 100) / F.lit(100.0)).alias("similarity_score"),
    )
    return rows, rows.select(F.col("id").alias("incident_id")), match


MAPPINGS["ruled"] = f"""
select i.id as incident_id, b.id as similar_incident_id, coalesce((b.id % 100) / 100.0e0, 0) as similarity_score,
       case when coalesce(b.notes, '') <> '' then 'The incident is similar to a previous ' || name || ' incident. The past notes indicate the same operational pattern.'
            when contains(upper(name), 'PAYMENT') or contains(upper(coalesce(p.failure_type, '')), 'PAYMENT') then '{C.CAUSE_PAYMENT}'
            when p.status_code = 401 or contains(upper(coalesce(p.failure_type, '')), 'AUTH') then '{C.CAUSE_AUTH}'
            when p.status_code >= 500 then name || ' is returning server-side errors.'
            else name || ' is showing an incident pattern that needs service and log review.' end as recommended_root_cause,
       case when coalesce(b.notes, '') <> '' then trim(regexp_extract(b.notes, 'Resolution steps:(.*)Verification:', 1))
            when contains(upper(name), 'PAYMENT') or contains(upper(coalesce(p.failure_type, '')), 'PAYMENT') then '{C.FIX_PAYMENT.replace("'", "''")}'
            when p.status_code = 401 or contains(upper(coalesce(p.failure_type, '')), 'AUTH') then '{C.FIX_AUTH}'
            when p.status_code >= 500 then 'Inspect ' || name || '{C.FIX_SERVER[1]}'
            else 'Check container status for ' || name || '{C.FIX_DEFAULT[1]}' end as recommended_fix,
       'Current service: ' || coalesce(i.service_name, 'unknown') || chr(10) || 'Alert: ' || i.alert_name || chr(10)
         || 'Failure type: ' || coalesce(p.failure_type, 'unknown') || chr(10)
         || 'Status code: ' || coalesce(cast(p.status_code as string), 'unknown') || chr(10)
         || case when b.id is null then 'No similar incident with usable notes was found.'
                 else 'Best match: ' || coalesce(b.incident_number, cast(b.id as string)) || ' with score '
                      || regexp_replace(printf('%.4f', (b.id % 100) / 100.0e0), '(\\.[0-9]+?)0+$', '\\1') end as evidence,
       'rules-and-similarity' as model_used
from (select *, coalesce(nullif(i.service_name, ''), 'affected service') as plain_name from {{incidents}} i) i
left join {{incidents}} b on b.id = i.id + 1
left join {{parsed}} p on p.incident_id = i.id
cross join lateral (select coalesce(i.service_name, p.service_name, 'affected service') as name) n
"""


@query("select * from {ruled}")
def rule_recommendation(spark, folder):
    return recommend.recommend_from(*advice_inputs(spark, folder))


@query("""
select r.incident_id, case when s.cause <> '' and s.fix <> '' then s.cause else r.recommended_root_cause end as recommended_root_cause,
       case when s.cause <> '' and s.fix <> '' then s.fix else r.recommended_fix end as recommended_fix,
       case when s.cause <> '' and s.fix <> '' then 'model-x' else r.model_used end as model_used
from {ruled} r left join (
  select incident_id,
         case incident_id % 4 when 0 then 'cause ' || regexp_extract(answer, 'cause ([0-9]+)', 1) when 1 then 'cause later' when 2 then 'only a cause' else '' end as cause,
         case incident_id % 4 when 0 then 'fix ' || cast(incident_id as string) when 1 then 'fix first.' else answer end as fix
  from {answers}) s on s.incident_id = r.incident_id
""")
def merge_generated_text(spark, folder):
    rows = recommend.recommend_from(*advice_inputs(spark, folder), A.mapped(spark, folder, A.ANSWERS))
    return rows.select("incident_id", "recommended_root_cause", "recommended_fix", "model_used")


@query("""
select incident_id,
       case incident_id % 4 when 0 then 'cause ' || regexp_extract(answer, 'cause ([0-9]+)', 1) when 1 then 'cause later' when 2 then 'only a cause' else '' end as root_cause,
       case incident_id % 4 when 0 then 'fix ' || cast(incident_id as string) when 1 then 'fix first.' else '' end as fix
from {answers}
""")
def extract_section(spark, folder):
    rows = A.mapped(spark, folder, A.ANSWERS)
    return rows.select(
        "incident_id", advice.extract_section(F.col("answer"), C.ROOT_CAUSE_HEADING).alias("root_cause"),
        advice.extract_section(F.col("answer"), C.FIX_HEADING).alias("fix"),
    )


@query("select id, case when notes is not null then trim(regexp_extract(notes, 'Resolution steps:(.*)Verification:', 1)) end as steps from {incidents}")
def resolution_from_notes(spark, folder):
    rows = A.mapped(spark, folder, A.INCIDENTS)
    return rows.select("id", advice.resolution_from_notes(F.col("notes")).alias("steps"))


MAPPINGS["doc_recommended"] = f"""
select m.*, case when best_notes <> '' then 'The incident is similar to a previous ' || name || ' incident. The past notes indicate the same operational pattern.'
                 else name || ' is showing an incident pattern that needs service and log review.' end as recommended_root_cause,
       case when best_notes <> '' then trim(replace(best_notes, 'Resolution steps:', ''))
            else 'Check container status for ' || name || '{C.FIX_DEFAULT[1].replace("'", "''")}' end as recommended_fix,
       'Current service: ' || coalesce(nullif(service_name, ''), 'unknown') || chr(10) || 'Alert: ' || coalesce(nullif(alert_name, ''), 'unknown') || chr(10)
         || 'Failure type: unknown' || chr(10) || 'Status code: unknown' || chr(10) || 'Best match: ' || cast(similar_incident_id as string)
         || ' with score ' || regexp_replace(printf('%.4f', similarity_score), '(\\.[0-9]+?)0+$', '\\1') as evidence,
       '{C.RULES_MODEL}' as model_used
from (select r.query_id as incident_id, max(case when r.rank = 1 then r.incident_id end) as similar_incident_id,
             max(case when r.rank = 1 then r.similarity_score end) as similarity_score,
             string_agg(cast(r.incident_id as string), ',' order by r.rank) as listed,
             coalesce(max(case when r.rank = 1 then r.notes end), '') as best_notes
      from {{doc_ranked}} r where r.rank <= 3 group by 1) m
join (select id, service_name, alert_name, coalesce(nullif(service_name, ''), 'affected service') as name from {{doc_incidents}}) i on i.id = m.incident_id
"""


@query("""
select incident_id, similar_incident_id, similarity_score, listed, recommended_root_cause, recommended_fix, evidence from {doc_recommended}
""")
def recommend_root_causes(spark, folder):
    rows = recommend.recommend_root_causes(
        doc_incidents(spark, folder), doc_queries(spark, folder), stop_words=STOP_WORDS
    )
    listed = F.transform("similar_incidents", lambda item: item["incident_id"].cast("string"))
    return rows.select(
        "incident_id", "similar_incident_id", "similarity_score", F.concat_ws(",", listed).alias("listed"),
        "recommended_root_cause", "recommended_fix", "evidence",
    )


@query("""
select incident_id, similar_incident_id, similarity_score, recommended_root_cause, model_used,
       row_number() over (order by incident_id) as id from {doc_recommended}
""")
def save_recommendations(spark, folder):
    """Recommendations kept by incident; the batch comes twice and is stored once."""
    path = scratch(spark, "recommendations")
    rows = stage(recommend.recommend_root_causes(doc_incidents(spark, folder), doc_queries(spark, folder), stop_words=STOP_WORDS), "results")
    for _ in range(2):
        saved.save_results(spark, path, "recommendations", rows, "answers", 0, A.ORDER_AS_OF)
    return saved.saved_results(spark, path, "recommendations").select(
        "incident_id", "similar_incident_id", "similarity_score", "recommended_root_cause", "model_used", "id")


@query(f"""
select incident_id, false as is_anomaly, case when is_anomaly then 0 else round(anomaly_score, 6) end as anomaly_score,
       case when is_anomaly then '{C.REASON_UNTRAINED}' else '{C.REASON_NORMAL}' end as reason, row_number() over (order by incident_id) as id
from {{fixed_scores}}
""")
def save_anomaly_results(spark, folder):
    """Results of all incidents, then new ones of those that were flagged: one row each, with the first row's id."""
    rows, path = stored_logs(spark, folder), scratch(spark, "results")
    encoders = stage(features.fit_encoders(rows), "encoders")
    first = stage(forest.detect_anomalies(rows.select("incident_id"), rows, encoders, fixed_model(spark)), "first-results")
    flagged = first.filter("is_anomaly").select("incident_id")
    second = forest.detect_anomalies(flagged, rows, encoders, None)
    for number, found in enumerate((first, second)):
        saved.save_results(spark, path, "anomaly_results", found, "detection", number, A.ORDER_AS_OF)
    return saved.saved_results(spark, path, "anomaly_results").select(
        "incident_id", "is_anomaly", F.round("anomaly_score", 6).alias("anomaly_score"), "reason", "id")


@query("""
select i.id as incident_id, md5('You are helping an incident analyst. Use the current incident and similar past notes. Return two short sections exactly named ''Root cause:'' and ''Recommended fix:''.'
  || chr(10) || chr(10) || 'Current incident:' || chr(10)
  || concat_ws(' ', i.alert_name, i.title, i.description, i.service_name, i.severity, i.source, i.status, i.raw_log, i.notes,
       p.log_level, p.error_message, p.exception_type, cast(p.status_code as string), p.failure_type)
  || chr(10) || chr(10) || 'Similar past incidents:' || chr(10)
  || coalesce('Incident ' || coalesce(b.incident_number, cast(b.id as string)) || ' score='
      || regexp_replace(printf('%.4f', (b.id % 100) / 100.0e0), '(\\.[0-9]+?)0+$', '\\1') || chr(10) || 'Notes:' || chr(10) || coalesce(b.notes, 'No notes available'), 'No similar incidents found.')) as digest
from {incidents} i left join {incidents} b on b.id = i.id + 1 left join {parsed} p on p.incident_id = i.id
""")
def build_prompt(spark, folder):
    rows, ids, match = advice_inputs(spark, folder)
    texts = recommend.prompts(rows, ids, match)
    return texts.select("incident_id", F.md5("prompt").alias("digest"))
