"""Root-cause recommendations from similar incidents, rules and stored model answers."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline import constants as C
from faultline.functions import advice
from faultline.functions.text import empty_to_null, strip
from faultline.operators.similarity import find_similar_incidents, incident_text
from faultline.session import stage

SIMILAR_FIELDS = [
    "rank", "incident_id", "incident_number", "alert_name", "service_name", "status", "severity",
    "similarity_score", "notes",
]


def attach_similar(rows: DataFrame, similar: DataFrame, key: str = "incident_id") -> DataFrame:
    """Add the ranked similar incidents as an array; k rows per incident at most."""
    item = F.struct(*[c for c in SIMILAR_FIELDS if c in similar.columns])
    lists = similar.groupBy(F.col("query_id").alias("_key")).agg(
        F.sort_array(F.collect_list(item)).alias("similar_incidents")
    )
    joined = rows.join(lists, rows[key] == lists["_key"], "left").drop("_key")
    return joined.withColumn("similar_incidents", F.coalesce("similar_incidents", F.array()))


def merge_generated_text(rules: DataFrame, answers: DataFrame | None) -> DataFrame:
    """Use a stored model answer where it names both cause and fix; the fix falls back to the whole answer.

    Answers are (incident_id, answer, model); without one the rules stay.
    """
    if answers is None:
        return rules
    text = strip(F.col("answer"))
    read = answers.select(
        "incident_id",
        empty_to_null(advice.extract_section(text, C.ROOT_CAUSE_HEADING)).alias("_cause"),
        F.coalesce(
            empty_to_null(advice.extract_section(text, C.FIX_HEADING)), empty_to_null(text)
        ).alias("_fix"),
        F.col("model").alias("_model"),
    )
    joined = rules.join(read, "incident_id", "left")
    usable = F.col("_cause").isNotNull() & F.col("_fix").isNotNull()
    return joined.withColumns(
        {
            "recommended_root_cause": F.when(usable, F.col("_cause")).otherwise(F.col("recommended_root_cause")),
            "recommended_fix": F.when(usable, F.col("_fix")).otherwise(F.col("recommended_fix")),
            "model_used": F.when(usable, F.col("_model")).otherwise(F.col("model_used")),
        }
    ).drop("_cause", "_fix", "_model")


def recommend_from(incidents: DataFrame, ids: DataFrame, similar: DataFrame, answers=None) -> DataFrame:
    """One recommendation per requested incident, from its similar incidents."""
    col = F.col
    best = similar.filter(col("rank") == 1).select(
        col("query_id").alias("_key"),
        col("incident_id").alias("similar_incident_id"),
        col("similarity_score").alias("_score"),
        col("notes").alias("_notes"),
        F.coalesce(empty_to_null(col("incident_number")), col("incident_id").cast("string")).alias("_name"),
    )
    current = incidents.join(ids.select(col("incident_id").alias("id")), "id", "left_semi")
    joined = current.join(best, current["id"] == best["_key"], "left")
    nested = "parsed_log" in incidents.columns

    def parsed(name: str, kind: str = "string"):
        return col(f"parsed_log.{name}") if nested else F.lit(None).cast(kind)

    failure, status = parsed("failure_type"), parsed("status_code", "int")
    cause, fix = advice.rule_recommendation(
        col("service_name"), parsed("service_name"), failure, status, col("_notes")
    )
    rules = joined.select(
        col("id").alias("incident_id"),
        "similar_incident_id",
        F.coalesce("_score", F.lit(0.0)).alias("similarity_score"),
        cause.alias("recommended_root_cause"),
        fix.alias("recommended_fix"),
        advice.build_evidence(
            col("service_name"), col("alert_name"), failure, status, col("_name"), col("_score")
        ).alias("evidence"),
        F.lit(C.RULES_MODEL).alias("model_used"),
    )
    return merge_generated_text(rules, answers)


def recommend_root_causes(incidents: DataFrame, ids: DataFrame, k: int = 3, answers=None, **options) -> DataFrame:
    """Recommendations with their similar incidents; one fit serves all requested ids."""
    similar = stage(find_similar_incidents(incidents, ids, k, **options), "similar")
    return attach_similar(recommend_from(incidents, ids, similar, answers), similar)


def prompts(incidents: DataFrame, ids: DataFrame, similar: DataFrame) -> DataFrame:
    """Analyst prompt per requested incident."""
    current = incidents.join(ids.select(F.col("incident_id").alias("id")), "id", "left_semi")
    texts = current.select(F.col("id").alias("incident_id"), incident_text(current).alias("text"))
    listed = attach_similar(texts, similar)
    return listed.select(
        "incident_id", advice.build_prompt(F.col("text"), F.col("similar_incidents")).alias("prompt")
    )
