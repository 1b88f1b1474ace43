"""Features, isolation forest, similarity and recommendations."""

import math
import random
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from faultline import constants as C
from faultline.functions import advice
from faultline.operators import features, forest, recommend, similarity
from faultline.session import scratch
from faultline.sources import tables

PARSED = "incident_id bigint, service_name string, log_level string, error_message string, status_code int, failure_type string, log_timestamp timestamp_ntz"
MATRIX = "incident_id bigint, status_code float, is_error float, service_idx float, failure_idx float, hour_of_day float, error_msg_length float"


def test_features(spark):
    rows = spark.sql(
        """select * from values
        (1L, 'payment-service', 'ERROR', 'Risk check failed', 500, 'PAYMENT_BLOCKED', timestamp_ntz '2026-07-12 15:30:00'),
        (2L, '', 'info', null, null, 'never seen', null) as t(incident_id, service_name, log_level, error_message, status_code, failure_type, log_timestamp)"""
    )
    encoders = features.fit_encoders(rows.filter("incident_id = 1"))
    index = {(r.encoder, r["class"]): r.idx for r in encoders.collect()}
    assert index["service", "UNKNOWN"] == 0 and index["service", "incident-service"] == 1
    matrix = {r.incident_id: r for r in features.build_feature_matrix(rows, encoders).collect()}
    assert tuple(matrix[1])[1:] == (500, 1, index["service", "payment-service"], index["failure_type", "PAYMENT_BLOCKED"], 15, 17)
    assert tuple(matrix[2])[1:] == (0, 0, index["service", "UNKNOWN"], index["failure_type", "UNKNOWN"], 0, 0)
    assert one(spark, features.hour_of_day(F.lit("2026-07-12T15:30:00+05:00"))) == 15
    assert one(spark, features.status_feature(F.lit("NaN"))) == 0


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def outlier_matrix(spark):
    rng = np.random.default_rng(1)
    rows = np.vstack([rng.normal(10, 1, (50, 6)), rng.normal(50, 5, (5, 6))])
    return spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(rows)], MATRIX)


def test_forest_separates_an_outlier(spark):
    model = forest.fit_isolation_forest(outlier_matrix(spark), contamination=0.1)
    probes = spark.createDataFrame([(1, *[10.0] * 6), (2, 500.0, 1.0, 10.0, 10.0, 10.0, 600.0)], MATRIX)
    rows = {r.incident_id: r for r in forest.score_isolation_forest(probes, *model).collect()}
    assert not rows[1].is_anomaly and rows[1].anomaly_score < 0.5
    assert rows[2].is_anomaly and rows[2].anomaly_score >= 0.5
    assert rows[2].reason == (
        "Anomaly flagged due to: high-severity error level, HTTP status code 500, unusually long stack trace/error message"
    )


def test_forest_does_not_depend_on_partitions(spark):
    matrix = outlier_matrix(spark)
    found = [
        sorted(map(tuple, forest.fit_isolation_forest(matrix.repartition(n), trees=5)[0].collect())) for n in (1, 4, 17)
    ]
    assert found[0] == found[1] == found[2]


def test_reasons(spark):
    def reason(flagged, level, status, length):
        return one(spark, forest.anomaly_reason(F.lit(flagged), F.lit(level), F.lit(status), F.lit(length)))

    assert reason(True, 0.0, 200.0, 10.0) == "Statistical anomaly in log pattern"
    assert reason(False, 1.0, 503.0, 600.0) == "Log pattern is within the expected range"


def test_missing_and_untrained(spark):
    parsed = spark.createDataFrame([(1, "s", "ERROR", "m", 500, "f", None)], PARSED)
    ids = spark.createDataFrame([(1,), (2,), (2,)], "incident_id bigint")
    rows = forest.detect_anomalies(ids, parsed, features.fit_encoders(parsed), None).collect()
    assert sorted((r.incident_id, r.reason, r.found) for r in rows) == [
        (1, "Model not trained", True), (2, "Incident parsed log not found", False), (2, "Incident parsed log not found", False),
    ]
    assert forest.train_anomaly_model(parsed.limit(0))[0] == "failed: no data"


def test_model_round_trip(spark):
    path = scratch(spark, "model")
    assert tables.load_model(spark, path) == (None, None)
    matrix = outlier_matrix(spark)
    model = forest.fit_isolation_forest(matrix, trees=10)
    tables.save_model(path, spark.createDataFrame([("service", "a", 0)], "encoder string, class string, idx int"), *model)
    _, stored = tables.load_model(spark, path)
    first, second = (forest.score_isolation_forest(matrix, *m).orderBy("incident_id").collect() for m in (model, stored))
    assert first == second


@pytest.mark.parametrize("values", [[1.0], [3.0, 1.0], [5.0] * 9 + [1.0], list(range(101))])
def test_exact_quantile(spark, values, monkeypatch):
    monkeypatch.setattr(forest, "QUANTILE_VALUES", 4)
    monkeypatch.setattr(forest, "QUANTILE_CELLS", 8)
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    for share in (0.0, 0.05, 0.333, 0.5, 1.0):
        assert math.isclose(forest.exact_quantile(df, "v", share), float(np.quantile(values, share)), abs_tol=1e-12)


def day(n):
    return datetime(2026, 1, n)


# --- similarity -------------------------------------------------------------------------------------------

COLUMNS = (
    "id bigint, alert_name string, title string, description string, incident_number string, service_name string, severity string, "
    "status string, source string, raw_log string, notes string, resolved_at timestamp_ntz, updated_at timestamp_ntz"
)


def small_corpus():
    random.seed(3)
    words = "disk full login timeout payment blocked retry queue node error".split()
    rows = []
    for key in range(60):
        text = " ".join(random.choice(words) for _ in range(random.randint(0, 6)))
        if key % 3 == 0:
            text = "payment blocked error"
        notes = random.choice([None, "Resolution steps: restart it Verification: ok"])
        rows.append(
            (key, random.choice(["A", "B", None]), None, None, None, random.choice(["s1", "s2", ""]), None,
             random.choice(["OPEN", "RESOLVED"]), None, text, notes, None, None)
        )
    return rows


def brute_force(rows, query, k, size):
    """Ranks of one query by a fit of its own over it and all others."""
    def text(row):
        return " ".join(str(row[i]) for i in (1, 2, 3, 5, 6, 8, 7, 9, 10) if row[i])

    def grams(row):
        import re

        words = re.findall(r"\w\w+", text(row).lower())
        return words + [f"{a} {b}" for a, b in zip(words, words[1:])]

    counts = {}
    for row in rows:
        for gram in grams(row):
            counts[gram] = counts.get(gram, 0) + 1
    kept = sorted(counts, key=lambda g: (-counts[g], g))[:size]
    df = {g: sum(g in grams(row) for row in rows) for g in kept}

    def vector(row):
        found = grams(row)
        raw = np.array([found.count(g) * (math.log((1 + len(rows)) / (1 + df[g])) + 1) for g in kept])
        norm = np.linalg.norm(raw)
        return raw / norm if norm else raw

    scored = []
    for row in rows:
        if row[0] == query[0]:
            continue
        bonus = 0.15 * bool(query[5] and query[5] == row[5]) + 0.12 * bool(query[1] and query[1] == row[1])
        bonus += 0.08 * bool(row[7] == "RESOLVED" and row[10])
        scored.append((-round(min(1.0, float(vector(query) @ vector(row)) + bonus), 4), -row[0]))
    return [(-key, -score) for score, key in sorted(scored)[:k]]


@pytest.mark.parametrize("block, shard", [(2048, 50_000), (7, 5)])
def test_one_fit_equals_a_fit_per_query(spark, monkeypatch, block, shard):
    monkeypatch.setattr(similarity, "QUERY_BLOCK", block)
    monkeypatch.setattr(similarity, "CANDIDATE_SHARD", shard)
    rows = small_corpus()
    df = spark.createDataFrame(rows, COLUMNS)
    ids = df.select(F.col("id").alias("incident_id"))
    found = similarity.find_similar_incidents(df, ids, k=4, vocabulary_size=30, stop_words=[]).collect()
    ranked = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        ranked.setdefault(r.query_id, []).append((r.incident_id, r.similarity_score))
    for row in rows:
        assert ranked[row[0]] == brute_force(rows, row, 4, 30)


def test_blocks_copy_few_vectors_and_terms_are_not_shuffled(spark):
    assert similarity.QUERY_BLOCK >= 32_768
    df = spark.createDataFrame(small_corpus(), COLUMNS)
    words = similarity.document_words(similarity.signatures(df), [])
    counted, numbered = similarity.document_terms(words, similarity.limit_vocabulary(words, 30))
    assert numbered.count() == 30
    weights = similarity.tfidf_l2(counted, similarity.idf_table(counted, numbered))
    assert "Exchange" not in weights._jdf.queryExecution().executedPlan().toString()
    lengths = weights.select(F.aggregate("weights", F.lit(0.0), lambda total, w: total + w * w).alias("n")).collect()
    assert len(lengths) == 60 and all(round(row.n, 9) in (0, 1) for row in lengths)


def test_tiles_keep_ties_and_capped_scores(monkeypatch):
    """Small tiles against a plain product, with many scores of 1 and many equal ones."""
    monkeypatch.setattr(similarity, "TILE", 7)
    monkeypatch.setattr(similarity, "CHUNK", 16)
    monkeypatch.setattr(similarity, "FIRST_CHUNK", 2)
    rng = np.random.default_rng(5)
    sparse = [np.sort(rng.choice(12, rng.integers(0, 4), replace=False)) for _ in range(120)]
    frame = pd.DataFrame({"signature": [bytes([n]) for n in range(120)], "positions": sparse})
    frame["weights"] = [np.full(len(p), 1 / math.sqrt(len(p) or 1)) for p in sparse]
    for name in similarity.MATCHED:
        frame[name] = rng.choice(["", "a", "b"], 120)
    frame["has_notes"] = rng.random(120) < 0.5
    frame = frame.assign(no_resolved=False, resolved_at=0, no_updated=False, updated_at=0, id=range(120))
    dense = np.zeros((120, 12))
    for row, (p, w) in enumerate(zip(frame["positions"], frame["weights"])):
        dense[row, p] = w
    found = similarity._compare(5, 12)(frame, frame)
    for row in range(120):
        total = dense @ dense[row] + C.BONUS_NOTES * frame["has_notes"]
        for name, weight in C.BONUS:
            total = total + weight * ((frame[name] == frame[name][row]) & (frame[name] != ""))
        scores = np.round(np.minimum(1, total), 4)
        expected = sorted((-score, -n) for n, score in enumerate(scores))[:5]
        own = found[found["query_signature"] == bytes([row])]
        assert [(-s, -n[0]) for n, s in zip(own["signature"], own["score"])] == expected


def test_rounds_of_places_give_the_ranks_of_one_round(spark, monkeypatch):
    """Bounds and answered queries are carried from round to round, null times lie somewhere, too."""
    for name, value in (("ROUND_PAIRS", 1500), ("ROUND_GROWTH", 2), ("QUERY_BLOCK", 11), ("CANDIDATE_SHARD", 9), ("SEGMENT", 4), ("CHUNK", 6)):
        monkeypatch.setattr(similarity, name, value)
    monkeypatch.setattr(similarity, "LEVELS", (2, 5, 9))
    jobs, cells = [], similarity._cells
    monkeypatch.setattr(similarity, "_cells", lambda *options: jobs.append(options[4:]) or cells(*options))
    rows = small_corpus()
    # Of the same words but for rare ones: their best score 1.
    rows += [(100 + n, "A", None, None, None, "s1", None, "OPEN", None, f"payment blocked error retry x{n}", None, None, None) for n in range(30)]
    df = spark.createDataFrame(rows, COLUMNS)
    ids = df.select(F.col("id").alias("incident_id"))
    found = similarity.find_similar_incidents(df, ids, k=4, vocabulary_size=30, stop_words=[]).collect()
    ranked = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        ranked.setdefault(r.query_id, []).append((r.incident_id, r.similarity_score))
    for row in rows:
        assert ranked[row[0]] == brute_force(rows, row, 4, 30)
    # Every candidate is in one round, and some queries are answered before the last.
    assert len(jobs) > 2 and jobs[-1][0] < jobs[0][0] - 9
    assert sum(known for _, known in jobs) == jobs[0][0]


def test_most_pairs_are_ruled_out_by_bounds_and_cells_stay_apart(spark, monkeypatch):
    """Texts of four vocabularies: few pairs are scored one by one, and as many partitions as cells wait for cores."""
    rng = np.random.default_rng(9)
    sparse = [np.sort(rng.choice(60, rng.integers(8, 16), replace=False)) + 60 * (n % 4) for n in range(2000)]
    frame = pd.DataFrame({"signature": [n.to_bytes(2) for n in range(2000)], "positions": sparse})
    frame["weights"] = [(w := rng.random(len(p))) / np.linalg.norm(w) for p in sparse]
    for name in similarity.MATCHED:
        frame[name] = ""
    frame["service_name"] = [f"s{n % 4}" for n in range(2000)]
    frame = frame.assign(has_notes=False, no_resolved=False, resolved_at=0, no_updated=False, updated_at=0, id=range(2000))
    scored, dots = [], similarity._Vectors.dots
    monkeypatch.setattr(similarity._Vectors, "dots", lambda self, rows, *other: scored.append(len(rows)) or dots(self, rows, *other))
    found = similarity._compare(4, 240)(frame, frame)
    assert len(found) == 8000 and sum(scored) < 2000 * 2000 / 40
    dense = np.zeros((2000, 240))
    for row, (p, w) in enumerate(zip(frame["positions"], frame["weights"])):
        dense[row, p] = w
    for row in range(0, 2000, 50):
        scores = np.round(np.minimum(1, dense @ dense[row] + 0.15 * (np.arange(2000) % 4 == row % 4)), 4)
        expected = sorted((-score, -n) for n, score in enumerate(scores))[:4]
        own = found[found["query_signature"] == row.to_bytes(2)]
        assert [(-s, -int.from_bytes(n)) for n, s in zip(own["signature"], own["score"])] == expected
    queries = spark.createDataFrame([(bytes([n]), [n], [1.0], "", "", "", "", "", False, -1.0) for n in range(40)], (
        "signature binary, positions array<int>, weights array<double>, service_name string, alert_name string, failure_type string, "
        "exception_type string, status_code string, has_notes boolean, floor double"))
    place = F.expr("named_struct('no_resolved', true, 'resolved_at', 1, 'no_updated', true, 'updated_at', 1, 'id', 1L)")
    cells = similarity._cells(queries, queries.withColumn("place", place), 4, 64, 40, 40)
    assert cells.count() == 160
    assert cells.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


def test_bonus_and_texts(spark):
    both = F.struct(
        *[F.lit("x").alias(n) for n in ("service_name", "alert_name", "failure_type", "exception_type")],
        F.lit(500).alias("status_code"), F.lit("RESOLVED").alias("status"), F.lit("n").alias("notes"),
    )
    assert round(one(spark, similarity.structured_bonus(both, both)), 4) == 0.61
    assert one(spark, advice.resolution_from_notes(F.lit("x Resolution steps: restart it Verification: ok"))) == "restart it"
    assert one(spark, advice.resolution_from_notes(F.lit(" whole "))) == "whole"
    answer = F.lit("Root cause: A\nRecommended fix: B")
    assert one(spark, advice.extract_section(answer, C.ROOT_CAUSE_HEADING)) == "A"
    assert one(spark, advice.extract_section(answer, C.FIX_HEADING)) == "B"
    assert [one(spark, advice.score_text(F.lit(v))) for v in (0.61, 1.0, 0.1234, 0.5)] == ["0.61", "1.0", "0.1234", "0.5"]


def test_recommendation_without_matches(spark):
    df = spark.createDataFrame([(1, "A", None, None, None, "payment-service", None, "OPEN", None, "x", None, None, None)], COLUMNS)
    rows = recommend.recommend_root_causes(df, df.select(F.col("id").alias("incident_id")), stop_words=[]).collect()
    assert rows[0].similarity_score == 0 and rows[0].similar_incident_id is None and rows[0].similar_incidents == []
    assert rows[0].recommended_root_cause == C.CAUSE_PAYMENT and C.NO_MATCH_LINE in rows[0].evidence


def test_an_incident_without_signal_fields_is_answered_but_no_candidate(spark):
    blank = [None] * 13
    rows = [(i, "A", None, None, None, "s", None, "OPEN", None, "x", None, None, None) for i in (1, 2)]
    rows.append(tuple(v if i else 3 for i, v in enumerate([*blank[:2], "x only a title", *blank[3:]])))
    found = similarity.find_similar_incidents(
        spark.createDataFrame(rows, COLUMNS), spark.createDataFrame([(1,), (3,)], "incident_id long"), k=5, stop_words=[]
    ).collect()
    assert sorted((r.query_id, r.incident_id) for r in found) == [(1, 2), (3, 1), (3, 2)]


def test_repeated_logs_give_one_result(spark):
    logs = [(1, "s", "ERROR", "m", None, 500, "t", "F", day(n), "r") for n in (1, 3, 2)] + [(2, "s", "INFO", "m", None, 200, "t", "F", day(1), "r")]
    parsed = spark.createDataFrame(logs, (
        "incident_id long, service_name string, log_level string, error_message string, exception_type string, "
        "status_code int, trace_id string, failure_type string, log_timestamp timestamp_ntz, raw_log string"))
    ids = spark.createDataFrame([(1,), (2,), (9,)], "incident_id long")
    results = forest.detect_anomalies(ids, parsed, features.fit_encoders(parsed), None)
    assert [(r.incident_id, r.found) for r in forest.missing_first(results).collect()] == [(9, False), (1, True), (2, True)]
    assert forest.last_logs(parsed).filter("incident_id = 1").first().log_timestamp == day(3)


def test_sampling_is_one_way_for_any_number_of_rows(spark):
    names = ", ".join(f"{c} float" for c in C.FEATURES)
    for rows in (3, 300, 40_000):
        matrix = spark.range(rows).selectExpr("id % 97 as incident_id", *[f"cast(id % {p} as float) as {c}" for p, c in zip((5, 2, 7, 11, 24, 300), C.FEATURES)])
        chosen = forest.sample_trees(matrix, 10, 256, 1)
        assert {r["count"] for r in chosen.groupBy("tree").count().collect()} == {min(256, rows)}
    assert forest.sample_trees(spark.createDataFrame([], "incident_id long, " + names), 10, 256, 1).count() == 0


def test_a_model_is_one_version(spark, tmp_path):
    path = str(tmp_path / "model")
    assert tables.load_model(spark, path) == (None, None)
    for n in (1, 2):
        tables.save_model(path, *[spark.range(n).withColumnRenamed("id", name) for name in ("e", "n", "p")])
    encoders, (nodes, params) = tables.load_model(spark, path)
    assert (encoders.count(), nodes.count(), params.count()) == (2, 2, 2)


def test_equal_points_are_walked_once():
    nodes = pd.DataFrame([(0, 0, 0, 0.0, 1, 2, 3, 0), (0, 1, -1, 0.0, -1, -1, 1, 1), (0, 2, -1, 0.0, -1, -1, 2, 1)],
                         columns=["tree", "node", "feature", "threshold", "left", "right", "size", "depth"])
    walker, seen = forest.Walker(nodes, 3), []
    points = np.array([[0.0, 1], [-0.0, 1], [2, 1], [2, 1], [2, 5], [0, 1]])
    want = walker._walk(points)
    walk = walker._walk
    walker._walk = lambda some: seen.append(len(some)) or walk(some)
    assert walker.scores(points).tolist() == want.tolist() and seen == [3]
    assert len(walker.scores(np.zeros((0, 2)))) == 0
