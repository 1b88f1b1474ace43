"""Isolation forest after Liu, Ting and Zhou (2008): fit as a node table, score in Arrow batches."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultline import constants as C
from faultline import schemas
from faultline.functions.text import chain
from faultline.operators.features import build_feature_matrix, fit_encoders
from faultline.operators.keyed import latest_per_key
from faultline.session import spread, stage
from faultline.sources.tables import load_model, save_model

DRAWS = 1 << 40
# A tree draws from the rows below a hash bound, this many times its sample on average.
SPARE = 4
EULER = 0.5772156649015329
# One cell per score interval in the first pass of the exact percentile.
QUANTILE_CELLS = 65536
QUANTILE_VALUES = 100_000


def path_constant(size):
    """Mean path length of an unsuccessful search among `size` rows."""
    size = np.asarray(size, dtype=float)
    safe = np.maximum(size, 3.0)
    long = 2.0 * (np.log(safe - 1.0) + EULER) - 2.0 * (safe - 1.0) / safe
    return np.where(size <= 1, 0.0, np.where(size == 2, 1.0, long))


def sample_trees(matrix: DataFrame, trees: int, sample: int, seed: int) -> DataFrame:
    """The rows of every tree, chosen by hash so that partitioning does not matter.

    Each row draws a number for each tree and goes to the trees whose number lies below a bound; a tree takes its
    smallest numbers. When a tree falls short the bound is widened and the draw repeated. The way is the same for
    any number of rows. A stored matrix with the hash of each row as `row_key` is read once per draw.
    """
    if "row_key" not in matrix.columns:
        matrix = keyed_features(matrix)
    rows = matrix.count()
    if not rows:
        return matrix.limit(0).withColumns({"tree": F.lit(0), "draw": F.lit(0).cast("bigint"), "place": F.lit(0)})
    share = min(1.0, SPARE * sample / rows)
    order = Window.partitionBy("tree").orderBy("draw", "incident_id", *C.FEATURES)
    every = F.sequence(F.lit(0), F.lit(trees - 1))
    single = [_draw(F.col("row_key"), F.lit(tree), F.lit(seed)) for tree in range(trees)]
    least = F.least(*single) if trees > 1 else single[0]
    while True:
        bound = int(DRAWS * share)
        # Most rows go to no tree: their least draw, which is plain generated code, tells so before any list is made.
        some = matrix if share >= 1 else matrix.filter(least < bound)
        # A row's draws are made once and stay beside their trees.
        draws = F.transform(every, lambda tree: F.struct(tree.alias("tree"), _draw(F.col("row_key"), tree, F.lit(seed)).alias("draw")))
        near = some.withColumn("_drawn", F.explode(F.filter(draws, lambda d: d["draw"] < bound)))
        near = near.select(*matrix.columns, "_drawn.tree", "_drawn.draw")
        place = F.row_number().over(order)
        chosen = stage(near.withColumn("place", place).filter(F.col("place") <= sample), "samples")
        if share >= 1 or chosen.count() == trees * min(sample, rows):
            return chosen
        share = min(1.0, 4 * share)


def keyed_features(matrix: DataFrame) -> DataFrame:
    """The matrix, stored, with a hash of each row."""
    return stage(matrix.withColumn("row_key", F.xxhash64("incident_id", *C.FEATURES)), "features")


def _draw(*columns) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(DRAWS))


def grow(points: np.ndarray, rng: np.random.Generator) -> list[tuple]:
    """Nodes (node, feature, threshold, left, right, size, depth) of one random tree; leaves have feature -1."""
    limit = math.ceil(math.log2(max(len(points), 2)))
    nodes, todo = [], [(0, np.arange(len(points)), 0)]
    following = 1
    while todo:
        node, members, depth = todo.pop()
        low, high = points[members].min(axis=0), points[members].max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(usable) == 0:
            nodes.append((node, -1, 0.0, -1, -1, len(members), depth))
            continue
        feature = int(rng.choice(usable))
        threshold = float(rng.uniform(low[feature], high[feature]))
        below = points[members, feature] <= threshold
        nodes.append((node, feature, threshold, following, following + 1, len(members), depth))
        todo += [(following, members[below], depth + 1), (following + 1, members[~below], depth + 1)]
        following += 2
    return nodes


def fit_trees(samples: DataFrame, seed: int, version: str) -> DataFrame:
    """One group per tree, each of at most the sample size."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        tree = int(pdf["tree"].iloc[0])
        nodes = grow(pdf[C.FEATURES].to_numpy(float), np.random.default_rng([seed, tree]))
        frame = pd.DataFrame(nodes, columns=["node", "feature", "threshold", "left", "right", "size", "depth"])
        return frame.assign(model_version=version, tree=tree)

    return samples.groupBy("tree").applyInPandas(build, schemas.FOREST_NODE)


class Walker:
    """Vectorised walk of all trees over a batch of rows."""

    def __init__(self, nodes: pd.DataFrame, sample: int):
        ordered = nodes.sort_values(["tree", "node"])
        starts = ordered.groupby("tree")["node"].size().cumsum().shift(fill_value=0).astype(int)
        offset = ordered["tree"].map(starts).to_numpy()
        self.roots = starts.to_numpy()
        self.feature = ordered["feature"].to_numpy()
        self.threshold = ordered["threshold"].to_numpy()
        self.left = ordered["left"].to_numpy() + offset
        self.right = ordered["right"].to_numpy() + offset
        self.length = ordered["depth"].to_numpy() + path_constant(ordered["size"].to_numpy())
        self.depth = int(ordered["depth"].max())
        self.scale = float(path_constant(sample)) * len(self.roots)

    def scores(self, points: np.ndarray) -> np.ndarray:
        """Negative isolation scores: near -1 is isolated, near 0 is deep. Equal points are walked once."""
        if not len(points):
            return np.zeros(0)
        points = np.ascontiguousarray(points, dtype=float) + 0.0  # no -0.0, so that equal points have equal bytes
        whole = points.view(np.dtype((np.void, points.itemsize * points.shape[1]))).ravel()
        _, firsts, place = np.unique(whole, return_index=True, return_inverse=True)
        return self._walk(points[firsts])[place.ravel()]

    def _walk(self, points: np.ndarray) -> np.ndarray:
        total = np.zeros(len(points))
        rows = np.arange(len(points))
        for root in self.roots:
            at = np.full(len(points), root)
            for _ in range(self.depth):
                feature = self.feature[at]
                inner = feature >= 0
                if not inner.any():
                    break
                below = points[rows, np.maximum(feature, 0)] <= self.threshold[at]
                at = np.where(inner, np.where(below, self.left[at], self.right[at]), at)
            total += self.length[at]
        return -np.power(2.0, -total / self.scale) if self.scale > 0 else np.full(len(points), -0.5)


def raw_scores(matrix: DataFrame, nodes: DataFrame, sample: int) -> DataFrame:
    """Add `raw_score`. The node table has a fixed upper size (trees x 2 x sample) and goes to every worker."""
    walker = Walker(nodes.toPandas(), sample)
    shared = matrix.sparkSession.sparkContext.broadcast(walker)

    def walk(batches):
        for pdf in batches:
            yield pdf.assign(raw_score=shared.value.scores(pdf[C.FEATURES].to_numpy(float)))

    layout = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in matrix.schema.fields)
    return matrix.mapInPandas(walk, f"{layout}, raw_score double")


def exact_quantile(rows: DataFrame, column: str, share: float) -> float | None:
    """Exact percentile with linear interpolation; only counts per score interval reach the driver.

    The interval holding the wanted rank is cut again until it has few distinct values. The limit on distinct values
    only chooses between two exact ways; no row is left out.
    """
    value = F.col("v")
    scores = stage(rows.select(F.col(column).cast("double").alias("v")).filter("v is not null"), "scores")
    low, high, total = scores.agg(F.min(value), F.max(value), F.count(value)).first()
    if total == 0:
        return None
    rank = math.floor(share * (total - 1))
    rest = share * (total - 1) - rank
    inside, skipped = scores, 0
    while True:
        distinct = inside.groupBy("v").agg(F.count("*").alias("n")).limit(QUANTILE_VALUES + 1).collect()
        if len(distinct) <= QUANTILE_VALUES:
            break
        width = (high - low) / QUANTILE_CELLS
        cell = F.least(F.floor((value - low) / width), F.lit(QUANTILE_CELLS - 1))
        counted = inside.groupBy(cell.alias("cell")).agg(F.count("*"), F.min(value), F.max(value))
        for _, n, cell_low, cell_high in sorted(counted.collect()):
            if skipped + n > rank:
                inside = inside.filter((value >= cell_low) & (value <= cell_high))
                low, high = cell_low, cell_high
                break
            skipped += n
    lower = upper = None
    for v, n in sorted(distinct):
        skipped += n
        if lower is None and skipped > rank:
            lower = v
        if skipped > rank + 1:
            upper = v
            break
    if rest == 0:
        return lower
    if upper is None:
        upper = scores.filter(value > max(v for v, _ in distinct)).agg(F.min(value)).first()[0]
    return lower + rest * (upper - lower)


def fit_isolation_forest(
    matrix: DataFrame,
    contamination: float = C.CONTAMINATION,
    trees: int = C.FOREST_TREES,
    sample: int = C.FOREST_SAMPLE,
    seed: int = C.FOREST_SEED,
    version: str = C.MODEL_VERSION,
    exact: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """(node table, one params row). Below five rows the contamination is 0.01.

    The threshold is the contamination percentile of the training scores.
    """
    spark = matrix.sparkSession
    matrix = spread(keyed_features(matrix))
    rows = matrix.count()
    share = C.SMALL_CONTAMINATION if rows < C.SMALL_SAMPLE else contamination
    used = min(sample, rows)
    nodes = stage(fit_trees(sample_trees(matrix, trees, used, seed), seed, version), "forest")
    scored = raw_scores(matrix, nodes, used)
    if exact:
        threshold = exact_quantile(scored, "raw_score", share)
    else:
        threshold = scored.agg(F.percentile_approx("raw_score", share, 1_000_000)).first()[0]
    params = spark.createDataFrame(
        [(version, contamination, threshold, trees, used, seed)], schemas.FOREST_PARAMS
    )
    return nodes, params


def anomaly_score(decision: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(0.5) - decision))


def anomaly_reason(flagged: Column, level: Column, status: Column, length: Column) -> Column:
    """Why a row is flagged, from its features."""
    parts = F.concat_ws(
        ", ",
        F.when(level == 1.0, F.lit(C.REASON_LEVEL)),
        F.when(status >= 500, F.concat(F.lit(C.REASON_STATUS), status.cast("int").cast("string"))),
        F.when(length > C.LONG_MESSAGE, F.lit(C.REASON_LENGTH)),
    )
    return chain(
        [(~flagged, F.lit(C.REASON_NORMAL)), (parts == "", F.lit(C.REASON_STATISTICAL))],
        F.concat(F.lit(C.REASON_PREFIX), parts),
    )


def score_isolation_forest(matrix: DataFrame, nodes: DataFrame, params: DataFrame) -> DataFrame:
    """Decision value, flag, score and reason per feature row."""
    row = params.first()
    scored = raw_scores(matrix, nodes, row["sample_size"])
    decision = F.col("raw_score") - F.lit(row["threshold"])
    return scored.withColumn("decision", decision).withColumns(
        {
            "is_anomaly": F.col("decision") < 0,
            "anomaly_score": anomaly_score(F.col("decision")),
            "reason": anomaly_reason(
                F.col("decision") < 0, F.col("is_error"), F.col("status_code"), F.col("error_msg_length")
            ),
            "model_version": F.lit(row["model_version"]),
        }
    ).drop("raw_score")


def last_logs(parsed: DataFrame) -> DataFrame:
    """The last parsed log of each incident."""
    order = [c for c in ("log_timestamp", "created_at", "id", "raw_log") if c in parsed.columns]
    return latest_per_key(parsed, ["incident_id"], order)


def requested_logs(ids: DataFrame, parsed: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Requested incident ids with the newest parsed log of each; ids without one keep a row."""
    logs = last_logs(parsed) if order is None else latest_per_key(parsed, ["incident_id"], order)
    return ids.select("incident_id").join(logs.withColumn("found", F.lit(True)), "incident_id", "left").withColumn(
        "found", F.coalesce("found", F.lit(False))
    )


def judge_logs(parsed: DataFrame, encoders: DataFrame, model: tuple[DataFrame, DataFrame] | None) -> DataFrame:
    """One result per parsed log, a default result without a model."""
    matrix = build_feature_matrix(parsed, encoders)
    if model is None:
        return matrix.select(
            "incident_id", F.lit(False).alias("is_anomaly"), F.lit(0.0).alias("anomaly_score"),
            F.lit(C.REASON_UNTRAINED).alias("reason"), F.lit(C.MODEL_VERSION).alias("model_version"),
        )
    return score_isolation_forest(matrix, *model).select("incident_id", "is_anomaly", "anomaly_score", "reason", "model_version")


def detect_anomalies(
    ids: DataFrame, parsed: DataFrame, encoders: DataFrame, model: tuple[DataFrame, DataFrame] | None
) -> DataFrame:
    """One result per requested id; ids without a log, or without a model, get a default result.

    An incident with several logs is judged by its last. `found` is false for ids without a log: those are reported
    but not saved; `missing_first` puts them before the others.
    """
    asked = ids.select("incident_id")
    results = judge_logs(last_logs(parsed.join(asked.distinct(), "incident_id", "left_semi")), encoders, model)
    joined = asked.join(results.withColumn("found", F.lit(True)), "incident_id", "left")
    return joined.select(
        "incident_id",
        F.coalesce("is_anomaly", F.lit(False)).alias("is_anomaly"),
        F.coalesce("anomaly_score", F.lit(0.0)).alias("anomaly_score"),
        F.coalesce("reason", F.lit(C.REASON_MISSING)).alias("reason"),
        "model_version",
        F.coalesce("found", F.lit(False)).alias("found"),
    )


def missing_first(results: DataFrame) -> DataFrame:
    """Results in the order of an answer: ids without a log first."""
    return results.orderBy("found", "incident_id")


def train_anomaly_model(parsed: DataFrame, **options):
    """(status, encoders, model) fitted on all parsed logs; `failed` without any."""
    if parsed.isEmpty():
        return "failed: no data", None, None
    encoders = stage(fit_encoders(parsed), "encoders")
    return "success", encoders, fit_isolation_forest(build_feature_matrix(parsed, encoders), **options)


def training_summary(parsed: DataFrame, results: DataFrame) -> DataFrame:
    """Samples trained, results saved and status in one row."""
    trained = parsed.agg(F.count("*").alias("samples_trained"))
    status = F.when(F.col("samples_trained") > 0, "success").otherwise("failed: no data")
    return trained.withColumns(
        {"results_saved": results.agg(F.count_if("found")).scalar(), "status": status}
    )


def anomaly_status(results: DataFrame, params: DataFrame, encoders: DataFrame) -> DataFrame:
    """Whether a model and encoders exist, the contamination and the number of saved results."""
    return (
        results.agg(F.count("*").alias("results_saved"))
        .withColumns(
            {
                "contamination": params.agg(F.max("contamination")).scalar(),
                "encoders_loaded": encoders.agg(F.count("*") > 0).scalar(),
            }
        )
        .withColumn("model_trained", F.col("contamination").isNotNull())
    )


def train_if_missing(spark: SparkSession, path: str, parsed: DataFrame, **options):
    """(encoders, model) stored under a path, trained and saved first when there is none."""
    encoders, model = load_model(spark, path)
    if encoders is None or model is None:
        status, encoders, model = train_anomaly_model(parsed, **options)
        if status == "success":
            save_model(path, encoders, *model)
    return encoders, model
