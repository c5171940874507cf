"""Churn models on labelled snapshots: temporal split, boosted trees, explanations, lists of customers at risk."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brasswork.functions.metrics import curve_metrics, ranking_metrics
from brasswork.functions.numbers import ratio
from brasswork.operators.ranges import top_rows
from brasswork.operators.trees import TreeEnsemble, attributed, ensemble_of, importance, reasons, scored
from brasswork.session import cut

MODEL_FEATURES = ("recency_days", "frequency", "monetary", "units_per_line", "categories", "promo_share", "mean_discount_pct", "online_share", "tenure_days", "avg_basket_value")
KEYS = ("customer_id", "snapshot_date")
TRAIN_SNAPSHOTS = 6
ROWS_PER_TASK = 50_000
MOST_ROWS_PER_TASK = 1_000_000  # beyond that there are more tasks than cores, in whole turns


def temporal_split(snapshots: DataFrame, train_dates: int = TRAIN_SNAPSHOTS) -> tuple[DataFrame, DataFrame]:
    """Rows of the first train_dates snapshot dates, and the others. Raises ValueError if none are left to test, or a date is on both sides."""
    dates = [r[0] for r in snapshots.select("snapshot_date").distinct().orderBy("snapshot_date").collect()]
    if len(dates) <= train_dates:
        raise ValueError(f"{len(dates)} snapshot dates leave nothing to test")
    boundary = F.lit(dates[train_dates])
    return snapshots.where(F.col("snapshot_date") < boundary), snapshots.where(F.col("snapshot_date") >= boundary)


def shared_dates(train: DataFrame, test: DataFrame) -> DataFrame:
    return train.select("snapshot_date").intersect(test.select("snapshot_date"))


def fit_model(train: DataFrame, features: Sequence[str] = MODEL_FEATURES, trees: int = 300, depth: int = 4, step: float = 0.05, seed: int = 42, test: DataFrame | None = None) -> PipelineModel:
    """Medians of the training rows for nulls, then boosted trees with the classes weighed alike; the snapshot dates of test, if given, must be others."""
    if test is not None and (both := shared_dates(train, test).limit(1).count()):
        raise ValueError(f"{both} snapshot date or more is in train and test")
    counts = train.agg(F.sum("churn").alias("p"), F.count("*").alias("n")).first()
    cores = train.sparkSession.sparkContext.defaultParallelism
    weight = (counts["n"] - counts["p"]) / max(1, counts["p"])
    rows = train.select(*KEYS, *[F.col(c).cast("double").alias(c) for c in features], F.col("churn").cast("double").alias("label"), F.when(F.col("churn") == 1, weight).otherwise(1.0).alias("weight"))
    # every tree starts a few jobs, whose tasks should be worth their start and fill the cores in whole turns; trees sample by
    # a row's place, so rows are dealt and sorted by their keys
    tasks = max(1, min(-(-counts["n"] // ROWS_PER_TASK), cores * -(-counts["n"] // (cores * MOST_ROWS_PER_TASK))))
    rows = rows.repartition(tasks, *KEYS).sortWithinPartitions(*KEYS).drop(*KEYS).persist()
    filled = [f"{c}_filled" for c in features]
    stages = [
        Imputer(strategy="median", inputCols=list(features), outputCols=filled), VectorAssembler(inputCols=filled, outputCol="features"),
        GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=step, subsamplingRate=0.8, featureSubsetStrategy="0.8", minInstancesPerNode=20, weightCol="weight", seed=seed),
    ]
    try:
        return Pipeline(stages=stages).fit(rows)
    finally:
        rows.unpersist()


def score(model: PipelineModel, frame: DataFrame, features: Sequence[str] = MODEL_FEATURES) -> DataFrame:
    """Key, label and churn_score."""
    rows = frame.select("customer_id", "snapshot_date", "churn", *[F.col(c).cast("double").alias(c) for c in features])
    return model.transform(rows).select("customer_id", "snapshot_date", "churn", vector_to_array("probability")[1].alias("churn_score"))


def evaluate(scores: DataFrame, k: float = 0.2) -> DataFrame:
    scores = cut(scores.select("customer_id", "churn", "churn_score"))  # several passes read them, and no model should score for each
    return ranking_metrics(scores, "churn_score", "churn", "customer_id", k).crossJoin(F.broadcast(curve_metrics(scores, "churn_score", "churn")))  # a row each


def flat(model: PipelineModel | TreeEnsemble) -> TreeEnsemble:
    return model if isinstance(model, TreeEnsemble) else ensemble_of(model)


def contributions(model: PipelineModel | TreeEnsemble, frame: DataFrame) -> DataFrame:
    """A row for each row and feature: customer_id, snapshot_date, feature, feature_value, contribution, log_odds, expected.

    Contributions are Shapley values of the trees in log-odds: those of a row and `expected` add to its log_odds.
    """
    trees = flat(model)
    parts = attributed(trees, frame, ("customer_id", "snapshot_date"))
    each = F.inline(F.arrays_zip(F.array(*[F.lit(c) for c in trees.features]).alias("feature"), F.col("values").alias("feature_value"), F.col("contributions").alias("contribution")))
    return parts.select("customer_id", "snapshot_date", each, "log_odds", "expected")


def global_importance(model: PipelineModel | TreeEnsemble, frame: DataFrame, top: int = 15) -> DataFrame:
    """feature, importance: the mean absolute contribution over all rows of a frame, largest first."""
    return importance(flat(model), frame, top)


def local_reasons(model: PipelineModel | TreeEnsemble, frame: DataFrame, customers: int = 25, most: int = 6) -> DataFrame:
    """The largest contributions, by size, for the rows of highest score: customer_id, snapshot_date, churn_score,
    feature_rank, feature, feature_value, contribution.
    """
    trees = flat(model)
    top = scored(trees, frame, ("customer_id", "snapshot_date", *trees.features)).orderBy(F.desc("churn_score"), "customer_id", "snapshot_date").limit(customers)
    return reasons(trees, top, ("customer_id", "snapshot_date", "churn_score"), most)


def churn_rates(snapshots: DataFrame) -> DataFrame:
    return snapshots.groupBy("snapshot_date").agg(F.count("*").alias("customers"), ratio(F.sum("churn").cast("double"), F.count("*")).alias("churn_rate"))


def at_risk(scores: DataFrame, snapshot, k: float = 0.2) -> DataFrame:
    """The max(1, floor(k n)) rows of highest score of one snapshot."""
    rows = scores.where(F.col("snapshot_date") == F.lit(snapshot))
    return top_rows(rows, [F.col("churn_score").isNull(), -F.col("churn_score"), F.col("customer_id")], k, int)
