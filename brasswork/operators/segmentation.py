"""Customer segments: k-means with a choice of k, density clusters, and names by rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brasswork.functions.numbers import ratio
from brasswork.operators.ranges import quantiles
from brasswork.session import cut

CLUSTER_FEATURES = ("recency_days", "frequency", "monetary", "units", "categories", "promo_share", "mean_discount_pct", "online_share", "avg_basket_value")
SAMPLE = 4000


def standardise(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns less their mean, over their population deviation (1 where that is 0), as z_<column>. Raises ValueError for nulls."""
    names = list(columns)
    missing = [c for c in names if c not in frame.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    stats = frame.agg(*[F.avg(F.col(c).cast("double")).alias(f"m_{c}") for c in names], *[F.stddev_pop(F.col(c).cast("double")).alias(f"s_{c}") for c in names], *[F.sum(F.col(c).isNull().cast("int")).alias(f"n_{c}") for c in names])
    nulls = stats.first()
    empty = [c for c in names if nulls[f"n_{c}"]]
    if empty:
        raise ValueError(f"nulls in {empty}; fill or drop them first")
    joined = frame.crossJoin(F.broadcast(stats))
    z = {f"z_{c}": F.coalesce((F.col(c).cast("double") - F.col(f"m_{c}")) / F.nullif(F.col(f"s_{c}"), F.lit(0.0)), F.lit(0.0)) for c in names}
    return joined.withColumns(z).drop(*[f"{p}_{c}" for c in names for p in "msn"])


def _vectors(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=[f"z_{c}" for c in columns], outputCol="features").transform(standardise(frame, columns))


def fit_clusters(frame: DataFrame, columns: Sequence[str] = CLUSTER_FEATURES, k: int = 6, starts: int = 10, seed: int = 42, max_iter: int = 40) -> DataFrame:
    """frame with z columns and `cluster`: the best of several seeded starts."""
    vectors = _vectors(cut(frame), columns).persist()  # standardising reads the frame twice, every start the vectors several times
    try:
        best = min((KMeans(k=k, seed=seed + i, maxIter=max_iter).fit(vectors) for i in range(starts)), key=lambda m: m.summary.trainingCost)
        return cut(best.transform(vectors).withColumnRenamed("prediction", "cluster").drop("features"))
    finally:
        vectors.unpersist()


def silhouette(x: np.ndarray, labels: np.ndarray) -> float:
    """Mean Euclidean silhouette; a point alone in its cluster scores 0."""
    kinds, codes = np.unique(labels, return_inverse=True)
    if len(kinds) < 2:
        return float("nan")
    sums = np.zeros((len(x), len(kinds)))
    for start in range(0, len(x), 512):
        part = x[start : start + 512]
        away = np.sqrt(np.maximum((part * part).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * part @ x.T, 0))
        for k in range(len(kinds)):
            sums[start : start + len(part), k] = away[:, codes == k].sum(1)
    sizes = np.bincount(codes)
    own = sums[np.arange(len(x)), codes] / np.maximum(sizes[codes] - 1, 1)
    means = sums / sizes[None]
    means[np.arange(len(x)), codes] = np.inf
    near = means.min(1)
    score = np.where(sizes[codes] > 1, (near - own) / np.maximum(np.maximum(near, own), 1e-300), 0.0)
    return float(score.mean())


def sample_rows(frame: DataFrame, columns: Sequence[str], key: str, most: int = SAMPLE) -> np.ndarray:
    """z rows of at most `most` customers, those of least key hash: a bounded sample for quadratic work."""
    z = [f"z_{c}" for c in columns]
    few = standardise(frame, columns).orderBy(F.xxhash64(key), key).limit(most).select(*z)
    return few.toPandas().to_numpy(float)


def lloyd(x: np.ndarray, k: int, seed: int = 42, starts: int = 10, steps: int = 60) -> np.ndarray:
    """Labels of the best of several k-means runs on a bounded sample."""
    random, best, cost = np.random.default_rng(seed), None, np.inf
    for _ in range(starts):
        centres = x[random.choice(len(x), k, replace=False)]
        for _ in range(steps):
            away = (x * x).sum(1)[:, None] + (centres * centres).sum(1)[None] - 2 * x @ centres.T
            labels = away.argmin(1)
            new = np.array([x[labels == i].mean(0) if (labels == i).any() else centres[i] for i in range(k)])
            if np.allclose(new, centres):
                break
            centres = new
        total = away.min(1).sum()
        if total < cost:
            best, cost = labels, total
    return best


def silhouettes(frame: DataFrame, columns: Sequence[str] = CLUSTER_FEATURES, ks: Sequence[int] = range(2, 11), key: str = "customer_id", most: int = SAMPLE) -> dict[int, float]:
    """Silhouette by k on a bounded sample; a k of the sample's size or more is left out."""
    x = sample_rows(frame, columns, key, most)
    return {k: silhouette(x, lloyd(x, k)) for k in ks if k < len(x)}


def select_k(scores: dict[int, float], tolerance: float = 0.02, preferred: Sequence[int] = (6, 7, 8)) -> int:
    """Of the k within tolerance of the best score: the best preferred one, else the best; the smaller on ties."""
    best = max(scores.values())
    near = [k for k, s in scores.items() if s >= best - tolerance]
    pool = [k for k in near if k in preferred] or near
    return min(pool, key=lambda k: (-scores[k], k))


def profiles(frame: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """Customers, median and mean of each column by group."""
    means = frame.groupBy(group).agg(F.count("*").alias("customers"), *[F.round(F.avg(F.col(c).cast("double")), 6).alias(f"mean_{c}") for c in columns])
    joined = means.join(group_medians(frame, group, columns), _name(group) == F.col("group_"), "left")
    return joined.select(group, "customers", *[x for c in columns for x in (F.round(f"median_{c}", 6).alias(f"median_{c}"), f"mean_{c}")])


def segment_summary(frame: DataFrame, group: str = "segment") -> DataFrame:
    """Customers, revenue, shares and medians by segment."""
    frame = cut(frame.select(group, "monetary", "recency_days", "frequency"))
    sums = frame.groupBy(group).agg(F.count("*").alias("customers"), F.round(F.sum("monetary"), 4).alias("revenue"))
    medians = group_medians(frame, group, ("recency_days", "frequency", "monetary"))
    sums = sums.join(medians, _name(group) == F.col("group_"), "left").select(
        group, "customers", "revenue", F.round("median_recency_days", 4).alias("median_recency"), F.round("median_frequency", 4).alias("median_frequency"), F.round("median_monetary", 4).alias("median_monetary")
    )
    whole = frame.agg(F.count("*").alias("all_customers"), F.round(F.sum("monetary"), 4).alias("all_revenue"))
    out = sums.crossJoin(F.broadcast(whole))
    return out.select(group, "customers", "revenue", "median_recency", "median_frequency", "median_monetary", ratio(F.col("customers").cast("double"), F.col("all_customers")).alias("customer_share"), F.round(ratio(F.col("revenue"), F.col("all_revenue")), 6).alias("revenue_share"), F.round(ratio(F.col("revenue"), F.col("customers")), 4).alias("revenue_per_customer"))


def against_population(frame: DataFrame, group: str, name: str, columns: Sequence[str]) -> DataFrame:
    """feature, segment_median, population_median."""
    told = frame.withColumn("in_", F.coalesce(F.col(group) == name, F.lit(False)))
    found = group_quantiles(told, "in_", {c: F.col(c) for c in columns}, (0.5,))
    of = lambda when: F.round(F.max(F.when(when, F.col("quantiles")[0])), 6)
    return found.groupBy("feature").agg(of(F.col("group_")).alias("segment_median"), of(F.col("group_").isNull()).alias("population_median"))


#: Percentiles that count as high and low, days, multiples of the population's median basket, and shares from
#: which a trait holds; and, in name_segments, the labels and the order in which they are tried.
HIGH, LOW = 0.70, 0.30
LOYAL_DAYS, AT_RISK_DAYS = 60, 180
BULK = 1.5
HEAVY, IN_STORE, WORTH_NAMING = 0.25, 0.10, 0.5
RANK_WORDS = ("highest", "high", "mid", "low", "lowest")
AXES = {"online share": "online_share", "promo share": "promo_share", "frequency": "visits", "recency": "recency", "monetary": "spend"}


def group_quantiles(frame: DataFrame, group: str, columns: Mapping[str, Column], at: Sequence[float]) -> DataFrame:
    """group_, feature, quantiles (in the order of `at`): of each group, and of all rows where group_ is null.

    Told from how often each value occurs, so no task holds the values of a group.
    """
    both = F.explode(F.array(F.col(group), F.lit(None))).alias("group_")
    tall = frame.select(F.col(group), *[c.cast("double").alias(n) for n, c in columns.items()]).select(both, *columns).unpivot(["group_"], list(columns), "feature", "x")
    counted = tall.where("x is not null").groupBy("group_", "feature", "x").agg(F.count("*").alias("n"))
    return quantiles(counted, ["group_", "feature"], "x", "n", at)


def _name(group: str) -> Column:
    """A group's value as text; a null one has a name of its own."""
    return F.coalesce(F.col(group).cast("string"), F.lit("\x00"))


def group_medians(frame: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """group_ (see _name) and median_<column>: a row for each group, a null one among them."""
    found = group_quantiles(frame.withColumn("of_", _name(group)), "of_", {c: F.col(c) for c in columns}, (0.5,)).where("group_ is not null")
    return found.groupBy("group_").agg(*[F.max(F.when(F.col("feature") == c, F.col("quantiles")[0])).alias(f"median_{c}") for c in columns])


def told_apart(named: DataFrame, group: str) -> DataFrame:
    """trait, axis and segment for rows of one cluster each with name_: the name alone, or for clusters that share one, the
    name with a trait of the cluster's own and its rank along the axis on which those clusters lie farthest apart.

    Ranks differ within a name, so names do. The rank words follow the values: the largest is the highest.
    """
    same = Window.partitionBy("name_")  # a row for each cluster
    spread = F.array(*[F.struct((F.max(c).over(same) - F.min(c).over(same)).alias("width"), F.lit(-k).alias("place"), F.lit(n).alias("axis")) for k, (n, c) in enumerate(AXES.items())])
    gap = lambda value, usual: F.abs(F.col(value) - F.col(usual)) / F.when(F.abs(F.col(usual)) > 1e-9, F.abs(F.col(usual))).otherwise(1.0)
    often, promo = gap("visits", "usual_visits"), gap("promo_share", "usual_promo")
    by_gap = F.when(F.greatest(often, promo) <= WORTH_NAMING, "mixed").when(
        often >= promo, F.when(F.col("visits") >= F.col("usual_visits"), "high-frequency").otherwise("low-frequency")
    ).otherwise(F.when(F.col("promo_share") >= F.col("usual_promo"), "promo-driven").otherwise("rarely-promoted"))
    trait = F.when(F.col("online_share") >= HEAVY, "online-heavy").when(F.col("online_share") <= IN_STORE, "in-store").when(F.col("promo_share") >= HEAVY, "promo-driven").otherwise(by_gap)
    out = named.withColumns({"tied_": F.count("*").over(same) > 1, "axis": F.array_max(spread)["axis"]})
    along = F.coalesce(*[F.when(F.col("axis") == n, F.col(c).cast("double")) for n, c in AXES.items()])
    out = out.withColumn("along_", along).withColumn("rank_", F.row_number().over(same.orderBy(F.desc("along_"), group)))
    word = F.coalesce(F.get(F.array(*map(F.lit, RANK_WORDS)), F.col("rank_") - 1), F.concat(F.lit("#"), F.col("rank_")))
    out = out.withColumns({"trait": F.when(F.col("tied_"), trait), "axis": F.when(F.col("tied_"), F.col("axis"))})
    label = F.concat(F.col("name_"), F.lit(" ("), F.col("trait"), F.lit(", "), F.col("axis"), F.lit(" "), word, F.lit(")"))
    return out.withColumn("segment", F.coalesce(label, F.col("name_"))).drop("tied_", "along_", "rank_")


def name_segments(frame: DataFrame, group: str = "cluster") -> DataFrame:
    """group, customers, medians, shares, trait, axis and segment: the name of each cluster by its medians against the
    population's percentiles; see told_apart for clusters that get one name.
    """
    basket = F.when(F.col("frequency") > 0, ratio(F.col("monetary").cast("double"), F.col("frequency")))
    measures = {"recency": F.col("recency_days"), "visits": F.col("frequency"), "spend": F.col("monetary"), "basket": basket, "promo": F.col("promo_share")}
    found = cut(group_quantiles(frame, group, measures, (LOW, 0.5, HIGH)))
    low, mid, high = (F.col("quantiles")[k] for k in range(3))
    take = lambda feature, value: F.max(F.when(F.col("feature") == feature, value))
    bounds = found.where("group_ is null").agg(
        take("spend", high).alias("spend_high"), take("spend", low).alias("spend_low"), take("visits", high).alias("often"), take("visits", low).alias("seldom"),
        F.coalesce(take("basket", mid), F.lit(0.0)).alias("usual_basket"), take("visits", mid).alias("usual_visits"), take("promo", mid).alias("usual_promo"),
    )
    medians = found.where("group_ is not null").groupBy("group_").agg(*[take(c, mid).alias(c) for c in ("recency", "visits", "spend")])
    rows = frame.groupBy(group).agg(F.count("*").alias("customers"), F.avg("online_share").alias("online_share"), F.avg("promo_share").alias("promo_share"))
    rows = rows.join(medians, F.col(group) == F.col("group_")).crossJoin(F.broadcast(bounds))  # one row
    spend, visits, recency = F.col("spend"), F.col("visits"), F.col("recency")
    lasting = spend >= F.col("spend_low")
    rules = [
        ((recency >= AT_RISK_DAYS) & lasting, "Lapsed high value"), (recency >= AT_RISK_DAYS, "Dormant"),
        ((recency >= LOYAL_DAYS) & lasting, "At risk loyal"), (recency >= LOYAL_DAYS, "At risk"),
        ((spend >= F.col("spend_high")) & (visits >= F.col("often")), "Champions"),
        ((spend <= F.col("spend_low")) & (visits <= F.col("seldom")), "One and done"),
        (spend / F.greatest(visits, F.lit(1)) >= BULK * F.col("usual_basket"), "Bulk buyers"),
        ((visits >= F.col("often")) & (F.col("promo_share") > 0), "Loyal discount seekers"), (visits >= F.col("often"), "Frequent small baskets"),
        (spend <= F.col("spend_low"), "Low spend"),
    ]
    name = F.coalesce(*[F.when(condition, label) for condition, label in rules], F.lit("Occasional buyers"))
    named = told_apart(rows.withColumn("name_", name), group)
    return named.select(group, "customers", "recency", "visits", "spend", F.round("online_share", 4).alias("online_share"), F.round("promo_share", 4).alias("promo_share"), "trait", "axis", "segment")
