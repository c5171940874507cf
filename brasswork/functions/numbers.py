"""Guarded arithmetic, quantile buckets, distribution quantiles and number formats."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.nullif(b, F.lit(0))


def total(column: str, condition: Column | None = None) -> Column:
    """A sum as double; of rows that meet a condition, if there is one. Decimals are added exactly."""
    value = F.col(column) if condition is None else F.when(condition, F.col(column))
    return F.sum(value).cast("double")


def count_if(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)).cast("long")


def quantile_bucket(rank: Column, n: Column, buckets: int) -> Column:
    """The bucket, from 1, of a rank from 1 to n, by edges linearly interpolated between ranks; not the same as ntile."""
    edges = [1 + (n - 1) * j / F.lit(float(buckets)) for j in range(1, buckets)]
    return (F.lit(1) + sum((F.when(edge < rank, 1).otherwise(0) for edge in edges), F.lit(0))).cast("int")


def price_band(price: Column) -> Column:
    return F.when(price < 299, "Budget").when(price < 1000, "Mid").when(price < 5000, "Premium").otherwise("Luxury")


def normal_quantile(q: float) -> float:
    """Standard normal quantile; q must lie strictly between 0 and 1."""
    return NormalDist().inv_cdf(q)


def poisson_quantile(q: float, mean: float) -> int:
    """Least k whose cumulative probability reaches q. Terms are taken in log space, from far below the mean on."""
    if mean <= 0:
        return 0
    k = max(0, int(mean - 12 * math.sqrt(mean) - 20))
    total_, log_mean = 0.0, math.log(mean)
    while True:
        total_ += math.exp(-mean + k * log_mean - math.lgamma(k + 1))
        if total_ >= q or k > mean + 40 * math.sqrt(mean) + 200:
            return k
        k += 1


@F.pandas_udf(T.LongType())
def poisson_quantiles(q: pd.Series, mean: pd.Series) -> pd.Series:
    """poisson_quantile by rows; null where an input is null. All rows of a batch take their next term together."""
    known = (q.notna() & mean.notna()).to_numpy()
    level, mu = q.to_numpy(float)[known], mean.to_numpy(float)[known]
    safe = np.maximum(mu, 1e-300)
    k = np.maximum(0, np.floor(mu - 12 * np.sqrt(np.maximum(mu, 0)) - 20)).astype(np.int64)
    k[mu <= 0] = 0
    last = mu + 40 * np.sqrt(np.maximum(mu, 0)) + 200
    log_term = -mu + k * np.log(safe) - np.array([math.lgamma(x + 1) for x in k.tolist()])
    reached = np.exp(log_term)
    open_ = np.flatnonzero((reached < level) & (k <= last) & (mu > 0))
    while len(open_):
        k[open_] += 1
        log_term[open_] += np.log(safe[open_]) - np.log(k[open_])
        reached[open_] += np.exp(log_term[open_])
        open_ = open_[(reached[open_] < level[open_]) & (k[open_] <= last[open_])]
    out = pd.Series(pd.NA, index=q.index, dtype="Int64")
    out[known] = k
    return out


def grouped_rupees(value: Column, decimals: int = 0) -> Column:
    """A number with separators after the last three digits and every two before them."""
    text = F.format_string(f"%.{decimals}f", F.abs(value).cast("double"))
    whole, part = F.substring_index(text, ".", 1), F.regexp_extract(text, r"(\.\d+)$", 1)
    head = F.regexp_replace(F.regexp_extract(whole, r"^(\d*)\d{3}$", 1), r"(?<=\d)(?=(\d\d)+$)", ",")
    grouped = F.when(F.length(whole) > 3, F.concat(head, F.lit(","), F.right(whole, F.lit(3)))).otherwise(whole)
    return F.concat(F.when(value < 0, "-").otherwise(""), grouped, part)


def percent(value: Column, decimals: int = 1) -> Column:
    return F.format_string(f"%.{decimals}f%%", (value * 100).cast("double"))
