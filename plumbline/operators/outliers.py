"""Outliers: quartile fences, z-scores, an isolation forest in one dimension, and their union."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.schema import feature_columns, stored
from plumbline.functions.text import percent

from .forest import mean_path
from .numeric import _by_column
from .quantiles import number

LEAST_VALUES = 5


def fences(df: DataFrame, columns: list[str] | None = None, factor: float = 1.5) -> DataFrame:
    """column, n, lower, upper: the quartiles less and plus ``factor`` times their distance."""
    wide = _by_column(df, columns or feature_columns(df), {"n": F.count}, {"q25": 0.25, "q75": 0.75})
    width = factor * (F.col("q75") - F.col("q25"))
    return wide.select("column", "n", (F.col("q25") - width).alias("lower"), (F.col("q75") + width).alias("upper"))


def cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, value of all cells that have a number."""
    parts = F.array(*[F.struct(F.lit(c).alias("column"), number(df, c).alias("value")) for c in columns])
    return df.select(F.inline(parts)).filter("value IS NOT NULL")


def least_values(rows: DataFrame, listed: int) -> DataFrame:
    """The ``listed`` smallest values of each column; the rank is bounded, so tasks hand on no more than that."""
    rank = F.row_number().over(Window.partitionBy("column").orderBy("value"))
    return rows.select("column", "value").withColumn("rank", rank).filter(F.col("rank") <= listed).drop("rank")


def iqr_outliers(df: DataFrame, columns: list[str] | None = None, factor: float = 1.5, listed: int = 5, *, of_all_rows: bool = False) -> DataFrame:
    """column, lower, upper, outlier_count, outlier_pct (of the filled cells, or of all rows), least, most, examples.
    Columns of fewer than 5 values are left out."""
    columns = columns or feature_columns(df)
    bounds = fences(df, columns, factor).filter(F.col("n") >= LEAST_VALUES)
    total = df.count() if of_all_rows else None
    out = cells(df, columns).join(F.broadcast(bounds), "column").filter((F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper")))  # a row for each column
    out = out.groupBy("column", "value").agg(F.count("*").alias("cnt"))
    out = stored(out)
    sums = out.groupBy("column").agg(F.sum("cnt").alias("outlier_count"), F.min("value").alias("least"), F.max("value").alias("most"))
    first = least_values(out, listed).groupBy("column").agg(F.sort_array(F.collect_list("value")).alias("examples"))
    sums = sums.join(F.broadcast(first), "column", "left")  # a row for each column
    rows = bounds.join(sums, "column", "left")
    count = F.coalesce("outlier_count", F.lit(0))
    base = F.lit(total) if of_all_rows else F.col("n")
    return rows.select("column", "lower", "upper", count.alias("outlier_count"), percent(count, base).alias("outlier_pct"), "least", "most", F.coalesce("examples", F.array().cast("array<double>")).alias("examples"))


def zscore_bounds(df: DataFrame, columns: list[str], threshold: float = 3.0) -> DataFrame:
    wide = _by_column(df, columns, {"n": F.count, "mean": F.avg, "std": F.stddev_pop})
    return wide.select("column", "n", "mean", "std", F.lit(threshold).alias("threshold"))


def beyond(value: Column, mean: Column, std: Column, threshold: Column) -> Column:
    return F.coalesce((std > 0) & (F.abs(F.try_divide(value - mean, std)) > threshold), F.lit(False))


def zscore_outliers(df: DataFrame, columns: list[str] | None = None, threshold: float = 3.0) -> DataFrame:
    """column, n, outlier_count, outlier_pct of cells further than ``threshold`` population deviations from the mean."""
    columns = columns or feature_columns(df)
    bounds = zscore_bounds(df, columns, threshold)
    flagged = cells(df, columns).join(F.broadcast(bounds), "column")
    out = flagged.groupBy("column", "n").agg(F.count_if(beyond(F.col("value"), F.col("mean"), F.col("std"), F.col("threshold"))).alias("outlier_count"))
    return out.filter(F.col("n") >= LEAST_VALUES).select("column", "n", "outlier_count", percent(F.col("outlier_count"), F.col("n")).alias("outlier_pct"))


def isolation_steps(sample: np.ndarray, trees: int = 100, tree_size: int = 256, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """A forest over one dimension as a step function: break points, and the anomaly score between them."""
    rng, depth_limit = np.random.default_rng(seed), math.ceil(math.log2(max(2, min(tree_size, len(sample)))))
    all_breaks, functions = [], []
    for _ in range(trees):
        values = np.sort(rng.choice(sample, min(tree_size, len(sample)), replace=False))
        breaks, paths, stack = [], [], [(0, len(values), 0, -math.inf)]
        while stack:  # leaves from left to right
            lo, hi, depth, start = stack.pop()
            if depth >= depth_limit or hi - lo <= 1 or values[lo] == values[hi - 1]:
                breaks.append(start)
                paths.append(depth + mean_path(hi - lo))
                continue
            at = rng.uniform(values[lo], values[hi - 1])
            mid = int(np.searchsorted(values[lo:hi], at)) + lo
            stack += [(mid, hi, depth + 1, at), (lo, mid, depth + 1, start)]
        all_breaks += breaks[1:]
        functions.append((np.array(breaks), np.array(paths)))
    points = np.unique(np.array([-math.inf, *all_breaks]))
    path = np.mean([p[np.searchsorted(b, points, "right") - 1] for b, p in functions], axis=0)
    return points, 2 ** (-path / mean_path(min(tree_size, len(sample))))


def drawn_rows(values: DataFrame, n: int, sample_rows: int, seed: int) -> np.ndarray:
    """``sample_rows`` of the ``n`` rows that ``values`` (value, cnt) stands for, or all if there are fewer. Each row is drawn
    with the same chance: the first drawn copy of a value is geometric by the value's hash, and values without one aren't
    collected; the driver draws among the copies after it. The sample depends on the counts and the seed only."""
    share = min(1.0, 1.05 * sample_rows / n)  # a little more than asked for, so that cutting leaves sample_rows
    uniform = F.pmod(F.xxhash64("value", F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)
    first = F.floor(F.log1p(-uniform) / F.lit(math.log1p(-share))) if share < 1 else F.lit(0)
    got = values.withColumn("first", first.cast("long")).filter("first < cnt").orderBy("value").collect()
    rng = np.random.default_rng(seed)
    copies = 1 + rng.binomial(np.array([r.cnt - r.first - 1 for r in got], np.int64), share)
    return rng.permutation(np.repeat(np.array([r.value for r in got], float), copies))[:sample_rows]


def isolation_outliers(df: DataFrame, column: str, *, sample_rows: int = 25_600, seed: int = 42) -> DataFrame:
    """value, score, is_outlier of the column's different values: the share min(0.1, max(0.01, 10 / n)) with
    the highest scores. The forest is grown on a seeded sample of at most ``sample_rows`` rows and
    is a step function in one dimension, so scoring is a look-up; all values are scored."""
    values = df.select(number(df, column).alias("value")).filter("value IS NOT NULL").groupBy("value").agg(F.count("*").alias("cnt"))
    n = values.agg(F.sum("cnt")).first()[0] or 0
    if n < LEAST_VALUES:
        return values.select("value", F.lit(None).cast("double").alias("score"), F.lit(False).alias("is_outlier"), "cnt")
    points, scores = isolation_steps(drawn_rows(values, n, sample_rows, seed), seed=seed)

    @F.pandas_udf("double")
    def score(v: pd.Series) -> pd.Series:
        return pd.Series(scores[np.searchsorted(points, v.to_numpy(), "right") - 1])

    scored = values.withColumn("score", score("value"))
    contamination = min(0.1, max(0.01, 10 / n))
    steps = scored.groupBy("score").agg(F.sum("cnt").alias("cnt"))  # scores are a step function's, a bounded number
    cut = steps.agg(F.percentile("score", F.lit(1 - contamination), F.col("cnt"))).first()[0]
    return scored.select("value", "score", (F.col("score") > cut).alias("is_outlier"), "cnt")


def combined_outliers(df: DataFrame, columns: list[str] | None = None, *, factor: float = 1.5, threshold: float = 3.0, isolation: bool = False, listed: int = 10) -> DataFrame:
    """column, n, iqr_count, zscore_count, forest_count, outlier_count (cells that any method flags),
    outlier_pct, values (the smallest flagged, up to ``listed``)."""
    columns = columns or feature_columns(df)
    wide = _by_column(df, columns, {"n": F.count, "mean": F.avg, "std": F.stddev_pop}, {"q25": 0.25, "q75": 0.75}).filter(F.col("n") >= LEAST_VALUES)
    width = factor * (F.col("q75") - F.col("q25"))
    bounds = wide.select("column", "n", (F.col("q25") - width).alias("lower"), (F.col("q75") + width).alias("upper"), "mean", "std", F.lit(threshold).alias("threshold"))
    counted = cells(df, columns).groupBy("column", "value").agg(F.count("*").alias("cnt")).join(F.broadcast(bounds), "column")
    if isolation:
        forest = None
        for c in columns:
            part = isolation_outliers(df, c).filter("is_outlier").select(F.lit(c).alias("column"), "value", F.lit(True).alias("by_forest"))
            forest = part if forest is None else forest.unionByName(part)
        counted = counted.join(forest, ["column", "value"], "left")
    else:
        counted = counted.withColumn("by_forest", F.lit(False))
    v = F.col("value")
    flagged = counted.select("column", "n", "value", "cnt", ((v < F.col("lower")) | (v > F.col("upper"))).alias("by_iqr"), beyond(v, F.col("mean"), F.col("std"), F.col("threshold")).alias("by_z"), F.coalesce("by_forest", F.lit(False)).alias("by_forest"))
    flagged = flagged.withColumn("any", F.col("by_iqr") | F.col("by_z") | F.col("by_forest"))
    flagged = stored(flagged)
    count = lambda c: F.sum(F.when(F.col(c), F.col("cnt")).otherwise(0))
    sums = flagged.groupBy("column", "n").agg(count("by_iqr").alias("iqr_count"), count("by_z").alias("zscore_count"), count("by_forest").alias("forest_count"), count("any").alias("outlier_count"))
    first = least_values(flagged.filter("any"), listed).groupBy("column").agg(F.sort_array(F.collect_list("value")).alias("values"))
    sums = sums.join(F.broadcast(first), "column", "left").withColumn("values", F.coalesce("values", F.array().cast("array<double>")))  # a row for each column
    return sums.withColumn("outlier_pct", percent(F.col("outlier_count"), F.col("n")))
