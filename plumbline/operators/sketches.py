"""Measures of a table's columns that can be merged: counts and moments exactly, quantiles and different values by sketches.

Stated errors, each at about 99 %: the rank of a quantile is off by at most RANK_ERROR of the filled cells, a number of
different values by at most DISTINCT_ERROR of it, and so a number of duplicate rows by DISTINCT_ERROR of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.schema import numeric_columns, quoted
from plumbline.functions.text import is_null

from .quantiles import number

#: Sizes of the sketches (the second as a power of two), and the errors that go with them.
KLL_SIZE, HLL_BITS = 1600, 16
RANK_ERROR, DISTINCT_ERROR = 0.003, 0.0125
MEASURES = "column string, rows bigint, filled bigint, mean double, m2 double, least double, most double, quantiles binary, distinct binary"


def measures(df: DataFrame) -> DataFrame:
    """One row for each column and one, with a null column, for whole rows, by one aggregation. NaN is missing; moments and
    quantiles are of numeric columns."""
    fields, numbers = df.schema.fields, set(numeric_columns(df))
    aggs = [F.count("*").alias("rows"), F.hll_sketch_agg(F.xxhash64(F.to_json(F.struct(*[quoted(f.name) for f in fields]), {"ignoreNullFields": "false"})), F.lit(HLL_BITS)).alias("rows_distinct")]
    for k, f in enumerate(fields):
        c = quoted(f.name)
        filled = F.when(~is_null(c, f.dataType), c)
        aggs += [F.count(filled).alias(f"filled{k}"), F.hll_sketch_agg(F.when(filled.isNotNull(), F.xxhash64(filled if f.name in numbers else filled.cast("string"))), F.lit(HLL_BITS)).alias(f"distinct{k}")]
        if f.name in numbers:
            v = number(df, f.name)
            aggs += [F.avg(v).alias(f"mean{k}"), (F.var_pop(v) * F.count(v)).alias(f"m2{k}"), F.min(v).alias(f"least{k}"), F.max(v).alias(f"most{k}"), F.kll_sketch_agg_double(v, F.lit(KLL_SIZE)).alias(f"quantiles{k}")]
    none = F.lit(None)

    def cell(k: int | None, name: str | None) -> F.Column:
        of = lambda what: F.col(f"{what}{k}") if name in numbers else none.cast("binary" if what == "quantiles" else "double")
        shared = [F.col("rows").alias("filled"), *[none.cast("double").alias(m) for m in ("mean", "m2", "least", "most")], none.cast("binary").alias("quantiles"), F.col("rows_distinct").alias("distinct")]
        own = [F.col(f"filled{k}").alias("filled"), *[of(m).alias(m) for m in ("mean", "m2", "least", "most", "quantiles")], F.col(f"distinct{k}").alias("distinct")]
        return F.struct(F.lit(name).cast("string").alias("column"), F.col("rows"), *(shared if k is None else own))

    return df.agg(*aggs).select(F.inline(F.array(cell(None, None), *[cell(k, f.name) for k, f in enumerate(fields)])))


def merged(parts: DataFrame, *keys: str) -> DataFrame:
    """The measures of tables put together, from the measures of each; for each of ``keys`` if there are any."""
    by = [*keys, "column"]
    means = parts.groupBy(*by).agg((F.sum(F.col("mean") * F.col("filled")) / F.sum(F.when(F.col("mean").isNotNull(), F.col("filled")))).alias("__mean"))
    means = means.toDF(*[f"__{k}" for k in by], "__mean")
    same = F.lit(True)
    for k in by:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    shifted = parts.join(means, same)
    return shifted.groupBy(*by).agg(
        F.sum("rows").alias("rows"), F.sum("filled").alias("filled"), F.first("__mean").alias("mean"),
        F.sum(F.col("m2") + F.col("filled") * (F.col("mean") - F.col("__mean")) * (F.col("mean") - F.col("__mean"))).alias("m2"),
        F.min("least").alias("least"), F.max("most").alias("most"), F.kll_merge_agg_double("quantiles").alias("quantiles"), F.hll_union_agg("distinct").alias("distinct"),
    )


def described(measured: DataFrame, *keys: str) -> DataFrame:
    """Of measures: rows, missing_count, mean, std (sample), min, quartiles (estimates), max, distinct (estimate), and of the row for whole rows
    (null column) the estimate of duplicates."""
    estimate = F.least(F.hll_sketch_estimate("distinct"), F.col("filled"))
    quartile = lambda p: F.when((F.col("filled") > 0) & F.col("mean").isNotNull(), F.kll_sketch_get_quantile_double("quantiles", F.lit(p)))
    return measured.select(
        *keys, "column", "rows", (F.col("rows") - F.col("filled")).alias("missing_count"), "mean", F.sqrt(F.try_divide(F.col("m2"), F.col("filled") - 1)).alias("std"), F.col("least").alias("min"),
        quartile(0.25).alias("q25"), quartile(0.5).alias("q50"), quartile(0.75).alias("q75"), F.col("most").alias("max"), estimate.alias("distinct"),
        F.when(F.col("column").isNull(), F.col("rows") - estimate).alias("duplicates"),
    )
