"""The frequency table (column, value, cnt): one aggregation that the text operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.schema import long_form, string_columns


def frequencies(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """How often each value (as text, NULL included) stands in each column. Sums are made before the
    shuffle, so a column of few values sends few rows."""
    return long_form(df, string_columns(df) if columns is None else columns).groupBy("column", "value").agg(F.count("*").alias("cnt"))


def top_values(freq: DataFrame, k: int, *, with_nulls: bool = True) -> DataFrame:
    """The k most frequent values of each column with their rank; ties by value, NULL last."""
    rows = freq if with_nulls else freq.filter("value IS NOT NULL")
    order = Window.partitionBy("column").orderBy(F.desc("cnt"), F.asc_nulls_last("value"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_with_other(freq: DataFrame, listed: int = 30, shown: int = 6) -> DataFrame:
    """The first ``shown`` of the ``listed`` most frequent values; the others of these as ``Other``."""
    label = F.when(F.col("rank") <= shown, F.coalesce("value", F.lit("Missing"))).otherwise("Other")
    return top_values(freq, listed).groupBy("column", label.alias("label")).agg(F.sum("cnt").alias("cnt"))


def distinct_counts(freq: DataFrame) -> DataFrame:
    """Different values, cells with a value and all cells of each column."""
    filled = F.col("value").isNotNull()
    return freq.groupBy("column").agg(
        F.count_if(filled).alias("n_unique"), F.coalesce(F.sum(F.when(filled, F.col("cnt"))), F.lit(0)).alias("non_null"), F.sum("cnt").alias("total"),
    )
