"""Missing-value profiles of a stream: counts by event-time window, and a profile of each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.schema import quoted
from plumbline.functions.text import is_missing
from plumbline.operators.missing import missing_full


def windowed_missing(stream: DataFrame, time_col: str, *, window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Rows and missing cells of each column by window of event time; rows later than ``late`` are dropped."""
    counts = [F.count_if(is_missing(quoted(f.name), f.dataType)).alias(f"missing_{f.name}") for f in stream.schema.fields if f.name != time_col]
    if dict(stream.dtypes)[time_col] == "timestamp_ntz":  # watermarks ask for an instant; the session's zone makes it one
        stream = stream.withColumn(time_col, F.col(time_col).cast("timestamp"))
    return stream.withWatermark(time_col, late).groupBy(F.window(time_col, window).alias("window")).agg(F.count("*").alias("rows"), *counts)


def profile_batches(sink: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: the missing-value profile of each micro-batch, with its number, goes to ``sink``."""

    def one(batch: DataFrame, number: int) -> None:
        sink(missing_full(batch).withColumn("batch", F.lit(number)))

    return one
