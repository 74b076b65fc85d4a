"""Which columns an operator works on, stored intermediates, and row numbers."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Names that never are features.
ROW_NAMES = {"id", "index", "key", "uuid"}


class EmptyDatasetError(ValueError):
    """The dataset, or what is left of it for a report, is empty."""


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMBERS)]


def float_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]


def feature_columns(df: DataFrame) -> list[str]:
    """Numeric columns but those named like a row id."""
    return [c for c in numeric_columns(df) if c.lower() not in ROW_NAMES]


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def nan_to_null(df: DataFrame) -> DataFrame:
    return df.select(*[F.when(~F.isnan(quoted(f.name)), quoted(f.name)).alias(f.name) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else quoted(f.name) for f in df.schema.fields])


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; in a local session without one, a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):  # local-cluster has executors with folders of their own
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.gettempdir() + "/plumbline-shared"
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read back."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Python workers get at most so many rows at once in what is computed meanwhile."""
    before = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, before)


def with_row_index(df: DataFrame, *order: str, name: str = "row_index") -> DataFrame:
    """Rows numbered from 0 in the order of a stable key. Ranges of the key are sorted and numbered
    each on its own, then shifted by the sizes of those before: no task sorts the whole table."""
    ranged = stored(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    upto = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    shifts = sizes.withColumn("__shift", F.coalesce(F.sum("__n").over(upto), F.lit(0))).drop("__n")
    inner = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return ranged.withColumn(name, inner).join(shifts, "__part").withColumn(name, (F.col(name) + F.col("__shift")).cast("long")).drop("__part", "__shift")


def long_form(df: DataFrame, columns: list[str], value: str = "value", *, keep: list[str] = ()) -> DataFrame:
    """(kept columns, column, value as text), one row for each cell."""
    cells = [F.struct(F.lit(c).alias("column"), quoted(c).cast("string").alias(value)) for c in columns]
    return df.select(*[quoted(k) for k in keep], F.inline(F.array(*cells))) if cells else df.sparkSession.createDataFrame([], "column string, value string")
