"""What the operators of this subpackage share: scratch tables and small column helpers."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SPACES = r"[\x20\x09-\x0D]+"
#: Bytes (of rows, without what a hash table adds) up to which a table is broadcast.
BROADCAST_BYTES = 32 << 20
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; where that is unset (a local
    session, as in tests) a temporary folder of this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):  # local-cluster has executors with folders of their own
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.gettempdir() + "/plumbline-scratch"
    return f"{root.rstrip('/')}/plumbline-{spark.sparkContext.applicationId}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a table in the scratch folder and read back: cuts lineage,
    survives lost executors, and lets several readers share one computation."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")  # what was shuffled for the table isn't needed once it is written
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` (cheap to read, such as a saved table), to be broadcast if its rows have at most ``limit`` bytes
    together; a join with a larger one is left to Spark, which shuffles."""
    size = F.lit(16)
    for name, kind in df.dtypes:
        if kind.startswith("array"):
            size = size + 16 + 8 * F.greatest(F.coalesce(F.size(F.col(f"`{name}`")), F.lit(0)), F.lit(0))
        elif kind in ("string", "binary"):
            size = size + 16 + F.coalesce(F.octet_length(F.col(f"`{name}`")), F.lit(0))
        else:
            size = size + 8
    return F.broadcast(df) if (df.agg(F.sum(size.cast("long"))).first()[0] or 0) <= limit else df


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Python workers get at most so many rows at once in what is computed meanwhile."""
    before = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """The words of a text, in order; null text: none."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), F.array().cast("array<string>"))


def bound(value: Column, body) -> Column:
    """``body`` of ``value`` with ``value`` evaluated once, also where ``body`` uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name += "_"
    return name
