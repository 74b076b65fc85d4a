"""Missing values, by three definitions: true nulls, a few report tokens, and all null tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.schema import quoted
from plumbline.functions.text import EXACT_NULL_TOKENS, NULL_TOKENS, REPORT_TOKENS, detected_as, is_missing, is_null, percent, strip


def _profile(df: DataFrame, test, digits: int | None) -> DataFrame:
    """column, missing_count, missing_pct, total_rows for all columns, by one aggregation."""
    fields = df.schema.fields
    row = df.agg(F.count("*").alias("total"), *[F.count_if(test(quoted(f.name), f.dataType)).alias(f"m{k}") for k, f in enumerate(fields)])
    cells = F.array(*[F.struct(F.lit(f.name).alias("column"), F.col(f"m{k}").alias("missing_count")) for k, f in enumerate(fields)])
    long = row.select("total", F.inline(cells))
    return long.select("column", "missing_count", percent(F.col("missing_count"), F.col("total"), digits).alias("missing_pct"), F.col("total").alias("total_rows"))


def _totals(profile: DataFrame, digits: int | None) -> DataFrame:
    sums = profile.agg(F.coalesce(F.sum("missing_count"), F.lit(0)).alias("total_missing"), F.coalesce(F.sum("total_rows"), F.lit(0)).alias("total_cells"))
    return sums.select("total_missing", "total_cells", percent(F.col("total_missing"), F.col("total_cells"), digits).alias("missing_pct"))


def missing_basic(df: DataFrame) -> DataFrame:
    """True nulls of the columns that have some; percentages as they are."""
    return _profile(df, is_null, None).filter("missing_count > 0").drop("total_rows")


def missing_basic_totals(df: DataFrame) -> DataFrame:
    return _totals(_profile(df, is_null, None), None)


def _report_test(c: Column, kind: T.DataType) -> Column:
    return F.coalesce(c.isin(REPORT_TOKENS), F.lit(True)) if isinstance(kind, T.StringType) else is_null(c, kind)


def missing_report(df: DataFrame) -> DataFrame:
    """Nulls and the texts nan, NaN, NA and '' of the columns that have some, most first."""
    return _profile(df, _report_test, 2).filter("missing_count > 0").drop("total_rows").orderBy(F.desc("missing_count"), "column")


def missing_report_totals(df: DataFrame) -> DataFrame:
    return _totals(_profile(df, _report_test, 2), 2)


def missing_full(df: DataFrame) -> DataFrame:
    """Nulls, all null tokens and blank texts, for every column."""
    return _profile(df, is_missing, 2).drop("total_rows")


def missing_full_totals(df: DataFrame) -> DataFrame:
    return _totals(_profile(df, is_missing, 2), 2)


def missing_tokens_used(freq: DataFrame) -> DataFrame:
    """Which tokens a table holds, with the number of cells (from the frequency table)."""
    token = F.when(F.lower("value").isin([t for t in NULL_TOKENS if t.strip()]), F.lower("value")).when(strip(F.col("value")) == "", "empty string")
    return freq.select(token.alias("token"), "cnt").filter("token IS NOT NULL").groupBy("token").agg(F.sum("cnt").alias("cells"))


def missing_examples(indexed: DataFrame, row_index: str = "row_index", per_column: int = 5) -> DataFrame:
    """The first missing cells of each column: row, value as text, and what it was taken for."""
    fields = [f for f in indexed.schema.fields if f.name != row_index]
    cells = [
        F.when(is_missing(c := quoted(f.name), f.dataType), F.struct(F.lit(f.name).alias("column"), c.cast("string").alias("original_value"), detected_as(c, f.dataType).alias("detected_as")))
        for f in fields
    ]
    long = indexed.select(F.col(row_index).alias("row_index"), F.explode(F.filter(F.array(*cells), lambda x: x.isNotNull())).alias("x")).select("row_index", "x.*")
    order = Window.partitionBy("column").orderBy("row_index")
    return long.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= per_column).drop("rank")


def sentinel_examples(freq: DataFrame, per_column: int = 5) -> DataFrame:
    """Different values that equal a token with its case, at most ``per_column`` for each column."""
    order = Window.partitionBy("column").orderBy("value")
    return freq.filter(F.col("value").isin(EXACT_NULL_TOKENS)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= per_column).select("column", "value")


def null_matrix(indexed: DataFrame, row_index: str = "row_index") -> DataFrame:
    """row_index, column, is_null for each cell: what a heat map shows."""
    fields = [f for f in indexed.schema.fields if f.name != row_index]
    cells = F.array(*[F.struct(F.lit(f.name).alias("column"), is_null(quoted(f.name), f.dataType).alias("is_null")) for f in fields])
    return indexed.select(F.col(row_index).alias("row_index"), F.inline(cells))


def legacy_missing(per_column: dict[str, int]) -> dict:
    """A stored profile of plain counts in today's form (its percentage is of the columns)."""
    if "missing_percentage" in per_column:
        return dict(per_column)
    total = sum(per_column.values())
    return {"total_missing": total, "missing_percentage": total / len(per_column) * 100 if per_column else 0.0, "per_column": {c: {"count": n, "percentage": 0.0} for c, n in per_column.items()}}
