"""Column types: what they are, what their texts could be, and which identify rows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.schema import float_columns, quoted, string_columns
from plumbline.functions.text import to_number

from .frequency import frequencies

#: Names of id columns (case doesn't count).
ID_NAMES = [r"^id$", r".*_id$", r"^.*id$", r"^.*_key$", r"^uuid$", r"^guid$", r"^identifier$", r"^primary_?key$", r"^unique.*$"]
#: Parts of the names of date columns.
DATE_NAME_PARTS = ["date", "day", "month", "year", "time", "dob", "birth"]
#: The formats that dates are tried in.
DATE_FORMATS = ["yyyy-MM-dd", "MM/dd/yyyy", "dd/MM/yyyy", "yyyy/MM/dd", "dd-MM-yyyy", "MM-dd-yyyy", "dd.MM.yyyy", "yyyy.MM.dd"]
UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def named_like_id(column: str) -> bool:
    return any(re.match(p, column, re.IGNORECASE) for p in ID_NAMES)


def id_columns(df: DataFrame, *, content_check: bool = True, order: str | None = None, first: int = 100) -> DataFrame:
    """column and reason (name, content) of the columns that identify rows. By content: among the first
    ``first`` values (in the order of ``order`` if given) over 90 % differ, or one is a UUID."""
    named = [c for c in df.columns if named_like_id(c)]
    rows = [(c, "name") for c in named]
    out = df.sparkSession.createDataFrame(rows, "column string, reason string")
    others = [c for c in df.columns if c not in named]
    if not (content_check and others):
        return out
    some = first_filled(df, others, order, first).groupBy("k")
    verdict = some.agg(F.count("*").alias("n"), F.count_distinct("value").alias("u"), F.bool_or(F.col("value").rlike(UUID)).alias("uuid")).filter("u > 0.9 * n OR uuid")
    names = F.array(*[F.lit(c) for c in others])
    return out.unionByName(verdict.select(F.get(names, "k").alias("column"), F.lit("content").alias("reason")))


def first_filled(df: DataFrame, columns: list[str], order: str | None, first: int) -> DataFrame:
    """k (the place in ``columns``), at, value: the first ``first`` filled cells, as texts, of every column, in one scan. A task keeps no more of
    each column, and without ``order``, where rows come as they are filed, it stops reading once it has them."""
    at = quoted(order) if order else F.monotonically_increasing_id()  # the order of the table's files, not of whichever task ends first
    rows = df.select(at.alias("at"), *[quoted(c).cast("string").alias(f"c{k}") for k, c in enumerate(columns)])
    kind = dict(rows.dtypes)["at"]

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table | None] = [None] * len(columns)
        for batch in batches:
            for k in range(len(columns)):
                if order is None and held[k] is not None and len(held[k]) >= first:
                    continue
                filled = pa.table([batch["at"], batch[f"c{k}"]], ["at", "value"]).filter(pc.is_valid(batch[f"c{k}"]))
                both = filled if held[k] is None else pa.concat_tables([held[k], filled])
                held[k] = (both if order is None else both.take(pc.sort_indices(both, [("at", "ascending"), ("value", "ascending")], null_placement="at_start"))).slice(0, first)
            if order is None and all(h is not None and len(h) >= first for h in held):
                break
        for k, table in enumerate(held):
            if table is not None:
                yield from table.append_column("k", pa.array([k] * len(table), pa.int32())).select(["k", "at", "value"]).combine_chunks().to_batches()

    found = rows.mapInArrow(least, f"k int, at {kind}, value string")
    rank = F.row_number().over(Window.partitionBy("k").orderBy("at", "value"))  # what the tasks have kept
    return found.withColumn("rank", rank).filter(F.col("rank") <= first).drop("rank")


def data_types(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(k, c, t) for k, (c, t) in enumerate(df.dtypes)], "ordinal int, column string, type string")


def parsed_date(c: Column, formats: list[str] = DATE_FORMATS) -> Column:
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats])


def text_types(freq: DataFrame, *, numeric_share: float = 0.8, date_share: float = 0.5, retry_share: float = 0.8) -> DataFrame:
    """What the texts of each column could be: inferred_type (integer, numeric, datetime, unknown), counts
    of values that parse, and the best date format (NULL: dates of ISO form).

    Dates are asked of columns that aren't numbers or whose name sounds like dates; where the name
    does and under ``retry_share`` parse, the format that parses most is taken."""
    filled = freq.filter("value IS NOT NULL")
    number, iso = to_number(F.col("value")), F.try_to_timestamp("value")
    counts = filled.groupBy("column").agg(
        F.sum("cnt").alias("non_null"), F.sum(F.when(number.isNotNull(), F.col("cnt")).otherwise(0)).alias("numbers"),
        F.coalesce(F.bool_and(F.when(number.isNotNull(), number == F.floor(number))), F.lit(False)).alias("whole"),
        F.sum(F.when(iso.isNotNull(), F.col("cnt")).otherwise(0)).alias("iso"),
        *[F.sum(F.when(F.try_to_timestamp("value", F.lit(f)).isNotNull(), F.col("cnt")).otherwise(0)).alias(f"d{k}") for k, f in enumerate(DATE_FORMATS)],
    )
    named = F.lower("column").rlike("|".join(DATE_NAME_PARTS))
    best = F.greatest(*[F.col(f"d{k}") for k in range(len(DATE_FORMATS))])
    best_format = F.coalesce(*[F.when(F.col(f"d{k}") == best, F.lit(f)) for k, f in enumerate(DATE_FORMATS)])
    retry = named & (F.col("iso") < retry_share * F.col("non_null")) & (best > F.col("iso"))
    dates, is_number = F.when(retry, best).otherwise(F.col("iso")), F.col("numbers") > numeric_share * F.col("non_null")
    is_date = (~is_number | named) & (dates > date_share * F.col("non_null"))
    kind = F.when(is_date, "datetime").when(is_number & F.col("whole"), "integer").when(is_number, "numeric").otherwise("unknown")
    return counts.select("column", "non_null", "numbers", dates.alias("dates"), F.when(is_date & retry, best_format).alias("date_format"), kind.alias("inferred_type"))


def invalid_dates(freq: DataFrame, types: DataFrame, listed: int = 10) -> DataFrame:
    """Of columns of dates, the values that don't parse in the column's format: column, cells, values."""
    dated = freq.filter("value IS NOT NULL").join(types.filter("inferred_type = 'datetime'").select("column", "date_format"), "column")
    ok = F.when(F.col("date_format").isNull(), F.try_to_timestamp("value").isNotNull())
    for f in DATE_FORMATS:
        ok = ok.when(F.col("date_format") == f, F.try_to_timestamp("value", F.lit(f)).isNotNull())
    bad = dated.filter(~ok)
    first = bad.withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy("value"))).filter(F.col("rank") <= listed)
    lists = first.groupBy("column").agg(F.sort_array(F.collect_list("value")).alias("values"))
    return bad.groupBy("column").agg(F.sum("cnt").alias("cells")).join(lists, "column")


def integer_like_floats(df: DataFrame) -> DataFrame:
    """Float columns that hold nothing but whole numbers."""
    columns = float_columns(df)
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, non_null bigint")
    filled = lambda c: F.when(~F.isnan(quoted(c)), quoted(c))
    row = df.agg(*[F.bool_and(filled(c) == F.floor(filled(c))).alias(f"w{k}") for k, c in enumerate(columns)], *[F.count(filled(c)).alias(f"n{k}") for k, c in enumerate(columns)])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{k}").alias("non_null"), F.col(f"w{k}").alias("whole")) for k, c in enumerate(columns)])
    return row.select(F.inline(cells)).filter("whole").drop("whole")


def type_examples(freq: DataFrame, types: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` smallest different values of columns with a better type."""
    issues = types.filter("inferred_type <> 'unknown'").select("column", "inferred_type")
    order = Window.partitionBy("column").orderBy("value")
    ranked = freq.filter("value IS NOT NULL").join(issues, "column").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
    return ranked.groupBy("column", "inferred_type").agg(F.sort_array(F.collect_list("value")).alias("examples"))


def analyze_types(df: DataFrame) -> dict[str, DataFrame]:
    freq = frequencies(df, string_columns(df))
    types = text_types(freq)
    return {"column_types": data_types(df), "inferred_types": types, "type_issues": type_examples(freq, types), "invalid_values": invalid_dates(freq, types), "integer_like_floats": integer_like_floats(df)}
