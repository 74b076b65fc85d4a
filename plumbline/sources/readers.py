"""Reading tabular files by type, with missing-value tokens taken out at once."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.schema import nan_to_null, quoted

from .arrow_file import FeatherSource
from .delimited import lines_of, quotes_in, records_of
from .workbook import WorkbookSource

#: Cells of a delimited file that mean no value.
NA_CELLS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
TYPES = ("csv", "tsv", "json", "parquet", "feather", "xlsx", "xls")


def file_type(path: str) -> str:
    return os.path.splitext(path)[1].lstrip(".").lower()


def without_na(raw: DataFrame, na_cells: list[str] = NA_CELLS) -> DataFrame:
    """Text cells that mean no value become NULL; the strings are untouched otherwise."""
    return raw.select(*[F.when(~quoted(f.name).isin(na_cells), quoted(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else quoted(f.name) for f in raw.schema.fields])


_WHOLE, _REAL = r"^[+-]?[0-9]{1,18}$", r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_TESTS = {"n": F.count, "i": lambda c: F.count_if(c.rlike(_WHOLE)), "d": lambda c: F.count_if(c.rlike(_REAL)), "b": lambda c: F.count_if(F.lower(c).isin("true", "false"))}


def _type_tests(cells: list[Column]) -> list[Column]:
    return [f(c).alias(f"{t}{k}") for k, c in enumerate(cells) for t, f in _TESTS.items()]


def typed(raw: DataFrame, tested: Row | None = None) -> DataFrame:
    """All-text columns as whole numbers, numbers or booleans where every value is one; one aggregation, whose row may be given."""
    columns = raw.columns
    row = tested or raw.agg(*_type_tests([quoted(c) for c in columns])).first()

    def cast(k: int, c: str):
        n = row[f"n{k}"]
        kind = "string" if not n else "bigint" if row[f"i{k}"] == n else "double" if row[f"d{k}"] == n else "boolean" if row[f"b{k}"] == n else "string"
        return quoted(c).cast(kind).alias(c)

    return raw.select(*[cast(k, c) for k, c in enumerate(columns)])


def spans_lines(spark: SparkSession, path: str) -> bool:
    """Whether a delimited file has records of several lines: some line then has an odd number of quotes. One pass over the lines,
    in splits, that ends with the first such line."""
    return not lines_of(spark, path).filter(quotes_in("value") % 2 == 1).isEmpty()


def read_delimited(spark: SparkSession, path: str, sep: str = ",", schema: T.StructType | str | None = None, *, multi_line: bool | None = None, **options: str) -> DataFrame:
    """A headed file, read in splits, whether or not its records span lines (``multi_line``; looked up if not given). Without
    ``schema`` cells are read as text, tokens of no value are taken out, and only then types are inferred, so that a token
    doesn't turn a column of numbers into text. The pass that looks for line breaks in cells tests the types as well, which
    holds if there are none; else another pass does."""
    how = {"sep": sep, "escape": '"', **options}
    headed = lambda lines: spark.read.options(**how).option("header", True).option("multiLine", lines)  # noqa: E731  (an option stays with its reader)
    if schema is None:
        names = headed(True).csv(path).columns  # reads the first record only
        texts = T.StructType([T.StructField(f"c{k}", T.StringType()) for k in range(len(names))])
    else:
        texts = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        names = texts.names
    tested = None
    if multi_line is None and schema is None and names:
        lines = lines_of(spark, path)
        header = spark.read.option("lineSep", "\n").text(path).first()
        own = lines.filter((F.col("block") > 0) | (F.col("value") != (header[0] if header else "")))  # no line but a header's, or one like it
        cells = own.select("value", F.from_csv(F.col("value"), ", ".join(f"c{k} string" for k in range(len(names))), how).alias("cells"))
        filled = [F.when(~F.col(f"cells.c{k}").isin(NA_CELLS), F.col(f"cells.c{k}")) for k in range(len(names))]
        tested = cells.agg(F.coalesce(F.bool_or(quotes_in("value") % 2 == 1), F.lit(False)).alias("spans"), F.count("*").alias("rows"), *_type_tests(filled)).first()
        whole = tested.spans or (header is not None and header[0].count('"') % 2 == 1)
        tested = None if whole or not tested.rows else tested
    else:
        whole = spans_lines(spark, path) if multi_line is None else multi_line
    if not whole:
        raw = headed(False).schema(T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, texts.fields, strict=True)])).csv(path)
    else:
        held = ", ".join(f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(texts.fields))
        raw = records_of(spark, path).select(F.from_csv("record", held, how).alias("cells")).select("cells.*").toDF(*names)
    return without_na(raw) if schema is not None else typed(without_na(raw), tested)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None, *, multi_line: bool | None = None) -> DataFrame:
    """JSON lines, read in splits, or one document (an array of objects) a file. Which of these is told by the first line if not given:
    lines begin with an object that is whole."""
    if multi_line is None:
        first = spark.read.text(path).filter(F.trim("value") != "").limit(1)
        row = first.select(F.trim("value").startswith("{") & F.try_parse_json("value").isNotNull()).first()
        multi_line = not (row and row[0])
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.option("multiLine", multi_line).json(path)


def read_dataset(spark: SparkSession, path: str, kind: str | None = None, *, schema: T.StructType | str | None = None) -> DataFrame:
    """The table in ``path``; ``kind`` is the extension if not given. An unknown kind is a ValueError."""
    kind = (kind or file_type(path)).lower()
    if kind == "csv":
        return read_delimited(spark, path, ",", schema)
    if kind == "tsv":
        return read_delimited(spark, path, "\t", schema)
    if kind == "json":
        return read_json(spark, path, schema)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if kind == "parquet":
        return nan_to_null(reader.parquet(path))
    if kind == "feather":
        spark.dataSource.register(FeatherSource)
        return reader.format("feather").option("path", path).load()
    if kind == "xlsx":
        spark.dataSource.register(WorkbookSource)
        return typed(without_na(spark.read.format("workbook").option("path", path).load()))
    if kind == "xls":
        raise ValueError("xls (the binary format) isn't supported; save the sheet as xlsx")
    raise ValueError(f"unsupported file type: {kind}")


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A relational table; give partitionColumn, lowerBound, upperBound and numPartitions for parallel reads."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
