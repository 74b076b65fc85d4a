"""The nine diagnosis reports and the full analysis as sets of DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.schema import EmptyDatasetError, feature_columns, numeric_columns, string_columns, with_row_index
from plumbline.operators import categorical, duplicates, frequency, inference, missing, numeric, outliers

Report = dict[str, DataFrame]
#: A report compares rows with each other only if no more than so many differ, and says NULL beyond; the operator itself has no bound.
NEAR_UP_TO = 10_000


def _missing(df: DataFrame) -> Report:
    return {"columns": missing.missing_report(df), "totals": missing.missing_report_totals(df)}


def _duplicates(df: DataFrame) -> Report:
    profiles = duplicates.duplicate_profiles(df, near_up_to=NEAR_UP_TO)
    return {"profiles": profiles, "additional": duplicates.additional_duplicates(profiles), "split": duplicates.duplicate_split(profiles.filter("profile = 'smart'")), "id_columns": inference.id_columns(df)}


def _categorical(df: DataFrame) -> Report:
    ids = [r.column for r in inference.id_columns(df).collect()]  # one row for each column at most
    parts = categorical.analyze_categorical(df, ids)
    freq = parts.pop("freq")
    return {**parts, "shares": frequency.top_with_other(freq), "issues": categorical.issue_table(freq), "main": categorical.main_column(parts["columns"], df.columns)}


def _outliers(df: DataFrame) -> Report:
    columns = feature_columns(df)
    if not columns:
        raise EmptyDatasetError("no numeric columns")
    return {"columns": outliers.combined_outliers(df, columns, isolation=True), "bounds": outliers.fences(df, columns), "conservative": outliers.iqr_outliers(df, columns, 3.0, of_all_rows=True)}


def _structure(df: DataFrame) -> Report:
    return {"columns": numeric.structure(df), "sizes": numeric.structure_size(df)}


def _distribution(df: DataFrame) -> Report:
    out: Report = {}
    if numeric_columns(df):
        out["numeric"] = numeric.distribution(df)
    if string_columns(df):
        freq = frequency.frequencies(df)
        out |= {"categorical": numeric.categorical_distribution(freq), "top_values": frequency.top_values(freq, 20, with_nulls=False)}
    return out


def _correlation(df: DataFrame) -> Report:
    if len(feature_columns(df)) < 2:
        raise EmptyDatasetError("fewer than two numeric columns")
    compared = numeric.correlation_comparison(df)
    return {"pairs": compared, "strongest": numeric.strongest_correlations(compared.withColumnRenamed("corr_filtered", "correlation"))}


def _summary(df: DataFrame) -> Report:
    out = {"dataset": numeric.dataset_summary(df)}
    if numeric_columns(df):
        out["numeric"] = numeric.describe(df)
    if string_columns(df):
        out["categorical"] = numeric.categorical_summary(df)
    return out


def _consistency(df: DataFrame) -> Report:
    if not string_columns(df):
        raise EmptyDatasetError("no categorical columns")
    freq = frequency.frequencies(df)
    report = categorical.report_consistency(freq)
    return {"columns": report, "summary": categorical.consistency_summary(report), "violations": categorical.rule_violations(freq), "values": categorical.value_flags(freq)}


REPORTS: dict[str, Callable[[DataFrame], Report]] = {
    "missing_values": _missing, "duplicates": _duplicates, "categorical": _categorical, "outliers": _outliers, "structure": _structure,
    "distribution": _distribution, "correlation": _correlation, "summary": _summary, "categorical_consistency": _consistency,
}


def diagnose(df: DataFrame, kind: str) -> Report:
    """The frames of one report. An unknown kind is a ValueError, a table without rows or columns an EmptyDatasetError."""
    if kind not in REPORTS:
        raise ValueError(f"unknown report {kind!r}; there are {', '.join(REPORTS)}")
    if not df.columns or df.isEmpty():
        raise EmptyDatasetError("the dataset is empty")
    return REPORTS[kind](df)


def as_json(report: Report) -> DataFrame:
    """part, row: all frames of a report as one, each row as JSON."""
    out = None
    for part, frame in report.items():
        rows = frame.select(F.lit(part).alias("part"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in frame.columns]), {"ignoreNullFields": "false"}).alias("row"))
        out = rows if out is None else out.unionByName(rows)
    return out


def full_analysis(df: DataFrame, *order: str) -> Report:
    """Missing values with examples, duplicates, types and consistency over all rows. ``order`` is a stable key
    for the row numbers of examples."""
    indexed = with_row_index(df, *(order or df.columns))
    freq = frequency.frequencies(df)
    searched = duplicates.duplicate_search_columns(df) or df.columns
    flags = duplicates.duplicate_flags(indexed, searched, case_sensitive=False)
    near = duplicates.near_rows(indexed, searched, up_to=NEAR_UP_TO)
    profiles = duplicates.duplicate_profiles(df, smart=searched, near=None if near is None else near.count())
    examples = duplicates.duplicate_examples(indexed, flags)
    examples = examples if near is None else examples.unionByName(duplicates.near_examples(indexed, near))
    types = inference.analyze_types(df)
    return {
        "missing_values": missing.missing_full(df), "missing_totals": missing.missing_full_totals(df), "missing_tokens": missing.missing_tokens_used(freq),
        "missing_examples": missing.missing_examples(indexed), "duplicates": profiles, "duplicate_examples": examples,
        **types, "categorical_consistency": categorical.consistency(freq), "case_examples": categorical.variation_examples(freq, "case"),
        "whitespace_examples": categorical.variation_examples(freq, "space"), "id_columns": inference.id_columns(df),
        "shape": df.agg(F.count("*").alias("row_count")).withColumn("column_count", F.lit(len(df.columns))),
    }
