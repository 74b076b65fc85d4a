"""Registered queries of the nine reports, the full analysis, and their JSON form, over whole tables.

A report is a set of frames. A query gives all cells of its frames as rows (part, item, measure, number, text): ``item`` is the
row's key, a list is joined to a text. The SQL puts together the SQL of the frames, or has its own, in the same way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.schema import quoted

from .catalogue import (
    _LINE_CELLS,
    _PROFILES_SQL,
    _REPORT,
    CELLS_SQL,
    FREQ_SQL,
    LABELLED_SQL,
    LINE,
    MISSING_SQL,
    SQL,
    _catalog,
    _labels,
    dirty_texts,
    labelled,
    query,
    read,
)
from .reports import as_json, diagnose, full_analysis

CELL = "part string, item string, measure string, number double, text string"


def cells_of(report: dict[str, DataFrame], keys: dict[str, list[str]]) -> DataFrame:
    """All cells of the frames in ``keys``, which names the columns that tell a frame's rows apart."""
    out = None
    for part, names in keys.items():
        frame = report[part]
        item = F.concat_ws("|", *[quoted(k).cast("string") for k in names])
        cells = []
        for c, kind in frame.dtypes:
            if c in names:
                continue
            listed = F.array_join(F.transform(quoted(c), lambda x: (x.cast("decimal(30,4)") if "double" in kind else x).cast("string")), "|") if kind.startswith("array") else quoted(c)  # noqa: B023
            text = kind == "string" or kind.startswith("array")
            number = F.lit(None) if text else F.round(quoted(c).cast("double"), 6)
            cells.append(F.struct(F.lit(part).alias("part"), item.alias("item"), F.lit(c).alias("measure"), number.cast("double").alias("number"), (listed if text else F.lit(None)).cast("string").alias("text")))
        rows = frame.select(F.inline(F.array(*(cells or [F.struct(F.lit(part).alias("part"), item.alias("item"), F.lit("").alias("measure"), F.lit(None).cast("double").alias("number"), F.lit(None).cast("string").alias("text"))]))))
        out = rows if out is None else out.unionByName(rows)
    return out


def cells_sql(parts: dict[str, tuple[str, list[str], list[str], list[str]]]) -> str:
    """The same of queries: part: (SQL, keys, measures that are numbers, measures that are texts)."""
    rows = []
    for part, (sql, keys, numbers, texts) in parts.items():
        item = f"""concat_ws('|', {", ".join(f'"{k}"' for k in keys)})""" if keys else "''"
        made = [(m, f'round("{m}"::DOUBLE, 6)', "NULL") for m in numbers] + [(m, "NULL", f'"{m}"') for m in texts] or [("", "NULL", "NULL")]
        rows += [f"SELECT '{part}' AS part, {item} AS item, '{m}' AS measure, {n}::DOUBLE AS number, {t}::VARCHAR AS text FROM ({sql})" for m, n, t in made]
    return "\nUNION ALL ".join(rows)


_MISSING = {
    "columns": (SQL["missing_tokens"], ["column"], ["missing_count", "missing_pct"], []),
    "totals": (f"WITH {CELLS_SQL} SELECT {_REPORT}::BIGINT AS total_missing, count(*) AS total_cells, round({_REPORT}::DOUBLE / count(*) * 100, 2) AS missing_pct FROM cells", [], ["total_missing", "total_cells", "missing_pct"], []),
}


@query("report_missing_values", cells_sql(_MISSING))
def _(spark, sf):
    return cells_of(diagnose(dirty_texts(spark, sf), "missing_values"), {"columns": ["column"], "totals": []})


_DUPLICATES = {
    "profiles": (SQL["dup_profiles"], ["profile"], ["total_rows", "duplicate_count", "duplicate_pct", "near_duplicate_count"], []),
    "additional": (SQL["dup_additional"], [], ["additional_duplicates_found"], []),
    "split": (_PROFILES_SQL + ", s AS (SELECT round(duplicate_count::DOUBLE / total_rows * 100, 1) AS pct FROM p WHERE profile = 'smart') SELECT 'Duplicates' AS label, pct FROM s UNION ALL SELECT 'Unique', 100 - pct FROM s", ["label"], ["pct"], []),
}


@query("report_duplicates", cells_sql(_DUPLICATES))
def _(spark, sf):
    return cells_of(diagnose(_labels(spark, sf), "duplicates"), {"profiles": ["profile"], "additional": [], "split": ["label"]})


_SHOWN = f'shown AS ({SQL["bundle_categorical"]})'
_OF_SHOWN = lambda name: f'WITH {_SHOWN} SELECT * FROM ({SQL[name]}) WHERE "column" IN (SELECT "column" FROM shown)'
_ORDER = "['kind', 'country', 'email', 'phone', 'gender', 'rating', 'category', 'ship_date', 'birth', 'amount']"
_CATEGORICAL = {
    "columns": (SQL["bundle_categorical"], ["column"], ["unique_values", "missing_count", "has_quality_issues"], []),
    "top_values": (_OF_SHOWN("value_validity"), ["column", "value"], ["cnt", "pct", "is_valid"], []),
    "case": (_OF_SHOWN("case_inconsistency"), ["column", "base_value"], ["total_occurrences"], ["variations"]),
    "standardization": (_OF_SHOWN("standardization"), ["column", "standard_options"], ["n_variations", "total_occurrences"], ["found_variations"]),
    "shares": (_OF_SHOWN("cat_other_bucket"), ["column", "label"], ["cnt"], []),
    "issues": (_OF_SHOWN("issue_table"), ["column", "issue_type", "base_value", "variation"], ["cnt"], ["recommendation"]),
    "main": (f'WITH {_SHOWN} SELECT "column" FROM shown ORDER BY has_quality_issues DESC, list_position({_ORDER}, "column") LIMIT 1', ["column"], [], []),
}


@query("report_categorical", cells_sql(_CATEGORICAL))
def _(spark, sf):
    report = diagnose(dirty_texts(spark, sf), "categorical")
    report["case"] = report["case"].select("column", "base_value", "variations", "total_occurrences")
    report["standardization"] = report["standardization"].withColumn("standard_options", F.array_join("standard_options", "|"))
    return cells_of(report, {part: keys for part, (_, keys, _, _) in _CATEGORICAL.items()})


_FEATURES = "cells AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c}::DOUBLE AS v FROM events" for c in ("event_id", "user_id", "value")) + ')'
_FENCED = f"""WITH {_FEATURES}, q AS (SELECT "column", count(v) AS n, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b, avg(v) AS mu, stddev_pop(v) AS sd FROM cells GROUP BY 1),
f AS (SELECT *, v < a - 1.5 * (b - a) OR v > b + 1.5 * (b - a) AS i, coalesce(abs((v - mu) / nullif(sd, 0)) > 3, false) AS z, v < a - 3 * (b - a) OR v > b + 3 * (b - a) AS far FROM cells JOIN q USING ("column"))"""
_OUTLIERS = {
    "columns": (_FENCED + ' SELECT "column", any_value(n) AS n, count(*) FILTER (WHERE i) AS iqr_count, count(*) FILTER (WHERE z) AS zscore_count FROM f GROUP BY 1', ["column"], ["n", "iqr_count", "zscore_count"], []),
    "bounds": (_FENCED + ' SELECT "column", n, a - 1.5 * (b - a) AS lower, b + 1.5 * (b - a) AS upper FROM q', ["column"], ["n", "lower", "upper"], []),
    "conservative": (_FENCED + """, x AS (SELECT "column", v, row_number() OVER (PARTITION BY "column" ORDER BY v) AS k FROM (SELECT DISTINCT "column", v FROM f WHERE far))
SELECT "column", a - 3 * (b - a) AS lower, b + 3 * (b - a) AS upper, coalesce((SELECT count(*) FROM f WHERE far AND f."column" = q."column"), 0) AS outlier_count, round(coalesce((SELECT count(*) FROM f WHERE far AND f."column" = q."column"), 0)::DOUBLE / n * 100, 2) AS outlier_pct,
(SELECT min(v) FROM f WHERE far AND f."column" = q."column") AS least, (SELECT max(v) FROM f WHERE far AND f."column" = q."column") AS most, coalesce((SELECT string_agg(v::DECIMAL(30, 4)::VARCHAR, '|' ORDER BY v) FROM x WHERE k <= 5 AND x."column" = q."column"), '') AS examples FROM q""", ["column"], ["lower", "upper", "outlier_count", "outlier_pct", "least", "most"], ["examples"]),
}


@query("report_outliers", cells_sql(_OUTLIERS))
def _(spark, sf):
    """All but what the isolation forest decides, which outlier_union_forest has."""
    report = diagnose(read(spark, sf, "events").select("event_id", "user_id", "value"), "outliers")
    report["columns"] = report["columns"].select("column", "n", "iqr_count", "zscore_count")
    return cells_of(report, dict.fromkeys(("columns", "bounds", "conservative"), ["column"]))


_STRUCTURE = {"columns": (SQL["structure"], ["ordinal", "name"], ["non_null_count", "null_pct"], ["dtype"])}


@query("report_structure", cells_sql(_STRUCTURE))
def _(spark, sf):
    return cells_of(diagnose(labelled(spark, sf), "structure"), {"columns": ["ordinal", "name"]})


@query("report_json", SQL["structure"])
def _(spark, sf):
    """The structure report as JSON rows, read back."""
    fields = "struct<ordinal:int,name:string,dtype:string,non_null_count:bigint,null_pct:double>"
    return as_json(diagnose(labelled(spark, sf), "structure")).filter("part = 'columns'").select(F.from_json("row", fields).alias("r")).select("r.*")


_FLAGS = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS cnt FROM lineitem GROUP BY {c}" for c in ("l_returnflag", "l_linestatus"))
_RANKED = f"""WITH t AS ({_FLAGS}), r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY cnt DESC, value) AS rank, sum(cnt) OVER (PARTITION BY "column") AS total FROM t WHERE value IS NOT NULL)"""
_DISTRIBUTION = {
    "numeric": (SQL["distribution_ext"], ["column"], ["count", "mean", "std", "min", "q25", "q50", "q75", "max", "iqr", "skewness", "kurtosis"], []),
    "categorical": (_RANKED + """, p AS (SELECT *, cnt::DOUBLE / sum(cnt) OVER (PARTITION BY "column") AS p FROM r WHERE rank <= 20), u AS (SELECT "column", count(*) AS unique_values FROM r GROUP BY 1)
SELECT "column", any_value(unique_values) AS unique_values, max(cnt) AS most_common_count, round(max(cnt)::DOUBLE / any_value(total) * 100, 2) AS most_common_pct, sum(-p * ln(p)) AS entropy, max(value) FILTER (WHERE rank = 1) AS most_common FROM p JOIN u USING ("column") GROUP BY 1""", ["column"], ["unique_values", "most_common_count", "most_common_pct", "entropy"], ["most_common"]),
    "top_values": (_RANKED + " SELECT * FROM r WHERE rank <= 20", ["column", "rank"], ["cnt"], ["value"]),
}


@query("report_distribution", cells_sql(_DISTRIBUTION))
def _(spark, sf):
    report = diagnose(read(spark, sf, "lineitem").select(*LINE, "l_returnflag", "l_linestatus"), "distribution")
    report["numeric"] = report["numeric"].drop("normality")  # a row of its own, to three places
    return cells_of(report, {"numeric": ["column"], "categorical": ["column"], "top_values": ["column", "rank"]})


_CORRELATION = {
    "pairs": (SQL["corr_diff"], ["column1", "column2"], ["corr_filtered", "corr_original", "abs_diff", "noted"], []),
    "strongest": (f"SELECT column1, column2, corr_filtered AS correlation, abs(corr_filtered) AS abs_correlation FROM ({SQL['corr_diff']}) WHERE abs(corr_filtered) < 1 ORDER BY abs(corr_filtered) DESC, column1, column2 LIMIT 5", ["column1", "column2"], ["correlation", "abs_correlation"], []),
}


@query("report_correlation", cells_sql(_CORRELATION))
def _(spark, sf):
    return cells_of(diagnose(read(spark, sf, "lineitem").select(*LINE), "correlation"), {"pairs": ["column1", "column2"], "strongest": ["column1", "column2"]})


_SUMMARY_CELLS = "cells AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c}::DOUBLE AS v FROM labelled" for c in ("doc_id", "n_chars", "quality", "toxic")) + ")"
_DESCRIBED = "count(v) AS count, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS min, quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.5) AS q50, quantile_cont(v, 0.75) AS q75, max(v) AS max"
_SUMMARY_FREQ = "freq AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS cnt FROM labelled GROUP BY {c}" for c in ("lang", "source")) + ")"
_SUMMARY = {
    "dataset": (f"""WITH {LABELLED_SQL}, s AS (SELECT count(*)::DOUBLE AS n, sum((lang IS NULL)::INT + (source IS NULL)::INT + (n_chars IS NULL)::INT + (quality IS NULL)::INT + (toxic IS NULL)::INT + (doc_id IS NULL)::INT)::DOUBLE AS m, (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM labelled)))::DOUBLE AS d FROM labelled)
SELECT unnest(['Total Rows', 'Total Columns', 'Numeric Columns', 'Categorical Columns', 'Missing Values', 'Missing %', 'Duplicate Rows', 'Duplicate %']) AS metric, unnest([n, 6, 4, 2, m, round(m / (n * 6) * 100, 2), d, round(d / n * 100, 2)]) AS value FROM s""", ["metric"], ["value"], []),
    "numeric": (f'WITH {LABELLED_SQL}, {_SUMMARY_CELLS} SELECT "column", {_DESCRIBED} FROM cells GROUP BY 1', ["column"], ["count", "mean", "std", "min", "q25", "q50", "q75", "max"], []),
    "categorical": (f"""WITH {LABELLED_SQL}, {_SUMMARY_FREQ}, r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY cnt DESC, value) AS k FROM freq WHERE value IS NOT NULL)
SELECT f."column", count(f.value) AS unique_count, any_value(r.value) AS top_value, any_value(r.cnt) AS top_count, coalesce(sum(f.cnt) FILTER (WHERE f.value IS NULL), 0) AS null_count FROM freq f JOIN r ON r."column" = f."column" AND r.k = 1 GROUP BY 1""", ["column"], ["unique_count", "top_count", "null_count"], ["top_value"]),
}


@query("report_summary", cells_sql(_SUMMARY))
def _(spark, sf):
    return cells_of(diagnose(labelled(spark, sf), "summary"), {"dataset": ["metric"], "numeric": ["column"], "categorical": ["column"]})


_CONSISTENCY = {
    "columns": (SQL["consistency_report"], ["column"], ["case_count", "space_count", "rare_count"], ["rare_values", "invalid_values"]),
    "summary": (f"""SELECT "column", case_count, space_count, rare_count, array_to_string(string_split(rare_values, '|')[1:3], ', ') AS examples FROM ({SQL["consistency_report"]})""", ["column"], ["case_count", "space_count", "rare_count"], ["examples"]),
    "violations": (SQL["category_pattern"], ["column", "value", "rule", "reason"], ["cnt"], []),
    "values": (SQL["value_flags"], ["column", "value"], ["cnt", "has_issue"], []),
}


@query("report_categorical_consistency", cells_sql(_CONSISTENCY))
def _(spark, sf):
    return cells_of(diagnose(dirty_texts(spark, sf), "categorical_consistency"), {part: keys for part, (_, keys, _, _) in _CONSISTENCY.items()})


_TYPED = f"""WITH {FREQ_SQL} SELECT "column", sum(cnt) AS non_null FROM freq WHERE value IS NOT NULL GROUP BY 1"""
_FULL = {
    "missing_values": (SQL["missing_full"], ["column"], ["missing_count", "missing_pct"], []),
    "missing_totals": (f"WITH {CELLS_SQL} SELECT count(*) FILTER (WHERE {MISSING_SQL}) AS total_missing, count(*) AS total_cells, round(count(*) FILTER (WHERE {MISSING_SQL})::DOUBLE / count(*) * 100, 2) AS missing_pct FROM cells", [], ["total_missing", "total_cells", "missing_pct"], []),
    "missing_tokens": (SQL["missing_used_tokens"], ["token"], ["cells"], []),
    "column_types": (f"SELECT unnest(range(10)) AS ordinal, unnest({_ORDER}) AS \"column\", 'string' AS type", ["ordinal", "column"], [], ["type"]),
    "inferred_types": (_TYPED, ["column"], ["non_null"], []),
    "type_issues": (SQL["type_examples"], ["column"], [], ["inferred_type", "examples"]),
    "invalid_values": (SQL["invalid_dates"], ["column"], ["cells"], ["values"]),
    "categorical_consistency": (SQL["consistency"], ["column"], ["case_count", "space_count", "rare_count"], ["rare_values"]),
    "case_examples": (SQL["case_examples"], ["column", "base_value"], [], ["variations"]),
    "whitespace_examples": (SQL["whitespace_inconsistency"], ["column", "base_value"], [], ["variations"]),
    "shape": ("SELECT count(*) AS row_count, 10 AS column_count FROM part", [], ["row_count", "column_count"], []),
}


@query("report_full_analysis", cells_sql(_FULL))
def _(spark, sf):
    """The frames but those of duplicate rows, which report_duplicates has, and of ids and whole floats, of which this table has none."""
    report = full_analysis(dirty_texts(spark, sf))
    report["inferred_types"] = report["inferred_types"].select("column", "non_null")
    return cells_of(report, {part: keys for part, (_, keys, _, _) in _FULL.items()})


@query("catalog_point", "SELECT o_orderkey::VARCHAR AS id, o_custkey AS user_id, o_orderpriority AS filename FROM orders WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders)")
def _(spark, sf):
    """A dataset by its id and owner, out of as many as there are orders."""
    catalog, orders = _catalog(spark), read(spark, sf, "orders")
    none = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in catalog.table("datasets").schema.fields}
    given = {"id": F.col("o_orderkey").cast("string").alias("id"), "filename": F.col("o_orderpriority").alias("filename"), "user_id": F.col("o_custkey").alias("user_id")}
    catalog.append("datasets", orders.select(*({**none, **given}).values()))
    last = orders.orderBy(F.desc("o_orderkey")).first()
    found = catalog.dataset(str(last.o_orderkey), last.o_custkey)
    return spark.createDataFrame([(found["id"], found["user_id"], found["filename"])], "id string, user_id bigint, filename string")
