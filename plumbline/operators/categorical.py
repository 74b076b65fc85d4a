"""Categorical columns: detection, frequent values, inconsistent spellings, and domain rules.

Everything but detection works on the frequency table (column, value, cnt), so rules see each
different value once, whatever the number of rows.
"""

from __future__ import annotations

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.schema import numeric_columns, quoted, string_columns
from plumbline.functions.text import strip, to_number

from .frequency import distinct_counts, frequencies, top_values
from .rules import (
    CONSISTENCY_RULES, COUNTRIES, COUNTRY_ALIASES, COUNTRY_NAME_PARTS, EMAIL, EMAIL_NAME_PARTS, GENDER_NAME_PARTS,
    GENDERS, NOT_COUNTRIES, PHONE_NAME_PARTS, RATING_NAME_PARTS, STANDARD_SETS,
)


#: Different values that a category of texts has at most, and values that a list of examples holds.
MOST_VALUES = 50
LISTED = 100


def _filled() -> Column:
    return F.col("value").isNotNull()


def categorical_columns(df: DataFrame, ids: list[str] = ()) -> DataFrame:
    """column, n_unique, total of the columns that are categories: texts of at most min(50, 20 % of rows)
    different values, numbers and booleans of at most min(15, 10 %); columns in ``ids`` never are."""
    booleans = [f.name for f in df.schema.fields if isinstance(f.dataType, T.BooleanType)]
    texts = [c for c in string_columns(df) if c not in ids]
    numbers = [c for c in numeric_columns(df) + booleans if c not in ids]
    if not texts + numbers:
        return df.sparkSession.createDataFrame([], "column string, n_unique bigint, total bigint")
    # a sketch keeps columns of many values, which can't be categories, out of the shuffle
    about = df.agg(*[F.approx_count_distinct(quoted(c).cast("string")).alias(f"u{k}") for k, c in enumerate(texts + numbers)]).first()
    few = [c for k, c in enumerate(texts + numbers) if about[f"u{k}"] <= 2 * MOST_VALUES]
    counts = distinct_counts(frequencies(df, few))
    is_text = F.col("column").isin(texts) if texts else F.lit(False)
    bound = F.when(is_text, F.least(F.lit(float(MOST_VALUES)), 0.2 * F.col("total"))).otherwise(F.least(F.lit(15.0), 0.1 * F.col("total")))
    return counts.filter((F.col("n_unique") > 0) & (F.col("n_unique") <= bound)).select("column", "n_unique", "total")


def value_rows(freq: DataFrame, invalid: DataFrame, listed: int = 30) -> DataFrame:
    """column, value (``Missing`` for NULL), cnt, pct of the column's rows, is_valid for the most frequent values."""
    totals = freq.groupBy("column").agg(F.sum("cnt").alias("total"))
    bad = invalid.select("column", "value").distinct().withColumn("bad", F.lit(True))
    rows = top_values(freq, listed).join(totals, "column").join(bad, ["column", "value"], "left")
    return rows.select("column", F.coalesce("value", F.lit("Missing")).alias("value"), "cnt", (F.col("cnt").cast("double") / F.col("total") * 100).alias("pct"), F.col("bad").isNull().alias("is_valid"))


def case_groups(freq: DataFrame) -> DataFrame:
    """Values that differ in case alone: column, base_value (lower case), variations, total_occurrences."""
    groups = freq.filter(_filled()).groupBy("column", F.lower("value").alias("base_value"))
    return groups.agg(F.sort_array(F.collect_list("value")).alias("variations"), F.sum("cnt").alias("total_occurrences")).filter(F.size("variations") > 1)


def first_values(rows: DataFrame, keys: list[str], name: str, listed: int) -> DataFrame:
    """keys and ``name``, the first ``listed`` values of each in order; the rank is bounded, so no task holds more of a key."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("value"))).filter(F.col("rank") <= listed)
    return ranked.groupBy(*keys).agg(F.sort_array(F.collect_list("value")).alias(name))


def _standard_rows(freq: DataFrame, match: str) -> DataFrame:
    low = F.lower("value")
    hit = lambda words: low.isin(words) if match == "exact" else F.exists(F.array(*[F.lit(w) for w in words]), lambda w: low.contains(w))
    sets = F.array(*[F.when(hit(s), F.lit(k)) for k, s in enumerate(STANDARD_SETS)])
    return freq.filter(_filled()).select("column", "value", "cnt", F.explode(F.filter(sets, lambda k: k.isNotNull())).alias("set_no"))


def _options() -> Column:
    return F.array(*[F.array_sort(F.array(*[F.lit(w) for w in s])) for s in STANDARD_SETS])


def standard_groups(freq: DataFrame, match: str = "substring", listed: int = LISTED) -> DataFrame:
    """Values that one set of spellings covers, where it covers more than one: column, standard_options,
    found_variations (the first ``listed``), n_variations, total_occurrences. ``substring``: a value that contains any spelling counts."""
    rows = _standard_rows(freq, match)
    sums = rows.groupBy("column", "set_no").agg(F.count("*").alias("n_variations"), F.sum("cnt").alias("total_occurrences")).filter("n_variations > 1")
    grouped = sums.join(first_values(rows, ["column", "set_no"], "found_variations", listed), ["column", "set_no"])
    return grouped.select("column", F.get(_options(), F.col("set_no")).alias("standard_options"), "found_variations", "n_variations", "total_occurrences")


def _named(parts: list[str]) -> Column:
    low = F.lower("column")
    return F.lit(False) if not parts else low.rlike("|".join(p.replace("-", r"\-") for p in parts))


def _near_places() -> Column:
    """A function of texts: whether one holds a country's name or is held by one, of which neither is over twice as long as the other. An
    automaton finds all names in a text at once; parts of at least half a name are a set."""
    names = [*COUNTRIES, *COUNTRY_ALIASES]
    parts = {c[i:j] for c in names for i in range(len(c)) for j in range(i + 1, len(c) + 1) if len(c) <= 2 * (j - i)}
    held: list[ahocorasick.Automaton] = []  # made once in each worker

    @F.pandas_udf("boolean")
    def near(texts: pd.Series) -> pd.Series:
        if not held:
            held.append(ahocorasick.Automaton())
            for c in names:
                held[0].add_word(c, 2 * len(c))
            held[0].make_automaton()
        return texts.map(lambda t: None if t is None else t in parts or any(twice >= len(t) for _, twice in held[0].iter(t)))

    return near


def country_verdict(value: Column) -> Column:
    """``ok``, ``obvious`` (names no place) or ``unknown`` for a text given as a country."""
    low = strip(F.lower(value))
    return F.when(low.isin([*COUNTRIES, *COUNTRY_ALIASES]), "ok").when(low.isin(NOT_COUNTRIES) | (F.length(low) < 2), "obvious").when(_near_places()(low), "ok").otherwise("unknown")


def invalid_values(freq: DataFrame) -> DataFrame:
    """column, value, cnt, domain, reason of values that their column's domain doesn't allow. The first
    domain whose words stand in the column's name counts: country, email, phone, gender, rating."""
    v = F.col("value")
    digits = F.length(F.regexp_replace(v, "[^0-9]", ""))
    number = to_number(v)
    domain = (
        F.when(_named(COUNTRY_NAME_PARTS), "country").when(_named(EMAIL_NAME_PARTS), "email").when(_named(PHONE_NAME_PARTS), "phone")
        .when(_named(GENDER_NAME_PARTS), "gender").when(_named(RATING_NAME_PARTS), "rating")
    )
    rows = freq.filter(_filled()).withColumn("domain", domain).filter("domain IS NOT NULL")
    country = country_verdict(F.when(F.col("domain") == "country", v))
    reason = (
        F.when(F.col("domain") == "country", F.when(country != "ok", country))
        .when((F.col("domain") == "email") & ~v.rlike(EMAIL), "pattern")
        .when((F.col("domain") == "phone") & ((digits < 7) | (digits < 0.7 * F.length(v))), "digits")
        .when((F.col("domain") == "gender") & ~F.lower(v).isin(GENDERS), "value")
        .when((F.col("domain") == "rating") & number.isNull(), "not a number")
        .when((F.col("domain") == "rating") & ~number.between(0, 100), "range")
    )
    return rows.withColumn("reason", reason).filter("reason IS NOT NULL").select("column", "value", "cnt", "domain", "reason")


def consistency(freq: DataFrame) -> DataFrame:
    """Cells that aren't lower case, cells with white space at an end, and rare values (under
    max(1, 1 % of filled cells)) of columns that have any: column, case_count, space_count, rare_count, rare_values (10)."""
    filled = freq.filter(_filled())
    totals = filled.groupBy("column").agg(F.sum("cnt").alias("total"))
    rows = filled.join(totals, "column").withColumn("rare", F.col("cnt") < F.greatest(F.lit(1.0), 0.01 * F.col("total")))
    return _summary(rows)


def _summary(rows: DataFrame) -> DataFrame:
    v, cnt = F.col("value"), F.col("cnt")
    sums = rows.groupBy("column").agg(
        F.coalesce(F.sum(F.when(v != F.lower(v), cnt)), F.lit(0)).alias("case_count"), F.coalesce(F.sum(F.when(v != strip(v), cnt)), F.lit(0)).alias("space_count"),
        F.count_if("rare").alias("rare_count"),
    )
    rarest = rows.filter("rare").withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy("cnt", F.asc_nulls_last("value")))).filter("rank <= 10")
    rarest = rarest.groupBy("column").agg(F.sort_array(F.collect_list(F.coalesce(v, F.lit("Missing")))).alias("rare_values"))
    sums = sums.join(rarest, "column", "left").withColumn("rare_values", F.coalesce("rare_values", F.array().cast("array<string>")))
    return sums.filter("case_count > 0 OR space_count > 0 OR rare_count > 0")


def variation_examples(freq: DataFrame, kind: str = "case", listed: int = 5) -> DataFrame:
    """Of the cells that ``consistency`` counts, the first keys (lower case, or without white space at the
    ends) with the spellings that share them: column, base_value, variations."""
    v = F.col("value")
    base = F.lower(v) if kind == "case" else strip(v)
    rows = freq.filter(_filled() & (v != base)).select("column", base.alias("base_value"), "value")
    bases = rows.select("column", "base_value").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy("base_value"))).filter(F.col("rank") <= listed)
    return first_values(rows.join(bases.drop("rank"), ["column", "base_value"], "left_semi"), ["column", "base_value"], "variations", listed)


def upload_consistency(freq: DataFrame, listed: int = LISTED) -> DataFrame:
    """column, inconsistent_format (the first ``listed`` values that aren't stripped lower case), inconsistent_count (how many
    there are), rare_values (once only, 10)."""
    v = F.col("value")
    odd, rare = freq.filter(_filled() & (v != F.lower(strip(v)))), freq.filter(_filled() & (F.col("cnt") == 1))
    sums = odd.groupBy("column").agg(F.count("*").alias("inconsistent_count")).join(first_values(odd, ["column"], "inconsistent_format", listed), "column")
    out = sums.join(first_values(rare, ["column"], "rare_values", 10), "column", "full")
    none = F.array().cast("array<string>")
    return out.select("column", F.coalesce("inconsistent_format", none).alias("inconsistent_format"), F.coalesce("inconsistent_count", F.lit(0)).alias("inconsistent_count"), F.coalesce("rare_values", none).alias("rare_values"))


def rule_violations(freq: DataFrame) -> DataFrame:
    """column, value, cnt, rule, reason by the report's rules (a rule holds for columns whose name has its word)."""
    v, low, out = F.col("value"), F.lower("value"), None
    for rule, spec in CONSISTENCY_RULES.items():
        rows = freq.filter(_filled() & F.lower("column").contains(rule))
        tests = {}
        if "valid_values" in spec:
            tests["value"] = ~low.isin([x.lower() for x in spec["valid_values"]])
        if "valid_range" in spec:
            tests["range"] = ~to_number(v).between(*spec["valid_range"])
        if "invalid_patterns" in spec:
            tests["pattern"] = F.exists(F.array(*[F.lit(p.lower()) for p in spec["invalid_patterns"]]), lambda p: low.contains(p))
        if "valid_pattern" in spec:
            tests["valid_pattern"] = ~v.rlike(spec["valid_pattern"])
        found = F.filter(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(name)) for name, t in tests.items()]), lambda x: x.isNotNull())
        part = rows.select("column", "value", "cnt", F.lit(rule).alias("rule"), F.explode(found).alias("reason"))
        out = part if out is None else out.unionByName(part)
    return out


def report_consistency(freq: DataFrame) -> DataFrame:
    """The report's variant: rare is under 1 % of all rows, NULL counted as a value; with invalid_values (10)."""
    totals = freq.groupBy("column").agg(F.sum("cnt").alias("total"), F.sum(F.when(_filled(), F.col("cnt"))).alias("filled"))
    rows = freq.join(totals.filter("filled > 0"), "column").withColumn("rare", F.col("cnt") < 0.01 * F.col("total"))
    bad = rule_violations(freq).select("column", "value").distinct()
    bad = bad.withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy("value"))).filter("rank <= 10")
    bad = bad.groupBy("column").agg(F.sort_array(F.collect_list("value")).alias("invalid_values"))
    out = _summary(rows).join(bad, "column", "full")
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("case_count", "space_count", "rare_count")}
    return out.withColumns({**zero, **{c: F.coalesce(F.col(c), F.array().cast("array<string>")) for c in ("rare_values", "invalid_values")}})


def consistency_summary(report: DataFrame) -> DataFrame:
    """One row for each column of a consistency report with up to three rare values as a text."""
    return report.select("column", "case_count", "space_count", "rare_count", F.concat_ws(", ", F.slice("rare_values", 1, 3)).alias("examples"))


def issue_table(freq: DataFrame) -> DataFrame:
    """column, issue_type, base_value, variation, cnt, recommendation of all issues."""
    case = case_groups(freq).select("column", F.lit("case").alias("issue_type"), "base_value", F.explode("variations").alias("value"))
    found = _standard_rows(freq, "substring")
    several = found.groupBy("column", "set_no").agg(F.count("*").alias("n")).filter("n > 1")
    names = found.join(several, ["column", "set_no"]).select("column", F.lit("standardization").alias("issue_type"), F.concat_ws(" / ", F.get(_options(), F.col("set_no"))).alias("base_value"), "value")
    bad = invalid_values(freq).select("column", F.lit("invalid").alias("issue_type"), F.lit("").alias("base_value"), "value")
    advice = F.when(F.col("issue_type") == "case", F.concat(F.lit("use "), F.col("base_value"))).when(F.col("issue_type") == "invalid", "check or remove").otherwise("use one spelling")
    rows = case.unionByName(names).unionByName(bad).join(freq.filter(_filled()), ["column", "value"])
    return rows.select("column", "issue_type", "base_value", F.col("value").alias("variation"), "cnt", advice.alias("recommendation"))


def value_flags(freq: DataFrame, listed: int = 15) -> DataFrame:
    """The most frequent values and whether one has an issue: case, space, rare or invalid."""
    totals = freq.groupBy("column").agg(F.sum("cnt").alias("total"))
    bad = rule_violations(freq).select("column", "value").distinct().withColumn("bad", F.lit(True))
    rows = top_values(freq, listed, with_nulls=False).join(totals, "column").join(bad, ["column", "value"], "left")
    v = F.col("value")
    issue = (v != F.lower(v)) | (v != strip(v)) | (F.col("cnt") < 0.01 * F.col("total")) | F.col("bad").isNotNull()
    return rows.select("column", "value", "cnt", issue.alias("has_issue"))


def analyze_categorical(df: DataFrame, ids: list[str] = ()) -> dict[str, DataFrame]:
    """Frames of the columns that are categories; their names come to the driver, so that only their values are counted."""
    freq = frequencies(df, [r.column for r in categorical_columns(df, ids).select("column").collect()])
    bad = invalid_values(freq)
    issues = [x.select("column") for x in (case_groups(freq), standard_groups(freq), bad)]
    flagged = issues[0].union(issues[1]).union(issues[2]).distinct().withColumn("has_quality_issues", F.lit(True))
    summary = distinct_counts(freq).select("column", F.col("n_unique").alias("unique_values"), (F.col("total") - F.col("non_null")).alias("missing_count"))
    summary = summary.join(flagged, "column", "left").fillna({"has_quality_issues": False})
    return {"columns": summary, "top_values": value_rows(freq, bad), "case": case_groups(freq), "standardization": standard_groups(freq), "invalid": bad, "freq": freq}


def main_column(summary: DataFrame, order: list[str]) -> DataFrame:
    """The column to show first: the first with issues, else the first."""
    place = F.array_position(F.array(*[F.lit(c) for c in order]), F.col("column"))
    return summary.orderBy(F.desc("has_quality_issues"), place).limit(1).select("column")
