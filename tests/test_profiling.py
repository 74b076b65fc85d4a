from __future__ import annotations

import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.functions.schema import EmptyDatasetError, with_row_index
from plumbline.operators import categorical, duplicates, frequency, inference, missing, numeric
from plumbline.operators.rules import COUNTRIES, COUNTRY_ALIASES, NOT_COUNTRIES
from plumbline.plans.reports import REPORTS, diagnose, full_analysis

QUICK = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@pytest.fixture(scope="module")
def people(spark):
    rows = [
        (0, "Ann", 31.0, "f", "Paris", 100.0), (1, " ann", None, "F", "paris", 250.5), (2, "Bob", 31.0, None, "N/A", 90.0),
        (3, "\t ", float("nan"), "m", "", 90.0), (4, None, 18.0, "m", "unknown", None), (5, "Bob", 31.0, None, "N/A", 90.0),
    ]
    return spark.createDataFrame(rows, "id bigint, name string, age double, gender string, city string, salary double")


def test_missing_by_three_definitions(people):
    basic = {r.column: r.missing_count for r in missing.missing_basic(people).collect()}
    assert basic == {"name": 1, "age": 2, "gender": 2, "salary": 1}
    report = {r.column: (r.missing_count, r.missing_pct) for r in missing.missing_report(people).collect()}
    assert report["city"] == (1, 16.67)
    full = {r.column: r.missing_count for r in missing.missing_full(people).collect()}
    assert full == {"id": 0, "name": 2, "age": 2, "gender": 2, "city": 4, "salary": 1}
    totals = missing.missing_full_totals(people).first()
    assert (totals.total_missing, totals.total_cells) == (11, 36)


def test_missing_examples_say_why(people):
    got = {(r.column, r.row_index): r.detected_as for r in missing.missing_examples(with_row_index(people, "id")).collect()}
    assert got["name", 3] == "Empty string" and got["name", 4] == "None" and got["age", 3] == "NaN"
    assert got["city", 2] == "Null indicator: N/A" and got["city", 3] == "Empty string"


def test_row_index_follows_the_key(spark):
    rows = with_row_index(spark.range(1000).select((999 - F.col("id")).alias("k")), "k").collect()
    assert all(r.k == r.row_index for r in rows) and len(rows) == 1000


def test_legacy_profile():
    assert missing.legacy_missing({"a": 2, "b": 0})["missing_percentage"] == 100.0
    assert missing.legacy_missing({"missing_percentage": 1, "total_missing": 3})["total_missing"] == 3


def test_duplicates(people):
    plain = duplicates.exact_duplicates(people.drop("id")).first()
    assert (plain.total_rows, plain.duplicate_count, plain.duplicate_pct) == (6, 1, 16.67)
    indexed = with_row_index(people, "id")
    flags = {r.row_index: r for r in duplicates.duplicate_flags(indexed, ["name", "age", "gender", "city", "salary"]).collect()}
    assert [k for k, r in flags.items() if r.is_duplicate] == [5] and flags[5].original_index == 2
    names = duplicates.normalised_duplicates(people, ["name"]).first()
    assert names.duplicate_count == 2  # " ann" with Ann, Bob with Bob; blank and missing differ
    assert duplicates.normalised_duplicates(people, ["name"], case_sensitive=True).first().duplicate_count == 1


@QUICK
@given(st.lists(st.tuples(st.sampled_from("abc"), st.one_of(st.none(), st.integers(0, 2))), min_size=1, max_size=30))
def test_duplicates_are_rows_less_distinct_rows(spark, rows):
    got = duplicates.exact_duplicates(spark.createDataFrame(rows, "a string, b int")).first()
    assert got.duplicate_count == len(rows) - len(set(rows)) and 0 <= got.duplicate_pct <= 100


def _indel(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b):
            prev, row[j + 1] = row[j + 1], prev + 1 if x == y else max(row[j + 1], row[j])
    return 1 - (len(a) + len(b) - 2 * row[-1]) / (len(a) + len(b)) if a or b else 1.0


def _lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        prev, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            prev, row[j + 1] = row[j + 1], min(prev + (x != y), row[j] + 1, row[j + 1] + 1)
    return 1 - row[-1] / max(len(a), len(b), 1)


@settings(QUICK, max_examples=6)
@given(st.lists(st.text("ab c", max_size=14), min_size=2, max_size=24), st.sampled_from([0.6, 0.8, 0.9]), st.sampled_from(["indel", "levenshtein"]))
def test_near_duplicates_lose_no_pair(spark, texts, threshold, metric):
    df = spark.createDataFrame(list(enumerate(texts)), "row_index bigint, record string")
    got = {(r.a, r.b) for r in duplicates.near_duplicates(df, threshold, metric=metric).collect()}
    same = _indel if metric == "indel" else _lev
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if texts[i] != texts[j] and same(texts[i], texts[j]) >= threshold - 1e-12}
    assert got == want
    assert all(math.isclose(duplicates.indel_similarity(x, y), _indel(x, y)) for x, y in zip(texts, texts[1:], strict=False))


def test_ids_and_types(spark):
    rows = [(k, f"v{k % 3}", f"2021-0{1 + k % 9}-10" if k % 7 else "2021-13-01", str(k) if k % 9 else "x", float(k % 4)) for k in range(60)]
    df = spark.createDataFrame(rows, "user_id bigint, kind string, birth_date string, amount string, level double")
    assert {r.column: r.reason for r in inference.id_columns(df, order="user_id").collect()} == {"user_id": "name"}
    freq = frequency.frequencies(df)
    types = {r.column: r.inferred_type for r in inference.text_types(freq).collect()}
    assert types == {"kind": "unknown", "birth_date": "datetime", "amount": "integer"}
    bad = inference.invalid_dates(freq, inference.text_types(freq)).first()
    assert (bad.column, bad["values"], bad.cells) == ("birth_date", ["2021-13-01"], 9)
    assert [r.column for r in inference.integer_like_floats(df).collect()] == ["level"]


def test_units_are_no_numbers(spark):
    df = spark.createDataFrame([("7d",), ("1_000",), (" 12 ",), ("1e3",), (".5",), ("nan",)], "v string")
    from plumbline.functions.text import to_number

    assert [r[0] for r in df.select(to_number(F.col("v"))).collect()] == [None, None, 12.0, 1000.0, 0.5, None]


def test_categories(spark):
    rows = [("USA", "x@y.org", "5"), ("usa", "bad", "200"), ("Moon", "a.b@c.de", "high"), (" france", None, "7"), ("Narnia", "q@r.st", None)] * 4
    df = spark.createDataFrame(rows, "country string, email string, rating string")
    freq = frequency.frequencies(df)
    assert {r.column for r in categorical.categorical_columns(df).collect()} == {"email", "rating"}  # five of twenty countries are over a fifth
    assert {r.column for r in categorical.categorical_columns(df.union(df)).collect()} == {"country", "email", "rating"}
    case = categorical.case_groups(freq).first()
    assert (case.base_value, case.variations, case.total_occurrences) == ("usa", ["USA", "usa"], 8)
    bad = {(r.column, r.value): r.reason for r in categorical.invalid_values(freq).collect()}
    assert bad == {("country", "Moon"): "obvious", ("country", "Narnia"): "unknown", ("email", "bad"): "pattern", ("rating", "200"): "range", ("rating", "high"): "not a number"}
    spaces = {r.column: r.space_count for r in categorical.consistency(freq).collect()}
    assert spaces["country"] == 4
    table = categorical.issue_table(freq)
    assert {"case", "invalid", "standardization"} == {r.issue_type for r in table.collect()}


def test_statistics(spark):
    values = [1.0, 2.0, 2.0, 3.0, 10.0, 4.0, 5.0, 2.5, 3.5, 100.0]
    df = spark.createDataFrame([(v, 2 * v, 7.0) for v in values] + [(None, float("nan"), 7.0)], "a double, b double, c double")
    d = {r.column: r for r in numeric.distribution(df).collect()}
    n, mean = len(values), sum(values) / len(values)
    m = [sum((v - mean) ** k for v in values) / n for k in (2, 3, 4)]
    assert d["a"]["count"] == 10 and math.isclose(d["a"].skewness, m[1] / m[0] ** 1.5) and math.isclose(d["a"].kurtosis, m[2] / m[0] ** 2 - 3)
    assert d["c"].skewness is None and d["c"].normality is None and d["a"].normality > 0
    corr = {(r.column1, r.column2): r.correlation for r in numeric.correlations(df).collect()}
    assert math.isclose(corr["a", "b"], 1.0) and corr["a", "c"] is None
    grid = sorted(numeric.density(df, "a", points=400).collect())
    step = grid[1].x - grid[0].x
    assert 0.4 < sum(r.density for r in grid) * abs(step) < 1.01
    assert numeric.trend(df, "a", "b").first().slope == pytest.approx(2.0)
    hist = numeric.histogram(df, "a", 10).collect()
    assert sum(r.cnt for r in hist) == 10


def test_reports_and_errors(people, spark):
    for kind in REPORTS:
        parts = diagnose(people, kind)
        assert parts and all(p.collect() is not None for p in parts.values())
    assert full_analysis(people, "id")["missing_values"].count() == 6
    with pytest.raises(ValueError, match="unknown report"):
        diagnose(people, "pie")
    with pytest.raises(EmptyDatasetError):
        diagnose(people.limit(0), "summary")
    with pytest.raises(EmptyDatasetError):
        diagnose(people.select("name"), "outliers")


@pytest.mark.parametrize("order", [None, "n"])
def test_id_columns_by_the_first_filled_cells_of_one_scan(spark, order):
    rows = [(k, None if k < 40 else f"v{k}", f"w{k % 80}", "x" if k != 7 else "0a1b2c3d-0000-1111-2222-0a1b2c3d4e5f", None, str(k % 95)) for k in range(400)]
    df = spark.createDataFrame(rows, "n bigint, late string, some string, tag string, none string, most string").repartitionByRange(5, "n").sortWithinPartitions("n")
    got = {r.column: r.reason for r in inference.id_columns(df, order=order).collect()}
    assert got == {"n": "content", "late": "content", "tag": "content", "most": "content"}  # 80 of 100 differ in some, 95 in most
    plan = inference.first_filled(df, df.columns, order, 100)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    back = df.repartition(3).select("n", "late")
    assert [r.at for r in inference.first_filled(back, ["late"], "n", 3).orderBy("at").collect()] == [40, 41, 42]


def test_places_hold_or_are_held_by_names(spark):
    rng = random.Random(2)
    names = [*COUNTRIES, *COUNTRY_ALIASES]
    texts = [None, "", "x", "test", *names[:40]]
    for c in rng.choices(names, k=300):
        i, j = sorted(rng.sample(range(len(c) + 1), 2)) if len(c) > 1 else (0, 1)
        texts += [c[i:j].upper(), " " + c + "x" * rng.randint(0, 2 * len(c)), "é" * rng.randint(0, 4) + c[i:j] + "!"]
    texts += ["france and germany and spain and italy", "a" * 5000]

    def verdict(text):
        low = text.lower().strip()
        if low in names:
            return "ok"
        if low in NOT_COUNTRIES or len(low) < 2:
            return "obvious"
        return "ok" if any((c in low or low in c) and 2 * len(c) >= len(low) and len(c) <= 2 * len(low) for c in names) else "unknown"

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", categorical.country_verdict(F.col("t")).alias("v")).collect()
    assert all(r.v == verdict(r.t) for r in got if r.t is not None) and {r.v for r in got if r.t} == {"ok", "obvious", "unknown"}


def test_bytes_of_columns(spark):
    rows = [(1, "é", b"abc", 1.5, [1, 2], True), (None, "", None, None, None, None), (3, None, b"", 2.0, [], False)]
    df = spark.createDataFrame(rows, "`a.b` int, name string, raw binary, bytes double, list array<int>, flag boolean").withColumn("d", F.lit("1.5").cast("decimal(20,2)")).withColumn("void", F.lit(None))
    got = {r.name: r.bytes for r in numeric.structure_size(df).collect()}
    assert got == {"a.b": 8, "name": 2, "raw": 3, "bytes": 16, "list": len("[1,2]") + len("[]"), "flag": 2, "d": 48, "void": 0}
    assert {r.bytes for r in numeric.structure_size(df.filter("false")).collect()} == {0}
