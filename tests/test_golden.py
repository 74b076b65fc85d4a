"""Small tables with known defects and independently computed figures."""

from __future__ import annotations

import json

import pytest

from plumbline.functions.schema import feature_columns
from plumbline.operators import clustering, duplicates, missing, numeric, outliers, sampling
from plumbline.plans.reports import as_json, diagnose

PEOPLE = [
    (1, "Alice", 28.0, "Female", "Paris", 35000.0), (2, "Bob", 35.0, "Male", "Lyon", 40000.0), (3, "Charlie", None, "Male", "Marseille", 38000.0),
    (4, "David", 45.0, None, "Lyon", 42000.0), (5, "Eva", 29.0, "Female", None, 39000.0), (6, "Frank", 33.0, "Male", "Bordeaux", None),
    (7, "Alice", 28.0, "Female", "Paris", 35000.0), (8, "Grace", 41.0, "Female", "Nice", 47000.0), (9, "Hugo", 38.0, "Male", "Paris", 45000.0), (10, "Ivy", 32.0, "Female", "Lyon", 41000.0),
]
FEATURES = [
    (1.0, 2.1, 3.0), (1.1, 2.0, 3.1), (0.9, 2.2, 2.9), (1.2, 1.9, 3.2), (0.8, 2.3, 2.8), (10.0, 15.0, 12.0), (1.0, 2.1, 3.1), (0.9, 2.0, 2.9),
    (1.1, 2.2, 3.0), (-5.0, -8.0, 20.0), (1.2, 1.8, 3.3), (1.0, 2.0, 3.0), (0.95, 2.05, 2.95), (1.05, 1.95, 3.05), (1.15, 2.15, 3.15),
]


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(PEOPLE, "id int, name string, age double, gender string, city string, salary double")


@pytest.fixture(scope="module")
def features(spark):
    return spark.createDataFrame([(k + 1, *r) for k, r in enumerate(FEATURES)], "id_col int, feature1 double, feature2 double, feature3 double")


def test_people(people):
    totals = missing.missing_basic_totals(people).first()
    assert totals.total_missing == 4 and totals.missing_pct == pytest.approx(6.6667, abs=1e-4)
    assert duplicates.exact_duplicates(people).first().duplicate_count == 0
    assert duplicates.exact_duplicates(people.drop("id")).first().duplicate_count == 1


def test_features(features):
    got = {r.column: r for r in numeric.describe(features, ["feature1", "feature2", "feature3"]).collect()}
    assert [(round(got[c].q25, 3), round(got[c].q50, 3), round(got[c].q75, 3)) for c in sorted(got)] == [(0.925, 1.0, 1.125), (1.975, 2.05, 2.175), (2.975, 3.05, 3.175)]
    columns = [c for c in feature_columns(features) if c != "id_col"]
    for factor in (1.5, 3.0):
        assert {r.outlier_count for r in outliers.iqr_outliers(features, columns, factor).collect()} == {2}
    assert {r.outlier_count for r in outliers.zscore_outliers(features, columns).collect()} == {1}
    assert missing.missing_basic(features).count() == 0


def test_run_artifacts(features, spark, tmp_path):
    rows, record = clustering.outlier_pipeline(features, id_col="id_col", features=["feature1", "feature2", "feature3"], min_samples=3)
    assert {r.original_index for r in rows.filter("is_outlier").collect()} == {6, 10}  # the seeded ones
    clustering.save_run(rows, record, tmp_path.as_uri())
    assert spark.read.parquet(f"{tmp_path.as_uri()}/cluster_labels.parquet").count() == 15
    assert json.loads(spark.read.text(f"{tmp_path.as_uri()}/run_summary").first()[0])["num_points"] == 15


def test_samples_repeat(people):
    one, two = ({r.id for r in sampling.sample_rows(people, 4, "id").collect()} for _ in range(2))
    assert one == two and len(one) == 4 and sampling.sample_rows(people, 99).count() == 10
    assert sampling.sample_fraction(people, 0.1, at_least=100).count() == 10


def test_report_as_json(people):
    rows = as_json(diagnose(people, "summary")).collect()
    assert {r.part for r in rows} == {"dataset", "numeric", "categorical"} and all(json.loads(r.row) for r in rows)
