"""Operators that avoid a task for a whole column, held against plain computations."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import categorical, clustering, duplicates
from plumbline.operators.duplicates import indel_similarity
from plumbline.operators.frequency import frequencies
from plumbline.operators.quantiles import exact_quantiles
from plumbline.plans.reports import diagnose, full_analysis
from plumbline.sources.catalog import Catalog
from plumbline.sources.readers import read_dataset, read_jdbc


@pytest.mark.parametrize(("accuracy", "most_rows"), [(10_000, 100_000), (50, 20), (200, 1)])
def test_exact_quantiles(spark, accuracy, most_rows):
    rng = np.random.default_rng(4)
    columns = {
        "even": rng.normal(size=4000), "few": rng.integers(0, 3, 4000).astype(float), "skew": np.where(rng.random(4000) < 0.7, 5.0, rng.exponential(size=4000) * 100),
        "one": np.full(4000, 2.5), "holes": np.where(rng.random(4000) < 0.3, np.nan, rng.normal(size=4000)),
    }
    rows = [tuple(None if i % 97 == 0 else float(v) for v in r) + (None,) for i, r in enumerate(zip(*columns.values(), strict=True))]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in [*columns, "nothing"]))
    probabilities = [0.0, 0.25, 0.5, 0.9, 0.99, 1.0]
    got = exact_quantiles(df, [*columns, "nothing"], probabilities, accuracy=accuracy, most_rows=most_rows)
    for c, values in columns.items():
        x = np.array([v for i, v in enumerate(values) if i % 97 and not np.isnan(v)])
        for p in probabilities:
            assert got[c, p] == pytest.approx(np.quantile(x, p), abs=1e-12)
    assert got["nothing", 0.5] is None and set(exact_quantiles(df.limit(0), ["even"], [0.5]).values()) == {None}
    assert exact_quantiles(df.filter("even is not null").limit(1), ["one"], [0.25, 1.0]) == {("one", 0.25): 2.5, ("one", 1.0): 2.5}


def _dbscan(x: np.ndarray, eps: float, least: int) -> np.ndarray:
    near = ((x[:, None] - x[None]) ** 2).sum(2) <= eps * eps
    core = near.sum(1) >= least
    root = np.arange(len(x))
    linked = near & core[:, None] & core[None]
    while True:
        now = np.where(linked, root[None], len(x)).min(1)
        now = np.where(core, np.minimum(root, now), root)
        if (now == root).all():
            break
        root = now
    label = {r: k for k, r in enumerate(sorted(set(root[core])))}
    out = np.full(len(x), -1)
    for i in range(len(x)):
        if core[i]:
            out[i] = label[root[i]]
        elif (near[i] & core).any():
            d2 = ((x[i] - x) ** 2).sum(1)
            out[i] = label[min((d2[j], root[j]) for j in np.flatnonzero(near[i] & core))[1]]
    return out


@pytest.mark.parametrize("dims", [1, 2, 3, 5])
def test_dbscan_of_dense_and_sparse_cells(spark, dims):
    rng = np.random.default_rng(dims)
    blobs = [rng.normal(size=(n, dims)) * s + rng.uniform(-4, 4, dims) for n, s in ((150, 0.05), (120, 0.4), (40, 0.2))]
    chain = np.stack([np.arange(40) * 0.24] + [np.full(40, 9.0)] * (dims - 1), 1)
    x = np.concatenate([*blobs, chain, rng.uniform(-6, 6, (60, dims)), np.repeat(rng.uniform(-6, 6, (1, dims)), 7, 0)])
    names = [f"x{k}" for k in range(dims)]
    rows = [(i, *map(float, r)) for i, r in enumerate(x)] + [(9000, *[None] * dims), (9001, *[float("inf")] * dims), (9002, *[float("nan")] * dims)]
    df = spark.createDataFrame(rows, "id bigint, " + ", ".join(f"{n} double" for n in names))
    got = {r.id: r.label for r in clustering.dbscan(df, names, id_col="id", eps=0.5, min_samples=5).collect()}
    assert [got[i] for i in range(len(x))] == _dbscan(x, 0.5, 5).tolist()
    assert [got[i] for i in (9000, 9001, 9002)] == [-1, -1, -1]


def test_dbscan_of_nothing(spark):
    assert clustering.dbscan(spark.createDataFrame([], "id bigint, v double"), ["v"], id_col="id", eps=1.0, min_samples=2).count() == 0


def test_run_is_saved_and_scores_new_rows(spark, tmp_path):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(i, float(a), float(2 * a + e), float(e)) for i, (a, e) in enumerate(rng.normal(size=(80, 2)))], "id bigint, a double, b double, c double")
    fitted = clustering.Reconstruction.fit(df, ["a", "b", "c"])
    rows, record = clustering.outlier_pipeline(df, id_col="id", features=["a", "b", "c"], min_samples=3, fitted=fitted)
    clustering.save_run(rows, record, tmp_path.as_uri())
    told = clustering.load_run(spark, tmp_path.as_uri())
    again = told["fitted"]
    assert told["num_points"] == 80 and again.features == ["a", "b", "c"]
    same, _ = clustering.outlier_pipeline(df, id_col="id", features=["a", "b", "c"], min_samples=3, fitted=again, forest=told["forest"])
    for x, y in zip(sorted(map(tuple, same.collect())), sorted(map(tuple, rows.collect())), strict=True):
        assert x == pytest.approx(y)
    new = spark.createDataFrame([(1000, 0.5, 1.0, 0.0), (1001, 0.5, -9.0, 9.0), (1002, None, 1.0, 1.0)], df.schema)
    one, two = ({r.id: r.reconstruction_error for r in f.errors(new, "id").collect()} for f in (fitted, again))
    assert one == pytest.approx(two) and set(one) == {1000, 1001} and one[1001] > one[1000]


def test_smart_profile_counts_near_rows(spark):
    rows = [("Anna Bell-Smith", "12 Long Street"), ("anna bell smith", "12 long street"), ("Anna Bell-Smyth", "12 Long Street"), ("Carl Other", "7 Road"), ("Carl Other", "7 Road"), ("Zed", None), ("Dora Lane", "3 Hill"), ("Dora Lane", "3 Hall"), ("Eve", "x"), ("Hal", "y"), ("Ida", "w")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id bigint, name string, street string")
    norm = [tuple((v or "NULL").lower().replace("-", "") for v in r) for r in rows]
    first = {n: i for i, n in reversed(list(enumerate(norm)))}
    text = {i: "{'name': '%s', 'street': '%s'}" % n for n, i in first.items()}  # noqa: UP031
    near = [(a, b) for a in text for b in text if a < b and indel_similarity(text[a], text[b]) >= 0.9]
    exact = len(rows) - len(first)
    profiles = {r.profile: r for r in duplicates.duplicate_profiles(df).collect()}
    assert near and (profiles["smart"].duplicate_count, profiles["smart"].near_duplicate_count) == (exact + len(near), len(near))
    assert profiles["smart"].duplicate_pct == round((exact + len(near)) / len(rows) * 100, 2) and profiles["standard"].near_duplicate_count == 0
    assert duplicates.duplicate_profiles(df, near_up_to=3).filter("profile = 'smart'").first().near_duplicate_count is None  # not looked for
    examples = [r for r in full_analysis(df, "id")["duplicate_examples"].collect() if r.type == "near"]
    assert sorted((r.original_index, r.duplicate_index) for r in examples) == sorted(near)[:5] and all(r.similarity < 1 for r in examples)
    assert diagnose(df, "duplicates")["profiles"].filter("profile = 'smart'").first().near_duplicate_count == len(near)


def test_lists_are_bounded_and_counted(spark):
    freq = frequencies(spark.createDataFrame([(f"Value {i:04d}",) for i in range(500)], "status string"))
    upload = categorical.upload_consistency(freq).first()
    assert len(upload.inconsistent_format) == 100 and upload.inconsistent_count == 500 and upload.rare_values == [f"Value {i:04d}" for i in range(10)]
    group = categorical.standard_groups(freq, listed=7).first()
    assert len(group.found_variations) == 7 and group.n_variations > 7
    assert len(categorical.variation_examples(freq, "case").collect()) == 5


def test_a_rewrite_that_fails_leaves_the_table(spark, tmp_path):
    catalog = Catalog(spark, tmp_path.as_uri())
    schema = catalog.table("users").schema
    users = spark.createDataFrame([(i, f"u{i}@b.org", "A", "B", "x", "user", None, None, True, None, None) for i in range(5)], schema)
    catalog.append("users", users)
    catalog.append("users", spark.createDataFrame([(7, "u7@b.org", "A", "B", "x", "user", None, None, True, None, None)], schema))
    before = sorted(r.email for r in catalog.table("users").collect())
    with pytest.raises(Exception, match="stop"):
        catalog._rewrite("users", catalog.table("users").withColumn("role", F.when(F.col("id") == 7, F.raise_error(F.lit("stop"))).otherwise(F.col("role"))))
    assert sorted(r.email for r in catalog.table("users").collect()) == before
    old = catalog.table("users")
    assert catalog.update("users", F.col("id") == 3, {"role": "admin"}) == 1 and catalog.delete("users", F.col("id") == 4) == 1
    assert {r.id: r.role for r in catalog.table("users").collect()} == {0: "user", 1: "user", 2: "user", 3: "admin", 7: "user"}
    assert catalog.update("users", F.col("id") == 99, {"role": "x"}) == 0 and old.columns == schema.fieldNames()


def test_delimited_files_are_split_unless_records_span_lines(spark, tmp_path):
    (tmp_path / "big.csv").write_text("id,text\n" + "".join(f'{i},"a ""quoted"" cell {i}"\n' for i in range(40_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 200_000)
    try:
        df = read_dataset(spark, str(tmp_path / "big.csv"))
        assert df.rdd.getNumPartitions() > 3 and df.count() == 40_000 and df.filter("id = 7").first().text == 'a "quoted" cell 7'
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "lines.csv").write_text('id,text\n1,"two\nlines"\n2,one\n')
    assert [r.text for r in read_dataset(spark, str(tmp_path / "lines.csv")).orderBy("id").collect()] == ["two\nlines", "one"]


def test_json_lines_and_documents(spark, tmp_path):
    (tmp_path / "lines.json").write_text('\n{"id": 1, "t": "a"}\n{"id": 2}\n')
    (tmp_path / "array.json").write_text('[\n {"id": 1, "t": "a"},\n {"id": 2}\n]\n')
    (tmp_path / "one.json").write_text('{\n "id": 5\n}\n')
    for name in ("lines", "array"):
        assert sorted((r.id, r.t) for r in read_dataset(spark, str(tmp_path / f"{name}.json")).collect()) == [(1, "a"), (2, None)]
    assert [r.id for r in read_dataset(spark, str(tmp_path / "one.json")).collect()] == [5]


def test_jdbc(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    spark.range(100).selectExpr("id", "concat('n', id) AS name").write.format("jdbc").options(url=url, dbtable="people", **driver).save()
    df = read_jdbc(spark, url, "people", partitionColumn="id", lowerBound="0", upperBound="100", numPartitions="4", **driver)
    assert df.rdd.getNumPartitions() == 4 and df.filter("id >= 50").count() == 50
