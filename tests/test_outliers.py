from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import clustering, dbscan, forest, numeric, outliers
from plumbline.plans import catalogue


@pytest.fixture(scope="module")
def features(spark):
    # rows 5 and 9 lie far from the others in every feature
    a = [1.0, 1.1, 0.9, 1.2, 0.95, 10.0, 1.05, 0.85, 1.15, -5.0, 1.0, 0.9, 1.1, 0.95, 1.05]
    rows = [(k, v, 2 * v, 3 * v) for k, v in enumerate(a)]
    return spark.createDataFrame(rows, "id_col bigint, feature1 double, feature2 double, feature3 double")


COLUMNS = ["feature1", "feature2", "feature3"]


def test_fences_find_both_rows(features):
    for factor in (1.5, 3.0):
        got = {r.column: r.outlier_count for r in outliers.iqr_outliers(features, COLUMNS, factor).collect()}
        assert got == {c: 2 for c in COLUMNS}
    assert {r.outlier_count for r in outliers.zscore_outliers(features, COLUMNS).collect()} == {1}
    union = {r.column: r for r in outliers.combined_outliers(features, COLUMNS, isolation=True).collect()}
    assert all(r.outlier_count >= 2 and 10.0 in [v / k for v in r["values"]] for k, r in zip((1, 2, 3), (union[c] for c in COLUMNS), strict=True))


def test_constant_and_short_columns(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, None), (1.0, None), (1.0, 2.0), (1.0, None)], "a double, b double")
    assert [(r.column, r.outlier_count) for r in outliers.iqr_outliers(df, ["a", "b"]).collect()] == [("a", 0)]
    assert [(r.column, r.outlier_count) for r in outliers.zscore_outliers(df, ["a", "b"]).collect()] == [("a", 0)]


def test_winsorised_values_stay_inside(features):
    q = {r.column: r for r in numeric.describe(features, COLUMNS).collect()}
    clipped = numeric.winsorised(features, COLUMNS, 3.0).collect()
    for c in COLUMNS:
        width = q[c].q75 - q[c].q25
        assert all(q[c].q25 - 3 * width - 1e-9 <= r[c] <= q[c].q75 + 3 * width + 1e-9 for r in clipped)


def test_forest_is_deterministic_and_flags_extremes(spark):
    values = [float(v) for v in np.random.default_rng(1).normal(size=500)] + [50.0, -40.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    one, two = (sorted((r.value, r.score, r.is_outlier) for r in outliers.isolation_outliers(df, "v").collect()) for _ in range(2))
    assert one == two
    flagged = {v for v, _, o in one if o}
    assert {50.0, -40.0} <= flagged and len(flagged) <= 0.05 * len(values)


@pytest.mark.parametrize("rows", [20_000, 200_000])
def test_forest_draws_rows_of_repeated_values(spark, rows):
    # ten values hold most rows, the first a third of them; 5 rows in 1,000 lie far away
    k = F.col("id") % 1000
    df = spark.range(rows).select(F.when(k < 5, 1000.0).when(k < 340, 0.0).otherwise((k % 10).cast("double")).alias("v"))
    values = df.groupBy(F.col("v").alias("value")).agg(F.count("*").alias("cnt"))
    drawn = outliers.drawn_rows(values, rows, 2000, 42)
    assert len(drawn) == 2000 and np.array_equal(drawn, outliers.drawn_rows(values.repartition(3), rows, 2000, 42))
    for r in values.collect():
        share = r.cnt / rows
        assert abs(np.count_nonzero(drawn == r.value) - 2000 * share) <= 5 * np.sqrt(2000 * share) + 1
    assert {r.value for r in outliers.isolation_outliers(df, "v", sample_rows=2000).collect() if r.is_outlier} == {1000.0}


def test_whole_union_against_brute_force(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    x = np.array([r.value for r in events.select("value").collect() if r.value is not None])
    a, b = np.percentile(x, [25, 75])
    iqr, z = (x < a - 1.5 * (b - a)) | (x > b + 1.5 * (b - a)), np.abs((x - x.mean()) / x.std()) > 3
    forest = np.isin(x, [r.value for r in outliers.isolation_outliers(events, "value").collect() if r.is_outlier])
    assert forest.any()
    got = catalogue.QUERIES["outlier_union_forest"](spark, sf_dir).first()
    assert (got.n, got.iqr_count, got.zscore_count, got.forest_count, got.outlier_count) == (len(x), iqr.sum(), z.sum(), forest.sum(), (iqr | z | forest).sum())
    # a value between two groups, which only the forest flags
    parts = spark.range(1001).select(F.when(F.col("id") == 1000, 5.0).otherwise((F.col("id") % 2) * 10 + F.col("id") / 1000).alias("v"))
    only = outliers.combined_outliers(parts, ["v"], isolation=True).first()
    assert (only.iqr_count, only.zscore_count) == (0, 0) and only.forest_count == only.outlier_count > 0 and 5.0 in only["values"]


def _dbscan(x, eps, least):
    near = [np.flatnonzero(((x - p) ** 2).sum(1) <= eps * eps) for p in x]
    core = [len(n) >= least for n in near]
    label = [-1] * len(x)
    for i in range(len(x)):
        if core[i] and label[i] < 0:
            new, stack = max(label) + 1, [i]
            label[i] = new
            while stack:
                for j in near[stack.pop()]:
                    if core[j] and label[j] < 0:
                        label[j] = new
                        stack.append(j)
    return core, label, near


@pytest.mark.parametrize(("dims", "eps", "leaf_sites"), [(2, 0.4, 4096), (2, 0.4, 10), (3, 0.5, 20), (5, 1.2, 20), (10, 2.0, 20)])
def test_dbscan_against_brute_force(spark, dims, eps, leaf_sites):
    rng = np.random.default_rng(dims)
    x = np.concatenate([rng.normal(size=(60, dims)) * 0.3, rng.normal(size=(60, dims)) * 0.3 + 3, rng.uniform(-4, 7, size=(40, dims))])
    chain = np.zeros((80, dims))  # a cluster that runs through many leaves, of points exactly as far apart as the bound in places
    chain[:, 0], chain[:, 1] = np.arange(80) * eps / 4, 9.0
    x = np.round(np.concatenate([x, x[:5], chain]), 2)
    names = [f"x{k}" for k in range(dims)]
    rows = [(i, *map(float, p)) for i, p in enumerate(x)]
    lost = [(1000, *[None] * dims), (1001, *[float("nan")] * dims), (1002, float("inf"), *[0.0] * (dims - 1))]
    df = spark.createDataFrame(rows + lost, "id bigint, " + ", ".join(f"{n} double" for n in names))
    got = {r.id: r.label for r in clustering.dbscan(df, names, id_col="id", eps=eps, min_samples=5, leaf_sites=leaf_sites).collect()}
    assert [got.pop(k) for k in (1000, 1001, 1002)] == [-1, -1, -1] and len(got) == len(x)
    core, label, near = _dbscan(x, eps, 5)
    pairs = {(label[i], got[i]) for i in range(len(x)) if core[i]}
    assert all(a == b for a, b in pairs)  # numbered by their smallest core id
    for i in range(len(x)):
        if not core[i]:
            around = {got[j] for j in near[i] if core[j]}
            assert got[i] in around if around else got[i] == -1


def test_leaves_by_cells_and_by_blocks_agree():
    rng = np.random.default_rng(3)
    x, w = np.concatenate([rng.normal(size=(1500, 2)) * 0.3, rng.uniform(-3, 3, size=(300, 2))]), rng.integers(1, 3, 1800)
    home = x[:, 0] < 0.2
    made = []
    for bound in (0, 10**9):
        before, dbscan.CELL_SITES = dbscan.CELL_SITES, bound
        made.append(dbscan.Leaf(x, w, home, 0.2, 6))
        dbscan.CELL_SITES = before
    cells, blocks = made
    assert np.array_equal(cells.core, blocks.core) and np.array_equal(cells.comp, blocks.comp)
    pairs = lambda found: {(int(a), int(b)) for p, q in found for a, b in zip(p, q, strict=True)}
    assert pairs(cells.near) == pairs(blocks.near)
    assert pairs(cells.links) <= pairs(blocks.links) and {a for a, _ in pairs(cells.links)} == {a for a, _ in pairs(blocks.links)}


def test_tree_sends_points_to_every_leaf_within_reach():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2000, 3))
    tree = dbscan.Tree(x, 50, 0.1)
    row, leaf, home = tree.places(x, 0.1)
    assert sorted(row[home]) == list(range(2000)) and len(set(leaf)) > 10
    at = dict(zip(row[home].tolist(), leaf[home].tolist(), strict=True))
    sent = set(zip(row.tolist(), leaf.tolist(), strict=True))
    near = np.argwhere(dbscan.squares(x, x) <= 0.01)
    assert all((i, at[j]) in sent for i, j in near.tolist())


def test_dbscan_numbers_clusters_by_ids_of_any_type(spark):
    rows = [(f"r{k:02}", float(k // 5 * 10), 1.0) for k in range(15)][::-1] + [("a", 99.0, 1.0)]
    df = spark.createDataFrame(rows, "id string, x double, y double")
    for cast in ("string", "int"):
        got = {r.id: r.label for r in clustering.dbscan(df.filter("id > 'a'").withColumn("id", F.substring("id", 2, 2).cast(cast)), ["x", "y"], id_col="id", eps=1.0, min_samples=5).collect()}
        assert {int(k): v for k, v in got.items()} == {k: k // 5 for k in range(15)}
    assert clustering.dbscan(df, ["x", "y"], id_col="id", eps=1.0, min_samples=5).filter("id = 'a'").first().label == -1


def test_dbscan_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "id bigint, x double, y double")
    assert clustering.dbscan(empty, ["x", "y"], id_col="id", eps=1.0, min_samples=2).count() == 0


def _plain_paths(sample, x, depth, rng):
    """Path lengths of the rows of x in one isolation tree, by splitting sample and rows together."""
    out = np.zeros(len(x))
    feature, value, left, _ = forest.grow(sample, depth, rng)

    def walk(node, inside, rows, level):
        if feature[node] < 0:
            out[rows] = level + forest.mean_path(len(inside))
            return
        f, v = feature[node], value[node]
        assert sample[inside, f].min() <= v < sample[inside, f].max() and level < depth
        walk(left[node], inside[sample[inside, f] <= v], rows[x[rows, f] <= v], level + 1)
        walk(left[node] + 1, inside[sample[inside, f] > v], rows[x[rows, f] > v], level + 1)

    walk(0, np.arange(len(sample)), np.arange(len(x)), 0)
    return out


@pytest.mark.parametrize(("n", "trees", "tree_size"), [(300, 20, 64), (4000, 10, 32)])  # each tree of all rows, and of its own draw
def test_forest_equals_a_plain_one_on_its_samples(spark, n, trees, tree_size):
    rng = np.random.default_rng(7)
    x = np.round(np.concatenate([rng.normal(size=(n - 3, 4)), rng.normal(size=(3, 4)) + 9]), 2)
    x[:, 3] = 1.0  # doesn't vary
    rows = [(i, *map(float, r)) for i, r in enumerate(x)] + [(-1, None, 1.0, 1.0, 1.0), (-2, float("nan"), 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "id bigint, a double, b double, c double, d double")
    columns = ["a", "b", "c", "d"]
    how = {"trees": trees, "tree_size": tree_size, "seed": 3}
    model = forest.IsolationForest.fit(df, columns, "id", **how)
    samples = {}
    for r in forest.IsolationForest.samples(df.repartition(5), columns, "id", **how).orderBy("tree", "place").collect():
        samples.setdefault(r.tree, []).append(r.x)
    assert len(samples) == trees and all(len(s) == tree_size for s in samples.values())
    assert len({tuple(map(tuple, s)) for s in samples.values()}) == trees
    depth = int(np.ceil(np.log2(tree_size)))
    plain = np.mean([_plain_paths(np.array(s), x, depth, np.random.default_rng([3, t])) for t, s in samples.items()], axis=0)
    assert np.allclose(model.path_lengths(x), plain)
    got = {r.id: r.anomaly for r in model.scored(df, "id").collect()}
    assert got.pop(-1) is None and got.pop(-2) is None
    assert np.allclose([got[i] for i in range(n)], 2 ** (-plain / forest.mean_path(tree_size)))
    assert min(got[i] for i in range(n - 3, n)) > np.quantile([got[i] for i in range(n - 3)], 0.99)


def test_forest_of_nothing(spark):
    empty = spark.createDataFrame([], "id bigint, a double")
    model = forest.IsolationForest.fit(empty, ["a"], "id")
    assert model.scored(empty, "id").count() == 0
    assert [r.anomaly for r in model.scored(spark.createDataFrame([(1, 2.0)], empty.schema), "id").collect()] == [0.5]


def test_pipeline_record(features):
    rows, record = clustering.outlier_pipeline(features, id_col="id_col", features=COLUMNS, eps=0.5, min_samples=3)
    found = {r.original_index for r in rows.filter("is_outlier").collect()}
    assert {5, 9} <= found and record["num_points"] == 15 and record["num_features"] == 3 and record["num_outliers"] == len(found)
    assert rows.filter(F.col("final_cluster_label") == -1).filter("if_score <> -1").count() == 0
