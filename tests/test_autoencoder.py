from __future__ import annotations

import numpy as np
import pytest

from plumbline.operators import autoencoder, clustering
from plumbline.operators.autoencoder import Autoencoder, loss_and_gradient, shapes

NAMES = ["a", "b", "c"]


def curve(n: int = 1500) -> np.ndarray:
    """Points near a bent line, which one component can't follow."""
    rng = np.random.default_rng(3)
    t = rng.uniform(-2, 2, n)
    return np.stack([t, t * t, np.sin(2 * t)], 1) + rng.normal(0, 0.02, (n, 3))


@pytest.fixture(scope="module")
def bent(spark):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(curve())], "id bigint, a double, b double, c double")


@pytest.fixture(scope="module")
def fitted(bent):
    return Autoencoder.fit(bent, NAMES, 1, rounds=25)


def test_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(0)
    d, k, h = 4, 2, 3
    flat = rng.normal(0, 0.5, sum(int(np.prod(s)) for s in shapes(d, k, h).values()))
    x, weight = rng.normal(size=(20, d)), rng.random(20)
    _, got = loss_and_gradient(flat, k, h, x, weight)
    sides = [[loss_and_gradient(flat + s * e, k, h, x, weight)[0] for s in (1, -1)] for e in np.eye(len(flat)) * 1e-6]
    assert got == pytest.approx([(u - v) / 2e-6 for u, v in sides], abs=1e-6)


def test_first_loss_is_that_of_the_components_and_rounds_lower_it(bent, fitted):
    linear = clustering.Reconstruction.fit(bent, NAMES, 1).errors(bent, "id").agg({"reconstruction_error": "avg"}).first()[0]
    mine = fitted.errors(bent, "id").agg({"reconstruction_error": "avg"}).first()[0]
    assert fitted.losses[0] == pytest.approx(linear, abs=1e-8) and fitted.losses[-1] == pytest.approx(mine, abs=1e-8)
    assert fitted.losses == sorted(fitted.losses, reverse=True) and mine < 0.6 * linear


def test_reruns_agree_whatever_the_partitions_and_blocks(bent, fitted, monkeypatch):
    assert Autoencoder.fit(bent.repartition(5), NAMES, 1, rounds=25).flat == pytest.approx(fitted.flat, abs=1e-4)
    assert not np.allclose(Autoencoder.fit(bent, NAMES, 1, rounds=2, seed=7).flat, fitted.flat)
    monkeypatch.setattr(autoencoder, "BLOCK_CELLS", 300)  # a dozen blocks, whose sums are added up in tasks first
    monkeypatch.setattr(autoencoder, "DIRECT", 4)
    split = Autoencoder.fit(bent, NAMES, 1, rounds=3)
    assert Autoencoder.blocks(bent, NAMES).count() > 4 and split.losses == pytest.approx(fitted.losses[: len(split.losses)], rel=1e-6)


def test_blocks_hold_every_row(spark, monkeypatch):
    monkeypatch.setattr(autoencoder, "BLOCK_CELLS", 20)
    x = np.repeat(curve(40), [30, *[1] * 39], 0)  # a repeated row is one row of a block
    df = spark.createDataFrame([tuple(map(float, r)) for r in x] + [(None, 1.0, 1.0), (1.0, float("nan"), 1.0), (1.0, 1.0, float("inf"))], "a double, b double, c double")
    got = [(tuple(row), w) for r in Autoencoder.blocks(df, NAMES).collect() for row, w in zip(np.frombuffer(r.x).reshape(-1, 3), np.frombuffer(r.weight), strict=True)]
    assert sorted(got) == sorted((tuple(row), 30.0 if i == 0 else 1.0) for i, row in enumerate(curve(40)))


def test_rows_without_a_feature_constant_features_and_odd_names(spark):
    rows = [(float(i % 7), float((i % 7) ** 2), 5.0, i) for i in range(60)]
    df = spark.createDataFrame([*rows, (None, 1.0, 5.0, 90), (float("nan"), 1.0, 5.0, 91), (float("inf"), 1.0, 5.0, 92)], "id double, f0 double, z0 double, error bigint")
    model = Autoencoder.fit(df, ["id", "f0", "z0"], 1, hidden=4, rounds=5)
    got = {r.error: r.reconstruction_error for r in model.errors(df, "error").collect()}
    assert set(got) == set(range(60)) and all(np.isfinite(v) for v in got.values())
    with pytest.raises(ValueError):
        Autoencoder.fit(df.filter("error >= 90"), ["id", "f0", "z0"], 1)


def test_run_with_a_network_is_saved_and_scores_again(spark, bent, fitted, tmp_path):
    rows, record = clustering.outlier_pipeline(bent, id_col="id", features=NAMES, min_samples=3, fitted=fitted)
    clustering.save_run(rows, record, tmp_path.as_uri())
    told = clustering.load_run(spark, tmp_path.as_uri())
    assert isinstance(told["fitted"], Autoencoder) and told["fitted"].losses == fitted.losses
    same, _ = clustering.outlier_pipeline(bent, id_col="id", features=NAMES, min_samples=3, fitted=told["fitted"], forest=told["forest"])
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, rows.collect()))
