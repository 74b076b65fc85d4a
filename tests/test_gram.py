from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from plumbline.operators import gram, numeric


def _plain(x):
    """Correlation of each pair over the rows that have both; None where one doesn't vary or is infinite."""
    out = {}
    for a in range(x.shape[1]):
        for b in range(a + 1, x.shape[1]):
            both = ~np.isnan(x[:, a]) & ~np.isnan(x[:, b])
            p, q = x[both, a], x[both, b]
            ok = len(p) and np.isfinite(p).all() and np.isfinite(q).all() and np.ptp(p) > 0 and np.ptp(q) > 0
            out[a, b] = float(np.corrcoef(p, q)[0, 1]) if ok else None
    return out


def _table(rows, width, seed=5):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(rows, 3))
    x = base @ rng.normal(size=(3, width)) + rng.normal(size=(rows, width)) + rng.uniform(-1e6, 1e6, width)
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 1], x[:, 2] = 7.25, np.nan
    x[3, 4] = np.inf
    x[:, 5] = np.where(np.arange(rows) == 11, x[:, 5], np.nan)  # a single value
    return x


@pytest.mark.parametrize(("rows", "width"), [(400, 9), (300, 150)])  # one tile, and several
def test_correlations_against_brute_force(spark, rows, width):
    x = _table(rows, width)
    df = spark.createDataFrame(pd.DataFrame(x, columns=[f"v {k}" for k in range(width)])).repartition(3)
    got = {(int(r.column1[2:]), int(r.column2[2:])): r.correlation for r in numeric.correlations(df).collect()}
    want = _plain(x)
    assert got.keys() == want.keys()
    for pair, value in want.items():
        assert (got[pair] is None) == (value is None) and (value is None or got[pair] == pytest.approx(value, abs=1e-9)), pair


def test_merging_batches_is_the_whole():
    x = _table(1000, 12)
    whole, merged = gram.moments(x), gram.moments(x[:7])
    for lo in range(7, 1000, 90):
        merged = merged.merged(gram.moments(x[lo : lo + 90]))
    for f in gram._FIELDS:
        a, b = getattr(whole, f), getattr(merged, f)
        some = np.where((whole.n > 0) & (whole.endless == 0), 1, np.nan)
        assert np.allclose(a * some, b * some, rtol=1e-6, atol=1e-6, equal_nan=True), f
    assert np.array_equal(np.isnan(whole.correlation()), np.isnan(merged.correlation()))


def test_comparison_takes_raw_and_clipped_columns_from_one_pass(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 3))
    x[:, 1] += x[:, 0]
    x[7] = [90.0, -90.0, 1.0]
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b", "c"]))
    got = {(r.column1, r.column2): r for r in numeric.correlation_comparison(df).collect()}
    clipped = _plain(np.stack([r for r in numeric.winsorised(df, ["a", "b", "c"]).toPandas().to_numpy().T], 1))
    for k, (a, b) in enumerate([("a", "b"), ("a", "c"), ("b", "c")]):
        raw = np.corrcoef(x[:, "abc".index(a)], x[:, "abc".index(b)])[0, 1]
        assert got[a, b].corr_original == pytest.approx(raw) and got[a, b].corr_filtered == pytest.approx(list(clipped.values())[k])
    assert got["a", "b"].noted and not got["b", "c"].noted
    assert numeric.correlations(df.limit(0)).count() == 0 and numeric.correlation_comparison(df.select("a")).count() == 0
