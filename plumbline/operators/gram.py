"""Moments of all pairs of numeric columns in one pass: masked Gram matrices of batches, merged tile by tile.

A batch of rows becomes a matrix X with a mask M of its filled cells. Over the rows that have both of a pair, the products
M'M, X'M, (X*X)'M and X'X give the counts, means and centred second moments of all pairs at once, whatever cells are missing. A task
merges its batches and hands on tiles (``TILE`` columns by ``TILE`` columns); tiles are merged in sorted streams, first in
``SALTS`` parts and then whole, so no task holds more than two of a kind.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.schema import batches_of, quoted, stored

TILE, SALTS = 128, 32
#: Cells of a batch that are multiplied at once, and tiles that a worker gets at once.
CELLS, TILES_AT_ONCE = 1 << 22, 4


@dataclass
class Moments:
    """Of pairs (rows a, columns b): how many rows have both, the means of a and of b over them, the centred sums of squares
    and products, and how many of these rows hold an infinite value."""

    n: np.ndarray
    mean_a: np.ndarray
    mean_b: np.ndarray
    aa: np.ndarray
    bb: np.ndarray
    ab: np.ndarray
    endless: np.ndarray

    def merged(self, other: Moments) -> Moments:
        n = self.n + other.n
        some = np.maximum(n, 1)
        da, db, weight = other.mean_a - self.mean_a, other.mean_b - self.mean_b, self.n * other.n / some
        share = other.n / some
        first = self.n == 0  # its means say nothing
        mean = lambda mine, theirs, d: np.where(first, theirs, mine + d * share)
        return Moments(n, mean(self.mean_a, other.mean_a, da), mean(self.mean_b, other.mean_b, db), self.aa + other.aa + da * da * weight, self.bb + other.bb + db * db * weight, self.ab + other.ab + da * db * weight, self.endless + other.endless)

    def correlation(self) -> np.ndarray:
        """NaN where a column doesn't vary over the pair's rows, or one holds an infinite value."""
        still = lambda ss, mean: ss <= self.n * (1e-13 * mean) ** 2
        lost = still(self.aa, self.mean_a) | still(self.bb, self.mean_b) | (self.endless > 0) | (self.n < 1)
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(lost, np.nan, np.clip(self.ab / (np.sqrt(self.aa) * np.sqrt(self.bb)), -1.0, 1.0))

    def tile(self, a: slice, b: slice) -> Moments:
        return Moments(*[getattr(self, f)[a, b] for f in self.__dataclass_fields__])


def moments(x: np.ndarray) -> Moments:
    """Of all pairs of columns of x; NaN is missing. Columns are shifted by the value nearest to their mean, so that one
    that doesn't vary has sums of exactly 0."""
    filled, endless = ~np.isnan(x), np.isinf(x)
    real = np.where(filled & ~endless, x, 0.0)
    counted = np.maximum((filled & ~endless).sum(0), 1)
    mean = real.sum(0) / counted
    away = np.where(filled & ~endless, np.abs(x - mean), np.inf)
    shift = np.where(np.isfinite(away).any(0), real[np.argmin(away, 0), np.arange(x.shape[1])], 0.0) if len(x) else mean
    y, m = np.where(filled & ~endless, x - shift, 0.0), filled.astype(float)
    n = m.T @ m
    some = np.maximum(n, 1)
    sums, squares = y.T @ m, (y * y).T @ m
    aa = squares - sums * sums / some
    aa = np.where(aa <= 1e-13 * squares, 0.0, aa)
    ab = y.T @ y - sums * sums.T / some
    mean_a = shift[:, None] + sums / some
    bad = endless.astype(float).T @ m if endless.any() else np.zeros_like(n)
    return Moments(n, mean_a, mean_a.T, aa, aa.T, ab, bad + bad.T)


_FIELDS = list(Moments.__dataclass_fields__)
_TILE = "part int, a int, b int, salt int, task int, " + ", ".join(f"{f} array<double>" for f in _FIELDS)


def _row(key: list[int], tile: Moments) -> pa.RecordBatch:
    columns = [pa.array([k], pa.int32()) for k in key] + [pa.array([np.ascontiguousarray(getattr(tile, f)).reshape(-1)], pa.list_(pa.float64())) for f in _FIELDS]
    return pa.RecordBatch.from_arrays(columns, ["part", "a", "b", "salt", "task", *_FIELDS])


def _of_rows(widths: list[int]):
    """Tiles of the parts, which stand side by side in the rows, ``widths`` columns each."""

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held = TaskContext.get().partitionId(), None
        step = max(1, CELLS // max(sum(widths), 1))
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.slice(lo, step).columns], 1)
                ends = np.cumsum([0, *widths])
                made = [moments(x[:, s:e]) for s, e in zip(ends, ends[1:], strict=False)]
                held = made if held is None else [m.merged(o) for m, o in zip(held, made, strict=True)]
        for part, whole in enumerate(held or []):
            for a in range(0, widths[part], TILE):
                for b in range(a, widths[part], TILE):
                    yield _row([part, a, b, task % SALTS, task], whole.tile(slice(a, a + TILE), slice(b, b + TILE)))

    return tiles


def _merged(widths: list[int], keyed: int):
    """One tile for each run of rows with the same first ``keyed`` of part, a, b and salt."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for batch in batches:
            keys = list(zip(*(batch[c].to_pylist() for c in ("part", "a", "b", "salt", "task")), strict=True))
            for k, key in enumerate(keys):
                shape = (min(TILE, widths[key[0]] - key[1]), min(TILE, widths[key[0]] - key[2]))
                tile = Moments(*[batch[f][k].values.to_numpy().reshape(shape) for f in _FIELDS])
                if held is not None and key[:keyed] == now[:keyed]:
                    held = held.merged(tile)
                    continue
                if held is not None:
                    yield _row(list(now), held)
                now, held = key, tile
        if held is not None:
            yield _row(list(now), held)

    return merge


def correlations_of(df: DataFrame, parts: list[list[str]]) -> DataFrame:
    """part (place in ``parts``), a, b (places of columns in it, a before b), correlation (NULL where one doesn't vary over the rows that have
    both) of each pair of columns of a part; all parts in one pass over the rows. A table without rows gives none."""
    widths = [len(p) for p in parts]
    spark = df.sparkSession
    cells = [quoted(c).cast("double").alias(f"c{k}") for k, c in enumerate(c for p in parts for c in p)]

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in _merged(widths, 3)(batches):
            part, a, b = (tile[c][0].as_py() for c in ("part", "a", "b"))
            shape = (min(TILE, widths[part] - a), min(TILE, widths[part] - b))
            found = Moments(*[tile[f][0].values.to_numpy().reshape(shape) for f in _FIELDS]).correlation()
            i, j = np.nonzero(np.arange(shape[0])[:, None] + a < np.arange(shape[1])[None, :] + b)
            values = found[i, j]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), part, np.int32)), pa.array((i + a).astype(np.int32)), pa.array((j + b).astype(np.int32)), pa.array(values, mask=np.isnan(values))], ["part", "a", "b", "correlation"])

    made = stored(df.select(*cells).mapInArrow(_of_rows(widths), _TILE))
    with batches_of(spark, TILES_AT_ONCE):
        order = ["part", "a", "b", "salt"]
        made = stored(made.repartition(*order).sortWithinPartitions(*order, "task").mapInArrow(_merged(widths, 4), _TILE))
        return stored(made.repartition(*order[:3]).sortWithinPartitions(*order).mapInArrow(pairs, "part int, a int, b int, correlation double"))
