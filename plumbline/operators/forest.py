"""Isolation forest over many features: a tree for each of many small samples, all rows scored against all trees at once."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.schema import quoted

#: Rows drawn for each that a tree takes, so that every tree gets its number.
DRAWN = 1.5
#: Row and tree pairs that are scored at once.
CELLS = 1 << 21


def mean_path(n: float) -> float:
    """Mean depth of an unsuccessful search among n values."""
    return 0.0 if n <= 1 else 1.0 if n <= 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def grow(x: np.ndarray, depth: int, rng: np.random.Generator) -> tuple[list[int], list[float], list[int], list[float]]:
    """A tree over the rows of x as flat arrays: the feature that a node asks (-1: a leaf), the value (up to it: left), the left
    child (the right one follows it) and, of a leaf, the path length. A node splits one of the features that vary in it."""
    feature, value, left, path = [-1], [0.0], [-1], [0.0]
    stack = [(0, np.arange(len(x)), 0)]
    while stack:
        node, rows, level = stack.pop()
        lo, hi = x[rows].min(0), x[rows].max(0)
        varying = np.flatnonzero(lo < hi)
        if level >= depth or not len(varying):
            path[node] = level + mean_path(len(rows))
            continue
        f = int(rng.choice(varying))
        at = min(float(rng.uniform(lo[f], hi[f])), float(np.nextafter(hi[f], -math.inf)))  # neither side is empty
        low = x[rows, f] <= at
        feature[node], value[node], left[node] = f, at, len(feature)
        for _ in range(2):
            feature.append(-1)
            value.append(0.0)
            left.append(-1)
            path.append(0.0)
        stack += [(left[node], rows[low], level + 1), (left[node] + 1, rows[~low], level + 1)]
    return feature, value, left, path


@dataclass
class IsolationForest:
    """Trees as rows of flat arrays, and the rows that each was grown from."""

    features: list[str]
    tree_size: int
    feature: np.ndarray
    value: np.ndarray
    left: np.ndarray
    path: np.ndarray

    @staticmethod
    def samples(df: DataFrame, features: list[str], id_col: str, *, trees: int = 100, tree_size: int = 256, seed: int = 42) -> DataFrame:
        """tree, place, x: the sample of each tree. Of a large table one pass keeps a seeded draw of about DRAWN * trees * tree_size rows, each for
        one tree; of a table of no more rows than that, each tree draws from all."""
        whole = F.lit(True)
        for c in features:
            whole = whole & (F.abs(quoted(c).cast("double")) < float("inf"))
        rows = df.filter(whole).select(F.col(id_col).alias("id"), F.array(*[quoted(c).cast("double") for c in features]).alias("x"))
        n, pool = rows.count(), int(DRAWN * trees * tree_size)
        if n > pool:
            order = F.xxhash64("id", "x", F.lit(seed))
            rows = rows.withColumn("at", order).filter(F.pmod("at", F.lit(1 << 40)) < F.lit(int(pool / n * (1 << 40))))
            rows = rows.withColumn("tree", F.pmod(F.xxhash64("at", F.lit(seed + 1)), F.lit(trees)).cast("int"))
        else:
            rows = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("at", F.xxhash64("id", "x", "tree", F.lit(seed)))
        place = F.row_number().over(Window.partitionBy("tree").orderBy("at", "id", "x")) - 1  # no more than the pool's rows
        return rows.withColumn("place", place).filter(F.col("place") < tree_size).select("tree", "place", "x")

    @classmethod
    def fit(cls, df: DataFrame, features: list[str], id_col: str, *, trees: int = 100, tree_size: int = 256, seed: int = 42) -> IsolationForest:
        """The forest of ``df``; rows without all features (null, NaN, infinite) don't count. Trees are grown where their samples
        are; the driver holds trees * 2 * tree_size nodes."""

        def build(rows: pa.Table) -> pa.Table:
            rows = rows.sort_by("place")
            x = rows["x"].combine_chunks().flatten().to_numpy().reshape(len(rows), -1)
            tree = rows["tree"][0].as_py()
            made = grow(x, math.ceil(math.log2(max(2, len(x)))), np.random.default_rng([seed, tree]))
            return pa.table([pa.array([tree], pa.int32()), *[pa.array([c], pa.list_(k)) for c, k in zip(made, (pa.int32(), pa.float64(), pa.int32(), pa.float64()), strict=True)], pa.array([len(x)], pa.int32())], ["tree", "feature", "value", "left", "path", "n"])

        drawn = cls.samples(df, features, id_col, trees=trees, tree_size=tree_size, seed=seed)
        rows = drawn.groupBy("tree").applyInArrow(build, "tree int, feature array<int>, value array<double>, left array<int>, path array<double>, n int").orderBy("tree").collect()
        return cls._of(features, rows)

    @classmethod
    def _of(cls, features: list[str], rows: list) -> IsolationForest:
        width = max((len(r.feature) for r in rows), default=1)
        wide = lambda name, empty, kind: np.array([[*r[name], *[empty] * (width - len(r[name]))] for r in rows], kind).reshape(len(rows), width)
        return cls(features, max((r.n for r in rows), default=0), wide("feature", -1, np.int64), wide("value", 0.0, float), wide("left", -1, np.int64), wide("path", 0.0, float))

    def path_lengths(self, x: np.ndarray) -> np.ndarray:
        """The mean path length of each row: all rows go down all trees together."""
        trees = np.arange(len(self.feature))[None, :]
        out = np.empty(len(x))
        step = max(1, CELLS // max(len(self.feature), 1))
        for lo in range(0, len(x), step):
            part = x[lo : lo + step]
            node = np.zeros((len(part), len(self.feature)), np.int64)
            while True:
                asked = self.feature[trees, node]
                inner = asked >= 0
                if not inner.any():
                    break
                high = np.take_along_axis(part, np.where(inner, asked, 0), 1) > self.value[trees, node]
                node = np.where(inner, self.left[trees, node] + high, node)
            out[lo : lo + step] = self.path[trees, node].mean(1)
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        """From 0 to 1, the more the further off; 0.5 for all where the trees are of one row."""
        if not len(self.feature) or self.tree_size < 2:
            return np.full(len(x), 0.5)
        return 2 ** (-self.path_lengths(x) / mean_path(self.tree_size))

    def scored(self, df: DataFrame, id_col: str, keep: list[str] = ()) -> DataFrame:
        """id_col, columns ``keep``, and anomaly for each row; null without all features."""

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = np.stack([batch[f"f{k}"].to_numpy(zero_copy_only=False).astype(float) for k in range(len(self.features))], 1)
                lost = ~np.isfinite(x).all(1)
                anomaly = pa.array(self.scores(np.where(np.isfinite(x), x, 0.0)), mask=lost)
                yield pa.RecordBatch.from_arrays([batch["id"], *[batch[f"k{k}"] for k in range(len(keep))], anomaly], [*names, "anomaly"])

        names, kinds = ["id", *[f"k{k}" for k in range(len(keep))]], dict(df.dtypes)
        held = [quoted(c).alias(n) for c, n in zip([id_col, *keep], names, strict=True)]
        cells = [quoted(c).cast("double").alias(f"f{k}") for k, c in enumerate(self.features)]
        schema = ", ".join(f"{n} {kinds[c]}" for c, n in zip([id_col, *keep], names, strict=True))
        return df.select(*held, *cells).mapInArrow(score, f"{schema}, anomaly double").toDF(id_col, *keep, "anomaly")

    def save(self, spark: SparkSession, folder: str) -> None:
        rows = [(k, f.tolist(), v.tolist(), c.tolist(), p.tolist(), self.tree_size) for k, (f, v, c, p) in enumerate(zip(self.feature, self.value, self.left, self.path, strict=True))]
        spark.createDataFrame(rows, "tree int, feature array<int>, value array<double>, left array<int>, path array<double>, n int").write.mode("overwrite").parquet(f"{folder}/forest")

    @classmethod
    def load(cls, spark: SparkSession, folder: str, features: list[str]) -> IsolationForest:
        return cls._of(features, spark.read.parquet(f"{folder}/forest").orderBy("tree").collect())
