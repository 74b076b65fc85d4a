"""A small autoencoder over all rows: partial gradients of blocks of rows, summed over the table, in a bounded number of rounds."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.schema import batches_of, quoted, stored

from .reconstruction import Reconstruction

#: Cells of a block of rows (512 KB), blocks that a Python worker gets at once, and those that a task packs.
BLOCK_CELLS, BLOCKS_AT_ONCE, BLOCKS_A_TASK = 1 << 16, 16, 64
#: Losses and gradients are summed as whole multiples of 1 / UNIT, so the order of tasks doesn't matter; LIMIT of them can't overflow.
UNIT, LIMIT = float(1 << 36), float(1 << 25)
#: Blocks up to which each task's sums come to the driver as they are; more are added up in GROUPS tasks first.
DIRECT, GROUPS = 256, 64
#: Steps tried along a direction: the whole one first, and only where it doesn't do the others, in one pass; and the steps that the next direction
#: is made from.
STEPS, MEMORY = ((1.0,), (0.3, 0.1, 0.01)), 8
#: Names of the weights, in the order in which they are laid out.
WEIGHTS = ("into", "in_hidden", "in_shift", "in_add", "out", "out_hidden", "out_shift", "out_add", "shift")


def shapes(d: int, k: int, h: int) -> dict[str, tuple[int, ...]]:
    """The weights' shapes for d features, k latent ones and h hidden ones on either side."""
    return dict(zip(WEIGHTS, ((d, k), (d, h), (h,), (h, k), (k, d), (k, h), (h,), (h, d), (d,)), strict=True))


def parted(flat: np.ndarray, d: int, k: int, h: int) -> dict[str, np.ndarray]:
    """The weights by name, as views of the flat array."""
    out, at = {}, 0
    for name, shape in shapes(d, k, h).items():
        size = math.prod(shape)
        out[name] = flat[at : at + size].reshape(shape)
        at += size
    return out


def encode(w: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Latent features (a linear part and one over tanh), and the hidden ones."""
    hidden = np.tanh(x @ w["in_hidden"] + w["in_shift"])
    return x @ w["into"] + hidden @ w["in_add"], hidden


def decode(w: dict[str, np.ndarray], z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.tanh(z @ w["out_hidden"] + w["out_shift"])
    return z @ w["out"] + hidden @ w["out_add"] + w["shift"], hidden


def loss_and_gradient(flat: np.ndarray, k: int, h: int, x: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """Sum of the rows' mean squared differences times their weights, and its gradient by all weights of the network."""
    d = x.shape[1]
    w = parted(flat, d, k, h)
    z, h1 = encode(w, x)
    made, h2 = decode(w, z)
    off = made - x
    g = (2.0 / d) * weight[:, None] * off
    to_h2 = (g @ w["out_add"].T) * (1 - h2 * h2)
    to_z = g @ w["out"].T + to_h2 @ w["out_hidden"].T
    to_h1 = (to_z @ w["in_add"].T) * (1 - h1 * h1)
    parts = (x.T @ to_z, x.T @ to_h1, to_h1.sum(0), h1.T @ to_z, z.T @ g, z.T @ to_h2, to_h2.sum(0), h2.T @ g, g.sum(0))
    return float(weight @ (off * off).mean(1)), np.concatenate([p.ravel() for p in parts])


def direction(gradient: np.ndarray, past: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The next quasi-Newton (L-BFGS) direction from the last steps and changes of the gradient; without any, downhill, one unit at most."""
    if not past:
        return -gradient / max(1.0, float(np.linalg.norm(gradient)))
    q, used = gradient.copy(), []
    for s, y in reversed(past):
        a = (s @ q) / (s @ y)
        q -= a * y
        used.append(a)
    s, y = past[-1]
    q *= (s @ y) / (y @ y)
    for (s, y), a in zip(past, reversed(used), strict=True):
        q += s * (a - (y @ q) / (s @ y))
    return -q


@dataclass
class Autoencoder:
    """A fitted network with the scaling before it. ``losses``: the mean loss after each round, the first one that of the principal components."""

    features: list[str]
    latent: int
    hidden: int
    mean: np.ndarray
    std: np.ndarray
    flat: np.ndarray
    losses: list[float]

    @staticmethod
    def _whole(df: DataFrame, features: list[str]) -> Column:
        """Whether a row has all features: none null, NaN or infinite."""
        whole = F.lit(True)
        for c in features:
            whole = whole & F.coalesce(F.abs(quoted(c).cast("double")) < float("inf"), F.lit(False))
        return whole

    @staticmethod
    def blocks(df: DataFrame, features: list[str]) -> DataFrame:
        """block, x, weight: the different rows, dense, in the order of their values, and how often each occurs. A value that
        many rows share is one of a block's rows. Blocks don't depend on how ``df`` is partitioned."""
        d = len(features)
        cells = [(quoted(c).cast("double") + F.lit(0.0)).alias(f"f{j}") for j, c in enumerate(features)]
        names = [f"f{j}" for j in range(d)]
        rows = stored(df.filter(Autoencoder._whole(df, features)).select(*cells).groupBy(*names).agg(F.count("*").alias("weight")))
        count = max(1, math.ceil(rows.count() * d / BLOCK_CELLS))

        def pack(part: pa.Table) -> pa.Table:
            part = part.sort_by([(n, "ascending") for n in names])
            x = np.stack([part[n].to_numpy() for n in names], 1)
            return pa.table([part["block"].slice(0, 1), pa.array([x.tobytes()], pa.binary()), pa.array([part["weight"].to_numpy().astype(float).tobytes()], pa.binary())], ["block", "x", "weight"])

        tasks = max(math.ceil(count / BLOCKS_A_TASK), min(count, df.sparkSession.sparkContext.defaultParallelism))
        return stored(rows.withColumn("block", F.pmod(F.xxhash64(*names), F.lit(count))).repartition(tasks, "block").groupBy("block").applyInArrow(pack, "block bigint, x binary, weight binary"))

    @staticmethod
    def _round(blocks: DataFrame, count: int, total: float, tried: np.ndarray, k: int, h: int, mean: np.ndarray, std: np.ndarray) -> list[tuple[float, np.ndarray] | None]:
        """Mean loss and gradient at each of the weights ``tried``, in one pass over the blocks; None where one is too large."""
        d, wide = len(mean), tried.shape[1] + 1

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, lost = np.zeros((len(tried), wide), np.int64), np.zeros(len(tried), np.int64)
            part = None
            for batch in batches:
                for block, x, weight in zip(*[batch[c].to_pylist() for c in ("block", "x", "weight")], strict=True):
                    part = block if part is None else min(part, block)
                    rows = Autoencoder._scaled(np.frombuffer(x).reshape(-1, d), mean, std)
                    share = np.frombuffer(weight) / total
                    for i, flat in enumerate(tried):
                        with np.errstate(all="ignore"):
                            loss, gradient = loss_and_gradient(flat, k, h, rows, share)
                        cells = np.concatenate([[loss], gradient])
                        if np.isfinite(cells).all() and np.abs(cells).max() <= LIMIT * share.sum():
                            sums[i] += np.rint(cells * UNIT).astype(np.int64)
                        else:
                            lost[i] += 1
            if part is not None:
                yield pa.RecordBatch.from_arrays([pa.array([part % GROUPS], pa.int64()), pa.array([np.concatenate([lost, sums.ravel()])], pa.list_(pa.int64()))], ["part", "sums"])

        def added(rows: pa.Table) -> pa.Table:
            cells = rows["sums"].combine_chunks().flatten().to_numpy().reshape(len(rows), -1).sum(0)
            return pa.table([rows["part"].slice(0, 1), pa.array([cells], pa.list_(pa.int64()))], ["part", "sums"])

        with batches_of(blocks.sparkSession, BLOCKS_AT_ONCE):
            sums = blocks.mapInArrow(partial, "part bigint, sums array<bigint>")
            if count > DIRECT:
                sums = sums.groupBy("part").applyInArrow(added, "part bigint, sums array<bigint>")
            cells = np.sum([np.array(r.sums, np.int64) for r in sums.collect()], axis=0)  # at most DIRECT or GROUPS rows of one network's size
        lost, means = cells[: len(tried)], cells[len(tried) :].reshape(len(tried), wide) / UNIT
        return [None if lost[i] else (float(means[i, 0]), means[i, 1:]) for i in range(len(tried))]

    @staticmethod
    def _scaled(x: np.ndarray, mean: np.ndarray, std: np.ndarray) -> np.ndarray:
        return (x - mean) * np.where(std > 0, 1.0 / np.where(std > 0, std, 1.0), 0.0)

    @classmethod
    def fit(cls, df: DataFrame, features: list[str], kept: int | None = None, *, hidden: int = 16, rounds: int = 40, seed: int = 42, settled: float = 1e-4) -> Autoencoder:
        """The network of ``df``'s rows that have all features, with ``kept`` latent ones (one less than the features, 10 at most).
        It begins as the principal components, with ``hidden`` tanh units on either side whose shares are zero, and takes only
        steps that lower the loss, so it never rebuilds the table worse than they do. A round is one pass over the table, or two where the whole
        step along its direction is too long; at most ``rounds`` are made, and they end once five together gain less than ``settled`` of the loss. Reruns with one seed agree, whatever
        the partitions, but for the rounding of the scaler's and the components' own sums. A table without such rows is a ValueError."""
        whole = stored(df.filter(cls._whole(df, features)).select(*[quoted(c).cast("double").alias(c) for c in features]))  # read by several passes
        total = float(whole.count())
        if not total:
            raise ValueError("no row has all features")
        base = Reconstruction.fit(whole, features, kept)
        mean, std, ways = base.scaler.mean.toArray(), base.scaler.std.toArray(), base.model.pc.toArray()
        d, k = ways.shape
        blocks = cls.blocks(whole, features)
        count = blocks.count()
        rng = np.random.default_rng(seed)
        start = parted(np.zeros(sum(math.prod(s) for s in shapes(d, k, hidden).values())), d, k, hidden)
        start.update(into=ways, out=ways.T, in_hidden=rng.normal(0, 1 / math.sqrt(d), (d, hidden)), in_shift=rng.normal(0, 0.5, hidden), out_hidden=rng.normal(0, 1 / math.sqrt(k), (k, hidden)), out_shift=rng.normal(0, 0.5, hidden))
        flat = np.concatenate([start[n].ravel() for n in WEIGHTS])
        at = lambda tried: cls._round(blocks, count, total, tried, k, hidden, mean, std)
        here = at(flat[None, :])[0]
        if here is None:
            raise ValueError("the features are too far apart to be summed")
        losses, past = [here[0]], []
        for _ in range(rounds):
            way = direction(here[1], past)
            slope, better = float(here[1] @ way), []
            for steps in STEPS:
                tried = np.stack([flat + s * way for s in steps])
                found = at(tried)
                better = [(r[0], i) for i, (r, s) in enumerate(zip(found, steps, strict=True)) if r is not None and r[0] < here[0] + 1e-4 * s * slope]
                if better:
                    break
            if not better and not past:
                break
            if not better:  # the last steps mislead: downhill from here
                past = []
                continue
            _, i = min(better)
            step, change = tried[i] - flat, found[i][1] - here[1]
            if step @ change > 1e-10 * (change @ change) > 0:
                past = [*past, (step, change)][-MEMORY:]
            flat, here = tried[i], found[i]
            losses.append(here[0])
            if len(losses) > 5 and losses[-6] - losses[-1] < settled * losses[-6]:
                break
        return cls(features, k, hidden, mean, std, flat, losses)

    def apply(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Reconstruction errors and latent features of rows of features."""
        w = parted(self.flat, len(self.features), self.latent, self.hidden)
        scaled = self._scaled(x, self.mean, self.std)
        z, _ = encode(w, scaled)
        return ((decode(w, z)[0] - scaled) ** 2).mean(1), z

    def errors(self, df: DataFrame, id_col: str) -> DataFrame:
        """id_col, reconstruction_error (mean squared difference of the scaled features to the point rebuilt by the network), and the
        latent features, for rows that have all features."""
        d, k = len(self.features), self.latent

        def rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                error, z = self.apply(np.stack([batch[f"f{j}"].to_numpy() for j in range(d)], 1))
                yield pa.RecordBatch.from_arrays([batch["id"], pa.array(error), *[pa.array(z[:, j]) for j in range(k)]], ["id", "error", *[f"z{j}" for j in range(k)]])

        kind = dict(df.dtypes)[id_col]
        cells = [quoted(c).cast("double").alias(f"f{j}") for j, c in enumerate(self.features)]
        rows = df.filter(self._whole(df, self.features)).select(quoted(id_col).alias("id"), *cells)
        schema = ", ".join([f"id {kind}", "error double", *[f"z{j} double" for j in range(k)]])
        return rows.mapInArrow(rebuilt, schema).toDF(id_col, "reconstruction_error", *[f"latent{j}" for j in range(k)])

    def save(self, folder: str) -> None:
        row = (self.latent, self.hidden, self.mean.tolist(), self.std.tolist(), self.flat.tolist(), self.losses)
        one = SparkSession.active().createDataFrame([row], "latent int, hidden int, mean array<double>, std array<double>, flat array<double>, losses array<double>")
        one.coalesce(1).write.mode("overwrite").parquet(f"{folder}/autoencoder")

    @classmethod
    def load(cls, folder: str, features: list[str]) -> Autoencoder:
        r = SparkSession.active().read.parquet(f"{folder}/autoencoder").first()
        return cls(features, r.latent, r.hidden, np.array(r["mean"]), np.array(r["std"]), np.array(r["flat"]), list(r.losses))
