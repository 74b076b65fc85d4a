"""Embedding near-dedup by collision-counting projections.

Equal vectors are one node with a weight from the start. Unit vectors are projected on many random
directions. ``projections`` of them are sorted, a window centred on each vector is laid on every
sorted axis, and what falls into it collides with the vector; collisions are counted for each
pair, and pairs whose count passes a threshold are verified by their cosine in double precision.
Window and threshold are calculated from the distance that the similarity allows.

Windows over the whole table would hold a fixed share of all vectors, and narrower ones need so
many more projections that collisions stay a fixed share of all pairs. So the axes are sorted and
counted inside cells: ``k`` further directions, each cut at a random offset into stretches,
together make a table's cell, and several tables make sure that a pair shares a cell. ``k`` grows
with the logarithm of the number of vectors, so that cells keep their size, and the number of
tables is calculated for ``recall`` at the very similarity asked for (nearer pairs are found more
surely). A cell with more than ``block`` vectors is compared block by block, in as many tasks.

A pair counts in the first table in which both share a cell, so each link is found once. A
block pair returns, for each vector, its weighted number of links and the smallest vector that
links reach there: rows that grow with the vectors and not with the links.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components
link with nothing; vectors of different lengths never link; equal vectors link; a null id is
ignored in a component's smallest id and a component without any id has none; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, small
from .components import connected_components

#: Length of the stretches on a projection's axis, and half the window's width in deviations of
#: a projected difference at the similarity asked for.
STRETCH = 2.0
WINDOW_DEVIATIONS = 2.0
#: Rows (a vector in one block pair) that one task gets at a time, about.
TASK_ROWS = 20_000


def cell_plan(n: int, similarity: float, recall: float, cell_vectors: int) -> tuple[int, int]:
    """Directions of a table, and tables, so that such pairs share a cell with half of what ``recall`` may miss."""
    distance = math.sqrt(2 - 2 * similarity)
    same = 1 - min(1.0, distance * math.sqrt(2 / math.pi) / STRETCH)  # two such vectors in one stretch, at least
    k = max(2, math.ceil(math.log2(max(2, n / cell_vectors))))
    return k, max(1, math.ceil(math.log((1 - recall) / 2) / math.log(1 - same**k)))


def window_plan(similarity: float, recall: float, projections: int) -> tuple[float, int]:
    """Half the window, and the count of collisions that such pairs reach but for the other half."""
    p = 2 * NormalDist().cdf(WINDOW_DEVIATIONS) - 1
    need, tail = projections, 0.0
    while need > 0 and tail < 1 - (1 - recall) / 2:
        tail += math.comb(projections, need) * p**need * (1 - p) ** (projections - need)
        need -= 1
    return WINDOW_DEVIATIONS * math.sqrt(2 - 2 * similarity), need + 1


def directions(dim: int, m: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, dim])
    return rng.standard_normal((dim, m)), rng.uniform(0, STRETCH, m)


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    x = np.stack(vectors).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def window_collisions(queries: np.ndarray, others: np.ndarray, half: float) -> np.ndarray:
    """How often each of ``others`` falls into the window of each query, over the axes (columns)."""
    hits = np.zeros(len(queries) * len(others), np.uint8)
    row = np.arange(len(queries)) * len(others)
    for d in range(queries.shape[1]):
        order = np.argsort(others[:, d])
        axis = others[order, d]
        lo, hi = np.searchsorted(axis, queries[:, d] - half, "left"), np.searchsorted(axis, queries[:, d] + half, "right")
        n = hi - lo
        inside = order[np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)]
        hits[np.repeat(row, n) + inside] += 1  # a pair collides once at most on an axis
    return hits.reshape(len(queries), len(others))


def smallest_reached(n: int, a: np.ndarray, b: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each of n vectors the smallest rank that links (a, b) reach."""
    least = rank.copy()
    while True:
        low = np.minimum(least[a], least[b])
        now = least.copy()
        np.minimum.at(now, a, low)
        np.minimum.at(now, b, low)
        if (now == least).all():
            return least
        least = now


def embedding_duplicates(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", similarity: float = 0.95, recall: float = 0.99,
    projections: int = 16, cell_vectors: int = 400, block: int = 1024, seed: int = 23,
) -> DataFrame:
    """One row per row: id_col, n_links, component_id, kept (whether its id is its component's)."""
    kind = "float" if dict(vectors.dtypes)[vector_col] == "array<float>" else "double"
    v = F.col(vector_col).cast(f"array<{kind}>")
    sound = F.coalesce((F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).alias("id"), F.when(sound, v).alias("v"))
    # equal vectors have equal digests; 128 bits
    rows = saved(rows.select("id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(seed), "v").alias("h2")).withColumn("uid", F.monotonically_increasing_id()), "vectors")
    nodes = rows.filter("v IS NOT NULL").groupBy("h1", "h2").agg(F.min("uid").alias("uid"), F.count("*").alias("weight"), F.min("id").alias("least_id"), F.first("v").alias("v"))
    nodes = saved(nodes, "nodes")
    good = nodes.select("uid", "weight", "v")
    k, tables = cell_plan(nodes.count(), similarity, recall, cell_vectors)
    half, need = window_plan(similarity, recall, projections)
    m = k * tables

    def cells_of(unit: np.ndarray, dim: int) -> np.ndarray:
        ways, offset = directions(dim, m, seed)
        return np.floor((unit @ ways + offset) / STRETCH).astype(np.int32).reshape(len(unit), tables, k)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pdf = batch.to_pandas()
            for dim, part in pdf.groupby(pdf["v"].map(len)):
                cells = cells_of(unit_rows(part["v"].to_numpy()), dim).astype(np.int64)
                cell = np.full((len(part), tables), dim, np.int64)
                for j in range(k):
                    cell = cell * 1_000_003 + cells[:, :, j]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part["uid"].to_numpy(), tables)), pa.array(np.tile(np.arange(tables, dtype=np.int32), len(part))), pa.array(cell.ravel())], ["uid", "t", "cell"])

    cells = saved(good.select("uid", "v").mapInArrow(place, "uid bigint, t int, cell bigint"), "cells")
    counts = cells.groupBy("t", "cell").agg(F.count("*").alias("n")).filter("n > 1").withColumn("blocks", F.ceil(F.col("n") / F.lit(block)))
    dealt = cells.join(small(saved(counts, "counts")), ["t", "cell"]).withColumn("own", F.pmod(F.xxhash64("uid"), "blocks"))
    # a block meets every block of its cell, itself included, once
    met = dealt.select("uid", "t", "cell", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    met = saved(met.select("uid", "t", "cell", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")), "met")
    # many small cells share a task's call; a block pair is never parted
    parts = max(1, -(-met.count() // TASK_ROWS))
    keyed = met.withColumn("part", F.pmod(F.xxhash64("t", "cell", "i", "j"), F.lit(parts))).join(good, "uid")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        pdf = pdf.sort_values(["t", "cell", "i", "j", "own", "uid"]).reset_index(drop=True)
        dims = pdf["v"].map(len).to_numpy()
        for dim in np.unique(dims):
            whole = pdf[dims == dim].reset_index(drop=True)
            unit = unit_rows(whole["v"].to_numpy())
            axis = unit @ directions(dim, projections, seed + 1)[0]
            key = whole[["t", "cell", "i", "j"]].to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1, [len(whole)]])
            own, uid, weight = (whole[c].to_numpy() for c in ("own", "uid", "weight"))
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                table, _, i, j = key[lo]
                left = np.arange(lo, hi) if i == j else lo + np.flatnonzero(own[lo:hi] == i)
                right = left if i == j else lo + np.flatnonzero(own[lo:hi] == j)
                if not len(left) or not len(right):
                    continue
                found_a, found_b = [], []
                for at in range(0, len(left), 256):
                    mine = left[at : at + 256]
                    a, b = np.nonzero(window_collisions(axis[mine], axis[right], half) >= need)
                    a, b = mine[a], right[b]
                    if i == j:
                        a, b = a[a < b], b[a < b]
                    close = np.einsum("ij,ij->i", unit[a], unit[b]) >= similarity
                    found_a.append(a[close])
                    found_b.append(b[close])
                a, b = np.concatenate(found_a), np.concatenate(found_b)
                if len(a) and table:  # a pair counts in the first table in which both share a cell
                    some = np.unique(np.concatenate([a, b]))
                    cell = cells_of(unit[some], dim)
                    at_a, at_b = np.searchsorted(some, a), np.searchsorted(some, b)
                    new = np.ones(len(a), bool)
                    for t in range(table):
                        new[new] = ~(cell[at_a[new], t] == cell[at_b[new], t]).all(1)
                    a, b = a[new], b[new]
                if len(a):
                    a, b = a - lo, b - lo
                    w = weight[lo:hi]
                    links = np.bincount(a, w[b], hi - lo) + np.bincount(b, w[a], hi - lo)
                    linked = links > 0
                    root = smallest_reached(hi - lo, a, b, uid[lo:hi])
                    out.append(pd.DataFrame({"uid": uid[lo:hi][linked], "links": links[linked].astype(np.int64), "root": root[linked]}))
        return pd.concat(out) if out else pd.DataFrame({"uid": [], "links": [], "root": []}).astype("int64")

    found = saved(keyed.groupBy("part").applyInPandas(compare, "uid bigint, links bigint, root bigint"), "links")
    edges = found.filter("uid <> root").select(F.col("uid").alias("a"), F.col("root").alias("b")).distinct()
    labels = connected_components(edges)
    links = saved(found.groupBy("uid").agg(F.sum("links").alias("n_links")), "counted")
    placed = nodes.select("h1", "h2", "uid", "weight", "least_id").join(small(labels.withColumnRenamed("node", "uid")), "uid", "left").join(small(links), "uid", "left")
    placed = saved(placed.select("h1", "h2", "least_id", F.coalesce("component", "uid").alias("component"), (F.coalesce("n_links", F.lit(0)) + F.col("weight") - 1).alias("n_links")), "placed")
    smallest = saved(placed.groupBy("component").agg(F.min("least_id").alias("component_id")), "smallest")
    classes = saved(placed.join(small(smallest), "component").select("h1", "h2", "n_links", "component_id", F.lit(True).alias("sound")), "classes")
    out = rows.withColumn("h1", F.when(F.col("v").isNotNull(), F.col("h1"))).join(small(classes), ["h1", "h2"], "left")
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.when(F.col("sound"), F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
    ).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
