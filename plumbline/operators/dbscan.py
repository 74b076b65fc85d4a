"""DBSCAN by a space-partition tree: exact clusters in each leaf, leaves merged over the points near their borders.

1. Points that are equal in all features are one weighted site.
2. A tree of median splits is grown on a bounded, seeded sample of the sites; only its splits reach the tasks.
3. A site goes to the leaf it lies in (its home) and to every leaf whose region it is within eps of (its halo).
4. A leaf knows all neighbours of its own sites, so it tells which of them are core, which own core sites are
   one cluster, which sites of the halo such a cluster reaches, and near which sites a site that isn't core stands.
5. A reached site that is core at home ties its cluster to the leaf's: connected components over these ties, which are
   one for each local cluster and halo site.

A leaf works on cells of side eps / sqrt(dimensions) where these hold many sites each (what lies in one cell is near each other,
and boxes settle most pairs of cells), else on blocks of distances. A region isn't split once it is less than
two eps wide, since its parts would lie in each other's halo whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.schema import quoted, stored, with_row_index

#: Sites that a leaf aims at, and of the sample that the tree is grown on (SAMPLE * dimensions numbers on the driver).
LEAF_SITES, SAMPLE_SITES = 4096, 100_000
#: Pairs of which the distances are held at once.
BLOCK_PAIRS = 1 << 22
#: Sites to a cell from which a leaf works on cells.
CELL_SITES = 8


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reached) of the nodes that edges (a, b) touch: labels move to the
    smallest neighbour's label, and to that one's label, until none changes."""
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct())
    labels = stored(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("component")))
    while True:
        other = labels.select(F.col("node").alias("b"), F.col("component").alias("near"))
        lower = both.join(other, "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        stepped = labels.join(lower, "node").select("node", F.least("component", "near").alias("component"), F.col("component").alias("was"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        moved = stored(stepped.join(jump, "component", "left").select("node", F.least("component", F.coalesce("further", "component")).alias("component"), "was"))
        changed = moved.filter("component <> was").limit(1).count()
        labels = moved.select("node", "component")
        if not changed:
            return labels


class Tree:
    """Median splits as flat arrays: axis (-1: a leaf), value, and the two children of each node."""

    def __init__(self, sample: np.ndarray, leaf_sites: float, eps: float):
        self.axis, self.value, self.left, self.right = [], [], [], []
        self._grow(sample, leaf_sites, eps)

    def _grow(self, x: np.ndarray, leaf_sites: float, eps: float) -> int:
        at = len(self.axis)
        for column, start in ((self.axis, -1), (self.value, 0.0), (self.left, -1), (self.right, -1)):
            column.append(start)
        if len(x) > max(leaf_sites, 1):
            widths = np.quantile(x, 0.95, axis=0) - np.quantile(x, 0.05, axis=0)  # a few far points don't make an axis wide
            axis = int(np.argmax(widths))
            middle = float(np.median(x[:, axis]))
            low = x[:, axis] <= middle
            if widths[axis] > 2 * eps and not low.all():
                self.axis[at], self.value[at] = axis, middle
                self.left[at], self.right[at] = self._grow(x[low], leaf_sites, eps), self._grow(x[~low], leaf_sites, eps)
        return at

    def places(self, x: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, leaf and whether it is the row's home, for each leaf whose region is within eps of the row."""
        rows, leaves, homes = [], [], []
        reach = eps * eps * (1 + 1e-9)
        stack = [(0, np.arange(len(x)), np.zeros_like(x), np.zeros(len(x)))]  # node, rows, offset to the region on each axis, square of their length
        while stack:
            node, at, off, d2 = stack.pop()
            if not len(at):
                continue
            axis = self.axis[node]
            if axis < 0:
                rows.append(at)
                leaves.append(np.full(len(at), node))
                homes.append(d2 == 0)
                continue
            gap = x[at, axis] - self.value[node]
            for child, inside in ((self.left[node], gap <= 0), (self.right[node], gap > 0)):
                new = np.where(inside, off[:, axis], np.maximum(off[:, axis], np.abs(gap)))
                further = d2 - off[:, axis] ** 2 + new**2
                # a row on the border is at home on one side only; on the other it is as near as can be
                further = np.where(inside, further, np.maximum(further, 1e-300))
                near = further <= reach
                moved = off[near].copy()
                moved[:, axis] = new[near]
                stack.append((child, at[near], moved, further[near]))
        return np.concatenate(rows), np.concatenate(leaves), np.concatenate(homes)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all of b."""
    out = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):
        step = a[:, k, None] - b[None, :, k]
        step *= step
        out += step
    return out


def within(a: np.ndarray, b: np.ndarray, far: float) -> np.ndarray:
    """Whether rows of a and b are within sqrt(far): by products, and anew by differences where rounding could matter."""
    if a.shape[1] < 4:
        return squares(a, b) <= far
    middle = b.mean(0) if len(b) else 0.0
    p, q = a - middle, b - middle
    left, right = (p * p).sum(1), (q * q).sum(1)
    d2 = left[:, None] + right[None, :] - 2 * (p @ q.T)
    near = d2 <= far
    slack = 1e-12 * (far + left.max(initial=0.0) + right.max(initial=0.0))
    i, j = np.nonzero(np.abs(d2 - far) <= slack)
    if len(i):
        exact = np.zeros(len(i))
        for k in range(a.shape[1]):
            exact += (a[i, k] - b[j, k]) ** 2
        near[i, j] = exact <= far
    return near


def _blocks(n: int, width: int) -> Iterator[slice]:
    step = max(1, BLOCK_PAIRS // max(width, 1))
    for lo in range(0, n, step):
        yield slice(lo, min(lo + step, n))


class Leaf:
    """Exact clusters of a leaf's own sites: ``core``, ``comp`` (the least own site of its cluster, -1: none), ``links`` (cluster, halo
    place) and ``near`` (own place that isn't core, place within eps)."""

    def __init__(self, x: np.ndarray, w: np.ndarray, home: np.ndarray, eps: float, least: int):
        self.x, self.w, self.home, self.far, self.least = x, w, home, eps * eps, least
        self.comp = np.full(len(x), -1)
        self.links: list[tuple[np.ndarray, np.ndarray]] = []
        self.near: list[tuple[np.ndarray, np.ndarray]] = []
        with np.errstate(invalid="ignore"):
            keys = np.floor((x - x.min(0)) / (eps / math.sqrt(x.shape[1]) * (1 - 1e-9))) if eps > 0 else x
        cells, of = np.unique(keys, axis=0, return_inverse=True)
        if len(cells) * CELL_SITES <= len(x):
            self._by_cells(of.reshape(-1), len(cells))
        else:
            self._by_blocks()

    def _by_blocks(self) -> None:
        own, halo = np.flatnonzero(self.home), np.flatnonzero(~self.home)
        core = np.zeros(len(self.x), bool)
        for part in _blocks(len(own), len(self.x)):
            mask = within(self.x[own[part]], self.x, self.far)
            enough = mask @ self.w >= self.least
            core[own[part]] = enough
            i, j = np.nonzero(mask[~enough])
            self.near.append((own[part][~enough][i], j))
        self.core = core
        left = np.flatnonzero(core)
        while len(left):
            front, members, left = left[:1], [left[:1]], left[1:]
            while len(front) and len(left):
                reached = np.zeros(len(left), bool)
                for part in _blocks(len(front), len(left)):
                    reached |= within(self.x[front[part]], self.x[left], self.far).any(0)
                front, left = left[reached], left[~reached]
                members.append(front)
            every = np.concatenate(members)
            self.comp[every] = every.min()
        cores = np.flatnonzero(core)
        for part in _blocks(len(halo), len(cores)):
            i, j = np.nonzero(within(self.x[halo[part]], self.x[cores], self.far))
            pairs = np.unique(np.stack([self.comp[cores[j]], halo[part][i]], 1), axis=0)
            self.links.append((pairs[:, 0], pairs[:, 1]))

    def _by_cells(self, of: np.ndarray, n: int) -> None:
        order = np.argsort(of, kind="stable")
        bounds = np.searchsorted(of[order], np.arange(n + 1))
        held = [order[bounds[k] : bounds[k + 1]] for k in range(n)]
        lo = np.minimum.reduceat(self.x[order], bounds[:-1])
        hi = np.maximum.reduceat(self.x[order], bounds[:-1])
        weight = np.add.reduceat(self.w[order], bounds[:-1])
        some, whole = [], []  # of each cell, the cells partly and wholly within eps
        for k in range(n):
            gap = np.maximum(0, np.maximum(lo[k] - hi, lo - hi[k]))
            reach = np.maximum(hi[k] - lo, hi - lo[k])
            near = np.flatnonzero((gap * gap).sum(1) <= self.far * (1 + 1e-9))
            inside = ((reach[near] ** 2).sum(1) <= self.far * (1 - 1e-9)) | (near == k)
            whole.append(near[inside])
            some.append(near[~inside])
        core = np.zeros(len(self.x), bool)
        for k in range(n):
            own = held[k][self.home[held[k]]]
            if weight[k] >= self.least:
                core[own] = True
                continue
            count = np.full(len(own), weight[whole[k]].sum())
            for j in some[k]:
                for part in _blocks(len(held[j]), len(own)):
                    count += within(self.x[own], self.x[held[j][part]], self.far) @ self.w[held[j][part]]
            core[own] = count >= self.least
        self.core = core
        cores = [held[k][core[held[k]]] for k in range(n)]
        parent = list(range(n))

        def root(k: int) -> int:
            while parent[k] != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        def touch(a: np.ndarray, b: np.ndarray) -> bool:
            return any(within(a[p], b[q], self.far).any() for p in _blocks(len(a), 2048) for q in _blocks(len(b), 2048))

        for k in range(n):
            if len(cores[k]):
                for j in whole[k]:
                    if j > k and len(cores[j]):
                        parent[root(j)] = root(k)
        for k in range(n):
            if len(cores[k]):
                for j in some[k]:
                    if j > k and len(cores[j]) and root(j) != root(k) and touch(self.x[cores[k]], self.x[cores[j]]):
                        parent[root(j)] = root(k)
        least: dict[int, int] = {}
        for k in range(n):
            if len(cores[k]):
                least[root(k)] = min(least.get(root(k), len(self.x)), int(cores[k].min()))
        for k in range(n):
            if len(cores[k]):
                self.comp[cores[k]] = least[root(k)]
        for k in range(n):
            out = held[k][~self.home[held[k]]]
            reached: dict[int, np.ndarray] = {}
            for j in whole[k]:
                if len(out) and len(cores[j]):
                    reached[int(self.comp[cores[j][0]])] = np.ones(len(out), bool)
            for j in some[k]:
                if len(out) and len(cores[j]):
                    hit = reached.setdefault(int(self.comp[cores[j][0]]), np.zeros(len(out), bool))
                    for part in _blocks(len(cores[j]), len(out)):
                        if hit.all():
                            break
                        hit |= within(self.x[out], self.x[cores[j][part]], self.far).any(1)
            for comp, hit in reached.items():
                if weight[k] >= self.least and hit.any():  # all core and of one cluster: one of them stands for the cell
                    self.links.append((np.array([comp]), out[hit][:1]))
                else:
                    self.links.append((np.full(int(hit.sum()), comp), out[hit]))
            own = held[k][self.home[held[k]] & ~core[held[k]]]
            for j in [*whole[k], *some[k]] if len(own) else []:
                i, to = np.nonzero(within(self.x[own], self.x[held[j]], self.far))
                self.near.append((own[i], held[j][to]))


_FOUND = "kind int, site bigint, other bigint, core boolean, d2 double"


def _clustered(eps: float, least: int):
    def cluster(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("site")
        site, w, home = (rows[c].to_numpy() for c in ("site", "w", "home"))
        x = np.array(rows["x"].combine_chunks().flatten().to_numpy()).reshape(len(site), -1)
        leaf = Leaf(x, w, home, eps, least)
        own = np.flatnonzero(home)
        a, b = (np.concatenate([p[k] for p in leaf.links] or [np.zeros(0, int)]).astype(int) for k in (0, 1))
        p, q = (np.concatenate([x[k] for x in leaf.near] or [np.zeros(0, int)]).astype(int) for k in (0, 1))
        useful = ~home[q] | leaf.core[q]
        p, q = p[useful], q[useful]
        comp = np.where(leaf.comp >= 0, site[leaf.comp], -1)
        away = np.zeros(len(p))
        for k in range(x.shape[1]):
            away += (x[p, k] - x[q, k]) ** 2
        kind = np.repeat([0, 1, 2], [len(own), len(a), len(p)]).astype(np.int32)
        columns = [kind, np.concatenate([site[own], site[a], site[p]]), np.concatenate([comp[own], site[b], site[q]])]
        columns += [np.concatenate([leaf.core[own], np.ones(len(a) + len(p), bool)]), np.concatenate([np.zeros(len(own) + len(a)), away])]
        return pa.table([pa.array(c) for c in columns], ["kind", "site", "other", "core", "d2"])

    return cluster


def dbscan(points: DataFrame, features: list[str], *, id_col: str, eps: float, min_samples: int, leaf_sites: int = LEAF_SITES, sample_sites: int = SAMPLE_SITES, seed: int = 42) -> DataFrame:
    """id_col, label: density clusters by euclidean distance, numbered from 0 by their smallest core id; -1 is noise.

    Exact, whatever the tree. A site that isn't core joins the cluster of its nearest core site (ties: the smaller
    cluster). Ids are unique, of any type that has an order. Rows with a null, NaN or infinite feature are noise; an empty table gives no rows. The driver holds the
    tree's sample of at most about ``sample_sites`` sites; a task holds one leaf with its halo, whose size a region of under two eps in width doesn't bound."""
    names = [f"f{k}" for k in range(len(features))]
    rows = stored(points.select(F.col(id_col).alias("id"), *[quoted(f).cast("double").alias(n) for f, n in zip(features, names, strict=True)]))
    finite = F.lit(True)
    for n in names:
        finite = finite & (F.abs(n) < float("inf"))  # neither NULL nor NaN
    sites = stored(rows.filter(finite).groupBy(*[(F.col(n) + 0.0).alias(n) for n in names]).agg(F.count("*").alias("w"), F.min("id").alias("site")))
    whole = dict(rows.dtypes)["id"] in ("tinyint", "smallint", "int", "bigint")
    sites = sites.withColumn("site", F.col("site").cast("long")) if whole else with_row_index(sites.withColumnRenamed("site", "least"), "least", name="site")
    n = sites.count()
    share = sample_sites / max(n, 1)
    drawn = sites.select(*names) if share >= 1 else sites.filter(F.pmod(F.xxhash64("site", F.lit(seed)), F.lit(1 << 40)) < F.lit(int(share * (1 << 40)))).select(*names)
    sample = drawn.toArrow() if n > leaf_sites else None
    grown = np.stack([c.to_numpy() for c in sample.columns], 1) if sample is not None and len(sample) else np.zeros((0, len(names)))
    tree = Tree(grown, max(8, leaf_sites * len(grown) / max(n, 1)), eps)
    lone = len(tree.axis) == 1

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch[f].to_numpy() for f in names], 1)
            row, leaf, home = tree.places(x, eps)
            for lo in range(0, len(row), 1 << 16):
                at = row[lo : lo + (1 << 16)]
                flat = pa.array(np.ascontiguousarray(x[at]).reshape(-1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * len(names)), flat)
                yield pa.RecordBatch.from_arrays([pa.array(leaf[lo : lo + (1 << 16)].astype(np.int32)), batch["site"].take(pa.array(at)), batch["w"].take(pa.array(at)), pa.array(home[lo : lo + (1 << 16)]), lists], ["leaf", "site", "w", "home", "x"])

    placed = sites.mapInArrow(dealt, "leaf int, site bigint, w bigint, home boolean, x array<double>")
    found = stored(placed.groupBy("leaf").applyInArrow(_clustered(eps, min_samples), _FOUND))
    homes = found.filter("kind = 0").select("site", F.when(F.col("core"), F.col("other")).alias("comp"))
    cores = homes.filter("comp IS NOT NULL")
    if not lone:
        ties = found.filter("kind = 1").select(F.col("site").alias("a"), F.col("other").alias("site")).join(cores, "site").select("a", F.col("comp").alias("b"))
        roots = components(ties)
        cores = stored(cores.join(roots, F.col("comp") == F.col("node"), "left").select("site", F.coalesce("component", "comp").alias("comp")))
    near = found.filter("kind = 2").select("site", "other", "d2").join(cores.select(F.col("site").alias("other"), "comp"), "other")
    border = near.groupBy("site").agg(F.min_by("comp", F.struct("d2", "comp")).alias("comp"))
    clusters = with_row_index(cores.select("comp").distinct(), "comp", name="label")
    of_site = cores.unionByName(border).join(clusters, "comp").select("site", F.col("label").cast("int"))
    by_site = sites.join(of_site, "site").select(*[F.col(f).alias(f"s_{f}") for f in names], "label")
    same = F.lit(True)
    for f in names:
        same = same & ((F.col(f) + 0.0) == F.col(f"s_{f}"))
    return rows.join(by_site, same, "left").select(F.col("id").alias(id_col), F.coalesce("label", F.lit(-1)).alias("label"))
