"""Connected cells and density clusters of views of any size, tile by tile.

A view is cut into tiles with a halo as wide as a link is long (twice that where it must also be
known who is a core point). Tiles are labelled apart, each by array operations; rows that lie in
several tiles join their labels, and the few joined labels are components of a graph. So
a group holds a tile, whatever the size of the view, and the result is that of the whole view. A
small view is one tile.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.functions import constants as K
from spanforge.operators import graph as G
from spanforge.operators import points as P
from spanforge.sources.store import written

#: Distances that are taken at once.
BLOCK = 1 << 21
#: Cells or places of a view that are one tile.
FEW = 20_000


class Sets:
    """Disjoint sets of the numbers below ``n``; the least member stands for a set."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.parent[max(i, j)] = min(i, j)

    def labels(self) -> np.ndarray:
        return np.array([self.find(i) for i in range(len(self.parent))], dtype=np.int64)


def _offsets(dims: int, reach: int, diagonal: bool = True) -> np.ndarray:
    """Steps to the cells around, one of each opposite pair."""
    every = np.stack(np.meshgrid(*[np.arange(-reach, reach + 1)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
    every = every if diagonal else every[np.abs(every).sum(axis=1) == 1]
    return every[len(every) // 2 + (len(every) % 2) :]


def _neighbour_pairs(cells: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Pairs of rows of the distinct integer ``cells`` that one of the offsets leads from and to."""
    if not len(cells):
        return np.empty((0, 2), dtype=np.int64)
    low, reach = cells.min(axis=0), int(np.abs(offsets).max())
    span = cells.max(axis=0) - low + 2 * reach + 1
    weight = np.append(np.cumprod(span[:0:-1].astype(object))[::-1], 1)
    if int(span.astype(object).prod()) >= 1 << 62:
        raise ValueError("a tile spans too many cells")
    weight = weight.astype(np.int64)
    code = (cells - low + reach) @ weight
    order = np.argsort(code)
    ranked = code[order]
    found = []
    for step in offsets @ weight:
        at = np.searchsorted(ranked, ranked + step)
        hit = at < len(ranked)
        hit[hit] = ranked[at[hit]] == ranked[hit] + step
        found.append(np.stack([order[hit], order[at[hit]]], axis=1))
    return np.concatenate(found)


def cell_labels(cells: np.ndarray, diagonal: bool) -> np.ndarray:
    """Label of each distinct integer cell: cells that touch have the same one."""
    sets = Sets(len(cells))
    for i, j in _neighbour_pairs(cells, _offsets(cells.shape[1], 1, diagonal)).tolist():
        sets.join(i, j)
    return sets.labels()


def connected_cells(cells: DataFrame, keys: list[str], axes: list[str], diagonal: bool = True, tile: int = 64, few: int = FEW) -> DataFrame:
    """``component`` of every distinct cell of each view, numbered by least cells; cells touch at faces, with ``diagonal`` also at edges and corners."""
    own = written(cells.select(*keys, *[F.col(a).cast("long").alias(a) for a in axes]).distinct(), "cells")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        return part.assign(_label=cell_labels(part[axes].to_numpy(np.int64), diagonal))

    tiled = G.with_tiles(own, keys, axes, tile, 1, few).groupBy(*keys, "_tile").applyInPandas(run, f"{fields}, _tile array<long>, _own boolean, _label long")
    return G.stitched(written(tiled, "tiles"), keys, axes).select(*own.columns, "component")


class Grid:
    """Points in cells whose diagonal is one link: points of a cell are near each other."""

    def __init__(self, x: np.ndarray, eps: float):
        side = eps / np.sqrt(x.shape[1]) * (1 - 1e-12)
        cells = np.floor(x / side).astype(np.int64)
        self.x, self.eps = x, eps
        self.cells, self.cell = np.unique(cells, axis=0, return_inverse=True)
        self.cell = self.cell.reshape(-1)
        self.order = np.argsort(self.cell, kind="stable")
        self.first = np.searchsorted(self.cell[self.order], np.arange(len(self.cells) + 1))
        pairs = _neighbour_pairs(self.cells, _offsets(x.shape[1], 2))
        both = np.concatenate([pairs, pairs[:, ::-1]])
        self.pairs = pairs
        both = both[np.argsort(both[:, 0], kind="stable")]
        self.around = np.split(both[:, 1], np.searchsorted(both[:, 0], np.arange(1, len(self.cells))))

    def members(self, cell: int) -> np.ndarray:
        return self.order[self.first[cell] : self.first[cell + 1]]

    def distances(self, a: np.ndarray, b: np.ndarray):
        """Blocks of distances: rows of ``a`` in slices, all of ``b``."""
        step = max(1, BLOCK // max(1, len(b)))
        for at in range(0, len(a), step):
            gap = self.x[a[at : at + step], None] - self.x[None, b]
            yield slice(at, at + step), np.sqrt(np.einsum("nmd,nmd->nm", gap, gap))

    def cores(self, weight: np.ndarray, least: int) -> np.ndarray:
        """Which points have ``least`` points or more within a link, themselves included."""
        held = np.bincount(self.cell, weights=weight, minlength=len(self.cells))
        core = held[self.cell] >= least
        for c in np.flatnonzero(held < least).tolist():
            mine = self.members(c)
            total = np.full(len(mine), held[c])
            for other in self.around[c].tolist():
                open_ = np.flatnonzero(total < least)
                theirs = self.members(other)
                for rows, far in self.distances(mine[open_], theirs):
                    total[open_[rows]] += (far <= self.eps) @ weight[theirs]
            core[mine] = total >= least
        return core

    def clusters(self, core: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Label of each core point, and for other points the nearest core point within a link (the least place of equal ones); -1 where none."""
        inside = [m[core[m]] for m in map(self.members, range(len(self.cells)))]
        sets = Sets(len(self.cells))
        for i, j in self.pairs.tolist():
            a, b = inside[i], inside[j]
            if len(a) and len(b) and sets.find(i) != sets.find(j) and any((far <= self.eps).any() for _, far in self.distances(a, b)):
                sets.join(i, j)
        of_cell = sets.labels()
        nearest = np.full(len(self.x), -1, dtype=np.int64)
        for c in np.unique(self.cell[~core]).tolist():
            mine = self.members(c)
            mine = mine[~core[mine]]
            theirs = np.sort(np.concatenate([inside[c], *[inside[o] for o in self.around[c].tolist()]]))
            if len(theirs):
                for rows, far in self.distances(mine, theirs):
                    best = far.argmin(axis=1)
                    hit = far[np.arange(len(best)), best] <= self.eps
                    nearest[mine[rows][hit]] = theirs[best[hit]]
        return np.where(core, of_cell[self.cell], -1), nearest


def dense_clusters(x: np.ndarray, weight: np.ndarray, eps: float, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Core flags, labels and nearest core points like those of a Grid, from all distances of a few points."""
    gap = x[:, None] - x[None]
    far = np.sqrt(np.einsum("nmd,nmd->nm", gap, gap))
    near = far <= eps
    core = near @ weight >= least
    label = np.full(len(x), -1, dtype=np.int64)
    for i in np.flatnonzero(core).tolist():
        if label[i] < 0:
            reached, front = np.zeros(len(x), dtype=bool), np.array([i])
            while len(front):
                reached[front] = True
                front = np.flatnonzero(near[front].any(axis=0) & core & ~reached)
            label[reached] = i
    nearest = np.full(len(x), -1, dtype=np.int64)
    if core.any():
        cores = np.flatnonzero(core)
        border = np.flatnonzero(~core & near[:, core].any(axis=1))
        nearest[border] = cores[far[np.ix_(border, cores)].argmin(axis=1)]
    return core, label, nearest


def tile_clusters(x: np.ndarray, weight: np.ndarray, eps: float, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Core flag, label (-1 without one) and nearest core point (-1) of each point of a tile."""
    if len(x) ** 2 <= BLOCK // 2:
        return dense_clusters(x, weight, eps, least)
    grid = Grid(x, eps)
    core = grid.cores(weight, least)
    return core, *grid.clusters(core)


def density_clusters(points: DataFrame, keys: list[str], eps: float = K.DBSCAN_EPS, least: int = K.DBSCAN_MIN, tile: int = 8, few: int = FEW) -> DataFrame:
    """``points`` with ``is_core`` and ``cluster`` (-1 for noise), numbered by the least core point (x, y, z) of each.

    A border point goes to the cluster of its nearest core point, the least of equally near ones.
    Points at one place are one row with a count on the way; tiles are ``tile`` links wide.
    Points with a coordinate that is null or no number are noise.
    """
    axes = list(P.AXES)
    known = P.finite_points(points)
    places = written(known.groupBy(*keys, *axes).agg(F.count(F.lit(1)).alias("_n")), "places")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in places.select(*keys, *axes).schema.fields)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(axes, ignore_index=True)
        core, label, nearest = tile_clusters(part[axes].to_numpy(np.float64), part["_n"].to_numpy(np.float64), eps, least)
        border = nearest >= 0
        label[border] = label[nearest[border]]
        near_own = part["_own"].to_numpy() | (part["_edge"].to_numpy() <= eps * wide)  # beyond, cores are not known for sure
        known = near_own & (label >= 0)
        out = part[[*keys, *axes, "_tile", "_own"]].assign(is_core=core, _seed=core, _label=pd.array(np.where(known, label, 0), dtype="Int64"))
        out.loc[~known, "_label"] = pd.NA
        return out[out["_own"] | (core & near_own)]

    size, wide = tile * eps, 1 + 1e-9  # a halo a little wider than a link, whatever the rounding
    inside = F.size("_tile") == 0
    gap = [F.greatest(F.lit(0.0), F.get("_tile", F.lit(i)) * size - F.col(a), F.col(a) - (F.get("_tile", F.lit(i)) + 1) * size) for i, a in enumerate(axes)]
    tiled = G.with_tiles(places, keys, axes, size, 2 * eps * wide, few).withColumn("_edge", F.when(inside, 0.0).otherwise(F.greatest(*gap)))
    labelled = written(tiled.groupBy(*keys, "_tile").applyInPandas(run, f"{fields}, _tile array<long>, _own boolean, is_core boolean, _seed boolean, _label long"), "tiles")
    whole = G.stitched(labelled, keys, axes).select(*keys, *axes, "is_core", F.coalesce("component", F.lit(-1)).alias("cluster"))
    found = points.join(whole, [*keys, *axes], "left")
    return found.select(*points.columns, F.coalesce("is_core", F.lit(False)).alias("is_core"), F.coalesce("cluster", F.lit(-1).cast("long")).alias("cluster"))
