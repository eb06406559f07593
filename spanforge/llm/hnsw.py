"""A hierarchical navigable small-world graph over unit vectors, built and searched in batches.

Nodes draw their top layer from a seeded generator and enter from the highest layer down,
so every upper layer is complete before the ones below. A batch of new nodes searches the
graph of the earlier ones and also sees itself; neighbours are chosen by the diversity
rule (a candidate nearer to a chosen neighbour than to the node is passed over), which
keeps groups of near-equal vectors connected to the rest. Of the new links back to a node
in one batch, the most similar ones, three times the layer's width at most, meet its
earlier links in that rule. All steps work on arrays.
"""

from __future__ import annotations

import numpy as np

NONE = np.int32(-1)


class Hnsw:
    def __init__(self, vectors: np.ndarray, links: int = 12, beam: int = 48, seed: int = 3):
        self.x = np.ascontiguousarray(vectors, dtype=np.float32)
        self.links, self.beam = links, beam
        n = len(self.x)
        level = np.minimum((-np.log(1.0 - np.random.default_rng(seed).random(n)) / np.log(links)).astype(int), 6)
        order = np.argsort(-level, kind="stable")
        top = int(level.max(initial=0))
        self.layers = [np.full((n, links * (2 if k == 0 else 1)), NONE) for k in range(top + 1)]
        self.entry = int(order[0]) if n else 0
        done = 0
        while done < n:
            size = min(max(1, done // 4), 512, n - done)
            batch = order[done : done + size]
            same = np.flatnonzero(level[batch] != level[batch[0]])
            batch = batch[: same[0]] if len(same) else batch  # a batch lies in one layer
            self._insert(batch.astype(np.int64), int(level[batch[0]]))
            done += len(batch)

    def _insert(self, batch: np.ndarray, level: int) -> None:
        if batch[0] == self.entry:
            return
        q = self.x[batch]
        start = np.full(len(batch), self.entry, dtype=np.int64)
        for k in range(len(self.layers) - 1, -1, -1):
            if k > level:
                start = self._search_layer(q, start[:, None], k, 1)[0][:, 0]
                continue
            ids, sims = self._search_layer(q, start[:, None], k, self.beam)
            start = ids[:, 0]
            own = q @ q.T
            np.fill_diagonal(own, -2)
            ids = np.concatenate([ids, np.broadcast_to(batch, (len(batch), len(batch)))], axis=1)
            sims = np.concatenate([sims, own], axis=1)
            best = np.argsort(-sims, axis=1, kind="stable")[:, : self.beam]
            ids, sims = np.take_along_axis(ids, best, 1), np.take_along_axis(sims, best, 1)
            ids = np.where(sims > -2, ids, NONE)
            chosen = self._diverse(ids, sims, self.links)
            self.layers[k][batch, : self.links] = chosen
            self._back_links(batch, chosen, k)

    def _diverse(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Up to ``most`` of the candidates (in falling order of similarity) by the diversity rule, then the nearest of the rest."""
        n, width = ids.shape
        vectors = self.x[np.maximum(ids, 0)]
        among = np.einsum("nad,nbd->nab", vectors, vectors)
        taken = np.zeros((n, width), dtype=bool)
        count = np.zeros(n, dtype=np.int64)
        for c in range(width):
            close = np.where(taken, among[:, c, :], -2).max(axis=1)
            ok = (ids[:, c] >= 0) & (count < most) & (close <= sims[:, c])
            taken[:, c] = ok
            count += ok
        rank = np.where(taken, 0, np.where(ids >= 0, 1, 2)) * width + np.arange(width)
        order = np.argsort(rank, axis=1)[:, :most]
        out = np.full((n, most), NONE)
        picked = np.take_along_axis(ids, order, 1)
        out[:, : picked.shape[1]] = picked
        return out

    def _back_links(self, batch: np.ndarray, chosen: np.ndarray, k: int) -> None:
        layer = self.layers[k]
        source = np.repeat(batch, chosen.shape[1])
        target = chosen.ravel().astype(np.int64)
        use = target >= 0
        source, target = source[use], target[use]
        sims = np.einsum("nd,nd->n", self.x[source], self.x[target])
        order = np.lexsort((-sims, target))  # of a node's new links the most similar come first
        source, target = source[order], target[order]
        nodes, first, counts = np.unique(target, return_index=True, return_counts=True)
        limit = layer.shape[1] * 3
        new = np.full((len(nodes), min(int(counts.max(initial=0)), limit)), NONE)
        slot = np.arange(len(target)) - np.repeat(first, counts)
        fits = slot < new.shape[1]
        new[np.repeat(np.arange(len(nodes)), counts)[fits], slot[fits]] = source[fits]
        ids = np.concatenate([layer[nodes], new], axis=1)
        again = (ids[:, :, None] == ids[:, None, :]) & (np.arange(ids.shape[1])[None, :] < np.arange(ids.shape[1])[:, None])[None]
        ids = np.where(again.any(axis=2), NONE, ids)
        sims = np.where(ids >= 0, np.einsum("nwd,nd->nw", self.x[np.maximum(ids, 0)], self.x[nodes]), -2)
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        full = (ids >= 0).sum(axis=1) > layer.shape[1]
        out = np.full((len(nodes), layer.shape[1]), NONE)
        width = min(layer.shape[1], ids.shape[1])
        out[:, :width] = ids[:, :width]
        if full.any():
            out[full] = self._diverse(ids[full], sims[full], layer.shape[1])
        layer[nodes] = out

    def _search_layer(self, q: np.ndarray, start: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search of one layer for all queries at once: ids and similarities, best first; gaps are -1 and -2."""
        layer, n, m = self.layers[k], len(self.x), len(q)
        ids, sims = np.full((m, beam), NONE, dtype=np.int64), np.full((m, beam), -2.0, dtype=np.float32)
        open_ = np.zeros((m, beam), dtype=bool)
        seen = np.zeros((m, n), dtype=bool)
        ids[:, 0] = start[:, 0]
        sims[:, 0] = np.einsum("md,md->m", self.x[start[:, 0]], q)
        open_[:, 0] = True
        seen[np.arange(m), start[:, 0]] = True
        active = np.arange(m)
        while len(active):
            best = open_[active].argmax(axis=1)  # rows are sorted, so the first open one is the best
            has = open_[active, best]
            active, best = active[has], best[has]
            if not len(active):
                break
            node = ids[active, best]
            open_[active, best] = False
            near = layer[node].astype(np.int64)
            new = (near >= 0) & ~seen[active[:, None], np.maximum(near, 0)]
            rows, cols = np.nonzero(new)
            seen[active[rows], near[rows, cols]] = True
            found = np.full(near.shape, -2.0, dtype=np.float32)
            found[rows, cols] = np.einsum("rd,rd->r", self.x[near[rows, cols]], q[active[rows]])
            all_sims = np.concatenate([sims[active], found], axis=1)
            all_ids = np.concatenate([ids[active], np.where(new, near, NONE)], axis=1)
            all_open = np.concatenate([open_[active], new], axis=1)
            order = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
            sims[active] = np.take_along_axis(all_sims, order, 1)
            ids[active] = np.take_along_axis(all_ids, order, 1)
            open_[active] = np.take_along_axis(all_open, order, 1)
        return ids, sims

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` nearest nodes found for each query."""
        q = np.ascontiguousarray(q, dtype=np.float32)
        start = np.full(len(q), self.entry, dtype=np.int64)
        for k in range(len(self.layers) - 1, 0, -1):
            start = self._search_layer(q, start[:, None], k, 1)[0][:, 0]
        return self._search_layer(q, start[:, None], 0, beam)

    def within(self, q: np.ndarray, least: float, beam: int, slack: float = 1e-4) -> list[np.ndarray]:
        """For each query the nodes found at ``least`` or above. A beam that is full of such nodes is
        widened four times, then gives way to a product with all nodes of the graph."""
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(q)
        todo = np.arange(len(q))
        for width in (beam, 4 * beam):
            if len(todo) and width < len(self.x):
                full = []
                for at in range(0, len(todo), 256):
                    part = todo[at : at + 256]
                    ids, sims = self.search(q[part], width)
                    good = sims >= least - slack
                    full.append(part[good.all(axis=1)])
                    for i, row, g in zip(part.tolist(), ids, good, strict=True):
                        out[i] = row[g]
                todo = np.concatenate(full)
        if len(self.x) <= 4 * beam and len(self.x) <= beam:
            todo = np.arange(len(q))
        step = max(1, 4_000_000 // max(1, len(self.x)))
        for at in range(0, len(todo), step):
            part = todo[at : at + step]
            good = q[part].astype(np.float32) @ self.x.T >= least - slack
            for i, g in zip(part.tolist(), good, strict=True):
                out[i] = np.flatnonzero(g)
        return out
