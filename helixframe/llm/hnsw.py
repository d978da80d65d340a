"""Hierarchical navigable small-world graphs, built and searched in numpy batches.

Nearness is squared Euclidean distance, held as the score ``2 x.q - |x|^2``
(larger is nearer), which on unit vectors orders as the cosine does.  Nodes are
renumbered so that each layer is a prefix of the node array.
"""

from __future__ import annotations

import io

import numpy as np

#: Nodes that join a layer in one step; they also see each other exactly.
STEP = 512


def _scores(x: np.ndarray, half: np.ndarray, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Scores of (rows, k) ids against (rows, d) queries; id -1 scores -inf."""
    out = np.matmul(x[ids], q[:, :, None])[:, :, 0] - half[ids]
    out[ids < 0] = -np.inf
    return out


class Graph:
    def __init__(self, x: np.ndarray, m: int = 12, ef: int = 64, seed: int = 5):
        """Build over the rows of ``x``; ``m`` links a node (twice that on the lowest layer)."""
        n = len(x)
        levels = np.floor(-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(m)).astype(int)
        self.order = np.argsort(-levels, kind="stable")
        self.x = np.ascontiguousarray(x[self.order], np.float32)
        self.half = (self.x * self.x).sum(1) / 2
        counts = np.bincount(levels, minlength=1)[::-1].cumsum()[::-1] if n else np.zeros(1, int)
        self.layers: list[np.ndarray] = [None] * len(counts)
        for level in range(len(counts) - 1, -1, -1):
            self._build(level, int(counts[level]), 2 * m if level == 0 else m, ef)

    def _build(self, level: int, n: int, m: int, ef: int) -> None:
        links = np.full((n, m), -1, np.int32)
        self.layers[level] = links
        done = 0
        while done < n:
            end = min(n, done + min(STEP, max(done, 64)))
            ids = np.arange(done, end)
            q = self.x[ids]
            own = q @ q.T - self.half[ids][None, :]
            np.fill_diagonal(own, -np.inf)
            k = min(ef, len(ids) - 1)
            near = np.argpartition(-own, k - 1, axis=1)[:, :k] if k > 0 else np.zeros((len(ids), 0), int)
            found, score = (ids[near] if k > 0 else near), np.take_along_axis(own, near, 1)
            if done:
                start = self._descend(q, level)
                start[start >= done] = 0  # not yet in this layer
                f, s = self._beam(links[:done], q, start, ef)
                found, score = np.concatenate([found, f], 1), np.concatenate([score, s], 1)
            if found.shape[1]:
                links[ids] = self._select(q, found, score, m)
                self._link_back(links, ids, m)
            done = end

    def _select(self, q: np.ndarray, found: np.ndarray, score: np.ndarray, m: int) -> np.ndarray:
        """Spread-out neighbours: one that is nearer to a chosen one than to the node waits until last."""
        order = np.argsort(-score, axis=1, kind="stable")[:, : 3 * m]
        found, score = np.take_along_axis(found, order, 1), np.take_along_axis(score, order, 1)
        valid = (found >= 0) & np.isfinite(score)
        x = self.x[found]
        half = self.half[found]
        # |a-b|^2 / 2 of candidate pairs, and of node and candidate
        apart = half[:, :, None] + half[:, None, :] - np.matmul(x, x.transpose(0, 2, 1))
        away = half + (q * q).sum(1)[:, None] / 2 - np.matmul(x, q[:, :, None])[:, :, 0]
        rows = np.arange(len(q))
        open_, chosen = valid.copy(), np.zeros_like(valid)
        for _ in range(m):
            pick = open_.argmax(1)
            has = open_[rows, pick]
            if not has.any():
                break
            chosen[rows[has], pick[has]] = True
            open_ &= ~((apart[rows, pick] < away) & has[:, None])
            open_[rows, pick] = False
        rank = np.where(chosen, 0, np.where(valid, 1, 2))
        best = np.argsort(rank, axis=1, kind="stable")[:, :m]
        out = np.where(np.take_along_axis(valid, best, 1), np.take_along_axis(found, best, 1), -1)
        if out.shape[1] < m:
            out = np.pad(out, ((0, 0), (0, m - out.shape[1])), constant_values=-1)
        return out.astype(np.int32)

    def _link_back(self, links: np.ndarray, ids: np.ndarray, m: int) -> None:
        to = links[ids]
        src = np.repeat(ids, to.shape[1])[to.ravel() >= 0]
        dst = to.ravel()[to.ravel() >= 0]
        score = np.einsum("nd,nd->n", self.x[src], self.x[dst]) - self.half[src]
        order = np.lexsort((-score, dst))
        src, dst = src[order], dst[order]
        heads, first, size = np.unique(dst, return_index=True, return_counts=True)
        place = np.arange(len(dst)) - np.repeat(first, size)
        near = place < m  # a node can keep no more than m anyway
        new = np.full((len(heads), m), -1, np.int64)
        new[np.repeat(np.arange(len(heads)), size)[near], place[near]] = src[near]
        for a in range(0, len(heads), STEP):
            h = heads[a : a + STEP]
            both = np.concatenate([links[h], new[a : a + STEP]], 1)
            both = -np.sort(-both, axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            links[h] = self._select(self.x[h], both, _scores(self.x, self.half, self.x[h], both), m)

    def _descend(self, q: np.ndarray, level: int) -> np.ndarray:
        """An entry node for each query, found greedily in the layers above ``level``."""
        start = np.zeros((len(q), 1), np.int64)
        for above in range(len(self.layers) - 1, level, -1):
            f, s = self._beam(self.layers[above], q, start, 4)
            start = f[np.arange(len(q)), s.argmax(1)][:, None]
        return start

    def _beam(self, links: np.ndarray, q: np.ndarray, start: np.ndarray, ef: int, at_once: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of each query's beam, unordered; free places have id -1."""
        b, n = len(q), len(links)
        ef = min(ef, n)
        ids = np.full((b, ef), -1, np.int64)
        score = np.full((b, ef), -np.inf, np.float32)
        e = min(start.shape[1], ef)
        ids[:, :e] = start[:, :e]
        score[:, :e] = _scores(self.x, self.half, q, ids[:, :e])
        seen = np.zeros((b, n), bool)
        np.put_along_axis(seen, np.maximum(ids[:, :e], 0), True, 1)
        todo = ids >= 0
        live = np.arange(b)
        while len(live):
            s = np.where(todo[live], score[live], -np.inf)
            k = min(at_once, ef)
            pick = np.argpartition(-s, k - 1, axis=1)[:, :k]
            good = np.isfinite(np.take_along_axis(s, pick, 1))
            going = good.any(1)
            live, pick, good = live[going], pick[going], good[going]
            if not len(live):
                break
            r = live[:, None]
            node = np.where(good, ids[r, pick], -1)
            todo[r, pick] = False
            near = np.where((node >= 0)[:, :, None], links[node], -1).reshape(len(live), -1).astype(np.int64)
            near.sort(axis=1)
            fresh = near >= 0
            fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
            fresh &= ~seen[r, near]
            keep = fresh.any(0)
            near, fresh = np.where(fresh, near, -1)[:, keep], fresh[:, keep]
            if not near.shape[1]:
                continue
            rr = np.broadcast_to(r, near.shape)[fresh]
            seen[rr, near[fresh]] = True
            value = np.full(near.shape, -np.inf, np.float32)
            at = np.nonzero(fresh)
            value[fresh] = np.einsum("nd,nd->n", self.x[near[fresh]], q[live[at[0]]]) - self.half[near[fresh]]
            all_ids = np.concatenate([ids[live], near], 1)
            all_score = np.concatenate([score[live], value], 1)
            all_todo = np.concatenate([todo[live], fresh], 1)
            top = np.argpartition(-all_score, ef - 1, axis=1)[:, :ef]
            ids[live], score[live], todo[live] = (np.take_along_axis(x, top, 1) for x in (all_ids, all_score, all_todo))
            todo[live] &= np.isfinite(score[live])
        return ids, score

    def search(self, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """(row numbers, scores) of the ``ef`` nodes found for each query, nearest first; -1 where fewer were found."""
        q = np.ascontiguousarray(q, np.float32)
        if not len(self.x):
            return np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0), np.float32)
        out, val = [], []
        for a in range(0, len(q), STEP):
            f, s = self._beam(self.layers[0], q[a : a + STEP], self._descend(q[a : a + STEP], 0), ef)
            order = np.argsort(-s, axis=1, kind="stable")
            f, s = np.take_along_axis(f, order, 1), np.take_along_axis(s, order, 1)
            out.append(np.where(f >= 0, self.order[f], -1))
            val.append(s)
        return np.concatenate(out), np.concatenate(val)

    def to_bytes(self) -> bytes:
        """Links and order alone; the vectors are stored once, beside them."""
        f = io.BytesIO()
        np.savez(f, order=self.order.astype(np.int32), **{f"l{i}": x for i, x in enumerate(self.layers)})
        return f.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes, x: np.ndarray) -> Graph:
        own = cls.__new__(cls)
        with np.load(io.BytesIO(data)) as z:
            own.order = z["order"].astype(np.int64)
            own.layers = [z[f"l{i}"] for i in range(len(z.files) - 1)]
        own.x = np.ascontiguousarray(x[own.order], np.float32)
        own.half = (own.x * own.x).sum(1) / 2
        return own
