"""Direct solution of sparse symmetric systems over a graph of places.

Places are numbered by their distance from an outer place, so that entries join
only equal or adjacent levels: the matrix is block tridiagonal, and its Cholesky
factor, its determinant and the diagonal of its inverse cost one small dense step a
block.
"""

from __future__ import annotations

import numpy as np

from spotweave.blas import one_thread

one_thread()

#: Rows a block has at least (levels are joined up to there).
BLOCK_ROWS = 32
#: Entries that all blocks of a factor may hold (8 bytes each, twice).
BLOCK_ENTRIES = 1 << 26


def _reach(head: np.ndarray, col: np.ndarray, start: int, seen: np.ndarray, mark: int) -> list[np.ndarray]:
    """Levels of the places reachable from ``start``."""
    level, out = np.array([start]), []
    seen[start] = mark
    while len(level):
        out.append(level)
        size = head[level + 1] - head[level]
        at = np.repeat(head[level] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        near = np.unique(col[at])
        level = near[seen[near] != mark]
        seen[level] = mark
    return out


def levels(row: np.ndarray, col: np.ndarray, n: int) -> list[np.ndarray]:
    """Groups of places, all entries (row, col) within one or between neighbours
    in the list. ``row`` is sorted."""
    head = np.searchsorted(row, np.arange(n + 1))
    degree = np.diff(head)
    seen, done, out, mark = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool), [], 0
    for start in np.argsort(degree, kind="stable"):
        if done[start]:
            continue
        far = start
        for _ in range(3):
            mark += 1
            found = _reach(head, col, far, seen, mark)
            far = found[-1][np.argmin(degree[found[-1]])]
            if len(found) < 3:
                break
        for level in found:
            done[level] = True
        out += found
    return out


class Blocks:
    """A symmetric matrix as dense blocks along its diagonal (``diag``) and below
    it (``low``); ``order`` lists the places block by block."""

    def __init__(self, row: np.ndarray, col: np.ndarray, v: np.ndarray, n: int, rows: int = BLOCK_ROWS):
        parts, size = [], rows
        for level in levels(row, col, n):
            if size >= rows:
                parts.append([])
                size = 0
            parts[-1].append(level)
            size += len(level)
        members = [np.concatenate(p) for p in parts]
        self.sizes = np.array([len(m) for m in members])
        self.order = np.concatenate(members)
        self.edge = np.concatenate(([0], np.cumsum(self.sizes)))
        self.diag, self.low = None, None
        if (self.sizes.astype(float) ** 2).sum() > BLOCK_ENTRIES:
            return
        at = np.empty(n, dtype=np.int64)
        at[self.order] = np.arange(n)
        of = np.repeat(np.arange(len(members)), self.sizes)
        i, j = at[row], at[col]
        self.diag = [np.zeros((k, k)) for k in self.sizes]
        self.low = [np.zeros((k, m)) for k, m in zip(self.sizes[1:], self.sizes[:-1], strict=True)]
        by = np.argsort(of[i], kind="stable")
        cut = np.searchsorted(of[i[by]], np.arange(len(members) + 1))
        for b in range(len(members)):
            here = by[cut[b] : cut[b + 1]]
            same, below = here[of[j[here]] == b], here[of[j[here]] == b - 1]
            np.add.at(self.diag[b], (i[same] - self.edge[b], j[same] - self.edge[b]), v[same])
            if b:
                np.add.at(self.low[b - 1], (i[below] - self.edge[b], j[below] - self.edge[b - 1]), v[below])


class Factor:
    """Cholesky factor of scale * matrix (x) I_p plus a p x p matrix at each place."""

    def __init__(self, blocks: Blocks, p: int = 1, scale: float = 1.0, own: np.ndarray | None = None):
        self.blocks, self.p = blocks, p
        self.root, self.low, self.logdet = [], [], 0.0
        one = np.eye(p)
        for b, (lo, k) in enumerate(zip(blocks.edge[:-1], blocks.sizes, strict=True)):
            a = np.kron(blocks.diag[b], scale * one) if p > 1 else scale * blocks.diag[b]
            if own is not None:
                a.reshape(k, p, k, p)[np.arange(k), :, np.arange(k), :] += own[blocks.order[lo : lo + k]]
            if b:
                a = a - self.low[-1] @ self.low[-1].T
            c = np.linalg.cholesky(a)
            self.logdet += 2 * float(np.log(np.diag(c)).sum())
            self.root.append(np.linalg.inv(c))
            if b + 1 < len(blocks.sizes):
                low = np.kron(blocks.low[b], scale * one) if p > 1 else scale * blocks.low[b]
                self.low.append(low @ self.root[-1].T)

    def solve(self, x: np.ndarray) -> np.ndarray:
        """Solutions for right sides of shape (places, m), or (places, p, m)."""
        order, edge = self.blocks.order, self.blocks.edge * self.p
        y = x[order].reshape(edge[-1], -1)
        parts = [y[lo:hi] for lo, hi in zip(edge[:-1], edge[1:], strict=True)]
        for b, root in enumerate(self.root):
            parts[b] = root @ (parts[b] - self.low[b - 1] @ parts[b - 1] if b else parts[b])
        for b in range(len(parts) - 1, -1, -1):
            parts[b] = self.root[b].T @ (parts[b] - self.low[b].T @ parts[b + 1] if b + 1 < len(parts) else parts[b])
        out = np.empty(x.shape)
        out[order] = np.concatenate(parts).reshape(x.shape)
        return out

    def power_traces(self, weight: np.ndarray) -> np.ndarray:
        """tr (W^1/2 M^-1 W^1/2)^p, p = 1..4, for the factor of M alone and a
        diagonal W >= 0: the terms of ln det(M + tW) as a series in t, block by
        block (in each, terms have one sign, so that none cancel)."""
        out, order, edge = np.zeros(5), self.blocks.order, self.blocks.edge
        v: list[np.ndarray] = []
        for b, root in enumerate(self.root):
            s = [np.zeros((len(root),) * 2) for _ in range(5)]
            if b:
                low = self.blocks.low[b - 1]
                for m in range(1, 5):
                    s[m] = -(low @ v[m] @ low.T)
            s[1] = s[1] + np.diag(weight[order[edge[b] : edge[b + 1]]])
            v = [root.T @ root]
            for m in range(1, 5):
                out[m] += sum(i * float((s[i] * v[m - i]).sum()) for i in range(1, m + 1))
                v.append(-v[0] @ sum(s[i] @ v[m - i] for i in range(1, m + 1)))
        return out[1:] * np.array([1.0, -1.0, 1.0, -1.0])

    def inverse_diagonal(self) -> np.ndarray:
        out, inner = np.empty(self.blocks.edge[-1] * self.p), None
        for b in range(len(self.root) - 1, -1, -1):
            root = self.root[b]
            mid = root.T @ root
            if inner is not None:
                g = self.low[b] @ root
                mid = mid + g.T @ inner @ g
            inner = mid
            at = self.blocks.edge[b] * self.p
            out[at : at + len(mid)] = np.diag(mid)
        back = np.empty((len(self.blocks.order), self.p))
        back[self.blocks.order] = out.reshape(-1, self.p)
        return back if self.p > 1 else back[:, 0]
