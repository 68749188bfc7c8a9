"""Sizes of work units for dense columns."""

from __future__ import annotations

import os

#: Live bytes and response columns of one unit of work.
BUDGET, MOST_COLUMNS = 2 << 30, 32


def chunk_columns(n_places: int, copies: int = 3, budget: int = BUDGET, most: int = MOST_COLUMNS) -> int:
    """Columns of doubles, each held ``copies`` times, that fit the budget."""
    if n_places < 1:
        raise ValueError("there must be places")
    return max(1, min(most, budget // (8 * copies * n_places)))


def pack(widths: list[int], cap: int) -> list[list[int]]:
    """Consecutive groups packed greedily into units of at most ``cap`` columns;
    a group is never split, so a wider one stands alone."""
    units: list[list[int]] = []
    used = cap + 1
    for i, w in enumerate(widths):
        if used + w > cap:
            units.append([])
            used = 0
        units[-1].append(i)
        used += w
    return units


def workers(n_jobs: int) -> int:
    """Positive counts as they are, -1 for all cores, -2 for all but one, ..."""
    if n_jobs == 0:
        raise ValueError("n_jobs can't be 0")
    cores = os.cpu_count() or 1
    return n_jobs if n_jobs > 0 else max(1, cores + 1 + n_jobs)


def response_width(kind: str, n_isos: int) -> int:
    return 1 if kind == "gc" else n_isos
