"""Plan-time search on the driver, over metadata only: assignment of slots, and beams of outputs."""

from __future__ import annotations

import heapq
import math


def assignment(scores: list[list[float]]) -> list[int]:
    """The column for each row that makes the sum of scores largest (rows no more than columns);
    shortest augmenting paths with potentials."""
    rows, cols = len(scores), len(scores[0]) if scores else 0
    if rows > cols:
        raise ValueError("more slots than candidates")
    row_price, col_price, owner = [0.0] * (rows + 1), [0.0] * (cols + 1), [0] * (cols + 1)
    for r in range(1, rows + 1):
        owner[0], at = r, 0
        slack, came, done = [math.inf] * (cols + 1), [0] * (cols + 1), [False] * (cols + 1)
        while owner[at]:
            done[at], best, nxt = True, math.inf, 0
            for c in range(1, cols + 1):
                if done[c]:
                    continue
                reduced = -scores[owner[at] - 1][c - 1] - row_price[owner[at]] - col_price[c]
                if reduced < slack[c]:
                    slack[c], came[c] = reduced, at
                if slack[c] < best:
                    best, nxt = slack[c], c
            for c in range(cols + 1):
                if done[c]:
                    row_price[owner[c]] += best
                    col_price[c] -= best
                else:
                    slack[c] -= best
            at = nxt
        while at:
            owner[at] = owner[came[at]]
            at = came[at]
    out = [0] * rows
    for c in range(1, cols + 1):
        if owner[c]:
            out[owner[c] - 1] = c - 1
    return out


def best_sequences(options: list[list[tuple[str, float]]], width: int) -> list[tuple[float, tuple[str, ...]]]:
    """The ``width`` best sequences that take a different output at each position, from the first on,
    by the sum of scores; ties by the sequence."""
    beam: list[tuple[float, tuple[str, ...]]] = [(0.0, ())]
    for step in options:
        grown = [(s + x, (*names, name)) for s, names in beam for name, x in step if name not in names]
        beam = heapq.nsmallest(width, grown, key=lambda p: (-p[0], p[1]))
    return beam
