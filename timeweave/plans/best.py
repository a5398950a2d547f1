"""What a task keeps of a search: the best hits of each query, in the videos that it may see."""

from __future__ import annotations

import numpy as np


class Best:
    """The ``limit`` least distances of each query so far, ties by id. What is added is settled after each of
    the ``first`` times, then whenever ``most`` candidates wait. With ``bounds`` (a distance and an id a
    query) only what comes before these is kept."""

    def __init__(self, queries: int, limit: int, most: int = 1 << 20, first: int = 4, bounds: tuple[np.ndarray, np.ndarray] | None = None):
        self.limit, self.most, self.first, self.bounds = limit, most, first, bounds
        self.reach = np.full(queries, np.inf) if bounds is None else bounds[0].copy()
        self.query, self.id, self.distance = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        self.parts: list[tuple] = []
        self.waiting = 0

    def add(self, distances: np.ndarray, ids: np.ndarray, queries: np.ndarray | None = None) -> None:
        """Distances of some queries (a row each; all, if it is None) to some chunks, infinite where a
        chunk is out of scope."""
        queries = np.arange(len(self.reach)) if queries is None else queries
        near = (distances <= self.reach[queries][:, None]) & np.isfinite(distances)
        many = np.flatnonzero(near.sum(axis=1) > self.limit)
        if len(many):
            last = np.partition(distances[many], self.limit - 1, axis=1)[:, self.limit - 1]
            near[many] &= distances[many] <= last[:, None]
        rows, columns = np.nonzero(near)
        self.parts.append((queries[rows], ids[columns], distances[rows, columns]))
        self.waiting += len(rows)
        self.first -= 1
        if self.waiting > self.most or (self.first >= 0 and self.waiting):
            self.settle()

    def settle(self) -> Best:
        query, found, near = (np.concatenate(c) for c in zip((self.query, self.id, self.distance), *self.parts, strict=True))
        self.parts, self.waiting = [], 0
        if self.bounds is not None:
            far, last = (b[query] for b in self.bounds)
            before = (near < far) | (near == far) & (found < last)
            query, found, near = query[before], found[before], near[before]
        order = np.lexsort((found, near, query))
        query, found, near = query[order], found[order], near[order]
        first = np.searchsorted(query, np.arange(len(self.reach)))
        keep = np.arange(len(query)) - first[query] < self.limit
        self.query, self.id, self.distance = query[keep], found[keep], near[keep]
        full = np.bincount(self.query, minlength=len(self.reach)) >= self.limit  # never farther than the bounds
        last = np.searchsorted(self.query, np.arange(len(self.reach)), "right") - 1
        self.reach[full] = self.distance[last[full]]
        return self


def bounds_of(ids: np.ndarray, rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """For queries ``ids``, in order, the distance and the id of hits (query_id, distance, id), endless where there is none."""
    far, last = np.full(len(ids), np.inf), np.full(len(ids), np.iinfo(np.int64).max)
    for query, distance, found in rows:
        at = np.searchsorted(ids, query)
        far[at], last[at] = distance, found
    return far, last


def share(tasks: int) -> int:
    """Of how many parts of the rows the first is searched for bounds: with its tasks and what then lies within
    the bounds, about 2 sqrt(tasks) lists of hits a query are shuffled, and not one a task."""
    return max(1, round(tasks**0.5))


class Scopes:
    """Which videos each query may see: sorted (query, video) pairs of those that have a scope."""

    def __init__(self, scopes: list):
        self.free = np.array([v is None for v in scopes], bool)
        pairs = [(i, v) for i, own in enumerate(scopes) for v in own or []]
        self.videos, place = np.unique(np.array([v for _, v in pairs], np.int64), return_inverse=True)
        order = np.lexsort(([i for i, _ in pairs], place)) if pairs else np.empty(0, np.intp)
        self.place, self.query = place[order], np.array([i for i, _ in pairs], np.intp)[order]

    def allow(self, videos: np.ndarray) -> np.ndarray:
        """A row for each query and a column for each video."""
        out = np.repeat(self.free[:, None], len(videos), axis=1)
        if len(self.videos):
            at = np.minimum(np.searchsorted(self.videos, videos), len(self.videos) - 1)
            known = np.flatnonzero(self.videos[at] == videos)
            first, last = np.searchsorted(self.place, at[known]), np.searchsorted(self.place, at[known], "right")
            column = np.repeat(known, last - first)
            row = self.query[np.arange(len(column)) - np.repeat(np.cumsum(last - first) - (last - first), last - first) + np.repeat(first, last - first)]
            out[row, column] = True
        return out
