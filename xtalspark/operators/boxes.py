"""Sums over the points whose cubes meet a box, without making the pairs.

Coordinates become ranks among the frame's distinct ones, a box a range of ranks on each
axis. The points are read, not moved, in one of two ways:

Where two axes have few distinct pairs of ranks (Grid), a sweep along the third keeps the
number and sum at each pair, and prefix sums of them along the levels of a wavelet matrix
over the pairs, anew at each rank of that axis: a box costs a logarithm at both its ends.

Else (Points) the range on x is cut into dyadic blocks; in a level's blocks, points are
sorted by y, and a wavelet matrix over z counts and sums those of a range: a box costs a
product of logarithms of the number of distinct coordinates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import frame_batches, frame_rows, store

# Boxes worked on at once, first points (by falling id) tried one by one, points in a leaf, entries of a table.
CHUNK = 450_000
TRIED = 4096
LEAF = 32
TABLE = 1 << 22
# Of a sweep: boxes held, boxes whose largest ids are sought at once, ranks on an axis and pairs of ranks, sums made in all.
SWEPT = 2_000_000
SLICE = 250_000
RANKS = (1 << 16) - 1
WORK = 6_000_000_000


class Grid:
    """A frame's points by the rank on one axis and the pair of ranks on the other two.

    ids rise, or are left out where they are the numbers from base on. A number and a sum are
    the parts of one complex number, exact below 2^53.
    """

    def __init__(self, values: list[np.ndarray], sweep: int, pairs: np.ndarray, base: int, ids: np.ndarray | None, x: np.ndarray, p: np.ndarray, reach: float):
        self.base, self.ids, self.x, self.p = base, ids, x, p
        self.axes = [sweep, *(k for k in range(3) if k != sweep)]
        # The range of ranks for a box that begins or ends at a rank.
        self.lowest = [np.searchsorted(v + reach, v, "left").astype(np.uint16) for v in values]
        self.highest = [np.searchsorted(v - reach, v, "right").astype(np.uint16) for v in values]
        self.sizes = [len(values[k]) for k in self.axes]
        self.y, self.z = ((r).astype(np.uint16) for r in np.divmod(pairs, self.sizes[2]))
        self.order = np.argsort(x, kind="stable").astype(np.int32)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(x, minlength=self.sizes[0]))])
        self.rows = np.searchsorted(self.y, np.arange(self.sizes[1] + 1))  # of the pairs from a rank of y on
        self._levels()

    @classmethod
    def read(cls, uri: str, frame: int, reach: float) -> Grid | None:
        """The frame's points, v and coordinates, of a stored table; None if they are too many or too different."""
        n, least, most, values = 0, np.iinfo(np.int64).max, np.iinfo(np.int64).min, [np.empty(0)] * 3
        for v, *at in frame_batches(uri, frame, "v", "x", "y", "z"):
            n, least, most = n + len(v), min(least, v.min()), max(most, v.max())
            values = [np.union1d(u, a) for u, a in zip(values, at)]
            if max(map(len, values)) > RANKS:
                return None
        if n == 0 or n >= 1 << 31 or n * max(abs(int(least)), abs(int(most))) >= 1 << 53:
            return None
        others = [[k for k in range(3) if k != sweep] for sweep in range(3)]
        pairs: dict[int, np.ndarray] = {s: np.empty(0, np.int64) for s in range(3)}
        ranks = lambda at: [np.searchsorted(u, a) for u, a in zip(values, at)]
        key = lambda r, s: r[others[s][0]] * len(values[others[s][1]]) + r[others[s][1]]
        for at in frame_batches(uri, frame, "x", "y", "z"):
            r = ranks(at)
            pairs = {s: u for s, p in pairs.items() if len(u := np.union1d(p, key(r, s))) <= RANKS and cls.work(len(values[s]), len(u), len(values[others[s][1]])) <= WORK}
        if not pairs:
            return None
        sweep = min(pairs, key=lambda s: cls.work(len(values[s]), len(pairs[s]), len(values[others[s][1]])))
        x, p, at = np.empty(n, np.uint16), np.empty(n, np.uint16), 0
        ids = None if most - least == n - 1 else np.empty(n, np.int64)
        seen = np.zeros(n if ids is None else 0, bool)
        for v, *c in frame_batches(uri, frame, "v", "x", "y", "z"):
            r = ranks(c)
            if ids is None:
                place = v - least
                seen[place] = True
            else:
                place = slice(at, at := at + len(v))
                ids[place] = v
            x[place], p[place] = r[sweep], np.searchsorted(pairs[sweep], key(r, sweep))
        if not seen.all():
            return None
        if ids is not None:
            by = np.argsort(ids, kind="stable")
            ids, x, p = ids[by], x[by], p[by]
        return cls(values, sweep, pairs[sweep], int(least), ids, x, p, reach)

    @staticmethod
    def digits(size: int) -> int:
        """Digits of two bits of the numbers up to size."""
        return (size.bit_length() + 1) // 2

    @classmethod
    def work(cls, steps: int, pairs: int, size: int) -> int:
        return steps * pairs * 3 * cls.digits(size)

    def _levels(self) -> None:
        """Of each level of digits of z: where a place among the pairs (by y at first) leads for each digit, and
        of the pairs before it those of a smaller digit."""
        m, depth = len(self.y), self.digits(self.sizes[2])
        self.shifts, order = [2 * (depth - 1 - t) for t in range(depth)], np.arange(m)
        self.next, self.smaller = np.zeros((depth, 4, m + 1), np.int64), np.full((depth, 3, m), m, np.int64)
        for t, shift in enumerate(self.shifts):
            digit, before = (self.z[order] >> shift) & 3, 0
            for d in range(4):
                self.next[t, d, 1:] = np.cumsum(digit == d)
                self.next[t, d] += before
                before = self.next[t, d, -1]
            for d in range(3):
                self.smaller[t, d] = np.where(digit <= d, order, m)
            order = order[np.argsort(digit, kind="stable")]

    def boxes(self, corners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(known, ranges): for corners (m, 4) the rows of known points, and the first and last ranks
        on each axis (6, known)."""
        if self.ids is None:
            place = corners - self.base
            known = ((place >= 0) & (place < len(self.x))).all(1)
        else:
            place = np.minimum(np.searchsorted(self.ids, corners), len(self.ids) - 1)
            known = (self.ids[place] == corners).all(1)
        place = place[known]
        p = self.p[place]
        ends = []
        for k, r in zip(self.axes, (self.x[place], self.y[p], self.z[p])):
            ends += [self.lowest[k][r.min(1)], self.highest[k][r.max(1)]]
        return known, np.stack(ends) if len(place) else np.empty((6, 0), np.uint16)

    def number(self, place: np.ndarray) -> np.ndarray:
        return place + self.base if self.ids is None else self.ids[place]

    def totals(self, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number, sum and largest of the ids in the ranges; the largest only where there are some."""
        sums = self._sums(ends)
        n, total, best = sums.real.astype(np.int64), sums.imag.astype(np.int64), np.zeros(len(sums), np.int64)
        del sums
        for i in range(0, len(n), SLICE):
            part = slice(i, i + SLICE)
            best[part] = self._largest(ends[:, part], n[part] > 0)
        return n, total, best

    def _sums(self, ends: np.ndarray) -> np.ndarray:
        out, m, depth = np.zeros(ends.shape[1], np.complex128), len(self.y), len(self.shifts)
        weights, sums, parts = np.zeros(m + 1, np.complex128), np.zeros((depth, 4, m + 1), np.complex128), np.empty((depth, 3, m), np.complex128)
        flat, ways, width, done = sums.reshape(depth, -1), self.next.reshape(depth, -1), np.int64(m + 1), 0
        sides = [(np.argsort(e, kind="stable").astype(np.int32), np.concatenate([[0], np.cumsum(np.bincount(e, minlength=self.sizes[0] + 1))]), sign) for e, sign in ((ends[0], -1), (ends[1], 1))]
        for at in range(1, self.sizes[0] + 1):
            asked = [(order[starts[at] : starts[at + 1]], sign) for order, starts, sign in sides]
            if not any(len(q) for q, _ in asked):
                continue
            come = self.order[self.starts[done] : self.starts[at]]
            to, done = self.p[come], at
            weights[:m] += np.bincount(to, minlength=m) + 1j * np.bincount(to, self.number(come.astype(np.int64)).astype(float), m)
            np.take(weights, self.smaller, out=parts)
            np.cumsum(parts, axis=-1, out=sums[:, 1:, 1:])
            for q, sign in asked:
                for q in np.array_split(q, 1 + len(q) // 100_000):
                    zs = ends[4:, q].astype(np.int64)[:, None]
                    place = np.repeat(self.rows[ends[2:4, q]][None], 2, 0)
                    total = np.zeros(place.shape, np.complex128)
                    for t, shift in enumerate(self.shifts):
                        place += ((zs >> shift) & 3) * width
                        total += flat[t].take(place)
                        place = ways[t].take(place)
                    out[q] += sign * (total[1, 1] - total[1, 0] - total[0, 1] + total[0, 0])
        return out

    def _largest(self, ends: np.ndarray, some: np.ndarray) -> np.ndarray:
        """The largest id in each range that has some: points are tried by falling id, one against all open
        ranges, then many against the few left."""
        best, rest = np.zeros(ends.shape[1], np.int64), np.flatnonzero(some)
        own, at, n = np.ascontiguousarray(ends[:, rest]), 0, len(self.x)
        while len(rest) > 1000 and at < n:
            place = np.arange(n - 1 - at, max(n - 17 - at, -1), -1)
            p, open_ = self.p[place], np.ones(len(rest), bool)
            for v, r in zip(self.number(place), np.stack([self.x[place], self.y[p], self.z[p]], 1)):
                hit = open_.copy()
                for k in range(3):
                    hit &= own[2 * k] <= r[k]
                    hit &= own[2 * k + 1] > r[k]
                best[rest[hit]] = v
                open_ &= ~hit
            rest, own, at = rest[open_], own[:, open_], at + len(place)
        for i in rest:
            b, to = ends[:, i], n - at
            while to > 0:
                span = slice(max(0, to - (1 << 16)), to)
                p = self.p[span]
                y, z, x = self.y[p], self.z[p], self.x[span]
                hit = (x >= b[0]) & (x < b[1]) & (y >= b[2]) & (y < b[3]) & (z >= b[4]) & (z < b[5])
                if hit.any():
                    best[i] = self.number(span.start + np.flatnonzero(hit)[-1])
                    break
                to = span.start
        return best


class Points:
    """A frame's points, ids (n) and coordinates (n, 3), for boxes that their cubes of half edge reach meet."""

    def __init__(self, ids: np.ndarray, at: np.ndarray, reach: float):
        down = np.argsort(ids)[::-1]
        self.ids, self.reach, self.tree = ids[down], reach, None
        self.values, ranks = zip(*(np.unique(at[down, k], return_inverse=True) for k in range(3)))
        self.ranks = np.stack([r.astype(np.int32) for r in ranks], 1)

    def totals(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number, sum and largest of the ids for closed boxes (m, 3); the largest only where there are some."""
        first = np.stack([np.searchsorted(v + self.reach, lo[:, k], "left") for k, v in enumerate(self.values)], 1).astype(np.int32)
        last = np.stack([np.searchsorted(v - self.reach, hi[:, k], "right") for k, v in enumerate(self.values)], 1).astype(np.int32)
        last = np.maximum(first, last)
        n, total = self._sums(first, last)
        return n, total, self._largest(first, last, n > 0)

    def _sums(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, total = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        l, r, k = first[:, 0].copy(), last[:, 0].copy(), 0
        while (l < r).any():
            left, right = (l < r) & (l & 1 == 1), (l < r) & (r & 1 == 1)
            rows = np.concatenate([np.flatnonzero(left), np.flatnonzero(right)])
            if len(rows):
                self._block_sums(k, np.concatenate([l[left], r[right] - 1]), rows, first, last, n, total)
            l, r, k = (l + left) >> 1, (r - right) >> 1, k + 1
        return n, total

    def _block_sums(self, k: int, block: np.ndarray, rows: np.ndarray, first: np.ndarray, last: np.ndarray, n: np.ndarray, total: np.ndarray) -> None:
        """Add to n and total what the boxes of rows have in the given blocks of 2^k ranks of x."""
        ny, nz = len(self.values[1]), len(self.values[2])
        size = (((len(self.values[0]) - 1) >> k) + 1) * ny
        whole = np.int32 if size < 1 << 31 else np.int64
        key = (self.ranks[:, 0] >> k).astype(whole) * whole(ny) + self.ranks[:, 1]
        order = np.argsort(key).astype(np.int32)
        ends = [block.astype(whole) * whole(ny) + e[rows, 1] for e in (first, last)]
        if size <= TABLE:
            upto = np.concatenate([[0], np.cumsum(np.bincount(key, minlength=size), dtype=np.int32)])
            l, r = (upto[e].astype(np.int32) for e in ends)
        else:
            l, r = (np.searchsorted(key[order], e).astype(np.int32) for e in ends)
        del key, ends
        some = np.flatnonzero(l < r)
        some = some[np.argsort(l[some])]  # neighbours in order read neighbours
        rows, l, r = rows[some], l[some], r[some]
        z = np.concatenate([last[rows, 2], first[rows, 2]])
        l, r = np.concatenate([l, l]), np.concatenate([r, r])
        number, summed = np.zeros(len(z), np.int64), np.zeros(len(z), np.int64)
        zs, ids = self.ranks[order, 2], self.ids[order]
        for bit in range(nz.bit_length() - 1, -1, -1):
            one = (zs >> bit) & 1 == 1
            ones = np.concatenate([[0], np.cumsum(one, dtype=np.int32)]).astype(np.int32)
            order = np.concatenate([np.flatnonzero(~one), np.flatnonzero(one)])
            zs, ids = zs[order], ids[order]
            before = np.concatenate([[0], np.cumsum(ids)])
            l1, r1 = ones[l], ones[r]
            l0, r0 = l - l1, r - r1
            up = (z >> bit) & 1 == 1
            at, zeros = np.flatnonzero(up), np.int32(len(zs) - ones[-1])
            a, b = l0[at], r0[at]
            number[at] += b - a
            summed[at] += before[b] - before[a]
            l0[at], r0[at] = zeros + l1[at], zeros + r1[at]
            l, r = l0, r0
        half = len(rows)
        np.add.at(n, rows, number[:half] - number[half:])
        np.add.at(total, rows, summed[:half] - summed[half:])

    def _largest(self, first: np.ndarray, last: np.ndarray, some: np.ndarray) -> np.ndarray:
        """The largest id in each box that has some: the first of the points by falling id, else by the tree."""
        best, rest, at, width = np.zeros(len(first), np.int64), np.flatnonzero(some), 0, 64
        while len(rest) and at < min(TRIED, len(self.ids)):
            p, left = self.ranks[at : at + width], []
            for part in np.array_split(rest, 1 + len(rest) * width // 4_000_000):
                hit = np.ones((len(part), len(p)), bool)
                for k in range(3):
                    hit &= (p[:, k] >= first[part, k, None]) & (p[:, k] < last[part, k, None])
                found, place = hit.any(1), hit.argmax(1)
                best[part[found]] = self.ids[at + place[found]]
                left.append(part[~found])
            rest, at, width = np.concatenate(left), at + width, min(2 * width, 1024)
        for part in np.array_split(rest, 1 + len(rest) // 2000) if len(rest) else []:
            best[part] = self._by_tree(first[part], last[part])
        return best

    def _levels(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Lowest and highest ranks and best place (by falling id) of the nodes of a tree of halves, the root
        first; the last level are the points."""
        depth = max(0, (len(self.ids) - 1) // LEAF).bit_length()
        size = LEAF << depth
        order = np.arange(size)
        own = np.concatenate([self.ranks, np.full((size - len(self.ids), 3), -1, np.int32)])
        for t in range(depth):
            nodes = order.reshape(1 << t, -1)
            order = np.take_along_axis(nodes, own[nodes, t % 3].argsort(1), 1).ravel()
        real, p = order < len(self.ids), own[order]
        low, high, place = np.where(real[:, None], p, np.iinfo(np.int32).max), p, order
        levels = [(low, high, place)]
        for t in range(depth, -1, -1):
            low, high, place = low.reshape(1 << t, -1, 3).min(1), high.reshape(1 << t, -1, 3).max(1), place.reshape(1 << t, -1).min(1)
            levels.append((low, high, place))
        return levels[::-1]

    def _by_tree(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        self.tree = self.tree or self._levels()
        best = np.full(len(first), len(self.ids))
        box, node = np.arange(len(first)), np.zeros(len(first), np.int64)
        for t, (low, high, place) in enumerate(self.tree):
            meets = (place[node] < best[box]) & (low[node] < last[box]).all(1) & (high[node] >= first[box]).all(1)
            box, node = box[meets], node[meets]
            inside = (low[node] >= first[box]).all(1) & (high[node] < last[box]).all(1)
            np.minimum.at(best, box[inside], place[node[inside]])
            box, node = box[~inside], node[~inside]
            if t + 1 < len(self.tree):
                ways = len(self.tree[t + 1][0]) // len(low)
                box, node = np.repeat(box, ways), (node[:, None] * ways + np.arange(ways)).ravel()
        return self.ids[best]


def cell_box_totals(cells: DataFrame, vertices: DataFrame, reach: float, key: str = "vh") -> DataFrame:
    """(frame_id, cell, n, total, last): for the bounding box of each cell's corners v0..v3 the
    number, the sum and the largest of the vertices whose cubes of half edge reach meet it.

    Cells that none meets, or with a corner of no known position, have no row. The vertices
    are stored once and read by every task; cells are not moved.
    """
    rows = vertices.select("frame_id", F.col(key).cast("bigint").alias("v"), "x", "y", "z").dropna()
    uri = store(rows)
    names = ["frame_id", "cell", "n", "total", "last"]

    def told(f: int, cell: np.ndarray, *sums: np.ndarray) -> Iterator[pa.RecordBatch]:
        some = np.flatnonzero(sums[0] > 0)
        for i in range(0, len(some), 100_000):
            part = some[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), f)), *(pa.array(x[part]) for x in (cell, *sums))], names)

    def by_points(f: int, t: pa.Table, kept: dict) -> Iterator[pa.RecordBatch]:
        if "points" not in kept:
            p = frame_rows(uri, f, "v", "x", "y", "z")
            v, at = p["v"].to_numpy(), np.stack([p[a].to_numpy() for a in "xyz"], 1)
            by = np.argsort(v)
            kept["points"] = v[by], at[by], Points(v, at, reach) if len(v) else None
        v, at, points = kept["points"]
        if points is None:
            return
        corners = np.stack([t[f"v{i}"].to_numpy() for i in range(4)], 1)
        place = np.minimum(np.searchsorted(v, corners), len(v) - 1)
        known = (v[place] == corners).all(1)
        p, cell = at[place[known]], t["cell"].to_numpy()[known]
        yield from told(f, cell, *points.totals(p.min(1), p.max(1)))

    def swept(kept: dict) -> Iterator[pa.RecordBatch]:
        if kept.get("held"):
            n, kept["held"] = kept["held"], 0
            yield from told(kept["frame"], kept["cell"][:n], *kept["grid"].totals(kept["ends"][:, :n]))

    def flush(batches: list[pa.RecordBatch], kept: dict) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        frame = t["frame_id"].to_numpy()
        for f in map(int, np.unique(frame)):
            if kept.get("frame") != f:
                yield from swept(kept)
                kept.clear()
                kept |= {"frame": f, "grid": Grid.read(uri, f, reach), "held": 0}
                pa.default_memory_pool().release_unused()
            own = t if (frame == f).all() else t.filter(pa.array(frame == f))
            if kept["grid"] is None:
                yield from by_points(f, own, kept)
                continue
            known, ends = kept["grid"].boxes(np.stack([own[f"v{i}"].to_numpy() for i in range(4)], 1))
            if "cell" not in kept or kept["held"] + ends.shape[1] > kept["ends"].shape[1]:
                yield from swept(kept)
                # Room for a sweep only where there is more than one chunk.
                room = max(ends.shape[1], SWEPT) if "cell" in kept or own.num_rows >= CHUNK else ends.shape[1]
                kept |= {"cell": np.empty(room, np.int64), "ends": np.empty((6, room), np.uint16)}
            to = slice(kept["held"], kept["held"] + ends.shape[1])
            kept["cell"][to], kept["ends"][:, to] = own["cell"].to_numpy()[known], ends
            kept["held"] = to.stop

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, kept = [], 0, {}
        for b in batches:
            held, n = [*held, b], n + b.num_rows
            if n >= CHUNK:
                yield from flush(held, kept)
                held, n = [], 0
        if n:
            yield from flush(held, kept)
        yield from swept(kept)

    long = cells.select("frame_id", "cell", *(F.col(f"v{i}").cast("bigint").alias(f"v{i}") for i in range(4)))
    # Few tasks of many cells: each reads the points of its frame anew.
    few = long.coalesce(cells.sparkSession.sparkContext.defaultParallelism)
    return few.mapInArrow(totals, "frame_id bigint, cell bigint, n bigint, total bigint, last bigint")
