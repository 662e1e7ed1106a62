"""Delaunay tessellation of each frame's points, one frame a group.

Signs of determinants are taken in floating point where an error bound proves
them and in integers otherwise, so crystals, whose points lie on common planes and
spheres up to the jitter, give sound cells. Points on a common sphere are parted by a
symbolic perturbation: the lifted coordinate of each point is raised by an amount
that grows beyond all bounds from point to point, so the cells do not depend on the
order of insertion.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "frame_id bigint, cell bigint, v0 int, v1 int, v2 int, v3 int, n0 bigint, n1 bigint, n2 bigint, n3 bigint, is_finite boolean"
OUTSIDE = -1

# Relative error bounds of the two determinants in double precision.
_EPS = 2.0**-53
ORIENT_BOUND = (7.0 + 56.0 * _EPS) * _EPS
SPHERE_BOUND = (16.0 + 224.0 * _EPS) * _EPS


class Predicates:
    """Signs of the orientation and sphere determinants of points given by number."""

    def __init__(self, points: np.ndarray) -> None:
        self.p = [tuple(x) for x in points.tolist()]
        self._whole: dict[int, tuple[int, int, int]] = {}
        # The smallest power of two that makes all coordinates integers.
        self._scale = max((x.as_integer_ratio()[1] for x in points.ravel().tolist()), default=1)

    def whole(self, i: int) -> tuple[int, int, int]:
        """The point's coordinates as integers, all by one scale."""
        if i not in self._whole:
            ratios = (x.as_integer_ratio() for x in self.p[i])
            self._whole[i] = tuple(n * (self._scale // d) for n, d in ratios)
        return self._whole[i]

    def orient(self, a: int, b: int, c: int, d: int) -> int:
        """Sign of (b - a) . ((c - a) x (d - a))."""
        p = self.p
        ax, ay, az = p[a]
        bx, by, bz = p[b]
        cx, cy, cz = p[c]
        dx, dy, dz = p[d]
        ux, uy, uz = bx - ax, by - ay, bz - az
        vx, vy, vz = cx - ax, cy - ay, cz - az
        wx, wy, wz = dx - ax, dy - ay, dz - az
        i, j, k, m, n, o = vy * wz, vz * wy, vz * wx, vx * wz, vx * wy, vy * wx
        det = ux * (i - j) + uy * (k - m) + uz * (n - o)
        bound = ORIENT_BOUND * (abs(ux) * (abs(i) + abs(j)) + abs(uy) * (abs(k) + abs(m)) + abs(uz) * (abs(n) + abs(o)))
        if det > bound:
            return 1
        if det < -bound:
            return -1
        (ax, ay, az), *rest = (self.whole(x) for x in (a, b, c, d))
        (ux, uy, uz), (vx, vy, vz), (wx, wy, wz) = ((x - ax, y - ay, z - az) for x, y, z in rest)
        det = ux * (vy * wz - vz * wy) + uy * (vz * wx - vx * wz) + uz * (vx * wy - vy * wx)
        return (det > 0) - (det < 0)

    @staticmethod
    def _sphere(rows):
        """Determinant of rows (x, y, z, x^2 + y^2 + z^2) and the sum of its terms' sizes."""
        (ax, ay, az), (bx, by, bz), (cx, cy, cz), (dx, dy, dz) = rows
        ab, bc, cd, da = ax * by - bx * ay, bx * cy - cx * by, cx * dy - dx * cy, dx * ay - ax * dy
        ac, bd = ax * cy - cx * ay, bx * dy - dx * by
        abc, bcd = az * bc - bz * ac + cz * ab, bz * cd - cz * bd + dz * bc
        cda, dab = cz * da + dz * ac + az * cd, dz * ab + az * bd + bz * da
        al, bl = ax * ax + ay * ay + az * az, bx * bx + by * by + bz * bz
        cl, dl = cx * cx + cy * cy + cz * cz, dx * dx + dy * dy + dz * dz
        return (dl * abc - cl * dab) + (bl * cda - al * bcd), (al, bl, cl, dl)

    def inside(self, a: int, b: int, c: int, d: int, e: int) -> bool:
        """Whether e is inside the sphere of the positively oriented cell, on the
        sphere by the perturbation."""
        p = self.p
        ex, ey, ez = p[e]
        near = [(x - ex, y - ey, z - ez) for x, y, z in (p[a], p[b], p[c], p[d])]
        det, (al, bl, cl, dl) = self._sphere(near)
        (ax, ay, az), (bx, by, bz), (cx, cy, cz), (dx, dy, dz) = near
        az, bz, cz, dz = abs(az), abs(bz), abs(cz), abs(dz)
        ab, bc, cd = abs(ax * by) + abs(bx * ay), abs(bx * cy) + abs(cx * by), abs(cx * dy) + abs(dx * cy)
        da, ac, bd = abs(dx * ay) + abs(ax * dy), abs(ax * cy) + abs(cx * ay), abs(bx * dy) + abs(dx * by)
        size = (cd * bz + bd * cz + bc * dz) * al + (da * cz + ac * dz + cd * az) * bl + (ab * dz + bd * az + da * bz) * cl + (bc * az + ac * bz + ab * cz) * dl
        if abs(det) > SPHERE_BOUND * size:
            return det < 0
        ex, ey, ez = self.whole(e)
        det, _ = self._sphere([(x - ex, y - ey, z - ez) for x, y, z in map(self.whole, (a, b, c, d))])
        if det:
            return det < 0
        corners = [a, b, c, d]
        for v in sorted((a, b, c, d, e), reverse=True):
            if v == e:
                return False
            i = corners.index(v)
            side = self.orient(*corners[:i], e, *corners[i + 1 :])
            if side:
                return side > 0
        return False


def _sweep_order(points: np.ndarray) -> list[int]:
    """Points along a snake through a grid of a few points a cell, so that walks are short."""
    low, span = points.min(axis=0), np.maximum(np.ptp(points, axis=0), 1e-300)
    k = max(1, round((len(points) / 2) ** (1 / 3)))
    x, y, z = np.minimum((points - low) / span * k, k - 1).astype(int).T
    y = np.where(x % 2, k - 1 - y, y)
    z = np.where((x * k + y) % 2, k - 1 - z, z)
    return np.lexsort((z, y, x)).tolist()


def _first_cell(order: list[int], sign: Predicates) -> tuple[int, int, int, int] | None:
    """Four points that span space, positively oriented; None if all lie in a plane."""
    a = order[0]
    b = next((v for v in order if sign.p[v] != sign.p[a]), None)
    if b is None:
        return None
    (ax, ay, az), (bx, by, bz) = sign.whole(a), sign.whole(b)
    ux, uy, uz = bx - ax, by - ay, bz - az

    def off_line(v: int) -> bool:
        x, y, z = (i - j for i, j in zip(sign.whole(v), (ax, ay, az)))
        return uy * z != uz * y or uz * x != ux * z or ux * y != uy * x

    c = next((v for v in order if off_line(v)), None)
    if c is None:
        return None
    for d in order:
        side = sign.orient(a, b, c, d)
        if side:
            return (a, b, c, d) if side > 0 else (b, a, c, d)
    return None


def tessellate(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(corners, neighbours) of the finite cells; neighbour i lies opposite corner i, -1 is outside.

    Points are inserted one after another: a walk finds a cell whose sphere
    holds the new point, the cells in conflict with it are spread over neighbours,
    and the facets around them are joined with the point. Outside the hull stand
    cells with the corner OUTSIDE, in conflict with points beyond their facet. Cells
    are positively oriented. Of equal points the first in the sweep gets cells; points
    in one plane have none.
    """
    nothing = np.zeros((0, 4), np.int64)
    if len(points) < 4:
        return nothing, nothing
    sign = Predicates(points)
    orient, inside, p = sign.orient, sign.inside, sign.p
    order = _sweep_order(points)
    first = _first_cell(order, sign)
    if first is None:
        return nothing, nothing
    cells: dict[int, tuple] = {0: first}
    near: dict[int, list] = {0: [1, 2, 3, 4]}
    for i in range(4):  # each corner replaced by OUTSIDE, and turned
        t = list(first)
        t[i] = OUTSIDE
        j, k = [x for x in range(4) if x != i][:2]
        t[j], t[k] = t[k], t[j]
        cells[1 + i], near[1 + i] = tuple(t), [0] * 4
        for x in range(4):
            if x != i:
                near[1 + i][x] = 1 + first.index(t[x])
    count, last = 5, 0

    def conflict(c: int, v: int) -> bool:
        t = cells[c]
        if OUTSIDE not in t:
            return inside(*t, v)
        i = t.index(OUTSIDE)
        side = orient(*t[:i], v, *t[i + 1 :])
        return side > 0 if side else inside(*cells[near[c][i]], v)

    used = set(first)
    for v in order:
        if v in used:
            continue
        at, came = last, -1
        while OUTSIDE not in cells[at]:  # walk through facets that part the cell from the point
            t = cells[at]
            for i in range(4):
                m = near[at][i]
                if m != came and orient(*t[:i], v, *t[i + 1 :]) < 0:
                    at, came = m, at
                    break
            else:
                break
        if any(x >= 0 and p[x] == p[v] for x in cells[at]):
            continue
        bad, stack, rim = {at}, [at], []
        clear: set[int] = set()
        while stack:
            c = stack.pop()
            for i, m in enumerate(near[c]):
                if m in bad:
                    continue
                if m not in clear and conflict(m, v):
                    bad.add(m)
                    stack.append(m)
                else:
                    clear.add(m)
                    rim.append((c, i, m))
        sides: dict[tuple, tuple] = {}
        for c, i, m in rim:
            t = cells[c]
            q = (*t[:i], v, *t[i + 1 :])
            new, count = count, count + 1
            cells[new], near[new] = q, [OUTSIDE] * 4
            near[new][i] = m
            near[m][near[m].index(c)] = new
            if OUTSIDE not in q:
                last = new
            for j in range(4):
                if j != i:
                    key = tuple(sorted(q[k] for k in range(4) if k != i and k != j))
                    if key in sides:
                        o, oj = sides.pop(key)
                        near[new][j], near[o][oj] = o, new
                    else:
                        sides[key] = (new, j)
        for c in bad:
            del cells[c], near[c]
    kept = [c for c in sorted(cells) if OUTSIDE not in cells[c]]
    name = {c: i for i, c in enumerate(kept)}
    corners = np.array([cells[c] for c in kept], np.int64).reshape(-1, 4)
    around = np.array([[name.get(m, OUTSIDE) for m in near[c]] for c in kept], np.int64).reshape(-1, 4)
    return corners, around


def delaunay(points: DataFrame) -> DataFrame:
    """(frame_id, cell, v0..v3, n0..n3, is_finite) of points (frame_id, vh, x, y, z).

    Finite cells come first; an infinite cell with corner v3 = -1 stands outside
    each hull facet, so every finite cell has four neighbours. A frame is one
    group: the sweep is sequential, and frames run side by side.
    """

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("vh")
        ids = df["vh"].to_numpy()
        corners, sides = tessellate(df[["x", "y", "z"]].to_numpy(float))
        m = len(corners)
        cell, slot = np.nonzero(sides < 0)
        others = np.array([[k for k in range(4) if k != i] for i in range(4)])
        hull = ids[corners[cell[:, None], others[slot]]] if len(cell) else np.zeros((0, 3), np.int64)
        sides[cell, slot] = m + np.arange(len(cell))
        v = np.concatenate([ids[corners] if m else np.zeros((0, 4), np.int64), np.column_stack([hull, np.full(len(cell), OUTSIDE)])])
        n = np.concatenate([sides, np.column_stack([np.full((len(cell), 3), OUTSIDE), cell])])
        out = pd.DataFrame({"frame_id": df["frame_id"].iloc[0], "cell": np.arange(len(v))} | {f"v{i}": v[:, i] for i in range(4)})
        for i in range(4):
            out[f"n{i}"] = pd.array(n[:, i], "Int64")
            if i < 3:
                out.loc[m:, f"n{i}"] = pd.NA
        out["is_finite"] = out["cell"] < m
        return out

    return points.select("frame_id", "vh", "x", "y", "z").groupBy("frame_id").applyInPandas(run, SCHEMA)
