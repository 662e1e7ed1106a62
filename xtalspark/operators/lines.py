"""Dislocation lines: polylines as (frame_id, segment_id, line array<struct<x,y,z>>, core_size array<int>)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import linalg as la

# Weights of the two smoothing passes.
LAMBDA, MU = 0.5, -0.53
CLIP_EPSILON, MAX_SPLITS = 1e-9, 10


def gather_lines(points: DataFrame) -> DataFrame:
    """Lines from rows (frame_id, segment_id, seq, x, y, z, core)."""
    row = F.struct("seq", F.struct("x", "y", "z").alias("p"), "core")
    g = points.groupBy("frame_id", "segment_id").agg(F.array_sort(F.collect_list(row)).alias("r"))
    return g.select("frame_id", "segment_id", F.transform("r", lambda x: x["p"]).alias("line"), F.transform("r", lambda x: x["core"]).alias("core_size"))


def line_length(line: Column) -> Column:
    """Sum of the steps' lengths."""
    step = lambda a, i: la.length(la.sub(la.xyz(F.get(line, i + 1)), la.xyz(a)))
    steps = F.transform(F.slice(line, 1, F.greatest(F.size(line) - 1, F.lit(0))), step)
    return F.aggregate(steps, F.lit(0.0), lambda s, x: s + x)


def point_lengths(points: DataFrame) -> DataFrame:
    """Lengths and point counts from point rows: a window within each line, no arrays."""
    w = Window.partitionBy("frame_id", "segment_id").orderBy("seq")
    back = [F.col(a) - F.lag(a).over(w) for a in "xyz"]
    step = points.withColumn("__d", F.sqrt(back[0] * back[0] + back[1] * back[1] + back[2] * back[2]))
    return step.groupBy("frame_id", "segment_id").agg(F.coalesce(F.sum("__d"), F.lit(0.0)).alias("length"), F.count("*").alias("n_points"))


def nondegenerate(lines: DataFrame) -> DataFrame:
    return lines.filter(F.size("line") > 1)


def line_totals(chunks: DataFrame) -> DataFrame:
    """Per frame over lines (length, n_points): counts, total, mean, extremes; zeros if empty."""
    zero = F.lit(0.0)
    return chunks.groupBy("frame_id").agg(
        F.count("*").alias("n_lines"),
        F.coalesce(F.sum("n_points"), F.lit(0)).cast("bigint").alias("n_points"),
        F.coalesce(F.sum("length"), zero).alias("total_length"),
        F.coalesce(F.avg("length"), zero).alias("mean_length"),
        F.coalesce(F.max("length"), zero).alias("max_length"),
        F.coalesce(F.min("length"), zero).alias("min_length"),
    )


def needs_flip(line: Column) -> Column:
    """Whether a largest component of (last - first) is negative; never for short moves."""
    d = la.sub(la.xyz(F.get(line, F.size(line) - 1)), la.xyz(F.get(line, F.lit(0))))
    most = F.greatest(*(F.abs(x) for x in d))
    negative = la.any_true((F.abs(x) == most) & (x < 0) for x in d)
    return F.coalesce(~la.is_zero(d, la.ATOM_EPSILON) & negative, F.lit(False))


def orient(lines: DataFrame) -> DataFrame:
    """Turn lines of a negative direction: points, core sizes, Burgers vector (bx, by, bz)."""
    flip = needs_flip(F.col("line"))
    out = lines.withColumn("flipped", flip)
    out = out.withColumn("line", F.when(F.col("flipped"), F.reverse("line")).otherwise(F.col("line")))
    if "core_size" in lines.columns:
        out = out.withColumn("core_size", F.when(F.col("flipped"), F.reverse("core_size")).otherwise(F.col("core_size")))
    for b in ("bx", "by", "bz"):
        if b in lines.columns:
            out = out.withColumn(b, F.when(F.col("flipped"), -F.col(b)).otherwise(F.col(b)))
    return out


def _pass(line: Column, weight: float, loop: Column) -> Column:
    n = F.size(line)

    def moved(p: Column, i: Column) -> Column:
        before = F.get(line, F.when(i > 0, i - 1).otherwise(n - 2))
        after = F.get(line, F.when(i < n - 1, i + 1).otherwise(F.lit(1)))
        still = ~loop & ((i == 0) | (i == n - 1))
        new = [p[a] + weight * 0.5 * ((before[a] - p[a]) + (after[a] - p[a])) for a in "xyz"]
        return F.struct(*(F.when(still, p[a]).otherwise(v).alias(a) for a, v in zip("xyz", new)))

    return F.transform(line, moved)


def _weighted(weight: float, loop: Column):
    return lambda line: _pass(line, weight, loop)


def smooth_line(line: Column, level: float, loop: Column) -> Column:
    """ceil(level) rounds of two passes over an array of points; short lines stay.

    Each pass is one transform whose input is bound as a variable.
    """
    out = line
    for _ in range(math.ceil(level) if level > 0 else 0):
        for w in (LAMBDA, MU):
            out = F.element_at(F.transform(F.array(out), _weighted(w, loop)), 1)
    short = (F.size(line) <= 2) | (loop & (F.size(line) <= 4))
    return F.when(short, line).otherwise(out)


def point_on_line(line: Column, t: float) -> Column:
    """Point at the share t of the line's length: on the first step that reaches it."""
    n = F.size(line)
    step = lambda a, i: la.length(la.sub(la.xyz(F.get(line, i + 1)), la.xyz(a)))
    steps = F.transform(F.slice(line, 1, n - 1), step)

    def found(s: Column) -> Column:
        total = F.aggregate(s, F.lit(0.0), lambda a, x: a + x)
        run = F.transform(s, lambda x, i: F.aggregate(F.slice(s, 1, i + 1), F.lit(0.0), lambda a, y: a + y))
        goal = total * t
        k = F.coalesce(F.get(F.filter(F.transform(run, lambda r, i: F.when(r >= goal, i)), lambda i: i.isNotNull()), F.lit(0)), F.size(s) - 1)
        into = F.get(s, k) - (F.get(run, k) - goal)
        share = F.when(F.get(s, k) > 0, into / F.nullif(F.get(s, k), F.lit(0.0))).otherwise(F.lit(0.0))
        a, b = la.xyz(F.get(line, k)), la.xyz(F.get(line, k + 1))
        return la.point(tuple(x + (y - x) * share for x, y in zip(a, b)))

    return F.when(n < 2, F.get(line, F.lit(0))).otherwise(F.element_at(F.transform(F.array(steps), found), 1))


def clip_polyline(points: np.ndarray, vectors: np.ndarray, origin: np.ndarray, pbc) -> list[np.ndarray]:
    """Chunks of a polyline, folded into a periodic cell and cut at its faces."""
    if len(points) < 2:
        return []
    r = np.linalg.solve(vectors.T, (points - origin).T).T
    pbc = np.asarray(pbc, bool)
    shift = np.where(pbc, -np.floor(r[0]), 0.0)
    chunks: list[list[np.ndarray]] = []
    at, fresh = r[0] + shift, True

    def emit(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal fresh
        if fresh or not chunks:
            chunks.append([a])
        chunks[-1].append(b)
        fresh = False

    for nxt in r[1:]:
        end = nxt + shift
        for _ in range(MAX_SPLITS):
            delta = end - at
            best, axis = 1.0 - CLIP_EPSILON, -1
            for d in np.flatnonzero(pbc & (np.floor(at) != np.floor(end)) & (np.abs(delta) >= CLIP_EPSILON)):
                wall = np.ceil(at[d]) if delta[d] > 0 else np.floor(at[d])
                t = (wall - at[d]) / delta[d]
                if CLIP_EPSILON < t < best:
                    best, axis = t, d
            if axis < 0:
                break
            cut = at + best * delta
            cut[axis] = np.round(cut[axis])
            emit(at, cut)
            way = -np.sign(delta[axis])
            at, end = cut.copy(), end.copy()
            at[axis] += way
            end[axis] += way
            shift = shift.copy()
            shift[axis] += way
            fresh = True
        emit(at, end)
        at = end
    return [np.array(c) @ vectors + origin for c in chunks]


def clip_lines(lines: DataFrame, boxes: DataFrame) -> DataFrame:
    """(frame_id, segment_id, chunk, line): lines cut at the faces of periodic cells.

    boxes is the plain cell table (frame_id, matrix, origin, pbc).
    """
    joined = lines.join(boxes, "frame_id").select("frame_id", "segment_id", "line", "matrix", "origin", "pbc")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out = []
            for f, s, line, m, o, p in df.itertuples(index=False):
                pts = np.array([[q["x"], q["y"], q["z"]] for q in line]).reshape(-1, 3)
                for i, c in enumerate(clip_polyline(pts, np.array([list(v) for v in m]), np.array(o), p)):
                    out.append((f, s, i, [{"x": a, "y": b, "z": d} for a, b, d in c.tolist()]))
            yield pd.DataFrame(out, columns=["frame_id", "segment_id", "chunk", "line"])

    kinds = dict(lines.dtypes)
    return joined.mapInPandas(run, f"frame_id {kinds['frame_id']}, segment_id {kinds['segment_id']}, chunk int, line array<struct<x:double,y:double,z:double>>")


def coarsen_polyline(points: np.ndarray, core: list[int], interval: float, loop: bool, infinite: bool) -> tuple[np.ndarray, list[int]]:
    """Averages of groups of neighbouring points; see coarsen_lines."""
    n = len(points)
    if n < 2:
        return points[:0], []
    if interval <= 0 or n < 4:
        return points, list(core)
    if infinite:
        m, total = n - 1, int(sum(core[: n - 1]))
        if total * interval > m * m:
            com = (points[:m] - points[0]).mean(axis=0)
            return np.array([points[0] + com, points[-1] + com]), [total // m] * 2
    out, sizes = ([], []) if loop else ([points[0]], [int(core[0])])
    i, stop = (0, n) if loop else (1, n - 1)
    while i < stop:
        total, count, where = 0, 0, np.zeros(3)
        while i < stop:
            where, total, count, i = where + points[i], total + int(core[i]), count + 1, i + 1
            if count * count >= interval * total:
                break
        out.append(where / count)
        sizes.append(total // count)
    if loop:
        out.append(out[0])
        sizes.append(sizes[0])
    else:
        out.append(points[-1])
        sizes.append(int(core[-1]))
    if len(out) < (4 if loop else 2):
        return points, list(core)
    return np.array(out), sizes


def coarsen_lines(lines: DataFrame, interval: float) -> DataFrame:
    """Lines with groups of points averaged: a group takes points until
    count^2 >= interval * sum of core sizes. Open lines keep their ends.

    lines have flags is_loop and is_infinite; core sizes become integer means.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            new, cores = [], []
            for line, core, loop, inf in zip(df["line"], df["core_size"], df["is_loop"], df["is_infinite"]):
                pts = np.array([[q["x"], q["y"], q["z"]] for q in line]).reshape(-1, 3)
                p, c = coarsen_polyline(pts, list(core), interval, bool(loop), bool(inf))
                new.append([{"x": a, "y": b, "z": d} for a, b, d in p.tolist()])
                cores.append([int(x) for x in c])
            df = df.copy()
            df["line"], df["core_size"] = new, cores
            yield df

    return lines.mapInPandas(run, lines.schema)


def smooth_lines(lines: DataFrame, level: float, interval: float) -> DataFrame:
    """Coarsen, then smooth; lines without core sizes are left alone, and core
    sizes are cleared afterwards."""
    have = F.size("core_size") > 0
    plain = lines.filter(~have)
    done = coarsen_lines(lines.filter(have), interval).withColumn("line", smooth_line(F.col("line"), level, F.col("is_loop")))
    return done.withColumn("core_size", F.array().cast("array<int>")).unionByName(plain)
