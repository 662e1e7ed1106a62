"""Text dumps of atomistic frames as a Spark data source, `lammpsdump`.

    spark.dataSource.register(LammpsDump)
    spark.read.format("lammpsdump").load("/dumps/*.dump")

Options: path (a file, a folder or a glob pattern) and split_bytes. A file may hold many frames;
it is cut into byte ranges, and a task reads the frames whose header begins inside its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

HEAD = b"ITEM: TIMESTEP"
SCHEMA = (
    "frame_id bigint, atom_idx int, id int, x double, y double, z double, structure_type int, cluster_id int, "
    "matrix array<array<double>>, origin array<double>, pbc array<boolean>"
)


def frame_cell(bounds: list[str], flags: list[str]) -> tuple[list[list[float]], list[float], list[bool]]:
    """Edge vectors, origin and periodic flags from three bounds lines and the
    words after BOX BOUNDS (tilt names, then boundary styles)."""
    rows = [list(map(float, b.split())) for b in bounds]
    tilted = "xy" in flags
    pbc = [f.startswith("p") for f in (flags[3:6] if tilted else flags[:3])] or [True] * 3
    xy, xz, yz = (r[2] for r in rows) if tilted else (0.0, 0.0, 0.0)
    lo, hi = [r[0] for r in rows], [r[1] for r in rows]
    lo[0] -= min(0.0, xy, xz, xy + xz)
    hi[0] -= max(0.0, xy, xz, xy + xz)
    lo[1] -= min(0.0, yz)
    hi[1] -= max(0.0, yz)
    size = [h - a for a, h in zip(lo, hi)]
    return [[size[0], 0.0, 0.0], [xy, size[1], 0.0], [xz, yz, size[2]]], lo, (pbc + [True] * 3)[:3]


def read_frame(lines: Iterator[str]) -> tuple[int, tuple, list[tuple]]:
    """(timestep, cell, atoms) of the frame whose header line has been read."""
    step = int(next(lines))
    cell, n = None, 0
    for line in lines:
        if line.startswith("ITEM: NUMBER OF ATOMS"):
            n = int(next(lines))
        elif line.startswith("ITEM: BOX BOUNDS"):
            cell = frame_cell([next(lines) for _ in range(3)], line.split()[3:])
        elif line.startswith("ITEM: ATOMS"):
            names = line.split()[2:]
            at = {c: i for i, c in enumerate(names)}
            axes = next((s for s in (("x", "y", "z"), ("xu", "yu", "zu"), ("xs", "ys", "zs")) if all(a in at for a in s)), None)
            if axes is None or cell is None:
                raise ValueError(f"timestep {step}: positions or box bounds are missing")
            matrix, origin = np.array(cell[0]), np.array(cell[1])
            rows = []
            for i in range(n):
                w = next(lines, "").split()
                if len(w) < len(names):
                    raise ValueError(f"timestep {step}: {n} atoms are announced, {i} are there")
                p = np.array([float(w[at[a]]) for a in axes])
                if axes[0] == "xs":
                    p = p @ matrix + origin
                number = lambda c, other: int(float(w[at[c]])) if c in at else other  # noqa: B023, E731
                rows.append((i, number("id", i + 1), *p.tolist(), number("structure_type", 0), number("cluster_id", 0)))
            return step, cell, rows
    raise ValueError(f"timestep {step}: no atoms")


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int) -> None:
        self.path, self.start, self.end = path, start, end


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.split = options["path"], int(options.get("split_bytes", 64 << 20))

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        folder, _, pattern = base.rpartition("/")
        info = system.get_file_info(base) if "*" not in base else None
        if info is not None and info.type == fs.FileType.File:
            files = [info]
        else:
            import fnmatch

            where = base if info is not None else folder or "."
            files = [f for f in system.get_file_info(fs.FileSelector(where)) if f.type == fs.FileType.File and (info is not None or fnmatch.fnmatch(f.base_name, pattern))]
        return [_Range(f.path, a, min(a + self.split, f.size)) for f in sorted(files, key=lambda f: f.path) for a in range(0, f.size, self.split)]

    def read(self, part: _Range) -> Iterator[tuple]:
        from pyarrow import fs

        system = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else fs.LocalFileSystem()
        with system.open_input_file(part.path) as raw:
            raw.seek(part.start)
            size, pos, rest = raw.size(), part.start, b""

            def lines() -> Iterator[tuple[int, str]]:
                nonlocal pos, rest
                if part.start:  # a line that begins before belongs to another task
                    raw.seek(part.start - 1)
                    skip = True
                else:
                    skip = False
                at = part.start - bool(part.start)
                while True:
                    block = raw.read(1 << 20)
                    rest += block
                    *whole, rest = rest.split(b"\n")
                    if not block and rest:
                        whole, rest = [*whole, rest], b""
                    for w in whole:
                        here, at = at, at + len(w) + 1
                        if skip:
                            skip = False
                            continue
                        yield here, w.decode("utf-8", "replace").rstrip("\r")
                    if not block:
                        return

            source = lines()
            del size
            for here, line in source:
                if here >= part.end:
                    return
                if line.startswith(HEAD.decode()):
                    step, cell, rows = read_frame(text for _, text in source)
                    for r in rows:
                        yield (step, *r, *cell)


class LammpsDump(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lammpsdump"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_dump(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(atoms, cells) of dump files."""
    spark.dataSource.register(LammpsDump)
    rows = spark.read.format("lammpsdump").load(path)
    atoms = rows.drop("matrix", "origin", "pbc")
    cells = rows.filter("atom_idx = 0").select("frame_id", "matrix", "origin", "pbc")
    return atoms, cells


def validate_frames(atoms: DataFrame, cells: DataFrame) -> DataFrame:
    """(frame_id, error): frames that cannot be analysed and why; empty if all are sound."""
    by = atoms.groupBy("frame_id").agg(
        F.count("*").alias("n"),
        F.countDistinct("atom_idx").alias("k"),
        F.count_if(F.col("x").isNull() | F.col("y").isNull() | F.col("z").isNull()).alias("gaps"),
    )
    boxes = cells.groupBy("frame_id").agg(F.count("*").alias("n_cells"))
    j = boxes.join(by, "frame_id", "full")
    why = (
        F.when(F.coalesce("n", F.lit(0)) == 0, "no atoms")
        .when(F.col("n") != F.col("k"), "atom indices repeat")
        .when(F.col("gaps") > 0, "positions are missing")
        .when(F.coalesce("n_cells", F.lit(0)) != 1, "not one simulation cell")
    )
    return j.select("frame_id", why.alias("error")).filter("error is not null")
