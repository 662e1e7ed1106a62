"""Lattice catalogue: built in, and read from a folder of YAML files."""

from __future__ import annotations

import itertools
import math
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "name string, coordination int, nv array<array<double>>"
# Names of structure types by number, in the order of polyhedral template matching.
STRUCTURES = ("other", "fcc", "hcp", "bcc", "ico", "sc", "cubic_diamond", "hex_diamond", "graphene")
_S = 3**0.5
_signs = lambda v: sorted({tuple(s * x + 0.0 for s, x in zip(t, v)) for t in itertools.product((1, -1), repeat=3)})
_turns = lambda v: sorted({p for q in _signs(v) for p in itertools.permutations(q)})


def _hexagonal(ratio: float) -> list[tuple[float, ...]]:
    """Neighbours in the plane and those of both stacking neighbours, in units where the basal vector is 1/sqrt(2)."""
    a = math.sqrt(0.5)
    plane = [(a * math.cos(k * math.pi / 3), a * math.sin(k * math.pi / 3), 0.0) for k in range(6)]
    r, h = a / _S, ratio
    caps = [(r * math.cos(t + k * 2 * math.pi / 3), r * math.sin(t + k * 2 * math.pi / 3), z) for t in (math.pi / 6, math.pi / 2) for k in range(3) for z in (h, -h)]
    return plane + caps


def built_in() -> list[tuple[str, int, list]]:
    """(name, coordination, neighbour vectors) of the known lattices, made by symmetry.

    Vectors are the union over sublattices, so there can be more than the coordination.
    """
    fcc = _turns((0.5, 0.5, 0.0))
    tetra = [v for v in _signs((0.25, 0.25, 0.25))]
    hcp = _hexagonal((1 / 3) ** 0.5)
    short = (3 / 16) ** 0.5
    r = (1 / 6) ** 0.5
    bonds = [(0.0, 0.0, z) for z in (short, -short)] + [(r * math.cos(t + k * 2 * math.pi / 3), r * math.sin(t + k * 2 * math.pi / 3), z) for t in (math.pi / 6, math.pi / 2) for k in range(3) for z in (short / 3, -short / 3)]
    # Vectors of the lattices without a full symmetry rule.
    a7 = [(1.0, 0.0, 0.0), (0.541218, 0.840882, 0.0), (0.541218, 0.295286, 0.787330)]
    a7 += [tuple(0.0 - x for x in v) for v in a7]
    bct = [*_signs((0.5, 0.5, 0.6)), *(v for v in _turns((1.0, 0.0, 0.0)) if v[2] == 0)]
    fct = [*(v for v in fcc if v[2] == 0), *(v for w in ((0.5, 0.0, 0.6), (0.0, 0.5, 0.6)) for v in _signs(w)), *(v for v in _turns((1.0, 0.0, 0.0)) if v[2] == 0)]
    out = [
        ("a7", 6, a7),
        ("bcc", 14, _signs((0.5, 0.5, 0.5)) + _turns((1.0, 0.0, 0.0))),
        ("bct", 12, bct),
        ("cubic_diamond", 16, tetra + fcc),
        ("fcc", 12, fcc),
        ("fct", 16, fct),
        ("hcp", 12, hcp),
        ("hex_diamond", 16, bonds + hcp),
        ("sc", 6, _turns((1.0, 0.0, 0.0))),
        ("st", 10, [v for w in ((1.0, 0.0, 0.0), (1.0, 1.0, 0.0)) for v in _turns(w) if v[2] == 0] + _signs((0.0, 0.0, 1.2))),
    ]
    return [(n, c, [list(x) for x in v]) for n, c, v in out]


def parse(text: str) -> tuple[str, int, list[list[float]]]:
    """name, coordination_number and neighbor_vectors of one lattice file."""
    field = lambda k: re.search(rf"^{k}:\s*(\S+)", text, re.M)
    name, number = field("name"), field("coordination_number")
    rows = re.findall(r"^\s*-\s*\[([^\]]*)\]", text, re.M)
    if not name or not number or not rows:
        raise ValueError("a lattice needs name, coordination_number and neighbor_vectors")
    return name[1], int(number[1]), [[float(x) for x in r.split(",")] for r in rows]


def catalogue(spark: SparkSession, folder: str | None = None) -> DataFrame:
    """Lattices by name; those of a folder come first, unreadable files are left out."""
    rows = {n: (n, c, v) for n, c, v in built_in()}
    for path in sorted(Path(folder).glob("*.y*ml")) if folder else []:
        try:
            row = parse(path.read_text())
        except (OSError, ValueError):
            continue
        rows[row[0]] = row
    return spark.createDataFrame([rows[k] for k in sorted(rows)], SCHEMA)


def canonical_names(names: DataFrame, lattices: DataFrame, column: str = "name") -> DataFrame:
    """Append canonical: the catalogue's spelling, or the name itself if unknown."""
    known = lattices.select(F.lower("name").alias("__k"), F.col("name").alias("__n"))
    return names.join(known, F.lower(F.trim(F.col(column))) == F.col("__k"), "left").withColumn("canonical", F.coalesce("__n", F.col(column))).drop("__k", "__n")
