"""Burgers vectors: labels, families, frames."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import linalg as la
from .linalg import Vec

FAMILY_TOLERANCE = 0.01

# Families by structure, in the order in which they are tried.
# Cubic structures: absolute components, largest first; name; nickname.
FCC_FAMILIES = [
    ((0.5, 0.5, 0.0), "1/2<110>", "Perfect"),
    ((1 / 3, 1 / 6, 1 / 6), "1/6<112>", "Shockley"),
    ((1 / 6, 1 / 6, 0.0), "1/6<110>", "Stair-rod"),
    ((1 / 3, 0.0, 0.0), "1/3<100>", "Hirth"),
    ((1 / 3, 1 / 3, 1 / 3), "1/3<111>", "Frank"),
]
BCC_FAMILIES = [((0.5, 0.5, 0.5), "1/2<111>", "Perfect"), ((1.0, 0.0, 0.0), "<100>", ""), ((1.0, 1.0, 0.0), "<110>", "")]
SC_FAMILIES = [((1.0, 0.0, 0.0), "<100>", ""), ((1.0, 1.0, 0.0), "<110>", ""), ((1.0, 1.0, 1.0), "<111>", "")]
# Hexagonal structures: length in the basal plane, absolute height.
HEX_FAMILIES = [
    ((0.70711, 0.0), "1/3<1-210>", "Perfect basal"),
    ((0.40825, 0.0), "1/3<1-100>", "Shockley"),
    ((0.0, 1.15470), "<0001>", "Perfect c"),
    ((0.0, 0.57735), "1/2<0001>", "Partial c"),
    ((0.70711, 1.15470), "1/3<1-213>", "Perfect c+a"),
]
FAMILIES = {"fcc": FCC_FAMILIES, "cubic_diamond": FCC_FAMILIES, "bcc": BCC_FAMILIES, "sc": SC_FAMILIES, "hcp": HEX_FAMILIES, "hex_diamond": HEX_FAMILIES}
OTHER = "Other"


def label(b: Vec) -> Column:
    """[x, y, z] with six decimals."""
    return F.format_string("[%f, %f, %f]", *b)


def structure_key(name: Column) -> Column:
    """A structure's name as the catalogue has it: lower case, underscores."""
    return F.regexp_replace(F.lower(F.trim(name)), "[ -]+", "_")


def family(b: Vec, structure: Column) -> Column:
    """struct(name, label) of the first family within the tolerance, else Other."""
    size = F.sort_array(F.array(*(F.abs(x) for x in b)), asc=False)
    cubic = [F.get(size, F.lit(i)) for i in range(3)]
    hexagonal = [F.hypot(b[0], b[1]), F.abs(b[2])]
    key = structure_key(structure)
    out = None
    for names, table, have in (
        (("fcc", "cubic_diamond"), FCC_FAMILIES, cubic),
        (("bcc",), BCC_FAMILIES, cubic),
        (("sc",), SC_FAMILIES, cubic),
        (("hcp", "hex_diamond"), HEX_FAMILIES, hexagonal),
    ):
        for values, name, nick in table:
            hit = key.isin(*names) & la.all_true(F.abs(h - v) < FAMILY_TOLERANCE for h, v in zip(have, values))
            full = F.struct(F.lit(name).alias("name"), F.lit(f"{name} ({nick})" if nick else name).alias("label"))
            out = F.when(hit, full) if out is None else out.when(hit, full)
    return out.otherwise(F.struct(F.lit(OTHER).alias("name"), F.lit(OTHER).alias("label")))


def global_vector(b: Vec, orientation: Column) -> Vec:
    """Orientation times the local vector; the vector itself without a cluster."""
    turned = la.matvec(la.mat(orientation), b)
    return tuple(F.when(orientation.isNull(), x).otherwise(t) for x, t in zip(b, turned))


def topology_name(name: Column, fallback: Column) -> Column:
    return F.coalesce(F.nullif(name, F.lit("")), fallback)
