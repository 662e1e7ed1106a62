"""Options of an analysis, with the defaults and the limits of each."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cell import parse_rescale


@dataclass(frozen=True)
class DxaOptions:
    clusters_table: str = ""
    clusters_transitions: str = ""
    neighbor_lattice: str = ""
    max_trial_circuit_size: int = 14
    circuit_stretchability: int = 9
    line_smoothing_level: float = 1.0
    line_point_interval: float = 2.5
    ghost_layer_scale: float = 3.5
    interface_alpha_scale: float = 5.0
    crystal_path_steps: int = 4
    export_defect_mesh: bool = True
    export_interface_mesh: bool = False
    export_delaunay_tessellation: bool = False
    export_structure_identification: bool = False
    mark_core_atoms: bool = False
    export_coherent_crystalline_regions: bool = False
    export_dislocations: bool = True
    export_circuit_information: bool = True
    export_dislocation_network_stats: bool = True
    export_junctions: bool = True
    clip_pbc_segments: bool = True
    cover_domain_with_finite_tets: bool = False
    lattice_dir: str = ""
    reference_topology: str = ""
    metric_rescale: tuple[float, float, float] = (1.0, 1.0, 1.0)

    @classmethod
    def from_mapping(cls, given: dict[str, object]) -> DxaOptions:
        """Options from text or typed values; names may have dashes. Doubles given for
        circuit sizes are cut to integers."""
        known = {f.name: f for f in fields(cls)}
        out = {}
        for key, value in given.items():
            name = key.lstrip("-").replace("-", "_")
            if name not in known:
                raise ValueError(f"unknown option {key!r}")
            kind = known[name].type
            if name == "metric_rescale":
                value = parse_rescale(value) if isinstance(value, str) else tuple(map(float, value))
            elif kind == "bool":
                value = value if isinstance(value, bool) else str(value).strip().lower() in ("1", "true", "yes", "on")
            elif kind == "int":
                value = int(float(value))
            elif kind == "float":
                value = float(value)
            out[name] = value
        return cls(**out)

    @classmethod
    def from_arguments(cls, argv: list[str]) -> tuple[DxaOptions, list[str]]:
        """Options and positional arguments of a command line; a flag without a
        value is true."""
        given, rest, i = {}, [], 0
        flags = {f.name for f in fields(cls) if f.type == "bool"}
        while i < len(argv):
            a = argv[i]
            if not a.startswith("--"):
                rest.append(a)
            elif "=" in a:
                key, _, given_value = a.partition("=")
                given[key] = given_value
            else:
                name = a[2:].replace("-", "_")
                alone = name in flags and (i + 1 == len(argv) or argv[i + 1].lower() not in ("true", "false", "0", "1", "yes", "no", "on", "off"))
                if alone:
                    given[a] = True
                else:
                    if i + 1 == len(argv):
                        raise ValueError(f"{a} needs a value")
                    given[a] = argv[i + 1]
                    i += 1
            i += 1
        return cls.from_mapping(given), rest

    def require(self) -> None:
        """Raise unless what every run needs is given and within its limits."""
        for name in ("reference_topology", "clusters_table", "clusters_transitions", "neighbor_lattice"):
            if not getattr(self, name):
                raise ValueError(f"--{name} is required")
        if self.max_trial_circuit_size < 3 or self.circuit_stretchability < 0 or self.crystal_path_steps < 1:
            raise ValueError("circuits have 3 edges and paths 1 step at least, and circuits do not shrink")
        for name in ("ghost_layer_scale", "interface_alpha_scale", "line_smoothing_level", "line_point_interval"):
            if getattr(self, name) < 0:
                raise ValueError(f"--{name} must not be negative")

    def named(self, lattices: DataFrame) -> DxaOptions:
        """These options with the catalogue's spelling of the reference topology, if it has it."""
        wanted = self.reference_topology.strip().lower()
        found = lattices.filter(F.lower("name") == wanted).select("name").first()
        return replace(self, reference_topology=found["name"]) if found else self
