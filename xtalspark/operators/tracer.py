"""Tracing of dislocation lines on an interface mesh, one frame a group.

A circuit is a closed ring of half-edges whose ideal vectors do not add up to
zero; it is swept over the mesh in both directions, and its centres are the line.
The order of steps matters, so a frame is worked through in sequence; frames
run side by side. Where several circuits leave a hole between them, a secondary
circuit around it is made; its line starts at theirs and goes on into the hole.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.linalg import ATOM_EPSILON, LATTICE_EPSILON, ROTATION_EPSILON

EYE = np.eye(3)
SCHEMA = (
    "frame_id bigint, segment_id int, line array<struct<x:double,y:double,z:double>>, core_size array<int>, bx double, by double, bz double, "
    "cluster_id int, n_pre int, n_post int, nodes array<struct<side:string,ring_id:bigint,edge_count:int,is_dangling:boolean,is_blocked:boolean,cap:array<int>>>, "
    "faces array<struct<face:int,flag:int,dangling:boolean>>, fans array<struct<fan:int,stored:boolean,dangling:boolean,centre:array<double>,ring:array<array<double>>>>"
)


@dataclass
class Surface:
    """Half-edges 3 * face + slot of a closed triangle mesh, with the vectors along them."""

    tail: list[int]
    head: list[int]
    opp: list[int]
    step: np.ndarray  # in space, minimum image
    ideal: np.ndarray  # in the frame of the cluster at the tail
    back: list  # rotation into the tail's frame from the head's; None within a cluster
    cluster: list[int]
    at: dict[int, np.ndarray]
    leaving: dict[int, list[int]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for h in sorted(range(len(self.tail)), key=lambda h: (self.tail[h], self.head[h], h)):
            self.leaving.setdefault(self.tail[h], []).append(h)

    @staticmethod
    def after(h: int) -> int:
        return h - h % 3 + (h + 1) % 3

    @staticmethod
    def before(h: int) -> int:
        return h - h % 3 + (h + 2) % 3

    def fold(self, ring: list[int]) -> tuple[np.ndarray, bool]:
        """Sum of ideal vectors along a ring and whether its rotations close."""
        total, turn = np.zeros(3), EYE
        for h in ring:
            total = total + turn @ self.ideal[h]
            if self.back[h] is not None:
                turn = turn @ self.back[h]
        return total, bool(np.abs(turn - EYE).max() <= ROTATION_EPSILON)

    def centre(self, ring: list[int]) -> np.ndarray:
        return self.at[self.tail[ring[0]]] + np.cumsum(self.step[ring], axis=0).mean(axis=0)

    def around(self, h: int) -> list[int]:
        """Half-edges that leave the tail of h, in the order of turning, from h on."""
        out, g = [h], self.opp[self.before(h)]
        while g != h and g >= 0 and len(out) < 1000:
            out.append(g)
            g = self.opp[self.before(g)]
        return out


class Circuit:
    def __init__(self, ring: list[int], line: Line, ahead: bool) -> None:
        self.ring, self.line, self.ahead = ring, line, ahead
        self.dangling, self.blocked, self.cap, self.tentative = True, False, None, 0

    def __len__(self) -> int:
        return len(self.ring)


class Line:
    def __init__(self, b: np.ndarray, cluster: int) -> None:
        self.b, self.cluster = b, cluster
        self.points: list[np.ndarray] = []
        self.cores: list[int] = []
        self.ends: list[Circuit] = []
        self.replaced: Line | None = None
        self.faces: list[tuple[int, int, Circuit]] = []


class Tracer:
    """Works through one mesh; with fans, remembers the circuit at each point of a line."""

    def __init__(self, mesh: Surface, wrap, max_trial: int = 14, stretch: int = 9, fans: bool = False) -> None:
        self.mesh, self.wrap, self.max_trial, self.stretch = mesh, wrap, max_trial, stretch
        self.fans: list[tuple[Circuit, bool, np.ndarray, list[int]]] | None = [] if fans else None
        self.owner: list[Circuit | None] = [None] * len(mesh.tail)
        self.swept: list[Circuit | None] = [None] * (len(mesh.tail) // 3)
        self.lines: list[Line] = []
        self.rings: dict[Circuit, int] = {}
        self.turn = 0  # where the next scan starts: goes on from circuit to circuit

    # -- finding circuits

    def search(self, root: int, depth: int) -> tuple[dict, list[int]]:
        """Vertices within depth steps of root with their ideal positions, and the
        half-edges that come back to one of them at another position."""
        mesh = self.mesh
        seen, queue, closing = {root: (np.zeros(3), EYE, -1, 0)}, [root], []
        for u in queue:
            pos, turn, _, d = seen[u]
            for h in mesh.leaving[u]:
                if self.owner[h] is not None or self.swept[h // 3] is not None or mesh.opp[h] < 0 or self.owner[mesh.opp[h]] is not None:
                    continue
                w = mesh.head[h]
                there = pos + turn @ mesh.ideal[h]
                facing = turn if mesh.back[h] is None else turn @ mesh.back[h]
                if w not in seen:
                    if d < depth:
                        seen[w] = (there, facing, h, d + 1)
                        queue.append(w)
                elif np.abs(there - seen[w][0]).max() > LATTICE_EPSILON and np.abs(facing - seen[w][1]).max() <= ROTATION_EPSILON:
                    closing.append(h)
        return seen, closing

    def ring_of(self, seen: dict, h: int) -> list[int]:
        """The two branches of a search from their last common vertex, joined by h."""
        mesh = self.mesh

        def up(v: int) -> list[int]:
            out = []
            while seen[v][2] >= 0:
                out.append(seen[v][2])
                v = mesh.tail[seen[v][2]]
            return out

        a, b = up(mesh.tail[h]), up(mesh.head[h])
        while a and b and a[-1] == b[-1]:
            a.pop()
            b.pop()
        return a[::-1] + [h] + [mesh.opp[g] for g in b]

    def crosses(self, ring: list[int]) -> bool:
        """Whether the ring crosses a living circuit at a vertex they share."""
        mesh = self.mesh
        for i, out in enumerate(ring):
            order = {g: k for k, g in enumerate(mesh.around(out))}
            into = order.get(mesh.opp[ring[i - 1]])
            if into is None:
                return True
            others = {self.owner[g] for g in order if self.owner[g] is not None}
            for c in others:
                for j, g in enumerate(c.ring):
                    other = mesh.opp[c.ring[j - 1]]
                    if mesh.tail[g] == mesh.tail[out] and g in order and other in order:
                        sides = [0 < order[x] < into for x in (g, other) if order[x] not in (0, into)]
                        if len(sides) == 2 and sides[0] != sides[1]:
                            return True
        return False

    def start(self, ring: list[int], limit: int) -> bool:
        """Make a line of a ring if it is a sound circuit; trace it both ways."""
        mesh = self.mesh
        other = [mesh.opp[h] for h in reversed(ring)]
        free = all(self.owner[h] is None and self.swept[h // 3] is None for h in ring + other)
        if len(ring) > limit or len(ring) < 3 or not free or len({mesh.tail[h] for h in ring}) < len(ring):
            return False
        b, closes = mesh.fold(ring)
        if not closes or np.abs(b).max() <= LATTICE_EPSILON or np.abs(mesh.step[ring].sum(axis=0)).max() > ATOM_EPSILON or self.crosses(ring):
            return False
        line = Line(b, mesh.cluster[ring[0]])
        line.ends = [Circuit(ring, line, True), Circuit(other, line, False)]
        for c in line.ends:
            for h in c.ring:
                self.owner[h] = c
        self.begin(line, limit)
        return True

    def begin(self, line: Line, limit: int) -> None:
        """The first points of a line, one of each circuit unless they are the same, and its sweep both ways."""
        ahead, behind = line.ends
        line.points, line.cores = [self.mesh.centre(behind.ring)], [len(behind.ring)]
        self.lines.append(line)
        if {self.mesh.tail[h] for h in ahead.ring} != {self.mesh.tail[h] for h in behind.ring}:
            self.append(ahead)
        for c in line.ends:
            self.trace(c, limit, True)

    # -- secondary circuits

    def hole(self, c: Circuit, h: int, limit: int) -> list[int] | None:
        """The ring around the hole that lies beyond half-edge h of a circuit, if it is bounded by
        several circuits and has a Burgers vector: all its edges are opposite to edges of circuits."""
        mesh = self.mesh
        ring, edge, met = [], mesh.opp[h], {c}
        first = edge
        while True:
            g, steps = mesh.opp[edge], 0
            if g < 0:
                return None
            g = mesh.before(g)
            while self.owner[g] is None:  # turn around the head of the edge up to the next circuit
                g = mesh.opp[g]
                steps += 1
                if g < 0 or steps > 1000:
                    return None
                g = mesh.before(g)
            met.add(self.owner[g])
            edge = mesh.opp[g]
            if edge < 0 or self.owner[edge] is not None:
                return None
            ring.append(edge)
            if edge == first:
                break
            if len(ring) > limit:
                return None
        if len(met) < 2 or len(ring) < 3 or len(ring) > limit:
            return None
        b, closes = mesh.fold(ring)
        open_ring = np.abs(mesh.step[ring].sum(axis=0)).max() > ATOM_EPSILON
        return None if not closes or open_ring or np.abs(b).max() <= LATTICE_EPSILON else ring

    def strip(self, ring: list[int]) -> tuple[list[int], list[int]] | None:
        """(inner ring, facets): the far side of the strip of facets across the ring, turning the
        other way; None if the strip is taken or has no inner ring."""
        mesh = self.mesh
        inner, facets = [], []
        n = len(ring)
        for i in reversed(range(n)):
            a, b = mesh.opp[ring[i]], mesh.opp[ring[(i + 1) % n]]
            facets.append(a // 3)
            if a // 3 != b // 3:
                inner += [mesh.opp[mesh.after(b)], mesh.opp[mesh.before(a)]]
        facets = list(dict.fromkeys(facets))
        inner = [h for k, h in enumerate(inner) if h != inner[k - 1]]
        free = all(h >= 0 and self.owner[h] is None for h in inner) and len(set(inner)) == len(inner)
        if len(inner) < 3 or not free or any(self.swept[f] is not None for f in facets):
            return None
        if any(mesh.head[h] != mesh.tail[g] for h, g in zip(inner, inner[1:] + inner[:1])):
            return None
        return inner, facets

    def secondary(self, limit: int) -> int:
        """Lines that start where several circuits surround a hole."""
        made = 0
        for c in [c for x in self.lines if x.replaced is None for c in x.ends if c.dangling and c.ring]:
            for h in list(c.ring):
                o = self.mesh.opp[h]
                if self.owner[h] is not c or o < 0 or self.owner[o] is not None:
                    continue
                ring = self.hole(c, h, limit)
                back = ring and self.strip(ring)
                if not back:
                    continue
                line = Line(self.mesh.fold(ring)[0], self.mesh.cluster[ring[0]])
                line.ends = [Circuit(ring, line, True), Circuit(back[0], line, False)]
                for end in line.ends:
                    for g in end.ring:
                        self.owner[g] = end
                for f in back[1]:
                    self.swept[f] = line.ends[1]
                    line.faces.append((f, 1, line.ends[1]))
                self.begin(line, limit)
                made += 1
        return made

    def find(self, limit: int) -> None:
        """New circuits of at most limit edges, shortest search trees first by vertex."""
        depth = (limit - 1) // 2
        found = []
        for v in sorted(self.mesh.leaving):
            if any(self.owner[h] is None and self.swept[h // 3] is None for h in self.mesh.leaving[v]):
                seen, closing = self.search(v, depth)
                found += [(self.mesh.tail[h], self.mesh.head[h], v) for h in closing]
        for v in dict.fromkeys(x[2] for x in sorted(found)):  # the mesh changes as lines are made
            seen, closing = self.search(v, depth)
            for h in closing:
                if self.start(self.ring_of(seen, h), limit):
                    break

    # -- moving circuits

    def move(self, c: Circuit, i: int) -> tuple[int, int, list[int], list[int]] | None:
        """A shortening or sweeping move at place i: (first place, edges taken out,
        edges put in, facets claimed)."""
        mesh, r = self.mesh, c.ring
        n = len(r)
        e0, e1, e2, e3 = (r[(i + k) % n] for k in range(4))
        free = lambda h: self.swept[h // 3] is None
        unowned = lambda h: h >= 0 and self.owner[h] is None
        if n > 2 and mesh.opp[e1] == e2:
            return i + 1, 2, [], []
        if n > 3 and e1 // 3 == e2 // 3 == e3 // 3 and free(e1):
            return i + 1, 3, [], [e1 // 3]
        if n > 2 and e1 // 3 == e2 // 3 and e0 // 3 != e1 // 3 and free(e1):
            short = mesh.opp[mesh.after(e2)]
            if unowned(short):
                return i + 1, 2, [short], [e1 // 3]
        if e1 // 3 != e2 // 3 and free(e1) and free(e2) and mesh.opp[mesh.after(e1)] == mesh.before(e2):
            outer = [mesh.opp[mesh.before(e1)], mesh.opp[mesh.after(e2)]]
            if all(map(unowned, outer)) and outer[0] != outer[1]:
                return i + 1, 2, outer, [e1 // 3, e2 // 3]
        return None

    def insertion(self, c: Circuit, i: int) -> tuple[int, int, list[int], list[int]] | None:
        mesh, e = self.mesh, c.ring[i % len(c.ring)]
        outer = [mesh.opp[mesh.before(e)], mesh.opp[mesh.after(e)]]
        if self.swept[e // 3] is None and all(h >= 0 and self.owner[h] is None for h in outer):
            return i, 1, outer, [e // 3]
        return None

    def apply(self, c: Circuit, move: tuple[int, int, list[int], list[int]], primary: bool) -> None:
        first, out, new, facets = move
        n = len(c.ring)
        ring = [c.ring[(first + k) % n] for k in range(n)]
        for h in ring[:out]:
            self.owner[h] = None
        c.ring = new + ring[out:]
        for h in new:
            self.owner[h] = c
        for f in facets:
            self.swept[f] = c
            c.line.faces.append((f, int(primary), c))

    def append(self, c: Circuit) -> None:
        """The circuit's centre, at the image nearest to the line's end."""
        line = c.line
        last = line.points[-1 if c.ahead else 0]
        at = last + self.wrap(self.mesh.centre(c.ring) - last)
        where = len(line.points) if c.ahead else 0
        line.points.insert(where, at)
        line.cores.insert(where, len(c.ring))
        c.tentative += 1
        if self.fans is not None:
            self.fans.append((c, c.cap is not None, at, list(c.ring)))

    def trace(self, c: Circuit, limit: int, primary: bool) -> None:
        while True:
            still = 0
            while still < len(c.ring) and len(c.ring) >= 3:
                m = self.move(c, self.turn % len(c.ring))
                self.turn += 1
                still += 1
                if m is not None:
                    self.apply(c, m, primary)
                    if c.ring:
                        self.append(c)
                    still = 0
            if len(c.ring) >= limit or len(c.ring) < 3:
                return
            for k in range(len(c.ring)):
                m = self.insertion(c, (self.turn + k) % len(c.ring))
                if m is not None:
                    self.apply(c, m, primary)
                    self.append(c)
                    break
            else:
                return
            self.turn += 1

    # -- joining lines

    def join(self) -> int:
        """Close, merge and knot circuits that meet on all their edges."""
        mesh = self.mesh
        alive = [c for x in self.lines if x.replaced is None for c in x.ends if c.dangling and c.ring]
        group = {c: c for c in alive}

        def top(c: Circuit) -> Circuit:
            while group[c] is not c:
                c = group[c]
            return c

        for c in alive:
            met = [self.owner[mesh.opp[h]] if mesh.opp[h] >= 0 else None for h in c.ring]
            # The two circuits of a line that has not moved yet lie on each other.
            fresh = not c.line.faces
            c.blocked = all(o is not None and o in group and o is not c and not (fresh and o.line is c.line) for o in met)
            if c.blocked:
                for o in set(met):
                    group[top(o)] = top(c)
        sets: dict[Circuit, list[Circuit]] = {}
        for c in alive:
            sets.setdefault(top(c), []).append(c)
        knots = 0
        for arms in sets.values():
            if len(arms) < 2 or not all(c.blocked for c in arms):
                continue
            ends = [c.line.points[-1 if c.ahead else 0] for c in arms]
            if len(arms) > 2:
                middle = ends[0] + np.mean([self.wrap(e - ends[0]) for e in ends], axis=0)
                ring = len(self.rings)
                for c, e in zip(arms, ends):
                    c.line.points.insert(len(c.line.points) if c.ahead else 0, e + self.wrap(middle - e))
                    c.line.cores.insert(len(c.line.cores) if c.ahead else 0, len(c.ring))
                    self.rings[c] = ring
                knots += 1
            elif arms[0].line is arms[1].line:
                line = arms[0].line
                gap = self.wrap(line.points[0] - line.points[-1])
                if np.abs(gap).max() > ATOM_EPSILON:
                    line.points.append(line.points[-1] + gap)
                    line.cores.append(line.cores[-1])
                self.rings[arms[0]] = self.rings[arms[1]] = len(self.rings)
            else:
                self.merge(*arms)
            for c in arms:
                c.dangling, c.tentative = False, 0
        return knots

    def merge(self, a: Circuit, b: Circuit) -> None:
        """The line of b goes on where that of a ends."""
        x, y = a.line, b.line
        points, cores = (y.points, y.cores) if not b.ahead else (y.points[::-1], y.cores[::-1])
        end = x.points[-1 if a.ahead else 0]
        gap = self.wrap(points[0] - end)
        moved = [p - points[0] + end + gap for p in points]
        if np.abs(gap).max() <= ATOM_EPSILON:
            moved, cores = moved[1:], cores[1:]
        far = next(c for c in y.ends if c is not b)
        if a.ahead:
            x.points, x.cores = x.points + moved, x.cores + list(cores)
        else:
            x.points, x.cores = moved[::-1] + x.points, list(cores)[::-1] + x.cores
        far.line, far.ahead = x, a.ahead
        x.ends[x.ends.index(a)] = far
        x.faces += y.faces
        y.replaced = x

    def run(self) -> list[Line]:
        for limit in range(3, self.max_trial + self.stretch + 1):
            dangling = [c for x in self.lines if x.replaced is None for c in x.ends if c.dangling and c.ring]
            for c in dangling:
                self.trace(c, limit, limit <= self.max_trial)
            if limit % 2 and limit <= self.max_trial:
                self.find(limit)
            self.secondary(limit)
            self.join()
            if limit >= self.max_trial:
                for c in dangling:
                    if c.dangling and c.cap is None:
                        c.cap, c.tentative = list(c.ring), 0
        return [x for x in self.lines if x.replaced is None]


def _fans_by_line(tracer: Tracer) -> dict[Line, list[dict]]:
    """What regions.circuit_triangles takes, under the lines that the circuits ended up in."""
    out: dict[Line, list[dict]] = {}
    mesh = tracer.mesh
    for n, (c, stored, centre, ring) in enumerate(tracer.fans or ()):
        line = c.line
        while line.replaced is not None:
            line = line.replaced
        near = [(centre + tracer.wrap(mesh.at[mesh.tail[h]] - centre)).tolist() for h in ring]
        out.setdefault(line, []).append({"fan": n, "stored": stored, "dangling": c.dangling, "centre": centre.tolist(), "ring": near})
    return out


def trace_frame(edges: pd.DataFrame, vertices: pd.DataFrame, max_trial: int, stretch: int, fans: bool = False) -> pd.DataFrame:
    columns = "frame_id segment_id line core_size bx by bz cluster_id n_pre n_post nodes faces fans".split()
    if not len(edges) or not len(vertices):
        return pd.DataFrame(columns=columns)
    e = edges.sort_values(["face", "slot"]).reset_index(drop=True)
    name = {(f, s): i for i, (f, s) in enumerate(zip(e["face"], e["slot"]))}
    names = list(e["face"])
    opp = [-1 if pd.isna(f) else name[int(f), int(s)] for f, s in zip(e["opp_face"], e["opp_slot"])]
    matrix = np.array(list(vertices["m"].iloc[0]), float).reshape(3, 3)
    pbc = np.array(list(vertices["pbc"].iloc[0]), bool)
    inverse = np.linalg.inv(matrix)

    def wrap(v: np.ndarray) -> np.ndarray:
        r = v @ inverse
        return np.where(pbc, r - np.floor(r + 0.5), r) @ matrix

    known = [c is not None for c in e["cv"]]
    mesh = Surface(
        e["v1"].tolist(),
        e["v2"].tolist(),
        opp,
        e[["px", "py", "pz"]].to_numpy(float),
        np.array([list(c) if c is not None else [0.0] * 3 for c in e["cv"]], float),
        [None if a == b or r is None else np.array(list(r), float).reshape(3, 3) for a, b, r in zip(e["c1"], e["c2"], e["rtm"])],
        [0 if pd.isna(c) else int(c) for c in e["c1"]],
        {v: np.array([x, y, z]) for v, x, y, z in zip(vertices["v"], vertices["x"], vertices["y"], vertices["z"])},
    )
    tracer = Tracer(mesh, wrap, max_trial, stretch, fans)
    if not all(known):  # edges without an ideal vector can be in no circuit
        for h in itertools.compress(range(len(known)), (not k for k in known)):
            tracer.owner[h] = Circuit([], Line(np.zeros(3), 0), True)
    rows, traced = [], tracer.run()
    by_line = _fans_by_line(tracer)
    for i, x in enumerate(traced):
        nodes = [{"side": "fwd" if c.ahead else "bwd", "ring_id": tracer.rings.get(c), "edge_count": len(c.ring), "is_dangling": c.dangling, "is_blocked": c.blocked, "cap": [int(h) for h in c.cap] if c.cap else None} for c in x.ends]
        pre = sum(c.tentative for c in x.ends if not c.ahead and c.dangling)
        post = sum(c.tentative for c in x.ends if c.ahead and c.dangling)
        faces = [{"face": int(names[3 * f]), "flag": flag, "dangling": c.dangling} for f, flag, c in x.faces]
        line = [{"x": a, "y": b, "z": d} for a, b, d in np.array(x.points).tolist()]
        rows.append((edges["frame_id"].iloc[0], i, line, [int(n) for n in x.cores], *x.b.tolist(), x.cluster, pre, post, nodes, faces, by_line.get(x, [])))
    return pd.DataFrame(rows, columns=columns)


def trace(edges: DataFrame, vertices: DataFrame, boxes: DataFrame, max_trial: int = 14, stretch: int = 9, fans: bool = False) -> DataFrame:
    """Segments of each frame from half-edges (mesh.link_opposites of mesh.edge_vectors),
    mesh vertices (frame_id, v, x, y, z) and prepared cells.

    Rows have the columns that network.finish_segments takes, nodes (their circuits,
    with the cap of a dangling end), the faces swept, with flag 1 by primary ones and whether that circuit dangles, and, if
    asked for, fans: the circuit around each point, numbered in the order of tracing.
    """
    cols = ["frame_id", "face", "slot", "v1", "v2", "opp_face", "opp_slot", "px", "py", "pz", "cv", "c1", "c2", "rtm"]
    at = vertices.join(boxes, "frame_id").select("frame_id", "v", "x", "y", "z", F.col("cell")["m"].alias("m"), F.col("cell")["pbc"].alias("pbc"))

    def run(e: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        return trace_frame(e, v, max_trial, stretch, fans)

    return edges.select(*cols).groupBy("frame_id").cogroup(at.groupBy("frame_id")).applyInPandas(run, SCHEMA)
