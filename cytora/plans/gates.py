"""Gate trees: value objects that compile to boolean columns, evaluated for all populations in one pass."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytora.functions import exprs as X
from cytora.functions.exprs import Axis, Logicle
from cytora.operators.surgery import unique_name


class Kind(str, Enum):
    POLYGON = "Polygon"
    RECTANGLE = "Rectangle"
    QUADRANT = "Quadrant"
    CURLY = "CurlyQuadrant"
    OFFSET = "OffsetQuadrant"
    THRESHOLD = "Threshold"
    RANGE = "Range"
    MERGE = "Merge"
    EXCLUDE = "Exclude"
    OVERLAP = "Overlap"


QUADRANTS = ("TopRight", "TopLeft", "BottomRight", "BottomLeft")
REGIONS = {
    Kind.QUADRANT: QUADRANTS, Kind.CURLY: QUADRANTS, Kind.OFFSET: QUADRANTS, Kind.THRESHOLD: ("More", "Less"),
    Kind.RANGE: ("InRange", "BelowRange", "AboveRange"),
}
BOOLEAN = (Kind.MERGE, Kind.EXCLUDE, Kind.OVERLAP)


@dataclass(frozen=True)
class Operand:
    gate: str
    region: str = "Primary"


@dataclass(frozen=True)
class Gate:
    """A gate; ``parent`` names another gate of the tree, ``first`` and ``second`` are operands of boolean gates."""

    name: str
    kind: Kind
    x: str = ""
    y: str = ""
    vertices: tuple[tuple[float, float], ...] = ()
    x_axis: Axis = Axis()
    y_axis: Axis = Axis()
    parent: str | None = None
    parent_region: str = "Primary"
    first: Operand | None = None
    second: Operand | None = None

    @property
    def regions(self) -> tuple[str, ...]:
        return REGIONS.get(self.kind, ("Primary",))


class GateError(ValueError):
    """The tree can't be compiled: unknown names, cycles, clashing names."""


@dataclass
class GateTree:
    """Gates by name, parents before children."""

    gates: list[Gate] = field(default_factory=list)

    def add(self, gate: Gate) -> GateTree:
        names = {g.name.lower() for g in self.gates}
        if gate.name.lower() in names:
            raise GateError(f"name {gate.name} is taken")
        if gate.parent is not None and gate.parent not in {g.name for g in self.gates}:
            raise GateError(f"no parent {gate.parent}")
        self.gates.append(gate)
        return self

    def get(self, name: str) -> Gate:
        for g in self.gates:
            if g.name == name:
                return g
        raise GateError(f"no gate {name}")

    def dependants(self, name: str) -> set[str]:
        """Gates that go when ``name`` goes: its descendants and boolean gates over any of them."""
        gone = {name}
        while True:
            more = {g.name for g in self.gates if g.name not in gone and (g.parent in gone or any(o and o.gate in gone for o in (g.first, g.second)))}
            if not more:
                return gone
            gone |= more

    def remove(self, name: str) -> GateTree:
        gone = self.dependants(name)
        return GateTree([g for g in self.gates if g.name not in gone])

    def rename_channel(self, old: str, new: str) -> GateTree:
        return GateTree([Gate(**{**g.__dict__, "x": new if g.x == old else g.x, "y": new if g.y == old else g.y}) for g in self.gates])

    def remove_channel(self, channel: str) -> GateTree:
        """The tree without gates on a channel, and without what depends on them."""
        out = self
        for g in self.gates:
            if channel in (g.x, g.y) and g.name in {k.name for k in out.gates}:
                out = out.remove(g.name)
        return out

    def copied(self, name: str) -> list[Gate]:
        """A gate, its descendants and the operands their boolean gates need, parents and operands first."""
        wanted, order = set(), []

        def take(n: str, seen: tuple[str, ...]) -> None:
            if n in seen:
                raise GateError(f"{n} depends on itself")
            if n in wanted:
                return
            g = self.get(n)
            for o in (g.first, g.second):
                if o is not None:
                    take(o.gate, (*seen, n))
            wanted.add(n)
            order.append(g)

        below = [name]
        for n in below:
            below += [g.name for g in self.gates if g.parent == n and g.name not in below]
        for n in below:
            take(n, ())
        return order

    def paste(self, gates: list[Gate], columns: list[str], parent: str | None = None, region: str = "Primary") -> GateTree:
        """A tree with copies of ``gates`` below ``parent``: names made unique, channels matched without regard to case.

        Gates on channels that don't exist are left out, and so is what depends on them.
        """
        known = {c.lower(): c for c in columns}
        out, names = GateTree(list(self.gates)), {}
        for g in gates:
            on = [known.get(c.lower(), "") if c else "" for c in (g.x, g.y)]
            lost = any(c and not k for c, k in zip((g.x, g.y), on)) or any(o is not None and o.gate not in names for o in (g.first, g.second))
            inside = g.parent in {k.name for k in gates}
            if lost or (inside and g.parent not in names):
                continue
            names[g.name] = unique_name(g.name, {k.name for k in out.gates}, True)
            moved = lambda o: None if o is None else Operand(names[o.gate], o.region)
            at = (names[g.parent], g.parent_region) if inside else (parent, region)
            out.add(Gate(**{**g.__dict__, "name": names[g.name], "x": on[0], "y": on[1], "parent": at[0], "parent_region": at[1], "first": moved(g.first), "second": moved(g.second)}))
        return out

    def to_json(self) -> str:
        return json.dumps([{k: (v.value if isinstance(v, Kind) else asdict(v) if isinstance(v, Operand) else v) for k, v in g.__dict__.items()} for g in self.gates])

    @staticmethod
    def from_json(text: str) -> GateTree:
        def axis(v: list) -> Axis:
            return Axis(v[0], v[1], v[2], v[3], Logicle(*v[4]))

        out = GateTree()
        for d in json.loads(text):
            d["kind"] = Kind(d["kind"])
            d["vertices"] = tuple(tuple(p) for p in d["vertices"])
            d["x_axis"], d["y_axis"] = axis(d["x_axis"]), axis(d["y_axis"])
            for k in ("first", "second"):
                d[k] = Operand(**d[k]) if d[k] else None
            out.gates.append(Gate(**d))
        return out


def population_name(gate: str, region: str) -> str:
    return gate if region == "Primary" else f"{gate}:{region}"


def own_predicate(gate: Gate, region: str, columns: list[str]) -> Column:
    """The gate's test on one event, without its parent."""
    if gate.x not in columns or (gate.y and gate.y not in columns):
        return F.lit(False)
    if gate.kind is Kind.CURLY:
        return _curly(gate, region)
    if not gate.vertices:
        return F.lit(True)
    flat = not gate.y or gate.kind in (Kind.THRESHOLD, Kind.RANGE)
    x = gate.x_axis.normalised(F.col(gate.x))
    y = F.lit(0.0) if flat else gate.y_axis.normalised(F.col(gate.y))
    points = [(gate.x_axis.normalised_number(a), 0.0 if flat else gate.y_axis.normalised_number(b)) for a, b in gate.vertices]
    if gate.kind is Kind.POLYGON:
        return X.inside_polygon(x, y, points)
    if gate.kind is Kind.RECTANGLE:
        if len(points) < 2:
            return F.lit(False)
        (ax, ay), (bx, by) = points[:2]
        return X.at_least(x, min(ax, bx)) & X.at_most(x, max(ax, bx)) & X.at_least(y, min(ay, by)) & X.at_most(y, max(ay, by))
    if gate.kind is Kind.THRESHOLD or (gate.kind is Kind.RANGE and len(points) < 2):
        more = X.at_least(x, points[0][0])
        return ~more if region == "Less" else more
    if gate.kind is Kind.RANGE:
        lo, hi = sorted((points[0][0], points[1][0]))
        return {"InRange": X.at_least(x, lo) & X.at_most(x, hi), "BelowRange": X.below(x, lo), "AboveRange": X.above(x, hi)}[region]
    if gate.kind in (Kind.QUADRANT, Kind.OFFSET):
        cx, cy = points[0]
        top = X.at_least(y, cy)
        under = X.below(y, cy)
        upper, lower = cx, cx
        if gate.kind is Kind.OFFSET:
            upper = points[1][0] if len(points) > 1 else cx
            lower = points[2][0] if len(points) > 2 else cx
        return {
            "TopRight": top & X.at_least(x, upper), "TopLeft": top & X.below(x, upper),
            "BottomRight": under & X.at_least(x, lower), "BottomLeft": under & X.below(x, lower),
        }[region]
    raise GateError(f"no test for {gate.kind}")


#: Slope of a curly quadrant's borders on logarithmic axes, and the least coordinate they see.
CURL, CURL_FLOOR = 0.1, 1e-6


def _curly(gate: Gate, region: str) -> Column:
    if not gate.vertices or not gate.y:
        return F.lit(False)
    cx, cy = (max(v, CURL_FLOOR) for v in gate.vertices[0])
    rx, ry = F.col(gate.x).cast("double"), F.col(gate.y).cast("double")
    sound = F.coalesce(~F.isnan(rx) & ~F.isnan(ry), F.lit(False))
    ln_x, ln_y = (F.ln(F.greatest(c, F.lit(CURL_FLOOR))) for c in (rx, ry))
    # the border between the top regions leans with y, the one between the right regions with x
    leaning_x = F.exp(CURL * (ln_y - math.log(cy)) + math.log(cx))
    leaning_y = F.exp(CURL * (ln_x - math.log(cx)) + math.log(cy))
    upper, righter = ry >= gate.vertices[0][1], rx >= gate.vertices[0][0]
    test = {
        "TopLeft": upper & (rx < leaning_x),
        "BottomRight": righter & (ry < leaning_y),
        "BottomLeft": ~upper & ~righter,
        "TopRight": (rx >= F.when(upper, leaning_x).otherwise(gate.vertices[0][0])) & (ry >= F.when(righter, leaning_y).otherwise(gate.vertices[0][1])),
    }[region]
    return sound & F.coalesce(test, F.lit(False))


def compile_tree(tree: GateTree, columns: list[str]) -> dict[str, Column]:
    """Mask of every population by name; a population lies within its parent, a boolean one combines whole paths."""
    done: dict[tuple[str, str], Column] = {}

    def mask(name: str, region: str, seen: tuple[tuple[str, str], ...]) -> Column:
        key = (name, region)
        if key in done:
            return done[key]
        if key in seen:
            raise GateError(f"{name} depends on itself")
        gate = tree.get(name)
        if region not in gate.regions:
            raise GateError(f"{name} has no region {region}")
        seen = (*seen, key)
        if gate.kind in BOOLEAN:
            known = {g.name for g in tree.gates}
            if not gate.first or not gate.second or gate.first.gate not in known or gate.second.gate not in known:
                own = F.lit(False)
            else:
                a, b = mask(gate.first.gate, gate.first.region, seen), mask(gate.second.gate, gate.second.region, seen)
                own = {Kind.MERGE: a | b, Kind.EXCLUDE: a & ~b, Kind.OVERLAP: a & b}[gate.kind]
        else:
            own = own_predicate(gate, region, columns)
        if gate.parent is not None:
            own = mask(gate.parent, gate.parent_region, seen) & own
        done[key] = own
        return own

    return {population_name(g.name, r): mask(g.name, r, ()) for g in tree.gates for r in g.regions}


def parents(tree: GateTree) -> dict[str, str | None]:
    return {population_name(g.name, r): None if g.parent is None else population_name(g.parent, g.parent_region) for g in tree.gates for r in g.regions}


def counts(events: DataFrame, tree: GateTree, sample: str) -> DataFrame:
    """(sample, population, n_events, freq_of_parent, freq_of_all): the whole tree in one aggregation over the events.

    An empty parent or sample gives frequency 0; a null sample is a group of its own.
    """
    masks = compile_tree(tree, events.columns)
    names = list(masks)
    # masks become columns first, so that a parent's test is made once
    marked = events.select(F.col(sample), *[masks[n].alias(f"m{i}") for i, n in enumerate(names)])
    sums = marked.groupBy(sample).agg(F.count(F.lit(1)).alias("_all"), *[F.sum(F.col(f"m{i}").cast("long")).alias(f"m{i}") for i in range(len(names))])
    up = parents(tree)
    share = lambda n, of: F.when(of > 0, 100.0 * n / of).otherwise(0.0)
    rows = F.array(
        *[
            F.struct(
                F.lit(n).alias("population"), F.col(f"m{i}").alias("n_events"),
                share(F.col(f"m{i}"), F.col("_all") if up[n] is None else F.col(f"m{names.index(up[n])}")).alias("freq_of_parent"),
                share(F.col(f"m{i}"), F.col("_all")).alias("freq_of_all"),
            )
            for i, n in enumerate(names)
        ]
    )
    return sums.select(sample, F.inline(rows))
