"""Facade for scripts: groups, strategies with gate definitions, samples and populations. Nothing runs before a result is asked for."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytora.functions.exprs import Axis
from cytora.operators import channels as C
from cytora.operators import linalg, platforms, stats, surgery
from cytora.plans import gates as G
from cytora.plans.gates import Gate, GateError, GateTree, Kind, Operand

_SHAPES = {Kind.POLYGON: (3, None), Kind.RECTANGLE: (2, 2), Kind.QUADRANT: (1, 1), Kind.CURLY: (1, 1), Kind.OFFSET: (3, 3), Kind.THRESHOLD: (1, 1), Kind.RANGE: (2, 2)}


@dataclass(frozen=True)
class Requirement:
    """What a script asks its user for: ``kind`` is channel, integer, float, enum or option."""

    name: str
    kind: str
    default: object = None
    choices: tuple[str, ...] = ()

    def accept(self, value: object) -> object:
        """The value in its kind, or an error."""
        if self.kind == "integer":
            return int(value)
        if self.kind == "float":
            return float(value)
        if self.kind == "option":
            return bool(value)
        if self.kind == "enum" and value not in self.choices:
            raise ValueError(f"{self.name} must be one of {', '.join(self.choices)}")
        return value


@dataclass
class Script:
    """A statistic in Python: ``entry(matrix, channels, parameters)``, what it requires, and how its value is shown."""

    entry: Callable
    channels: list[str]
    parameters: dict = field(default_factory=dict)
    requires: tuple[Requirement, ...] = ()
    format: Callable[[float], str] = str

    def settings(self) -> dict:
        """Parameters with defaults, each in its kind."""
        known = {r.name: r.accept(self.parameters.get(r.name, r.default)) for r in self.requires}
        return {**self.parameters, **known}


class Strategy:
    """A gate tree under construction; every gate starts with its count and share of the parent."""

    def __init__(self) -> None:
        self.tree = GateTree()
        self.statistics: list[tuple[str, str | None]] = [("NumberOfEvents", None), ("FrequencyOfParent", None)]
        self.scripts: dict[str, Script] = {}

    def children(self, name: str | None = None) -> list[str]:
        """Names of the gates right below a gate, or at the top."""
        return [g.name for g in self.tree.gates if g.parent == name]

    def __getitem__(self, name: str) -> Gate:
        return self.tree.get(name)

    def _define(self, kind: Kind, name: str, x: str, y: str, vertices, parent: str | None, region: str, x_axis: Axis, y_axis: Axis) -> Strategy:
        points = tuple((float(a), float(b)) for a, b in vertices)
        least, most = _SHAPES[kind]
        if len(points) < least or (most is not None and len(points) > most):
            raise GateError(f"{kind.value} needs {least}{'' if most == least else ' or more'} vertices")
        self.tree.add(Gate(name, kind, x, y, points, x_axis, y_axis, parent, region))
        return self

    def define_gate_polygon(self, name, x, y, vertices, parent=None, region="Primary", x_axis=Axis(), y_axis=Axis()):
        return self._define(Kind.POLYGON, name, x, y, vertices, parent, region, x_axis, y_axis)

    def define_gate_rectangle(self, name, x, y, vertices, parent=None, region="Primary", x_axis=Axis(), y_axis=Axis()):
        return self._define(Kind.RECTANGLE, name, x, y, vertices, parent, region, x_axis, y_axis)

    def define_gate_quadrant(self, name, x, y, centre, parent=None, region="Primary", x_axis=Axis(), y_axis=Axis()):
        return self._define(Kind.QUADRANT, name, x, y, [centre], parent, region, x_axis, y_axis)

    def define_gate_curly(self, name, x, y, centre, parent=None, region="Primary", x_axis=Axis(), y_axis=Axis()):
        return self._define(Kind.CURLY, name, x, y, [centre], parent, region, x_axis, y_axis)

    def define_gate_offset(self, name, x, y, centre, upper, lower, parent=None, region="Primary", x_axis=Axis(), y_axis=Axis()):
        return self._define(Kind.OFFSET, name, x, y, [centre, (upper, centre[1]), (lower, centre[1])], parent, region, x_axis, y_axis)

    def define_gate_threshold(self, name, x, value, parent=None, region="Primary", x_axis=Axis()):
        return self._define(Kind.THRESHOLD, name, x, "", [(value, 0)], parent, region, x_axis, Axis())

    def define_gate_range(self, name, x, low, high, parent=None, region="Primary", x_axis=Axis()):
        return self._define(Kind.RANGE, name, x, "", [(low, 0), (high, 0)], parent, region, x_axis, Axis())

    def _boolean(self, kind: Kind, name: str, first: str, second: str) -> Strategy:
        a, b = (self._operand(k) for k in (first, second))
        # a scripted boolean gate hangs below its first operand
        self.tree.add(Gate(name, kind, parent=a.gate, parent_region=a.region, first=a, second=b))
        return self

    def _operand(self, key: str) -> Operand:
        gate, _, region = key.partition(":")
        self.tree.get(gate)
        return Operand(gate, region or "Primary")

    def define_gate_merge(self, name, first, second):
        return self._boolean(Kind.MERGE, name, first, second)

    def define_gate_exclude(self, name, first, second):
        return self._boolean(Kind.EXCLUDE, name, first, second)

    def define_gate_overlap(self, name, first, second):
        return self._boolean(Kind.OVERLAP, name, first, second)

    def define_statistics(self, kind: str, channel: str | None = None) -> Strategy:
        if kind not in ("NumberOfEvents", "FrequencyOfParent", "FrequencyOfAll", *stats.NATIVE):
            raise ValueError(f"no statistic {kind}")
        if kind in stats.NATIVE and not channel:
            raise ValueError(f"{kind} needs a channel")
        if (kind, channel) not in self.statistics:
            self.statistics.append((kind, channel))
        return self

    def define_statistics_python(self, name: str, entry: Callable, channels: list[str], parameters: dict | None = None, requires: tuple[Requirement, ...] = (), format: Callable[[float], str] = str) -> Strategy:  # noqa: A002
        """A statistic that ``evaluate`` runs over the matrix of every population of every sample."""
        if not callable(entry) or not callable(format):
            raise ValueError("entry and format must be callable")
        script = Script(entry, list(channels), parameters or {}, tuple(requires), format)
        script.settings()
        self.scripts[name] = script
        return self

    def resolve(self, key: str) -> str:
        """Name of the population a key stands for: ``gate``, ``gate:Region``, ``gate Region`` or a region of one gate only."""
        names = [G.population_name(g.name, r) for g in self.tree.gates for r in g.regions]
        if key in names:
            return key
        shown = {n.replace(":", " "): n for n in names}
        if key in shown:
            return shown[key]
        regions = [n for n in names if n.partition(":")[2] == key]
        if len(regions) == 1:
            return regions[0]
        raise KeyError(f"{key} is ambiguous" if regions else key)


@dataclass
class Population:
    """Events of a population in one sample."""

    group: Grouping
    key: str
    sample: object

    def rows(self) -> DataFrame:
        return self.group.population(self.key).filter(F.col(self.group.sample).eqNullSafe(F.lit(self.sample)))

    def mask(self) -> DataFrame:
        """(event, mask) of every event of the sample."""
        rows = self.group.events_of(self.sample)
        return rows.select(self.group.event, self.group.masks(rows)[self.key].alias("mask"))

    def matrix(self, channels: list[str] | None = None) -> DataFrame:
        """(event, raw channels...)."""
        rows = self.group.with_embeddings(self.group.events)
        names = channels or self.group.channels
        keys = self.rows().select(self.group.sample, self.group.event)
        return rows.join(keys, [self.group.sample, self.group.event], "left_semi").select(self.group.event, *names)

    def compensated_matrix(self, channels: list[str] | None = None) -> DataFrame:
        """(event, compensated channels...)."""
        return self.rows().select(self.group.event, *(channels or self.group.channels))

    def set_embedding(self, name: str, values: DataFrame) -> None:
        """Store ``values`` (event, value) as a column of the group's events; events without a value are NaN."""
        self.group.set_embedding(name, values.select(F.lit(self.sample).alias(self.group.sample), self.group.event, "value"))


class Grouping:
    """Samples with the same channels, a strategy and a compensation."""

    def __init__(self, name: str, events: DataFrame | None, channels: list[str], sample: str = "sample_id", event: str = "event_idx"):
        self.name, self.events, self.channels, self.sample, self.event = name, events, list(channels), sample, event
        self.strategy, self.compensations = Strategy(), linalg.Registry(channels)
        self.embeddings: dict[str, DataFrame] = {}

    def can_accept(self, channels: list[str]) -> bool:
        return not self.channels or list(channels) == self.channels

    def add(self, events: DataFrame, channels: list[str]) -> Grouping:
        """Further samples of the same channels in the same order."""
        if not self.can_accept(channels):
            raise C.ChannelError("the group holds samples of other channels")
        self.channels = self.channels or list(channels)
        new = C.projected(events, self.channels, [self.sample, self.event])
        self.events = new if self.events is None else self.events.unionByName(new, allowMissingColumns=True)
        return self

    def add_fcs(self, spark, path: str) -> Grouping:
        """Samples from instrument files, which need the group's channels in its order; the data source has to be registered."""
        lists = [tuple(c["name"] for c in r["channels"]) for r in spark.read.format("fcs").option("part", "text").load(path).select("channels").distinct().collect()]  # channel lists only
        if len(set(lists)) > 1:
            raise C.ChannelError("the files hold different channels")
        names = self.channels or (list(lists[0]) if lists else [])
        rows = spark.read.format("fcs").load(path)
        at = {n: i for i, n in enumerate(lists[0])} if lists else {}
        missing = [n for n in names if n not in at]
        if missing:
            raise C.ChannelError(f"missing channels: {', '.join(missing)}")
        return self.add(rows.select(F.col("sample").alias(self.sample), F.col("event_idx").alias(self.event), *[F.get("event_values", F.lit(at[n])).alias(n) for n in names]), names)

    def create_compensation(self, name: str, matrix: np.ndarray) -> int:
        return self.compensations.add(name, self.channels, matrix)

    def set_compensation(self, index: int) -> None:
        self.compensations.choose(index)

    def set_embedding(self, name: str, values: DataFrame) -> None:
        """(sample, event, value) as a column ``name`` of the events, in place of what it held for these samples."""
        old = self.embeddings.get(name)
        if old is not None:
            values = values.unionByName(old.join(values.select(self.sample).distinct(), self.sample, "left_anti"))
        self.embeddings[name] = values

    def with_embeddings(self, events: DataFrame) -> DataFrame:
        """Events with their embeddings, which shadow channels of the same name."""
        for name, values in self.embeddings.items():
            events = surgery.write_back(events.drop(name), values.withColumnRenamed("value", name), [self.sample, self.event], name)
            events = events.withColumn(name, F.coalesce(name, F.lit(float("nan"))))
        return events

    def compensated(self) -> DataFrame:
        return self.with_embeddings(linalg.compensated(self.events, self.channels, self.compensations.known[self.compensations.chosen][1]))

    def events_of(self, sample: object) -> DataFrame:
        return self.compensated().filter(F.col(self.sample).eqNullSafe(F.lit(sample)))

    def masks(self, rows: DataFrame) -> dict[str, Column]:
        return G.compile_tree(self.strategy.tree, rows.columns)

    def population(self, key: str) -> DataFrame:
        """Events of a population of all samples, by any of its names."""
        rows = self.compensated()
        return rows.filter(self.masks(rows)[self.strategy.resolve(key)])

    def get_population(self, key: str, sample: object) -> Population:
        return Population(self, self.strategy.resolve(key), sample)

    def get_statistics(self, key: str, kind: str, channel: str | None = None) -> DataFrame:
        """(sample, value) of one statistic of a population; a statistic that isn't defined is NaN."""
        name = self.strategy.resolve(key)
        if (kind, channel) not in self.strategy.statistics and kind not in self.strategy.scripts:
            return self.events.select(self.sample).distinct().withColumn("value", F.lit(math.nan))
        return self.evaluate().filter((F.col("population") == name) & (F.col("kind") == kind) & F.col("channel").eqNullSafe(F.lit(channel))).select(self.sample, "value")

    def row_map(self, keys: list[str]) -> DataFrame:
        """Where each row of a job over these populations of all samples comes from."""
        rows = self.compensated()
        names = [self.strategy.resolve(k) for k in keys]
        chosen = platforms.source_rows(rows, self.masks(rows), [platforms.Source(n) for n in names], [], self.sample, self.event)
        return platforms.row_map(chosen, self.sample, self.event, self.name, self.name)

    def evaluate(self) -> DataFrame:
        """(sample, population, kind, channel, value): all statistics of all populations.

        Counts, shares and moments come from one aggregation, medians from exact order statistics over (sample, population), scripts
        from the matrices of the populations.
        """
        rows = self.compensated()
        tree = self.strategy.tree
        masks, up = self.masks(rows), G.parents(tree)
        names = list(masks)
        native = [(k, c) for k, c in self.strategy.statistics if k != "Median"]
        used = sorted({c for _, c in native if c})
        marked = rows.select(self.sample, *used, *[masks[n].alias(f"m{i}") for i, n in enumerate(names)])
        aggregates: list[Column] = [F.count(F.lit(1)).alias("total")] + [F.sum(F.col(f"m{i}").cast("long")).alias(f"n{i}") for i in range(len(names))]
        for i in range(len(names)):
            for k, (kind, channel) in enumerate(native):
                if kind in stats.NATIVE:
                    aggregates.append(stats.NATIVE[kind](stats.kept(F.col(channel), F.col(f"m{i}"))).alias(f"s{i}_{k}"))
        sums = marked.groupBy(self.sample).agg(*aggregates)
        share = lambda n, of: F.when(of > 0, 100.0 * n / of).otherwise(0.0)
        out = []
        for i, n in enumerate(names):
            of = F.col("total") if up[n] is None else F.col(f"n{names.index(up[n])}")
            for k, (kind, channel) in enumerate(native):
                value = {"NumberOfEvents": F.col(f"n{i}").cast("double"), "FrequencyOfParent": share(F.col(f"n{i}"), of), "FrequencyOfAll": share(F.col(f"n{i}"), F.col("total"))}.get(kind)
                value = F.col(f"s{i}_{k}") if value is None else value
                out.append(F.struct(F.lit(n).alias("population"), F.lit(kind).alias("kind"), F.lit(channel).cast("string").alias("channel"), value.cast("double").alias("value")))
        found = sums.select(self.sample, F.inline(F.array(*out)))
        everywhere = rows.select(self.sample).distinct().withColumn("population", F.explode(F.array(*[F.lit(n) for n in names])))
        member = platforms.marked(rows, masks).withColumn("population", F.explode("populations"))
        asked = [c for k, c in self.strategy.statistics if k == "Median"]
        if asked:
            q = stats.exact_quantiles(member, [self.sample, "population"], asked, [0.5]).select(F.col(self.sample).alias("_s"), F.col("population").alias("_p"), F.col("channel").alias("_c"), F.col("q")[0].alias("_v"))
            grid = everywhere.withColumn("channel", F.explode(F.array(*[F.lit(c) for c in asked])))
            on = F.col(self.sample).eqNullSafe(F.col("_s")) & (F.col("population") == F.col("_p")) & (F.col("channel") == F.col("_c"))
            found = found.unionByName(grid.join(q, on, "left").select(self.sample, "population", F.lit("Median").alias("kind"), "channel", F.coalesce("_v", F.lit(0.0)).alias("value")))
        for name, script in self.strategy.scripts.items():
            keyed = member.withColumn("_key", F.to_json(F.struct(F.col(self.sample).alias("s"), F.col("population").alias("p"))))
            values = stats.python_statistic(keyed, "_key", script.channels, script.entry, script.settings())
            grid = everywhere.withColumn("_key", F.to_json(F.struct(F.col(self.sample).alias("s"), F.col("population").alias("p"))))
            row = grid.join(values, "_key", "left").select(self.sample, "population", F.lit(name).alias("kind"), F.lit(None).cast("string").alias("channel"), F.coalesce("value", F.lit(math.nan)).alias("value"))
            found = found.unionByName(row)
        return found

    def statistic_table(self) -> DataFrame:
        """One row per sample, one column per statistic of a population."""
        rows = self.evaluate().withColumn("stat", F.concat_ws(" ", "population", "kind", "channel"))
        names = [G.population_name(g.name, r) for g in self.strategy.tree.gates for r in g.regions]
        columns = [" ".join(x for x in (n, kind, channel) if x) for n in names for kind, channel in [*self.strategy.statistics, *((k, None) for k in self.strategy.scripts)]]
        return rows.groupBy(self.sample).pivot("stat", columns).agg(F.first("value"))


class Workspace:
    """Groups by name, and storage for results that later steps use again."""

    def __init__(self) -> None:
        self.groups: dict[str, Grouping] = {}
        self.storage: dict[str, object] = {}

    def add(self, group: Grouping) -> Grouping:
        self.groups[group.name] = group
        return group

    def __getitem__(self, name: str) -> Grouping:
        return self.groups[name]

    def cached(self, key: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A table under ``key``, built and written once."""
        from cytora.session import materialise

        if key not in self.storage:
            self.storage[key] = materialise(build())
        return self.storage[key]

    def run(self, script: Callable[[DataFrame, dict], dict[str, DataFrame]], group: str, keys: list[str], features: list[str], parameters: dict | None = None) -> dict[str, DataFrame]:
        """A job's script over the rows of populations of a group; it gets (source_id, sample, population, event, features...) and gives tables by name.

        A table ``embedding:<name>`` (sample, event, value) becomes an embedding of the group.
        """
        g = self[group]
        rows = g.compensated()
        chosen = platforms.source_rows(rows, g.masks(rows), [platforms.Source(g.strategy.resolve(k)) for k in keys], features, g.sample, g.event)
        results = script(chosen, parameters or {})
        for name, found in results.items():
            if name.startswith("embedding:"):
                g.set_embedding(name.partition(":")[2], found.select(g.sample, g.event, "value"))
        return results
