"""Order-dependent operators without a single-task sort.

Rows are range-partitioned and sorted within partitions, once; what crosses a border (row offsets, running totals, the
last value) is one row per partition and group and is joined back. A hot group spreads over many partitions. Callers
hand over the columns they need only, as sorted rows are written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cytora.session import materialise


def _sorted(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` in global order, with the partition ``_pid`` and the place ``_pos`` in it of each row; not written yet."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return placed.withColumns({"_ord_pid": F.spark_partition_id(), "_ord_pos": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})


def _borders(rows: DataFrame, group: Column, extra: dict[str, Column], carried: dict[str, Column]) -> DataFrame:
    """One row per partition and group: first place, rows, rows before in the group, and what is carried over."""
    each = rows.groupBy(group.alias("_ord_g"), F.col("_ord_pid").alias("_ord_p")).agg(F.min("_ord_pos").alias("_ord_start"), F.count(F.lit(1)).alias("_ord_rows"), *[c.alias(n) for n, c in extra.items()])
    w = Window.partitionBy("_ord_g").orderBy("_ord_p")  # partitions that a group lies in
    return each.withColumns({"_ord_before": F.sum("_ord_rows").over(w) - F.col("_ord_rows"), "_ord_total": F.sum("_ord_rows").over(Window.partitionBy("_ord_g"))} | carried)


def _joined(rows: DataFrame, borders: DataFrame, group: Column) -> DataFrame:
    return rows.join(borders, (F.col("_ord_pid") == F.col("_ord_p")) & group.eqNullSafe(F.col("_ord_g")))


def row_index(df: DataFrame, order: list[str], out: str = "event_idx", within: str | None = None, total: str | None = None) -> DataFrame:
    """Adds the 0-based place of each row in the order, or in the order of its group ``within``; ``total`` names a column for the rows of the group.

    ``order`` has to be unique for the result to be; ties take any order among themselves.
    """
    rows = materialise(_sorted(df, ([within] if within else []) + order))
    group = F.col(within) if within else F.lit(0)
    whole = _joined(rows, _borders(rows, group, {}, {}), group)
    added = {out: F.col("_ord_pos") - F.col("_ord_start") + F.col("_ord_before")} | ({total: F.col("_ord_total")} if total else {})
    return whole.withColumns(added).select(*df.columns, *added)


def scan(df: DataFrame, order: list[str], sums: dict[str, str] | None = None, previous: dict[str, str] | None = None, within: str | None = None) -> DataFrame:
    """Adds the running totals ``sums[column]`` (own row included) and the values ``previous[column]`` of the row before, both in one pass.

    They begin anew with every group ``within``; the first row has no value before. Nulls count as 0 in totals.
    """
    sums, previous = sums or {}, previous or {}
    rows = _sorted(df, ([within] if within else []) + order)
    fields = {f.name: f for f in df.schema}
    whole = {c: isinstance(fields[c].dataType, T.IntegralType) for c in sums}
    local = {o: T.LongType() if whole[c] else T.DoubleType() for c, o in sums.items()} | {o: fields[c].dataType for c, o in previous.items()}
    schema = T.StructType([*rows.schema.fields, *[T.StructField(f"_ord_l{i}", t) for i, t in enumerate(local.values())]])
    names = [f.name for f in schema]

    def pass_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[float] = [0] * len(sums)
        last: list[pa.Array | None] = [None] * len(previous)
        group: object = _NONE
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            starts = np.zeros(n, dtype=bool)
            if within is not None:
                code = batch.column(within).dictionary_encode(null_encoding="encode")
                index = code.indices.to_numpy()
                first = batch.column(within)[0].as_py()
                starts[1:] = index[1:] != index[:-1]
                starts[0] = group is _NONE or first != group
                group = batch.column(within)[n - 1].as_py()
            else:
                starts[0] = group is _NONE
                group = None
            at = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
            fresh = np.maximum.accumulate(starts)  # a group that began in this batch
            out = []
            for k, c in enumerate(sums):
                v = batch.column(c).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64 if whole[c] else np.float64)
                run = np.cumsum(v)
                base = np.where(fresh, (run - v)[at], -held[k])
                run = run - base
                held[k] = run[-1]
                out.append(pa.array(run))
            for k, c in enumerate(previous):
                column = batch.column(c)
                before = pa.concat_arrays([last[k] if last[k] is not None else pa.nulls(1, column.type), column.slice(0, n - 1)])
                last[k] = column.slice(n - 1, 1)
                out.append(pc.if_else(pa.array(starts), pa.scalar(None, column.type), before))
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], names=names)

    rows = materialise(rows.mapInArrow(pass_on, schema))
    group = F.col(within) if within else F.lit(0)
    extra: dict[str, Column] = {}
    carried: dict[str, Column] = {}
    w = Window.partitionBy("_ord_g").orderBy("_ord_p")
    for i, c in enumerate(sums):
        extra[f"_ord_t{i}"] = F.coalesce(F.sum(c), F.lit(0))
        carried[f"_ord_b{i}"] = F.sum(f"_ord_t{i}").over(w) - F.col(f"_ord_t{i}")
    for i, c in enumerate(previous):
        extra[f"_ord_v{i}"] = F.max_by(F.struct(F.col(c).alias("v")), "_ord_pos")
        carried[f"_ord_e{i}"] = F.lag(f"_ord_v{i}").over(w)
    joined = _joined(rows, _borders(rows, group, extra, carried), group)
    added: dict[str, Column] = {o: F.col(f"_ord_l{i}") + F.col(f"_ord_b{i}") for i, o in enumerate(sums.values())}
    for i, o in enumerate(previous.values()):
        added[o] = F.when(F.col("_ord_pos") == F.col("_ord_start"), F.col(f"_ord_e{i}.v")).otherwise(F.col(f"_ord_l{len(sums) + i}"))
    return joined.withColumns(added).select(*df.columns, *added)


_NONE = object()


def running_sums(df: DataFrame, order: list[str], values: dict[str, str], within: str | None = None) -> DataFrame:
    """Adds ``values[column]``: the running total of each column in the order, the own row included."""
    return scan(df, order, sums=values, within=within)


def previous(df: DataFrame, order: list[str], value: str, out: str, group: str | None = None) -> DataFrame:
    """Adds ``out``: the value of the row before in the order, null at the start of the data or of a ``group``."""
    return scan(df, order, previous={value: out}, within=group)
