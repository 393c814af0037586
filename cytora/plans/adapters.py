"""Event frames from the star-schema tables; values are narrowed to single precision as event files hold them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytora.functions.exprs import Axis, f32
from cytora.session import table

#: The columns that together identify a row of the item table.
ITEM_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]

Q, P, D, X = Axis(0, 50), Axis(0, 110000), Axis(0, 0.1), Axis(0, 0.08)
P_LOG, P_ASINH = Axis(900, 110000, "log"), Axis(900, 110000, "arcsinh", 150.0)


def items(spark: SparkSession, d: str) -> DataFrame:
    """(sample_id, batch, q, p, d, t): four channels, sample by return flag, batch by line status."""
    rows = table(spark, d, "lineitem")
    return rows.select(F.col("l_returnflag").alias("sample_id"), F.col("l_linestatus").alias("batch"), f32(F.col("l_quantity")).alias("q"), f32(F.col("l_extendedprice")).alias("p"), f32(F.col("l_discount")).alias("d"), f32(F.col("l_tax")).alias("t"))


def keyed_items(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem")
    return rows.select(*ITEM_KEY, F.col("l_returnflag").alias("sample_id"), F.col("l_linestatus").alias("batch"), f32(F.col("l_quantity")).alias("q"), f32(F.col("l_extendedprice")).alias("p"), f32(F.col("l_discount")).alias("d"), f32(F.col("l_tax")).alias("t"))


def timed(spark: SparkSession, d: str) -> DataFrame:
    """(event_id, sample_id, time, value): time in seconds with a microsecond fraction."""
    rows = table(spark, d, "events")
    return rows.select("event_id", F.col("event_type").alias("sample_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("time"), f32(F.col("value")).alias("value"), "user_id")


F32 = "CAST(CAST({} AS FLOAT) AS DOUBLE)"
ITEMS_SQL = f"ev AS (SELECT l_returnflag AS sample_id, l_linestatus AS batch, {F32.format('l_quantity')} AS q, {F32.format('l_extendedprice')} AS p, {F32.format('l_discount')} AS d, {F32.format('l_tax')} AS t, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate FROM lineitem)"
TIMED_SQL = f"ev AS (SELECT event_id, event_type AS sample_id, epoch_us(ts) / 1e6 AS time, {F32.format('value')} AS value, user_id FROM events)"
KEY_SQL = ", ".join(ITEM_KEY)


def norm_sql(column: str, axis: Axis) -> str:
    """Normalised position in SQL."""
    lo, hi = axis.number(axis.low), axis.number(axis.high)
    forward = {
        "linear": column,
        "log": f"(sign({column}) * log10(1 + abs({column})))",
        "arcsinh": f"asinh({column} / {axis.cofactor!r})",
    }[axis.kind]
    return F32.format(f"(({forward} - {lo!r}) / {hi - lo!r})")
