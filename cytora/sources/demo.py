"""Three made-up samples of two channels, for trying out gates without a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytora import api

# Events of the three samples.
SIZES = (56_860, 45_732, 48_167)
CHANNELS = ["FSC-A", "FL1-A"]


def events(spark: SparkSession, sizes: tuple[int, ...] = SIZES, seed: int = 7) -> DataFrame:
    """(sample_id, event_idx, FSC-A, FL1-A): normal clouds, the same in every run and in any number of partitions."""
    rows = None
    for k, n in enumerate(sizes):
        u = lambda j, k=k: (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), F.lit(j), F.col("id")), F.lit(1 << 40)) + 0.5) / float(1 << 40)
        radius, angle = F.sqrt(-2 * F.ln(u(0))), 2 * 3.141592653589793 * u(1)
        x, y = 60_000 + 9_000 * k + 12_000 * radius * F.cos(angle), 8_000 * (k + 1) + 2_500 * radius * F.sin(angle)
        one = spark.range(n).select(F.lit(f"sample {k + 1}").alias("sample_id"), F.col("id").alias("event_idx"), x.cast("float").alias("FSC-A"), y.cast("float").alias("FL1-A"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def group(spark: SparkSession, sizes: tuple[int, ...] = SIZES) -> api.Grouping:
    """The samples as a group with one polygon gate and two statistics."""
    g = api.Grouping("demo", events(spark, sizes), CHANNELS)
    g.strategy.define_gate_polygon("cells", *CHANNELS, [(40_000, 4_000), (90_000, 4_000), (100_000, 30_000), (45_000, 26_000)])
    g.strategy.define_statistics("Mean", "FL1-A").define_statistics("Median", "FL1-A")
    return g
