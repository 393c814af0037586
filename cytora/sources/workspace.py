"""A workspace on disk: Parquet for tables, JSON for the plan; group assignment of files by their channels."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytora.operators.surgery import infer_kind
from cytora.plans.gates import GateTree

TABLES = ("events", "samples", "channels", "embeddings", "compensation", "statistics")


def save(path: str, tables: dict[str, DataFrame], trees: dict[str, GateTree], notes: dict[str, str] | None = None) -> None:
    """Writes every table and the gate trees; events are partitioned by sample so that a sample is read alone."""
    for name, df in tables.items():
        if name not in TABLES:
            raise ValueError(f"no table {name}")
        writer = df.write.mode("overwrite")
        if name == "events" and "sample_id" in df.columns:
            writer = writer.partitionBy("sample_id")
        writer.parquet(f"{path}/{name}")
        spark = df.sparkSession
    plan = {"version": 1, "trees": {g: t.to_json() for g, t in trees.items()}, "notes": notes or {}, "tables": sorted(tables)}
    spark.createDataFrame([(json.dumps(plan),)], "plan string").coalesce(1).write.mode("overwrite").text(f"{path}/plan")


def load(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict[str, GateTree], dict[str, str]]:
    plan = json.loads(spark.read.text(f"{path}/plan").first()[0])
    if plan["version"] != 1:
        raise ValueError(f"version {plan['version']} can't be read")
    return {t: spark.read.parquet(f"{path}/{t}") for t in plan["tables"]}, {g: GateTree.from_json(t) for g, t in plan["trees"].items()}, plan["notes"]


def assign_groups(files: DataFrame) -> DataFrame:
    """Adds group: files (sample, channels) with the same ordered channel names belong together, numbered by their first sample."""
    profile = files.withColumn("profile", F.concat_ws("|", F.transform("channels", lambda c: c["name"])))
    first = profile.groupBy("profile").agg(F.min("sample").alias("_first"))
    from pyspark.sql import Window

    numbered = first.withColumn("group", F.concat(F.lit("Group "), F.row_number().over(Window.orderBy("_first"))))  # one row per profile
    return profile.join(numbered.drop("_first"), "profile").drop("profile")


def metadata_kinds(samples: DataFrame, column: str = "metadata") -> DataFrame:
    """(name, kind) of every metadata column."""
    rows = samples.select(F.explode(column).alias("name", "value"))
    return rows.groupBy("name").agg(infer_kind(F.col("value")).alias("kind"))
