"""Queries of the training-data operators."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytora.llm import clusters, knn, leaks, packing, sketch, spam
from cytora.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return clusters.found(table(spark, d, "fcs_events"), table(spark, d, "channels"))


def p1_clusters(spark: SparkSession, d: str) -> DataFrame:
    return clusters.describe(clusters.populations(table(spark, d, "fcs_events"), table(spark, d, "channels")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked(table(spark, d, "documents"), table(spark, d, "benchmark_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.spam_pages(table(spark, d, "documents"))


def p2_channel_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of every channel of every group, from the merged sketches of the days of loading."""
    days = sketch.event_sketches(table(spark, d, "fcs_events"))
    keys = ["group_id", "channel_idx"]
    rows = sketch.percentiles(sketch.merge(days, keys), keys)
    return rows.select(*keys, "n_values", "p", "bucket", F.round("estimate", 3).alias("estimate"))


def p2_mass_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of the raw medians of every cytometer and mass, from the merged sketches of the days of loading."""
    days = sketch.series_sketches(table(spark, d, "mass_series"))
    keys = ["cytometer", "mass_number"]
    rows = sketch.percentiles(sketch.merge(days, keys), keys)
    return rows.select(*keys, "n_values", "p", "bucket", F.round("estimate", 3).alias("estimate"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return knn.similar_pairs(table(spark, d, "spectral_events"))


def p4_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The ten most similar vectors of every vector whose id is divisible by 20, among all vectors."""
    rows = table(spark, d, "spectral_events")
    return knn.neighbours(rows, 10, queries=rows.filter("vec_id % 20 = 0"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.containers(table(spark, d, "documents"))


def _percentile_sql(source: str, keys: str) -> str:
    """Percentiles from logarithmic buckets in SQL, over rows (keys, x) of ``source``."""
    growth = math.log((1 + sketch.ACCURACY) / (1 - sketch.ACCURACY))
    middle = 2 / ((1 + sketch.ACCURACY) / (1 - sketch.ACCURACY) + 1)
    ranks = ", ".join(f"({p})" for p in sketch.PERCENTILES)
    return f"""
WITH r AS ({source}),
b AS (SELECT {keys}, CASE WHEN abs(x) < {sketch.TINY} THEN 0
        WHEN x > 0 THEN CAST(ceil(ln(x) / {growth!r}) AS INTEGER) + {1 << 20}
        ELSE -(CAST(ceil(ln(-x) / {growth!r}) AS INTEGER) + {1 << 20}) END AS bucket
      FROM r WHERE x IS NOT NULL AND NOT isnan(x) AND NOT isinf(x)),
c AS (SELECT {keys}, bucket, count(*) AS n FROM b GROUP BY ALL),
w AS (SELECT {keys}, bucket, n, sum(n) OVER (PARTITION BY {keys} ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {keys}) AS total FROM c),
p AS (SELECT CAST(column0 AS DOUBLE) AS p FROM (VALUES {ranks}) t(column0))
SELECT {keys}, CAST(total AS BIGINT) AS n_values, p, bucket,
       round(CASE WHEN bucket = 0 THEN 0.0 ELSE sign(bucket) * exp((abs(bucket) - {1 << 20}) * {growth!r}) * {middle!r} END, 3) AS estimate
FROM w, p WHERE floor(p * (total - 1)) < upto AND floor(p * (total - 1)) >= upto - n"""


QUERIES = {
    "p1_found": p1_found,
    "p1_clusters": p1_clusters,
    "p2_channel_percentiles": p2_channel_percentiles,
    "p2_mass_percentiles": p2_mass_percentiles,
    "p4_found": p4_found,
    "p4_neighbours": p4_neighbours,
    "p7_containers": p7_containers,
    "p8_found": p8_found,
    "p9_found": p9_found,
}
SQL = {
    "p2_channel_percentiles": _percentile_sql(
        "SELECT group_id, CAST(i - 1 AS INTEGER) AS channel_idx, CAST(event_values[i] AS DOUBLE) AS x FROM"
        " (SELECT DISTINCT ON (event_id) * FROM fcs_events WHERE event_values IS NOT NULL) e, range(1, 200) t(i) WHERE i <= len(event_values)",
        "group_id, channel_idx",
    ),
    "p2_mass_percentiles": _percentile_sql(
        "SELECT cytometer, mass_number, raw_median AS x FROM (SELECT DISTINCT ON (series_id, bin_idx) * FROM mass_series) s", "cytometer, mass_number"
    ),
}
