"""Queries of the general data-quality operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cytora.operators import packed, spikes, timestamps
from cytora.session import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return timestamps.file_instants(table(spark, d, "fcs_text"), table(spark, d, "instruments"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return packed.file_list_items(table(spark, d, "fcs_text"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return spikes.implausible_bins(table(spark, d, "mass_series"), table(spark, d, "samples"), table(spark, d, "channels"))


QUERIES = {"p3_found": p3_found, "p5_found": p5_found, "p6_found": p6_found}
SQL: dict[str, str] = {}
