"""Session helpers shared by all operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes a task of Python work should read at most, from which its number of tasks follows where rows can be counted.
TASK_BYTES = 8 << 20
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a session on one machine takes a folder of its own; on a cluster that is an error, as
    executors would write where nobody else reads.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="cytora-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def materialise(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage with files that outlive any executor. ``drop_tables`` removes them; the session's end does too.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/cytora-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(since: int = 0) -> None:
    """Remove the tables written by ``materialise`` after the first ``since``; results that read them have to be consumed before."""
    while len(_written) > since:
        spark, path = _written.pop()
        context = spark.sparkContext
        if context._jsc is not None:
            target = context._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def tables_written() -> int:
    """How many tables ``materialise`` has written and nobody has removed."""
    return len(_written)


@atexit.register
def _at_end() -> None:
    try:
        drop_tables()
    except Exception:  # noqa: BLE001  the JVM may be gone already
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the project's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores, for work that Python does row by row.

    A few large files would else leave cores idle; input that has enough partitions already isn't moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def tasks(spark: SparkSession, size: float = 0) -> int:
    """Tasks for Python work by group: three a core at least, and as many as ``size`` bytes ask for."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism, int(size / TASK_BYTES))


def hashed(df: DataFrame, *keys: str, size: float = 0) -> DataFrame:
    """``df`` partitioned by ``keys`` for work that Python does group by group.

    The number of partitions is stated, as adaptive execution would put groups of few bytes but much work into one
    task; with ``size``, the bytes of the rows, it grows with them.
    """
    return df.repartition(tasks(df.sparkSession, size), *keys)
