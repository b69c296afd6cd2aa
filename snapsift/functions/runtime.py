"""Session-level helpers: lineage cuts, scratch folders, partitioning."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A local session without the setting gets a temporary folder; a cluster session
    without it is an error, because a machine-local folder would be lost with its node.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if named is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
            named = tempfile.mkdtemp(prefix="snapsift-")
        spark.sparkContext.setCheckpointDir(named)
    return named or current


#: Scratch folders of this process, with their sessions.
_scratch: list[tuple[SparkSession, str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; its folder is deleted when the driver ends."""
    folder = f"{shared_folder(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"
    if not _scratch:
        atexit.register(drop_scratch)
    _scratch.append((spark, folder))
    return f"{folder}/{name}"


def drop_scratch() -> None:
    """Delete the scratch folders of this process; frames that read them can't be used any more."""
    while _scratch:
        spark, folder = _scratch.pop()
        with contextlib.suppress(Exception):  # the session may be gone
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint.

    Used where one plan reads a result twice and both reads must see the same rows, and
    between the steps of iterative operators.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a table in the shared folder.

    For wide results of which later steps read a few columns: the table is columnar.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, keys: list[str], rows: int, groups: int = 0) -> DataFrame:
    """Hash-partition compute-heavy work explicitly, by its known size.

    Adaptive execution sizes partitions by bytes; rows that are few in bytes but costly
    in numpy would end up in one task. Every core gets a partition; beyond that, one per
    5,000 rows up to the configured shuffle partitions, which grow for very many rows.
    ``groups`` is the number of key groups, when known: about eight share a task.
    """
    spark = df.sparkSession
    configured = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by_rows = min(rows // 5_000, max(configured, min(rows // 200_000, 100_000)))
    return df.repartition(max(spark.sparkContext.defaultParallelism, by_rows, min(groups // 8, 50_000)), *keys)


def store_records(records: DataFrame, rows: int, placed: bool = False) -> DataFrame:
    """Settle records spread by (dataset, rec_id), as multi-pass detectors read them.

    ``rows`` is their number or an upper bound. Joins of scores with records on
    (dataset, rec_id) then need not move the records. ``placed`` records were spread by the caller,
    by a key that their own steps group by: they are stored as they are, and only such joins move them.
    """
    return settle(records if placed else spread(records, ["dataset", "rec_id"], rows))
