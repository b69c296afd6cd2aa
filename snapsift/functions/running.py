"""Exact running totals that do not funnel a large group through one task."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .runtime import settle

#: A group up to this many rows is sorted inside one task; above it the group is
#: range-partitioned and the pieces are stitched with offsets.
WINDOW_ROWS = 4_000_000


def running_totals(
    cells: DataFrame,
    group: list[str],
    order: str,
    sums: dict[str, str],
    largest: int | None = None,
    window_rows: int = WINDOW_ROWS,
) -> DataFrame:
    """Add inclusive running sums of ``sums`` (new name -> column) along ``order``.

    ``cells`` holds one row per (group, order). ``largest`` is an upper bound on the
    number of rows in any group, when the caller already knows one; otherwise it is
    counted. Small groups use a plain window. When some group is larger than
    ``window_rows`` the rows are range-partitioned on (group, order), so that a group
    spreads over as many tasks as it needs, settled once (the partition number must be
    the same for both reads), and each piece adds the total of the pieces before it.
    """
    if largest is None:
        largest = cells.groupBy(*group).count().agg(F.max("count")).first()[0] or 0
    if largest <= window_rows:
        w = W.partitionBy(*group).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
        return cells.withColumns({new: F.sum(old).over(w) for new, old in sums.items()})

    spark = cells.sparkSession
    pieces = max(
        int(spark.conf.get("spark.sql.shuffle.partitions")),
        2 * math.ceil(largest / window_rows),
    )
    ranged = settle(
        cells.repartitionByRange(pieces, *group, order).withColumn(
            "_piece", F.spark_partition_id()
        )
    )
    before = W.partitionBy(*group).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("_piece", *group)
        .agg(*[F.sum(old).alias(f"_t_{new}") for new, old in sums.items()])
        .select(
            "_piece",
            *group,
            *[F.coalesce(F.sum(f"_t_{new}").over(before), F.lit(0)).alias(f"_o_{new}") for new in sums],
        )
    )
    w = W.partitionBy("_piece", *group).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    inside = ranged.withColumns({new: F.sum(old).over(w) for new, old in sums.items()})
    return (
        inside.join(offsets, ["_piece", *group])
        .withColumns({new: F.col(new) + F.col(f"_o_{new}") for new in sums})
        .drop("_piece", *[f"_o_{new}" for new in sums])
    )
