"""Left join to a key-unique side when a few keys hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys with more left rows than this are split off, as long as they are few.
HEAVY_ROWS = 1_000_000
#: No more than this many keys can be heavy, whatever the total.
HEAVY_KEYS = 10_000
SALTS = 4096
#: A measured side up to this size is broadcast.
BROADCAST_BYTES = 32 * 1024 * 1024


def measured_bytes(df: DataFrame) -> int:
    """Size of a settled table: eight bytes per value, text and array lengths counted.

    Structs, maps and nested arrays count by their length as JSON, which is no less.
    """
    cells = F.lit(0)
    for field in df.schema.fields:
        kind = field.dataType.typeName()
        element = getattr(field.dataType, "elementType", None)
        if kind in ("struct", "map") or (element is not None and element.typeName() in ("struct", "map", "array", "string")):
            cells = cells + F.coalesce(F.length(F.to_json(F.col(f"`{field.name}`"))), F.lit(0)) + 16
        elif kind == "array":
            cells = cells + F.coalesce(F.size(field.name), F.lit(0)) * 8
        elif kind == "string":
            cells = cells + F.coalesce(F.length(field.name), F.lit(0)) + 16
        else:
            cells = cells + 8
    return df.agg(F.sum(cells.cast("long"))).first()[0] or 0


def small_side(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint when its measured size is within ``limit``.

    For settled side tables with one row per dataset, table or column: joined on such a
    key without it, the large side would be shuffled into a few hot partitions.
    """
    return F.broadcast(df) if measured_bytes(df) <= limit else df


def skew_lookup(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    weight: str,
    total: int,
    how: str = "left",
    heavy_rows: int = HEAVY_ROWS,
    measure: bool = True,
) -> DataFrame:
    """Join ``right`` (unique on ``keys``) to ``left``.

    ``weight`` is a column of ``right`` with the number of left rows of the key (it is
    dropped) and ``total`` their sum. A key is heavy above
    ``max(heavy_rows, total / HEAVY_KEYS)`` left rows, so there are at most
    ``HEAVY_KEYS`` heavy keys: these are broadcast, and their left rows are salted away
    from the shuffle join that serves all other keys.

    With ``measure`` (for a settled ``right``) its size is taken first, and a side within
    ``BROADCAST_BYTES`` is broadcast whole, so ``left`` is not shuffled at all.
    """
    if measure and measured_bytes(right) <= BROADCAST_BYTES:
        return left.join(F.broadcast(right.drop(weight)), keys, how)
    values = [c for c in right.columns if c not in keys and c != weight]
    floor = max(heavy_rows, total // HEAVY_KEYS)
    if total <= floor:
        return left.join(right.drop(weight), keys, how)

    heavy = right.filter(F.col(weight) > floor).select(
        *keys, F.struct(*values).alias("_heavy"), F.lit(True).alias("_is_heavy")
    )
    light = right.filter(F.col(weight) <= floor).select(
        *keys, F.lit(-1).alias("_salt"), F.struct(*values).alias("_light"),
        F.lit(True).alias("_is_light"),
    )
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in _hashable(left)]), F.lit(SALTS)).cast("int")
    joined = (
        left.join(F.broadcast(heavy), keys, "left")
        .withColumn("_salt", F.when(F.col("_is_heavy"), spread).otherwise(F.lit(-1)))
        .join(light, [*keys, "_salt"], "left")
    )
    if how == "inner":
        joined = joined.filter(F.coalesce("_is_heavy", "_is_light"))
    return joined.select(
        *left.columns,
        *[F.when(F.col("_is_heavy"), F.col(f"_heavy.{c}")).otherwise(F.col(f"_light.{c}")).alias(c) for c in values],
    )


def _hashable(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if "map" not in f.dataType.simpleString()]

