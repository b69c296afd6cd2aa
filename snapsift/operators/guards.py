"""Projection, typing and guards on one snapshot table or plate."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config
from ..config import TableFailure
from ..functions.skew import small_side


def prune_columns(
    df: DataFrame,
    prefix: str = config.SYSTEM_PREFIX,
    keep: Iterable[str] = config.KEEP_SYSTEM_COLS,
) -> DataFrame:
    """Drop system columns (by name prefix) except those in ``keep``."""
    kept = set(keep)
    return df.drop(*[c for c in df.columns if c.startswith(prefix) and c not in kept])


def cast_typed(df: DataFrame, types: Mapping[str, str] = config.TYPED_COLS) -> DataFrame:
    """Cast the named columns that are present; values that do not fit become null."""
    present = {c: F.col(c).try_cast(t) for c, t in types.items() if c in df.columns}
    return df.withColumns(present) if present else df


def guard_width(
    pre: DataFrame,
    gold: DataFrame,
    least: int = config.MIN_TABLE_COLUMNS,
    most: int = config.MAX_TABLE_COLUMNS,
) -> None:
    """Both sides must have between ``least`` and ``most`` columns."""
    for side, df in (("PreliminarySnapshot", pre), ("GoldStandardSnapshot", gold)):
        if len(df.columns) < least:
            raise TableFailure(f"{side}TooNarrow")
        if len(df.columns) > most:
            raise TableFailure(f"{side}TooWide")


def align_schemas(
    pre: DataFrame, gold: DataFrame, strict: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Keep the shared columns on both sides.

    ``strict`` does so only when the column counts differ; a renamed column between
    tables of equal width is then left for :func:`guard_schema_change` to report.
    """
    if strict and len(pre.columns) == len(gold.columns):
        return pre, gold
    here, there = set(pre.columns), set(gold.columns)
    return (
        pre.select(*[c for c in pre.columns if c in there]),
        gold.select(*[c for c in gold.columns if c in here]),
    )


def guard_schema_change(pre: DataFrame, gold: DataFrame) -> None:
    """Names and types must agree, in any column order."""
    if dict(pre.dtypes) != dict(gold.dtypes):
        raise TableFailure("SnapshotSchemaChange")


def guard_nonempty(pre: DataFrame) -> None:
    if pre.isEmpty():
        raise TableFailure("EmptyTableSnapshot")


def guard_identifiers(pre: DataFrame, ids: Iterable[str]) -> None:
    if not set(ids) <= set(pre.columns):
        raise TableFailure("ParticipantIdentifierNotAvailable")


def filter_changes(diff: DataFrame) -> DataFrame:
    """Changed and deleted rows of a diff."""
    return diff.filter(F.col("diff").isin("C", "D"))


def filter_salient(cells: DataFrame) -> DataFrame:
    """Cells whose sides differ; a pair of missing values does not differ."""
    return cells.filter(~F.col("left").eqNullSafe(F.col("right")))


def filter_corrections(cells: DataFrame) -> DataFrame:
    """Cells of changed records that had a value before (no deletions, no fill-ins)."""
    return cells.filter((F.col("diff") == "C") & F.col("left").isNotNull())


def select_tables(
    status: DataFrame, valid: DataFrame | None = None, exclude: Iterable[str] = ()
) -> DataFrame:
    """Successful tables that are in ``valid`` (``table_name``) and not excluded."""
    kept = status.filter(F.col("success"))
    if valid is not None:
        kept = kept.join(valid, "table_name", "left_semi")
    excluded = list(exclude)
    return kept.filter(~F.col("table_name").isin(excluded)) if excluded else kept


def drop_unreliable_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Wide form: drop the given columns that exist."""
    return df.drop(*columns)


def drop_unreliable_cells(cells: DataFrame, unreliable: DataFrame, on: list[str]) -> DataFrame:
    """Long form: drop the cells of unreliable columns (one row per table column)."""
    return cells.join(small_side(unreliable), on, "left_anti")


def numeric_columns(df: DataFrame, without: Iterable[str] = ()) -> list[str]:
    """Names of integral and floating columns (decimals and booleans do not count)."""
    skip = set(without)
    return [
        f.name
        for f in df.schema.fields
        if f.name not in skip
        and isinstance(f.dataType, T.NumericType)
        and not isinstance(f.dataType, T.DecimalType)
    ]


def select_numeric(df: DataFrame, keys: Iterable[str] = ()) -> DataFrame:
    """Keep ``keys`` and the numeric columns."""
    keys = list(keys)
    return df.select(*keys, *numeric_columns(df, keys))


def missing_fraction(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, fraction)`` of missing values, in one aggregate."""
    rates = df.agg(*[F.avg(F.col(f"`{c}`").isNull().cast("double")).alias(c) for c in columns])
    pairs = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("fraction")) for c in columns]
    return rates.select(F.inline(F.array(*pairs)))


def filter_missingness(
    df: DataFrame, columns: list[str], most: float = config.MAX_MISSING_FRACTION
) -> DataFrame:
    """Drop those of ``columns`` whose share of missing values is ``most`` or more."""
    rates = missing_fraction(df, columns).filter(F.col("fraction") >= most)
    return df.drop(*[row["column"] for row in rates.collect()])


def plate_type(df: DataFrame, keys: list[str], by: list[str] = ()) -> DataFrame:
    """``single`` when every key occurs once, else ``multi``, per ``by`` group.

    Counted in two levels (rows per key, then keys), so no task holds a set of keys.
    """
    by = list(by)
    per_key = df.groupBy(*by, *[k for k in keys if k not in by]).agg(F.count(F.lit(1)).alias("_n"))
    kind = F.when(F.coalesce(F.max("_n"), F.lit(1)) == 1, "single").otherwise("multi")
    return per_key.groupBy(*by).agg(kind.alias("plate_type"))


def plate_variables(df: DataFrame, keys: Iterable[str] = ()) -> DataFrame:
    """``(name, dtype)`` of the columns collected in a plate."""
    skip = set(keys)
    rows = [(n, t) for n, t in df.dtypes if n not in skip]
    return df.sparkSession.createDataFrame(rows, "name string, dtype string")


def distinct_centres(df: DataFrame, column: str = "centre") -> DataFrame:
    return df.select(column).distinct()


def distinct_participants(df: DataFrame, column: str = "id") -> DataFrame:
    return df.select(column).distinct()


def apply_ignore_lists(
    df: DataFrame,
    variables: Iterable[str] = config.IGNORED_VARIABLES,
    centres: Iterable[int] = config.IGNORED_CENTRES,
    least: int = config.MIN_PARTICIPANTS_PER_CENTRE,
    centre: str = "centre",
    participant: str = "id",
) -> DataFrame:
    """Drop ignored variables, ignored centres and centres with too few participants."""
    kept = df.drop(*variables).filter(~F.col(centre).isin(list(centres)))
    large = (
        kept.select(centre, participant).distinct()
        .groupBy(centre).count().filter(F.col("count") >= least)
    )
    return kept.join(large, centre, "left_semi")
