"""From labelled plates to complete numeric records.

A plate set holds many datasets: ``(dataset, rec_id, values, y)`` with ``values`` an
array that may contain nulls. Records hold ``(dataset, rec_id, features, y)``, complete.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.models import feature_cells, gather
from ..functions.runtime import settle
from ..functions.skew import skew_lookup
from .guards import numeric_columns


def to_plates(
    df: DataFrame, dataset: str, rec_id: str, y: str, columns: Sequence[str] | None = None
) -> DataFrame:
    """Wide table to plates: numeric columns only, NaN as missing."""
    columns = list(columns) if columns else numeric_columns(df, [dataset, rec_id, y])
    values = [F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")) for c in columns]
    return df.select(
        F.col(dataset).alias("dataset"), F.col(rec_id).cast("long").alias("rec_id"),
        F.array(*values).alias("values"), F.col(y).cast("int").alias("y"),
    )


def value_counts(plates: DataFrame) -> DataFrame:
    """``(dataset, pos, value, c)``; missing values count as one value."""
    return feature_cells(plates, "values").groupBy("dataset", "pos", "value").agg(
        F.count(F.lit(1)).alias("c")
    )


def feature_profile(plates: DataFrame) -> DataFrame:
    """Per (dataset, pos): rows, share of missing values and most frequent value.

    The mode is the maximum of (count, -value), a plain aggregate with map-side combine,
    so no task holds a feature's value set.
    """
    present = F.col("value").isNotNull()
    top = F.max(F.when(present, F.struct(F.col("c"), (-F.col("value")).alias("v"))))
    return (
        value_counts(plates).groupBy("dataset", "pos")
        .agg(
            F.sum("c").alias("n"),
            (F.sum(F.when(present, 0).otherwise(F.col("c"))) / F.sum("c")).alias("missing"),
            top.alias("_top"),
        )
        .select("dataset", "pos", "n", "missing", (-F.col("_top.v") + 0.0).alias("mode"))
    )


def usable_features(profile: DataFrame, most: float = config.MAX_MISSING_FRACTION) -> DataFrame:
    return profile.filter(F.col("missing") < most)


def usable_datasets(
    profile: DataFrame,
    least_rows: int = config.PLATE_MIN_ROWS,
    least_columns: int = config.PLATE_MIN_COLUMNS,
    most_missing: float = config.MAX_MISSING_FRACTION,
) -> DataFrame:
    """``(dataset, n, keep, fill)`` of datasets with enough rows and usable columns."""
    model = gather(usable_features(profile, most_missing), {"ns": "n", "keep": "pos", "fill": "mode"})
    return model.select("dataset", F.col("ns")[0].alias("n"), "keep", "fill").filter(
        (F.col("n") >= least_rows) & (F.size("keep") >= least_columns)
    )


def impute_mode(plates: DataFrame, profile: DataFrame) -> DataFrame:
    """Fill missing values with the feature's most frequent value; all columns stay."""
    model = settle(gather(profile, {"ns": "n", "keep": "pos", "fill": "mode"}).select(
        "dataset", F.col("ns")[0].alias("n"), "keep", "fill"
    ))
    return _fill(plates, model)


def preprocess_plates(
    plates: DataFrame,
    least_rows: int = config.PLATE_MIN_ROWS,
    least_columns: int = config.PLATE_MIN_COLUMNS,
    most_missing: float = config.MAX_MISSING_FRACTION,
    profile: DataFrame | None = None,
) -> DataFrame:
    """Usable columns of usable datasets, imputed, for all plates in one plan.

    ``profile`` is the :func:`feature_profile` of the same rows, when they need not be placed to be counted.
    """
    profile = feature_profile(plates) if profile is None else profile
    model = usable_datasets(profile, least_rows, least_columns, most_missing)
    return _fill(plates, settle(model))


def _fill(plates: DataFrame, model: DataFrame) -> DataFrame:
    total = model.agg(F.sum("n")).first()[0] or 0
    joined = skew_lookup(plates, model.withColumnRenamed("n", "_w"), ["dataset"], "_w", total, "inner")
    filled = F.zip_with("keep", "fill", lambda p, f: F.coalesce(F.get(F.col("values"), p), f))
    others = [c for c in plates.columns if c not in ("dataset", "rec_id", "values", "y")]
    return joined.select("dataset", "rec_id", filled.alias("features"), "y", *others)
