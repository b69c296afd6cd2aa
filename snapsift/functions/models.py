"""Run numpy code over records next to one bounded model row per dataset."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import settle, spread
from .skew import skew_lookup

#: All models together may be broadcast up to this size.
BROADCAST_BYTES = 64 * 1024 * 1024
#: Records of one dataset handled by one grouped task.
CHUNK_ROWS = 50_000

SCORES = "dataset string, rec_id long, score double"
#: Cells of partial sums that a task holds.
FOLD_CELLS = 4_000_000
ARRAYS = "dataset string, part array<double>"

ModelFn = Callable[[pd.DataFrame, np.ndarray, dict], pd.DataFrame]


def stack(features: pd.Series) -> np.ndarray:
    """Feature arrays of one dataset as a matrix."""
    return np.array(features.tolist(), dtype=np.float64).reshape(len(features), -1)


def dataset_sizes(records: DataFrame) -> DataFrame:
    """``(dataset, n)``."""
    return records.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))


def with_chunk(records: DataFrame, sizes: DataFrame, total: int, chunk_rows: int) -> DataFrame:
    """Number the records' chunks so that no (dataset, chunk) grows with its dataset."""
    located = skew_lookup(
        records, sizes.select("dataset", F.col("n").alias("_n"), F.col("n").alias("_w")),
        ["dataset"], "_w", total, "inner",
    )
    chunks = F.greatest(F.lit(1), F.ceil(F.col("_n") / F.lit(chunk_rows)))
    return located.withColumn("chunk", F.pmod(F.xxhash64("rec_id"), chunks)).drop("_n")


def map_with_models(
    records: DataFrame,
    models: DataFrame,
    fn: ModelFn,
    schema: str,
    broadcast_bytes: int = BROADCAST_BYTES,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Rows of ``fn(part, matrix, model)`` for parts of each dataset.

    ``models`` is a settled table with ``dataset``, the record count ``n`` and numeric
    columns or arrays. When all models fit in ``broadcast_bytes`` (checked) they are
    broadcast and records are handled where they lie, without a shuffle. Otherwise
    records and models meet per (dataset, chunk), chunks being bounded in rows. ``fn``
    may see a dataset in any number of parts.
    """
    arrays = [f.name for f in models.schema.fields if f.dataType.typeName() == "array"]
    cells = sum([F.size(c) for c in arrays], F.lit(8))
    size, total = models.agg(F.sum(cells.cast("long")), F.sum("n")).first()
    records = records.select("dataset", "rec_id", "features")
    if (size or 0) * 8 <= broadcast_bytes:
        table = {row["dataset"]: _as_model(row.asDict()) for row in models.toLocalIterator()}
        held = records.sparkSession.sparkContext.broadcast(table)

        def map_batches(batches):
            for pdf in batches:
                for name, part in pdf.groupby("dataset", sort=False):
                    model = held.value.get(name)
                    if model is not None:
                        yield fn(part, stack(part["features"]), model)

        return records.mapInPandas(map_batches, schema)

    chunked = with_chunk(records, models.select("dataset", "n"), total, chunk_rows)
    last = F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(chunk_rows))) - 1
    copies = models.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    # both sides read the models, so one gets fresh column identities
    copies = copies.toDF(*copies.columns)

    def map_chunk(part: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if part.empty or model.empty:
            return pd.DataFrame()
        return fn(part, stack(part["features"]), _as_model(model.iloc[0].to_dict()))

    keys, groups = ["dataset", "chunk"], (total or 0) // chunk_rows
    return (
        spread(chunked, keys, total or 0, groups).groupBy(*keys)
        .cogroup(spread(copies, keys, total or 0, groups).groupBy(*keys))
        .applyInPandas(map_chunk, schema)
    )


def _as_model(row: dict) -> dict:
    return {k: np.asarray(v) if isinstance(v, (list, np.ndarray)) else v for k, v in row.items()}


def score_with_models(
    records: DataFrame, models: DataFrame, score: Callable[[np.ndarray, dict], np.ndarray], **limits
) -> DataFrame:
    """``(dataset, rec_id, score)`` from ``score(matrix, model)``."""

    def rows(part, matrix, model):
        return pd.DataFrame(
            {"dataset": part["dataset"].to_numpy(), "rec_id": part["rec_id"].to_numpy(), "score": score(matrix, model)}
        )

    return map_with_models(records, models, rows, SCORES, **limits)


def score_settings(
    records: DataFrame,
    models: DataFrame,
    score: Callable[[np.ndarray, dict], np.ndarray],
    names: list[str],
    **limits,
) -> DataFrame:
    """``(dataset, rec_id, algorithm, score)`` when ``score`` gives one column per name."""

    def rows(part, matrix, model):
        return pd.DataFrame(
            {
                "dataset": part["dataset"].to_numpy(),
                "rec_id": part["rec_id"].to_numpy(),
                "scores": list(score(matrix, model)),
            }
        )

    wide = map_with_models(records, models, rows, "dataset string, rec_id long, scores array<double>", **limits)
    return explode_settings(wide, names)


def explode_settings(wide: DataFrame, names: list[str]) -> DataFrame:
    labels = F.array(*[F.lit(n) for n in names])
    return wide.select("dataset", "rec_id", F.posexplode("scores").alias("_i", "score")).select(
        "dataset", "rec_id", F.element_at(labels, F.col("_i") + 1).alias("algorithm"), "score"
    )


def fold_arrays(
    records: DataFrame, models: DataFrame, partial: Callable[[np.ndarray, dict], np.ndarray], **limits
) -> DataFrame:
    """``(dataset, total array)``: element-wise sum of ``partial`` over all parts.

    Arrays are added up within each partition and then by position, so a partition shuffles one
    array per dataset (more only when the sums held reach ``FOLD_CELLS``).
    """

    def rows(part, matrix, model):
        return pd.DataFrame({"dataset": [part["dataset"].iloc[0]], "part": [partial(matrix, model).ravel()]})

    def add_up(batches):
        held, cells = {}, 0
        for pdf in batches:
            for name, part in zip(pdf["dataset"], pdf["part"]):
                if name in held:
                    held[name] = held[name] + part
                else:
                    held[name], cells = np.asarray(part), cells + len(part)
            if cells > FOLD_CELLS:
                yield pd.DataFrame({"dataset": list(held), "part": list(held.values())})
                held, cells = {}, 0
        if held:
            yield pd.DataFrame({"dataset": list(held), "part": list(held.values())})

    parts = map_with_models(records, models, rows, ARRAYS, **limits).mapInPandas(add_up, ARRAYS)
    summed = parts.select("dataset", F.posexplode("part").alias("pos", "v")).groupBy("dataset", "pos").agg(
        F.sum("v").alias("v")
    )
    return gather(summed, {"total": "v"})


def gather(cells: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``(dataset, pos, value..)`` to one row per dataset with arrays in order of ``pos``."""
    items = F.array_sort(F.collect_list(F.struct("pos", *[F.col(c).alias(f"_{n}") for n, c in columns.items()])))
    return cells.groupBy("dataset").agg(items.alias("_items")).select(
        "dataset", *[F.col(f"_items._{n}").alias(n) for n in columns]
    )


def feature_cells(records: DataFrame, column: str = "features") -> DataFrame:
    return records.select("dataset", F.posexplode(column).alias("pos", "value"))


def feature_stats(records: DataFrame) -> DataFrame:
    """Settled per-dataset model with n and per-feature lo, hi, mean and sd arrays."""
    per_feature = feature_cells(records).groupBy("dataset", "pos").agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"),
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"),
    )
    model = gather(per_feature, {"ns": "n", "lo": "lo", "hi": "hi", "mean": "mean", "sd": "sd"})
    return settle(model.select("dataset", F.col("ns")[0].alias("n"), "lo", "hi", "mean", "sd"))
