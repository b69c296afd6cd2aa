"""Whole-study runs: diff all tables, label all tables."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..config import StudyConfig, TableFailure
from ..functions.runtime import scratch_path, settle
from ..functions.skew import small_side
from ..operators import guards, labels, snapdiff
from ..sources import tables as src


#: Snapshots of a table that are compared in one job, which bounds its plan.
SNAPSHOTS_PER_JOB = 8

CELLS_SCHEMA = (
    "trial string, snapshot string, table_name string, key array<string>, diff string, column string, left string, right string"
)
RECORDS_SCHEMA = (
    "trial string, snapshot string, table_name string, key array<string>, value_names array<string>, values array<double>, "
    "text_names array<string>, texts array<string>, columns array<string>"
)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def table_schema_text(result: snapdiff.TableDiff) -> list[str]:
    return [c for c in result.records.columns if c not in result.key]


def study_diff(
    spark: SparkSession,
    study: StudyConfig,
    snapshots: dict[str, dict[str, DataFrame]],
    gold: dict[str, DataFrame],
    threads: int = 8,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Compare every table of every preliminary snapshot.

    Returns ``(cells, status, records)``: the long salient diff of all tables; one status row
    per (snapshot, table); and the lazy records. A table is joined in a job that stores the cells
    of up to ``SNAPSHOTS_PER_JOB`` snapshots; a failure is a status row and leaves the others alone.
    Only counts reach the driver. Tables are submitted side by side, so that small ones fill the
    gaps of large ones.
    """
    root = scratch_path(spark, "cells")
    work = [(s, t, pre) for s, pre_tables in snapshots.items() for t, pre in pre_tables.items()]
    counts = {table: snapdiff.GoldCounts() for table in gold}
    with ThreadPoolExecutor(max_workers=threads) as submit:
        done = list(submit.map(
            lambda w: snapdiff.compare_table(study, w[0], w[1], w[2], gold.get(w[1]), counts.get(w[1])), work))
        jobs: list[tuple[str, dict[str, snapdiff.TableDiff]]] = []
        for table in dict.fromkeys(t for _, t, _ in work):
            pairs = [(s, r) for (s, t, _), (r, _) in zip(work, done) if t == table and r]
            jobs += [(table, dict(pairs[i:i + SNAPSHOTS_PER_JOB])) for i in range(0, len(pairs), SNAPSHOTS_PER_JOB)]
        stored = list(submit.map(
            lambda job: snapdiff.store_cells(study, *job[1], f"{root}/{job[0]:05d}"), enumerate(jobs)))
    cells = [folder for folders, _ in stored for folder in folders]
    late = {(s, table): failed for (table, _), (_, failures) in zip(jobs, stored) for s, failed in failures.items()}
    records, outcomes = [], []
    for (snapshot, table, _), (result, failure) in zip(work, done):
        failure = failure or late.get((snapshot, table))
        if failure:
            outcomes.append(failure)
            continue
        outcomes.append(snapdiff.success_row(study.name, snapshot, table, result))
        records.append(study_records(study.name, snapshot, table, result))
    # without any success the failure rows are the result, beside empty frames
    cells = spark.read.schema(CELLS_SCHEMA).parquet(*cells) if cells else spark.createDataFrame([], CELLS_SCHEMA)
    records = union_all(records) if records else spark.createDataFrame([], RECORDS_SCHEMA)
    outcomes = spark.createDataFrame(outcomes, snapdiff.STATUS_SCHEMA)
    return cells, settle(snapdiff.table_status(outcomes, cells, records)), records


def study_records(trial: str, snapshot: str, table: str, result: snapdiff.TableDiff) -> DataFrame:
    """Records of one table with the schema shared by all tables.

    ``values`` are the numeric columns in order of ``value_names``; ``texts`` hold all other
    columns (text, dates, booleans) as text, in order of ``text_names``; ``columns`` names
    every non-key column.
    """
    names = guards.numeric_columns(result.records, result.key)
    values = F.array(*[F.col(f"`{c}`").cast("double") for c in names]).cast("array<double>")
    others = [c for c in table_schema_text(result) if c not in names]
    return result.records.select(
        F.lit(trial).alias("trial"), F.lit(snapshot).alias("snapshot"), F.lit(table).alias("table_name"),
        snapdiff.text_key(result.key).alias("key"),
        F.array(*[F.lit(c) for c in names]).cast("array<string>").alias("value_names"),
        values.alias("values"),
        F.array(*[F.lit(c) for c in others]).cast("array<string>").alias("text_names"),
        F.array(*[F.col(f"`{c}`").cast("string") for c in others]).cast("array<string>").alias("texts"),
        F.array(*[F.lit(c) for c in table_schema_text(result)]).cast("array<string>").alias("columns"),
    )


def derive_labels(
    cells: DataFrame,
    status: DataFrame,
    records: DataFrame,
    valid: DataFrame | None = None,
    exclude_tables: tuple[str, ...] = (),
    exclude_fields: tuple[str, ...] = (),
    column_threshold: float = config.COLUMN_CHANGE_FRACTION,
    record_threshold: float = config.RECORD_CHANGE_FRACTION,
    drop_excluded: bool = True,
) -> DataFrame:
    """Labelled records of all selected tables in one plan.

    Configured and derived exclusions are taken per table. Excluded columns leave the label
    counts, the numeric features and the text columns; without ``drop_excluded`` the counts only, and
    the fraction of changes is taken over all columns.
    """
    by = ["snapshot", "table_name"]
    chosen = settle(guards.select_tables(status, valid, exclude_tables))
    tables = small_side(chosen.select(*by))
    kept = cells.join(tables, by, "left_semi")
    corrections = guards.filter_corrections(kept)
    fractions = labels.column_change_fraction(corrections, chosen.select(*by, "n_rows"), by)
    bad = settle(labels.unreliable_columns(fractions, by, column_threshold, exclude_fields, tables=chosen))
    # one list of column names per table
    bad_lists = settle(bad.groupBy(*by).agg(F.collect_list("column").alias("_bad")))
    counts = labels.record_change_counts(
        corrections.filter(~F.exists("key", lambda k: k.isNull())), bad, ["key"], by
    )
    frame = (
        records.join(tables, by, "left_semi")
        .join(small_side(bad_lists), by, "left")
        .withColumn("_bad", F.coalesce("_bad", F.array().cast("array<string>")))
        .join(counts, [*by, "key"], "left")
    )
    if not drop_excluded:
        frame = frame.withColumn("_bad", F.array().cast("array<string>"))
    width = F.size(F.array_except("columns", "_bad"))

    def reliable(names, values):
        return F.filter(F.arrays_zip(names, values), lambda x: ~F.array_contains(F.col("_bad"), x[names]))

    frame = frame.withColumn("change_count", F.coalesce("change_count", F.lit(0).cast("long"))).withColumn(
        "_width", width
    )
    out = labels.derive_record_labels(frame, "_width", record_threshold)
    out = out.withColumns({"_r": reliable("value_names", "values"), "_t": reliable("text_names", "texts")})
    return out.select(
        "trial", *by, "key",
        F.col("_r.value_names").alias("value_names"), F.col("_r.values").alias("values"),
        F.col("_t.text_names").alias("text_names"), F.col("_t.texts").alias("texts"),
        "change_count", F.coalesce("change_frac", F.lit(0.0)).alias("change_frac"),
        F.coalesce("record_change", F.lit(False)).alias("record_change"), "any_change",
    )


def run_study(
    spark: SparkSession, study: StudyConfig, output: str, fmt: str = "parquet", infer_long: bool = False, **options
) -> None:
    """Read a study from storage, compare it, label it and store both results.

    Whole numbers are not turned into long by default: the formats read here carry types,
    and a column that is whole in one snapshot only would count as a schema change.
    """
    gold_root = study.snapshot_root(study.gold)
    snapshots: dict[str, dict[str, DataFrame | None]] = {}
    gold: dict[str, DataFrame] = {}
    for snapshot in study.preliminary:
        root = study.snapshot_root(snapshot)
        pairs = src.pair_snapshot_tables(src.list_snapshot(spark, root), src.list_snapshot(spark, gold_root))
        found = {}
        # one small row per table file
        for row in pairs.collect():
            name = row["table_name"]
            found[name] = _read_or_none(spark, f"{root}/{row['preliminary_file']}", fmt, infer_long, options)
            if row["gold_file"] and name not in gold:
                gold[name] = _read_or_none(spark, f"{gold_root}/{row['gold_file']}", fmt, infer_long, options)
        snapshots[snapshot] = found
    cells, status, records = study_diff(spark, study, snapshots, gold)
    src.write_diff(cells, f"{output}/diffs")
    status.write.mode("overwrite").parquet(f"{output}/status")
    cells = src.read_diff(spark, f"{output}/diffs")
    status = spark.read.parquet(f"{output}/status")
    valid = src.valid_tables(src.read_metadata(spark, study), study.metadata_column, status)
    labelled = derive_labels(
        cells, status, records, valid, study.label_exclude_tables, study.label_exclude_fields,
        study.column_threshold, study.record_threshold, study.drop_excluded,
    )
    src.write_labelled(labelled, f"{output}/derived")


def _read_or_none(spark: SparkSession, path: str, fmt: str, infer_long: bool, options: dict) -> DataFrame | None:
    try:
        return src.read_snapshot_table(spark, path, fmt, infer_long, **options)
    except TableFailure:
        return None
