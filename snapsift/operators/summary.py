"""Study summary: how the table comparisons went."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cells import only

STANDARD_KEYS = ("centre", "id")
REPORT_KEY_PATTERN = r"^(?:.+r(pt)?n$)"


def table_summary(status: DataFrame) -> DataFrame:
    """Cells, changed cells and their share per (snapshot, table), or the error."""
    cells = F.col("n_rows") * F.col("n_cols")
    return status.select(
        "snapshot", "table_name", "success", "error", "key_cols",
        cells.alias("num_cells"), F.col("n_diffs").alias("num_diffs"),
        F.try_divide(F.col("n_diffs").cast("double"), cells.cast("double")).alias("diff_frac"),
    )


def key_union(summary: DataFrame, by: list[str] = ("table_name",)) -> DataFrame:
    """Sorted set of key columns per ``by`` (none: over all tables).

    Names are made distinct before they are gathered, so a list holds column names of
    one table and nothing that grows with rows or snapshots.
    """
    by = list(by)
    names = summary.select(*by, F.explode_outer("key_cols").alias("name")).distinct()
    return names.groupBy(*by).agg(F.array_sort(F.collect_list("name")).alias("key_cols"))


def status_matrix(summary: DataFrame, snapshots: list[str]) -> DataFrame:
    """Table by snapshot: share of changed cells, else the error, else TableNotPresent."""
    cell = F.coalesce(F.round("diff_frac", 6).cast("string"), F.col("error"))
    return (
        summary.groupBy("table_name")
        .pivot("snapshot", snapshots)
        .agg(only(cell, "results of a table"))
        .na.fill("TableNotPresent", snapshots)
    )


def success_order(summary: DataFrame) -> DataFrame:
    """Number of successes per table, most first."""
    return (
        summary.groupBy("table_name")
        .agg(F.sum(F.col("success").cast("long")).alias("num_successes"))
        .orderBy(F.desc("num_successes"), "table_name")
    )


def ordered_status_matrix(summary: DataFrame, snapshots: list[str]) -> DataFrame:
    """Status matrix with the key set of each table, most successful tables first."""
    return (
        status_matrix(summary, snapshots)
        .join(success_order(summary), "table_name")
        .join(key_union(summary), "table_name")
        .orderBy(F.desc("num_successes"), "table_name")
        .drop("num_successes")
    )


def study_totals(summary: DataFrame, snapshots: int) -> DataFrame:
    """Tables, attempts, successes and both success percentages."""
    per_table = success_order(summary).agg(
        F.count(F.lit(1)).alias("tables"),
        F.sum("num_successes").alias("successful"),
        F.sum((F.col("num_successes") > 0).cast("long")).alias("partially_successful"),
    )
    attempts = F.col("tables") * F.lit(snapshots)
    return per_table.select(
        "tables", attempts.alias("attempts"), "successful", "partially_successful",
        F.try_divide(F.col("successful") * 100.0, attempts.cast("double")).alias("pct_successful"),
        F.try_divide(F.col("partially_successful") * 100.0, F.col("tables").cast("double")).alias("pct_partially"),
    )


def nonstandard_keys(summary: DataFrame) -> DataFrame:
    """Per (snapshot, table): does the key use columns beyond the standard ones."""
    named = summary.select("snapshot", "table_name", "success", F.explode_outer("key_cols").alias("name"))
    odd = F.col("success") & ~F.coalesce(F.col("name").isin(*STANDARD_KEYS), F.lit(False))
    report = F.coalesce(F.col("name").rlike(REPORT_KEY_PATTERN), F.lit(False))
    return named.groupBy("snapshot", "table_name").agg(
        F.bool_or(odd).alias("uses_nonstandard_key"),
        F.bool_or(odd & ~report).alias("uses_highly_nonstandard_key"),
    )


def per_snapshot_flags(summary: DataFrame) -> DataFrame:
    """Success of each (snapshot, table) with both key flags."""
    success = summary.select("snapshot", "table_name", "success").dropDuplicates()
    return success.join(nonstandard_keys(summary), ["snapshot", "table_name"], "full")


def success_rates(summary: DataFrame) -> DataFrame:
    return summary.groupBy("table_name").agg(F.avg(F.col("success").cast("double")).alias("success_rate"))


def imperfect_tables(summary: DataFrame) -> DataFrame:
    """Rows of tables that failed at least once."""
    perfect = success_rates(summary).filter(F.col("success_rate") == 1.0)
    return summary.join(perfect, "table_name", "left_anti")
