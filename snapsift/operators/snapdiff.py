"""Key discovery and comparison of a preliminary table with its gold version."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from threading import Lock

from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..config import StudyConfig, TableFailure
from ..functions.runtime import settle
from ..functions.skew import small_side
from . import guards

#: Cells of one key that a group may hold while candidate columns are counted.
GROUP_CELLS = 200_000
#: One in so many keys of a gold table is looked at first when candidate columns are compared.
KEYS_PER_TRIED = 32


def _largest_group(df: DataFrame, columns: list[str]) -> int | None:
    """Largest number of rows that share the values of ``columns``, if there are rows that can be grouped."""
    try:
        return duplicates(df, columns).first()[0]
    except AnalysisException:
        return None


def _counted(largest: int | None) -> int:
    if not largest:
        raise TableFailure("DuplicatesUncountable")
    return largest


def dup_count(df: DataFrame, columns: list[str]) -> int:
    """Largest number of rows that share the values of ``columns``."""
    return _counted(_largest_group(df, columns))


def duplicates(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row, ``dup_count``: counts combine on the map side, so hot keys cost nothing."""
    return df.groupBy(*columns).count().agg(F.max("count").alias("dup_count"))


def _comparable_text(df: DataFrame, name: str) -> Column:
    """Text that is equal exactly when the values are (both zeros are one value)."""
    col = F.col(f"`{name}`")
    if dict(df.dtypes)[name] in ("double", "float"):
        col = F.when(col == 0, F.lit(0).cast("double")).otherwise(col.cast("double"))
    return col.cast("string")


def _most_alike(rows: Column, position: Column) -> Column:
    """Largest number of rows (arrays of text) that agree at ``position``."""
    cells = F.transform(rows, lambda r: F.get(r, position))
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(seen, cell):
        run = F.when(seen["last"].eqNullSafe(cell), seen["run"] + 1).otherwise(F.lit(1))
        return F.struct(cell.alias("last"), run.alias("run"), F.greatest(seen["best"], run).alias("best"))

    longest = F.aggregate(F.sort_array(cells), start, step, lambda seen: seen["best"])
    return F.when(F.size(F.array_distinct(cells)) == F.size(cells), F.lit(1)).otherwise(longest).cast("long")


def candidate_dup_counts(
    df: DataFrame, key: list[str], candidates: list[str], group_cells: int = GROUP_CELLS
) -> DataFrame:
    """``(candidate, dup_count)`` for the key extended by each candidate column.

    The rows of a key meet once, and all candidates are counted inside that group, so a row is
    moved once however many candidates there are. Keys with more than ``group_cells`` candidate
    cells are no group: their cells are counted by value, over all tasks.
    """
    spark = df.sparkSession
    names = spark.createDataFrame(list(enumerate(candidates)), "_pos int, candidate string")
    rows = df.select(*[F.col(f"`{k}`") for k in key], F.array(*[_comparable_text(df, c) for c in candidates]).alias("_cells"))
    hot = settle(rows.groupBy(*key).count().filter(F.col("count") > max(1, group_cells // len(candidates))).drop("count"))
    light, parts = rows, []
    if not hot.isEmpty():
        side = small_side(hot.toDF(*[f"_k{i}" for i in range(len(key))]))
        same_key = reduce(Column.__and__, [F.col(f"`{k}`").eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)])
        light = rows.join(side, same_key, "left_anti")
        parts.append(
            rows.join(side, same_key, "left_semi").select(*[F.col(f"`{k}`") for k in key], F.posexplode("_cells").alias("_pos", "_cell"))
            .groupBy(*key, "_pos", "_cell").count().select("_pos", F.col("count").alias("n"))
        )
    every = F.sequence(F.lit(0), F.lit(len(candidates) - 1))
    grouped = light.groupBy(*key).agg(F.collect_list("_cells").alias("_rows")).filter(F.size("_rows") > 1)
    parts.append(grouped.select(F.posexplode(F.transform(every, lambda i: _most_alike(F.col("_rows"), i))).alias("_pos", "n")))
    counts = reduce(DataFrame.union, parts).groupBy("_pos").agg(F.max("n").alias("dup_count"))
    return names.join(counts, "_pos", "left").select(
        "candidate", F.coalesce("dup_count", F.lit(1).cast("long")).alias("dup_count")
    )


class GoldCounts:
    """Duplicate counts of one gold table, each taken once for all tables compared with it."""

    def __init__(self):
        self._known: dict[tuple[str, ...], int | None] = {}
        self._least: dict[tuple[str, ...], int] = {}
        self._one_at_a_time = Lock()

    def _largest(self, gold: DataFrame, key: list[str]) -> int | None:
        if tuple(key) not in self._known:
            self._known[tuple(key)] = _largest_group(gold, key)
        return self._known[tuple(key)]

    def dup_count(self, gold: DataFrame, key: list[str]) -> int:
        with self._one_at_a_time:
            return _counted(self._largest(gold, key))

    def repeats(self, gold: DataFrame, key: list[str]) -> bool:
        """Whether several rows are known to share a key."""
        with self._one_at_a_time:
            return (self._largest(gold, key) or 0) > 1

    def best(self, gold: DataFrame, key: list[str], names: list[str], order: Callable[[str], tuple]) -> str:
        """The one of ``names`` that leaves the smallest group when the key is extended by it, by ``order`` among equals.

        The rows of a part of the keys come first: a group is at least as large as what they show. The
        name that looks best is then counted over all rows, and after it only those that may still beat it.
        """
        with self._one_at_a_time:
            new = [c for c in names if (*key, c) not in self._least]
            if new:
                tried = gold.filter(F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in key]), F.lit(KEYS_PER_TRIED)) == 0)
                # one small row per column: at most max_table_columns rows
                self._least |= {(*key, r["candidate"]): r["dup_count"] for r in candidate_dup_counts(tried, key, new).collect()}
            found = {c: self._known[(*key, c)] for c in names if self._known.get((*key, c))}

            def bound(c: str) -> tuple:
                return (found.get(c) or self._least[(*key, c)], *order(c))

            first = min(names, key=bound)
            if first not in found and (count := self._largest(gold, [*key, first])):
                found[first] = count
            rest = [c for c in names if c not in found and bound(c) <= bound(first)]
            if rest:
                found |= {r["candidate"]: r["dup_count"] for r in candidate_dup_counts(gold, key, rest).collect()}
                if self._largest(gold, key):  # an empty table has no count of its own
                    self._known |= {(*key, c): found[c] for c in rest}
            return min(names, key=bound)


def discover_key(
    pre: DataFrame,
    gold: DataFrame,
    key: list[str],
    max_cols: int = config.MAX_KEY_COLS,
    patterns: tuple[str, ...] = config.KEY_NAME_PATTERNS,
    counts: GoldCounts | None = None,
) -> list[str]:
    """Grow ``key`` until it is unique in both tables.

    Each step adds the shared column that leaves the smallest group in the gold table;
    among equals a column named like an identifier wins, then the first name. Only
    counts reach the driver. ``counts`` of the gold table may be shared by several calls.
    """
    counts = counts or GoldCounts()
    key = list(dict.fromkeys(key))
    while True:
        if len(key) > max_cols:
            raise TableFailure("SufficientIdentifiersNotAvailable")
        if not counts.repeats(gold, key) and dup_count(pre, key) == 1 and counts.dup_count(gold, key) == 1:
            return key
        candidates = sorted((set(pre.columns) & set(gold.columns)) - set(key))
        if not candidates:
            raise TableFailure("SufficientIdentifiersNotAvailable")
        key.append(counts.best(gold, key, candidates, lambda c: (not any(re.match(p, c) for p in patterns), c)))


def diff_snapshots(pre: DataFrame, gold: DataFrame, key: list[str], gold_only: bool = True) -> DataFrame:
    """Compare two tables on ``key`` (null-safe).

    One row per key: ``diff`` is N (same), C (changed), I (only gold) or D (only
    preliminary), then the key, then ``left_`` (preliminary) and ``right_`` (gold)
    values. ``gold_only=False`` leaves the I rows out with an outer join from the
    preliminary side, which is all that labels and summaries need.
    """
    names = [c for c in pre.columns if c not in key]
    left = pre.select(
        *[F.col(f"`{k}`").alias(f"_lk{i}") for i, k in enumerate(key)],
        *[F.col(f"`{c}`").alias(f"left_{c}") for c in names],
        F.lit(True).alias("_in_pre"),
    )
    right = gold.select(
        *[F.col(f"`{k}`").alias(f"_rk{i}") for i, k in enumerate(key)],
        *[F.col(f"`{c}`").alias(f"right_{c}") for c in names],
        F.lit(True).alias("_in_gold"),
    )
    on = [F.col(f"_lk{i}").eqNullSafe(F.col(f"_rk{i}")) for i in range(len(key))]
    joined = left.join(right, on, "full" if gold_only else "left")
    if names:
        same = F.struct(*[F.col(f"`left_{c}`") for c in names]).eqNullSafe(
            F.struct(*[F.col(f"`right_{c}`") for c in names])
        )
    else:
        same = F.lit(True)
    code = (
        F.when(F.col("_in_pre").isNull(), "I")
        .when(F.col("_in_gold").isNull(), "D")
        .when(same, "N")
        .otherwise("C")
    )
    pairs = [F.col(f"`{side}_{c}`") for c in names for side in ("left", "right")]
    return joined.select(
        code.alias("diff"),
        *[F.when(F.col("_in_pre"), F.col(f"_lk{i}")).otherwise(F.col(f"_rk{i}")).alias(k) for i, k in enumerate(key)],
        *pairs,
    )


def value_columns(diff: DataFrame) -> list[str]:
    """Compared columns of a wide diff."""
    return [c.removeprefix("left_") for c in diff.columns if c.startswith("left_")]


def unpivot_diff(diff: DataFrame, key: list[str]) -> DataFrame:
    """Wide diff to one row per (key, column, side), values as text."""
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"), F.lit(side).alias("side"),
                F.col(f"`{side}_{c}`").cast("string").alias("value"),
            )
            for c in value_columns(diff)
            for side in ("left", "right")
        ]
    )
    return diff.select("diff", *key, F.inline(cells))


def pivot_sides(cells: DataFrame, key: list[str]) -> DataFrame:
    """One row per (key, column) with the two sides as columns."""
    return (
        cells.groupBy("diff", *key, "column")
        .pivot("side", ["left", "right"])
        .agg(F.first("value"))
    )


def salient_cells(diff: DataFrame, key: list[str]) -> DataFrame:
    """:func:`unpivot_diff`, :func:`pivot_sides` and the salience filter in one pass.

    Sides are compared with their types and unchanged cells never leave the row, so
    there is no shuffle and no explosion of the whole table.
    """
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"`left_{c}`").cast("string").alias("left"),
                F.col(f"`right_{c}`").cast("string").alias("right"),
                F.col(f"`left_{c}`").eqNullSafe(F.col(f"`right_{c}`")).alias("same"),
            )
            for c in value_columns(diff)
        ]
    )
    return diff.select("diff", *key, F.inline(F.filter(cells, lambda x: ~x["same"]))).drop("same")


def duplicate_diff_keys(diff: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once in the diff."""
    return diff.groupBy("diff", *key).count().filter(F.col("count") > 1)


def guard_diff_key(diff: DataFrame, key: list[str]) -> None:
    if not duplicate_diff_keys(diff, key).isEmpty():
        raise TableFailure("DiffIdentifiersInsufficient")


def guard_meaningful(changes: DataFrame) -> None:
    if not value_columns(changes) or changes.isEmpty():
        raise TableFailure("NoMeaningfulData")


@dataclass(frozen=True)
class TableDiff:
    """Lazy result for one table pair."""

    key: list[str]
    records: DataFrame
    changes: DataFrame
    cells: DataFrame


def typed(table: DataFrame) -> DataFrame:
    """A raw table as it is compared: without system columns, identifiers with their types."""
    return guards.cast_typed(guards.prune_columns(table))


def compute_table_diff(
    pre: DataFrame | None,
    gold: DataFrame | None,
    id_cols: tuple[str, ...] = config.DEFAULT_ID_COLS,
    extra_ids: tuple[str, ...] = (),
    max_key_cols: int = config.MAX_KEY_COLS,
    strict: bool = True,
    check: bool = True,
    counts: GoldCounts | None = None,
) -> TableDiff:
    """All steps for one pair of raw tables; raises :class:`TableFailure`.

    Without ``check`` the join is not run to see whether there are changes; the caller judges
    by the cells it stores. ``counts`` may be shared by all tables compared with ``gold``.
    The key was tested for uniqueness on both sides by :func:`discover_key`, and a key
    survives the left join as it is, so the duplicate guard needs no job of its own.
    """
    if pre is None:
        raise TableFailure("DataFrameLoadingException")
    if gold is None:
        raise TableFailure("GoldStandardTableNotFound")
    pre, gold = typed(pre), typed(gold)
    guards.guard_width(pre, gold)
    guards.guard_nonempty(pre)
    ids = [*id_cols, *extra_ids]
    guards.guard_identifiers(pre, ids)
    key = discover_key(pre, gold, ids, max_key_cols, counts=counts)
    pre, gold = guards.align_schemas(pre, gold, strict)
    guards.guard_schema_change(pre, gold)
    changes = guards.filter_changes(diff_snapshots(pre, gold, key, gold_only=False))
    if check:
        guard_meaningful(changes)
    elif not value_columns(changes):
        raise TableFailure("NoMeaningfulData")
    return TableDiff(key, pre, changes, salient_cells(changes, key))


#: Messages of Spark about plans and results that it can't hold.
TOO_LARGE = re.compile(r"OutOfMemory|StackOverflow|maxResultSize|grows beyond 64 KB|too large|Cannot grow BufferHolder")

STATUS_SCHEMA = (
    "trial string, snapshot string, table_name string, success boolean, error string, "
    "error_message string, key_cols array<string>, n_rows long, n_cols long, n_diffs long"
)


def failure_row(trial: str, snapshot: str, table: str, failure: TableFailure) -> tuple:
    return (trial, snapshot, table, False, failure.kind, failure.message, None, None, None, None)


def _or_failure(study: StudyConfig, snapshot: str, table: str, work: Callable) -> tuple[object, tuple | None]:
    """What ``work`` returns, or the table's failure row, which keeps Spark's message.

    Whatever goes wrong with one table is that table's failure: reading errors, and plans or results too large for Spark.
    """
    try:
        return work(), None
    except TableFailure as failure:
        return None, failure_row(study.name, snapshot, table, failure)
    except (PySparkException, Py4JError) as error:
        kind = "DataFrameTooLarge" if TOO_LARGE.search(str(error)) else "DataFrameLoadingException"
        return None, failure_row(study.name, snapshot, table, TableFailure(kind, str(error)))


def compare_table(
    study: StudyConfig, snapshot: str, table: str, pre: DataFrame | None, gold: DataFrame | None, counts: GoldCounts | None = None
) -> tuple[TableDiff | None, tuple | None]:
    """Lazy comparison of one table, or its failure row."""

    def work() -> TableDiff:
        if table in study.exclude_tables:
            raise TableFailure("ExcludedTable")
        extra = tuple(study.additional_identifiers.get(table, ()))
        return compute_table_diff(pre, gold, study.id_cols, extra, study.max_key_cols, check=False, counts=counts)

    return _or_failure(study, snapshot, table, work)


def store_cells(
    study: StudyConfig, table: str, results: dict[str, TableDiff], path: str
) -> tuple[list[str], dict[str, tuple]]:
    """Store the long cells of one table in several snapshots; returns the folders and the failure rows by snapshot.

    One job stores them all, so that Spark moves the gold rows once for all snapshots. If it fails, every
    snapshot has a job of its own, and only those that fail again are failures.
    """
    frames = {s: long_diff(study.name, s, table, r) for s, r in results.items()}
    _, failure = _or_failure(study, next(iter(frames)), table, lambda: reduce(DataFrame.unionByName, frames.values()).write.parquet(path))
    if failure and len(frames) == 1:
        return [], dict.fromkeys(frames, failure)
    folders, failures = dict.fromkeys(frames, path), {}
    for i, (snapshot, cells) in enumerate(frames.items()):

        def work() -> None:
            if failure:
                folders[snapshot] = f"{path}-{i:05d}"
                cells.write.parquet(folders[snapshot])
            stored = cells.sparkSession.read.schema(cells.schema).parquet(folders[snapshot])
            if stored.filter(F.col("snapshot") == snapshot).isEmpty():
                guard_meaningful(results[snapshot].changes)  # changed records need not have a changed cell

        _, failed = _or_failure(study, snapshot, table, work)
        if failed:
            failures[snapshot] = failed
    return sorted({folders[s] for s in frames if s not in failures}), failures


def process_table(
    study: StudyConfig, snapshot: str, table: str, pre: DataFrame | None, gold: DataFrame | None, path: str,
    counts: GoldCounts | None = None,
) -> tuple[TableDiff | None, tuple | None]:
    """Compare one table and store its long cells at ``path``, in a job of its own; its diff, or its failure row."""
    result, failure = compare_table(study, snapshot, table, pre, gold, counts)
    if not failure:
        failure = store_cells(study, table, {snapshot: result}, path)[1].get(snapshot)
    return (None, failure) if failure else (result, None)


def text_key(key: list[str]) -> Column:
    """Key values as an array of text, so that tables with different keys share a schema."""
    return F.array(*[F.col(f"`{k}`").cast("string") for k in key])


def long_diff(study: str, snapshot: str, table: str, result: TableDiff) -> DataFrame:
    """Salient cells of one table in the schema shared by all tables."""
    return result.cells.select(
        F.lit(study).alias("trial"), F.lit(snapshot).alias("snapshot"),
        F.lit(table).alias("table_name"), text_key(result.key).alias("key"),
        "diff", "column", "left", "right",
    )


def success_row(study: str, snapshot: str, table: str, result: TableDiff) -> tuple:
    """Status row of a compared table; its counts come from the stored results."""
    width = len(result.records.columns) - len(result.key)
    return (study, snapshot, table, True, None, None, list(result.key), None, width, None)


def table_status(outcomes: DataFrame, cells: DataFrame, records: DataFrame) -> DataFrame:
    """Fill the record and cell counts of the successful tables into their status rows."""
    by = ["snapshot", "table_name"]
    rows = records.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"))
    diffs = cells.groupBy(*by).agg(F.count(F.lit(1)).alias("_diffs"))
    return outcomes.join(rows, by, "left").join(diffs, by, "left").select(
        "trial", *by, "success", "error", "error_message", "key_cols", F.col("_rows").alias("n_rows"), "n_cols",
        F.when(F.col("success"), F.coalesce("_diffs", F.lit(0).cast("long"))).alias("n_diffs"),
    )
