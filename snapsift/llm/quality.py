"""Operator 3: quality rules judged by an isolation forest over their statistics.

Word, symbol and repetition statistics are counted over whole texts, in the tasks that read them.
An isolation forest is grown over all labelled rows: each tree splits a subsample of ``SUBSAMPLE`` of
them at random, as the method has it, and each row has the same chance in each tree. The anomaly score
of a document is ``2 ** -(mean path length / expected path length)``. The threshold is the exact one of
all labelled rows that pass the base rule: the lowest score that rejects at most ``MOST_GOOD_LOST`` of
the good ones (quality 1). Statistics and scores cover every document.

Defined results: null or wordless text has zeros throughout and fails the base rule; repeated
doc_ids are scored row by row, and their best label counts; without labelled rows no document is
anomalous; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.running import running_totals
from ..functions.runtime import store
from .registry import query, table
from .words import SPACED, combine, lean, mix, pieces, window_hashes, window_starts

#: Words of the windows whose repetition counts.
REPEAT_WINDOW = 3
#: Base rule: fewest words, and most percent of words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 50, 50
TREES, SUBSAMPLE, SEED = 100, 256, 7
#: Share of the good labelled rows that the threshold may reject.
MOST_GOOD_LOST = 0.002

STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_STARTS_CHAR = (np.arange(256) & 0xC0) != 0x80


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    running = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return running[bounds[1:]] - running[bounds[:-1]]


def _repeated_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def statistics(column: pa.Array) -> list[np.ndarray]:
    """The columns of ``STATISTICS`` for a column of texts."""
    out = [[np.zeros(0, np.int64)] for _ in STATISTICS]
    for piece in pieces(column, SPACED):
        bounds = piece.bounds
        starts = window_starts(bounds, REPEAT_WINDOW)
        windows = window_hashes(piece.hashes(), REPEAT_WINDOW)
        starts = starts[: len(windows)]
        windows = windows[starts]
        keys = combine(mix(piece.doc[starts].astype(np.uint64) + np.uint64(1)), windows)
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        again = starts[order[np.r_[False, same] | np.r_[same, False]]] if len(order) else starts
        repeated = np.zeros(len(piece.start), bool)
        for k in range(REPEAT_WINDOW):
            repeated[again + k] = True
        low, high = int(piece.offsets[0]), int(piece.offsets[-1])
        data, places = piece.data[low:high], piece.offsets - low
        lines = [_repeated_lines(data[a:b].tobytes()) for a, b in zip(places[:-1], places[1:], strict=True)]
        for values, found in zip(out, [
            piece.counts, _per_text(SPACED[data] & _STARTS_CHAR[data], places), _per_text(_SYMBOL[data], places),
            np.array(lines, np.int64), _per_text(repeated, bounds),
        ], strict=True):
            values.append(found)
    return [np.concatenate(x) for x in out]


def rule_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and ``STATISTICS`` of every document."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [pa.array(x, pa.int64()) for x in statistics(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts], ["doc_id", *STATISTICS])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lean(count), f"doc_id {kind}, " + ", ".join(f"{x} long" for x in STATISTICS))


def features(counts: pd.DataFrame) -> np.ndarray:
    """What the forest splits on: length, word length, and rates of symbols and repetition."""
    c = {k: counts[k].to_numpy(float) for k in STATISTICS}
    words = np.maximum(c["n_words"], 1)
    return np.column_stack([
        np.log1p(c["n_words"]), c["word_chars"] / words, c["n_symbols"] / np.maximum(c["word_chars"], 1),
        np.log1p(c["n_dup_lines"]), c["n_repeat_words"] / words,
    ])


def expected_path(n: float) -> float:
    """Mean path length of an unsuccessful search in a binary tree of ``n`` rows."""
    return 0.0 if n <= 1 else 1.0 if n <= 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


class IsolationForest:
    """Random axis splits over one subsample per tree; trees are arrays of nodes."""

    def __init__(self, samples: list[np.ndarray], seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.size = max(map(len, samples), default=0)
        depth = int(np.ceil(np.log2(max(self.size, 2))))
        self.roots, nodes = [], []

        def grow(part: np.ndarray, level: int) -> int:
            at = len(nodes)
            nodes.append([-1, 0.0, at, at, level + expected_path(len(part))])
            spread = np.flatnonzero(part.max(0) > part.min(0)) if len(part) > 1 and level < depth else []
            if len(spread):
                k = int(rng.choice(spread))
                cut = rng.uniform(part[:, k].min(), part[:, k].max())
                left = part[:, k] <= cut
                nodes[at][:2] = k, cut
                nodes[at][2] = grow(part[left], level + 1)
                nodes[at][3] = grow(part[~left], level + 1)
            return at

        for rows in samples:
            self.roots.append(grow(rows, 0))
        columns = list(zip(*nodes, strict=True)) or [()] * 5
        self.feature, self.left, self.right = (np.array(columns[i], np.int32) for i in (0, 2, 3))
        self.cut, self.path = np.array(columns[1], float), np.array(columns[4], float)
        self.depth = depth

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly score of each row, from 0 (usual) to 1."""
        if not self.roots:
            return np.zeros(len(rows))
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for root in self.roots:
            at = np.full(len(rows), root, np.int32)
            for _ in range(self.depth):
                feature = self.feature[at]
                goes_left = rows[every, np.maximum(feature, 0)] <= self.cut[at]
                at = np.where(feature < 0, at, np.where(goes_left, self.left[at], self.right[at]))
            total += self.path[at]
        return 2.0 ** -(total / len(self.roots) / max(expected_path(self.size), 1e-9))


def tree_samples(labelled: DataFrame, rows: int, trees: int = TREES, subsample: int = SUBSAMPLE) -> DataFrame:
    """tree and ``STATISTICS``: ``subsample`` of the ``rows`` labelled rows for each tree.

    A row enters a tree's draw when its hash is below a rate that leaves a little more than the
    subsample, and the smallest hashes win; so what is sorted does not grow with the rows. Equal rows
    are numbered and drawn apart.
    """
    rate = min(1.0, (subsample + 8 * subsample**0.5) / max(rows, 1))
    some = min(1.0, rate * trees)

    def draw(*of: Column) -> Column:
        return F.pmod(F.xxhash64("doc_id", *STATISTICS, "_copy", *of, F.lit(SEED)), F.lit(1 << 30)) / F.lit(float(1 << 30))

    copy = F.row_number().over(W.partitionBy("doc_id", *STATISTICS).orderBy("quality"))
    chosen = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: draw(t) < rate / some)
    drawn = labelled.withColumn("_copy", copy).filter(draw(F.lit(-1)) < some).withColumn("tree", F.explode(chosen))
    order = W.partitionBy("tree").orderBy(draw(F.col("tree")), "doc_id", *STATISTICS, "_copy")
    return drawn.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= subsample).drop("_place")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def fit_forest(counts: DataFrame, labels: DataFrame) -> tuple[Column, float]:
    """Score of a row of ``counts``, and its threshold, from all labelled rows."""
    labels = labels.filter("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    labelled = store(counts.join(labels, "doc_id"))
    # at most TREES * SUBSAMPLE rows
    drawn = tree_samples(labelled, labelled.count()).toPandas().sort_values(["tree", "doc_id", *STATISTICS])
    forest = IsolationForest([features(rows) for _, rows in drawn.groupby("tree")])
    shared = counts.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(features(pd.DataFrame(dict(zip(STATISTICS, columns, strict=True))))))

    good = labelled.filter((F.col("quality") == 1) & ~base_failed()).select(score(*STATISTICS).alias("score"))
    good = store(good.groupBy("score").agg(F.count(F.lit(1)).alias("n")).withColumn("all", F.lit(0)))
    total, distinct = good.agg(F.sum("n"), F.count("n")).first()
    if not total:
        return score(*STATISTICS), 1.0
    running = running_totals(good, ["all"], "score", {"upto": "n"}, distinct)
    at_least = F.lit(total) - F.col("upto") + F.col("n")
    threshold = running.filter(at_least > int(MOST_GOOD_LOST * total)).agg(F.max("score")).first()[0]
    return score(*STATISTICS), float(threshold)


def judge_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, ``STATISTICS``, base_failed, score and kept of every document."""
    counts = store(rule_statistics(docs))
    score, threshold = fit_forest(counts, labels)
    return (
        counts.withColumn("base_failed", base_failed())
        .withColumn("score", score)
        .withColumn("kept", ~F.col("base_failed") & (F.col("score") <= threshold))
    )


@query("op3_quality_rules")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    return judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
