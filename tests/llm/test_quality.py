import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from snapsift.llm import quality as q


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


TEXTS = [None, "", " ", "a", "a b", "a b c a b c", "x\nx\n\n \nx", "é# ü$ |", "a b c d", "a b", "c a b c", "same line\nsame line \nsame line"]


def test_statistics_like_brute_force(odd):
    texts = TEXTS + [r.text for r in odd.select("text").collect()]
    found = q.statistics(pa.array(texts))
    assert [tuple(int(c[i]) for c in found) for i in range(len(texts))] == [brute(t) for t in texts]


def test_anomalies_go_and_usual_rows_stay(spark):
    rng = np.random.default_rng(1)
    usual = [" ".join(f"w{x}" for x in rng.integers(0, 5000, int(rng.integers(60, 400)))) for _ in range(600)]
    odd_ones = [" ".join(f"w{x}" + "#" * (3 * k) for x in rng.integers(0, 5000, 55 + 3 * k)) for k in range(4, 12)]
    docs = spark.createDataFrame(list(enumerate(usual + odd_ones)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 600), 0) for i in range(0, 608, 2)], "doc_id long, quality int, toxic int")
    rows = q.judge_quality(docs, labels).toPandas()
    assert rows[rows.doc_id < 600].kept.mean() > 0.98 and rows[rows.doc_id >= 600].kept.mean() < 0.4


def test_odd_rows_and_empty_tables(odd, empty, spark):
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 0), (5, None, 0), (None, 1, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")
    rows = q.judge_quality(odd, labels).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)
    unlabelled = q.judge_quality(odd, labels.limit(0)).toPandas()
    assert (unlabelled.kept == ~unlabelled.base_failed).all()
    assert q.judge_quality(empty, labels).count() == 0


def test_the_threshold_and_the_trees_come_from_all_labelled_rows(spark):
    rows = [(i, 60 + i % 900, 300 + i % 700, i % 5, 0, 0) for i in range(30_000)]
    counts = spark.createDataFrame(rows, "doc_id long, " + ", ".join(f"{x} long" for x in q.STATISTICS))
    labels = counts.selectExpr("doc_id", "1 as quality")
    score, threshold = q.fit_forest(counts, labels)
    rejected = counts.filter(score > threshold).count()
    at_least = counts.filter(score >= threshold).count()
    assert rejected <= q.MOST_GOOD_LOST * 30_000 < at_least
    drawn = q.tree_samples(counts.withColumn("quality", F.lit(1)), 30_000)
    assert {r["n"] for r in drawn.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).collect()} == {q.SUBSAMPLE}
    # draws from 20,000 rows would hold about 14,400 different ones
    assert drawn.select("doc_id").distinct().count() > 16_000


def test_copies_of_a_row_are_drawn_apart(spark):
    rows = [(1, 70, 300, 0, 0, 0, 1)] * 5_000 + [(i, 60 + i, 300, 0, 0, 0, 1) for i in range(2, 5_002)]
    labelled = spark.createDataFrame(rows, "doc_id long, " + ", ".join(f"{x} long" for x in q.STATISTICS) + ", quality int")
    share = q.tree_samples(labelled, 10_000).groupBy("tree").agg(F.avg(F.expr("cast(doc_id = 1 as int)")).alias("s"))
    assert all(0.3 < r["s"] < 0.7 for r in share.collect())
