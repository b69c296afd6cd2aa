import pytest
from pyspark.sql import functions as F

from snapsift.llm import decontamination as d

TEXTS = {
    "a": "one two three four five six seven eight nine ten eleven twelve", "b": "short item",
    "c": "Seven EIGHT nine, ten eleven twelve one two three four", "d": None, "e": "...", "a2": "one two three four five six seven eight nine ten",
}


@pytest.fixture
def benchmark(spark):
    return spark.createDataFrame([(k, v, "x") for k, v in TEXTS.items()], "item_id string, text string, hit string")


@pytest.fixture
def docs(spark, odd):
    made = [
        (20, TEXTS["a"] + " and " + TEXTS["c"]), (21, "a short item"), (22, "one two three four five six seven eight nine"), (23, TEXTS["a"].upper()),
        (24, "short"), (25, "item short"), (25, "item short item"), (26, " ".join([TEXTS["a"]] * 3)),
    ]
    return odd.select("doc_id", "text", "hit").union(spark.createDataFrame([(*r, None) for r in made], "doc_id long, text string, hit string"))


def report(docs, benchmark):
    found = d.contamination_report(docs, benchmark)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


# The SQL joins by doc_id and copies a text for each of its words: clashing and null ids and very
# long texts are checked apart.
@pytest.mark.parametrize("block", [d.BLOCK_BYTES, 60])
def test_like_sql(docs, benchmark, in_duckdb, same_rows, monkeypatch, block):
    monkeypatch.setattr(d, "BLOCK_BYTES", block)
    alone = docs.filter("doc_id is not null and coalesce(length(text), 0) < 9999").dropDuplicates(["doc_id"]).cache()
    same_rows(report(alone, benchmark).toPandas(), in_duckdb(d._SQL, documents=alone.toPandas(), benchmark=benchmark.toPandas()))


@pytest.mark.parametrize("block", [d.BLOCK_BYTES, 60])
def test_removes_affected_documents(docs, benchmark, monkeypatch, block):
    monkeypatch.setattr(d, "BLOCK_BYTES", block)
    left = d.decontaminate(docs, benchmark)
    assert left.columns == docs.columns
    ids = sorted(str(r.doc_id) for r in left.collect())
    gone = {"20", "21", "23", "26"}  # and one of the two rows 25
    assert len(ids) == docs.count() - 5 and not gone & set(ids)


def test_longest_match(spark, benchmark):
    docs = spark.createDataFrame([(1, "x " + TEXTS["a"] + " y"), (2, TEXTS["a2"] + " zzz"), (3, "none")], "doc_id long, text string")
    assert {r.doc_id: r.longest for r in d.contamination_report(docs, benchmark).collect()} == {1: 12, 2: 10, 3: 0}


def test_empty_tables(docs, benchmark, empty):
    assert report(empty, benchmark).count() == 0
    assert report(docs, benchmark.limit(0)).filter("contaminated").count() == 0
    assert d.decontaminate(docs, benchmark.limit(0)).count() == docs.count()
