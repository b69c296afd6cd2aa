import pytest
from pyspark.sql import functions as F

from snapsift.llm import reversed_search as s

ITEMS = [
    (1, "one two three"), (2, "THE the the rare"), (3, None), (4, "..."), (5, "nowhere"), (6, "éè été 42"), (6, "one two three"), (None, "k1 k2 k3"),
    (8, " ".join(f"k{i}" for i in range(300))),
]


@pytest.fixture
def items(spark):
    return spark.createDataFrame([(*r, 1) for r in ITEMS], "item_id long, text string, score int")


@pytest.fixture
def docs(spark, odd):
    made = [
        (100 + i, " ".join(["the"] * (i % 7 + 1) + ["one", "TWO"] * (i % 3) + [f"k{j}" for j in range(i)] + ["rare"] * (i == 11))) for i in range(40)
    ] + [(300 + i, "one two three the same text") for i in range(15)] + [(None, "one two three")]
    return odd.select("doc_id", "text", "score").union(spark.createDataFrame([(*r, "s") for r in made], "doc_id long, text string, score string"))


@pytest.mark.parametrize("block", [s.BLOCK_BYTES, 700])
@pytest.mark.parametrize("cells", [s.CELLS, 20])
def test_like_sql(docs, items, in_duckdb, same_rows, monkeypatch, block, cells):
    monkeypatch.setattr(s, "BLOCK_BYTES", block)
    monkeypatch.setattr(s, "CELLS", cells)
    found = s.search_documents(docs.repartition(5), items)
    theirs = in_duckdb(
        s._SQL, documents=docs.select("doc_id", "text").toPandas().astype({"doc_id": "Int64"}), benchmark=items.toPandas().astype({"item_id": "Int64"})
    )
    same_rows(found.toPandas(), theirs)
    by = {(r.item_id, r["rank"]): r.doc_id for r in found.filter("item_id in (1, 2)").collect()}
    assert by[2, 1] == 111 and {k for k in by if k[0] == 1} == {(1, i) for i in range(1, 11)}


def test_ties_go_by_doc_id(spark):
    docs = spark.createDataFrame([(i, "same words here") for i in range(50, 0, -1)] + [(None, "same words here")], "doc_id long, text string").repartition(7)
    items = spark.createDataFrame([("x", "words")], "item_id string, text string")
    found = sorted((r["rank"], r.doc_id) for r in s.search_documents(docs, items).collect())
    assert found == [(i, i) for i in range(1, 11)]
    few = docs.filter("doc_id is null or doc_id < 3")
    assert sorted((r["rank"], r.doc_id) for r in s.search_documents(few, items, top=5).collect()) == [(1, 1), (2, 2), (3, None)]


def test_empty_tables(docs, items, empty):
    assert s.search_documents(empty, items).count() == 0
    assert s.search_documents(docs, items.limit(0)).count() == 0
    assert s.search_documents(docs.withColumn("text", F.lit(None).cast("string")), items).count() == 0
