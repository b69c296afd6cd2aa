import pandas as pd

from snapsift.llm import mixing as m


def test_like_sql(odd, spark, in_duckdb, same_rows):
    labels = spark.createDataFrame([(5, 1, 0), (5, 0, 0), (6, 0, 1), (99, 1, 0), (None, 1, 1), (7, None, 0)], "doc_id long, quality int, toxic int")
    mixed = m.mix_sources(odd, m.quality_weights(labels)).select("doc_id", "size", "source_size", "target", "taken").toPandas()
    same_rows(mixed, in_duckdb(m._SQL, documents=odd.toPandas(), labels=labels.toPandas()))


def test_targets_and_budgets(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "if(id % 10 < 7, 'a', if(id % 10 < 9, 'b', null)) as source", "repeat('w ', cast(1 + id % 7 as int)) as text")
    mixed = m.mix_sources(docs).toPandas()
    total = mixed["size"].sum()
    by = mixed.groupby(mixed.source.fillna("none")).agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    assert abs(by.target.sum() - total) < 1e-3 and (by.target <= 3 * by["size"] + 1e-6).all()
    assert (by.taken - by.target).abs().max() <= 7
    assert (mixed.taken <= 3 * mixed["size"]).all()
    again = m.mix_sources(docs.repartition(5)).toPandas()
    pd.testing.assert_frame_equal(mixed.sort_values("doc_id", ignore_index=True), again.sort_values("doc_id", ignore_index=True))


def test_weights_lead_the_choice(spark):
    docs = spark.range(2000).selectExpr("id as doc_id", "if(id < 1500, 'a', 'b') as source", "'x y z' as text")
    good = spark.range(0, 2000, 2).selectExpr("id as doc_id", "50.0D as weight")
    part = m.mix_sources(docs, good).filter("source = 'a' and taken = 3").toPandas()
    assert (part.doc_id % 2 == 0).mean() > 0.8


def test_empty(empty):
    assert m.mix_sources(empty).count() == 0
