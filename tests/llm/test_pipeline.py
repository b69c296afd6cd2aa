from pyspark.sql import functions as F

import corpus_pipeline as c
from snapsift.llm.decontamination import decontaminate
from snapsift.llm.language import keep_identified


def test_each_stage_on_its_predecessors_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in c.STAGES:
        out = stage(spark, docs, sf).cache()
        seen[name] = (docs.toPandas(), out.toPandas())
        if name != c.STAGES[-1][0]:
            assert out.columns == columns
            docs = spark.createDataFrame(seen[name][1], docs.schema)
    before, after = seen["language ID"]
    assert len(after) >= 0.98 * len(before)
    before, after = seen["n-gram Jaccard join"]
    assert len(after) == sum(1 for _ in _firsts(before))
    before, after = seen["benchmark decontamination"]
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").toPandas()
    assert set(after.doc_id) == {d for d, t in zip(before.doc_id, before.text, strict=True) if not _contaminated(t, bench.text)}
    before, after = seen["PII"]
    assert len(after) == len(before) and not after.text.str.contains(r"@mail\d+\.example").any()
    before, after = seen["mixing sources"]
    assert sorted(after.doc_id) == sorted(before.doc_id) and (after.taken <= 3 * after["size"]).all()


def _firsts(docs):
    from llm.test_shingle_join import brute

    for doc_id, _, component in brute(list(zip(docs.doc_id, docs.text, strict=True)), c.NEAR_WORDS, c.NEAR_PERCENT):
        if doc_id == component:
            yield doc_id


def _contaminated(text, items):
    import re

    low = {i: i + 32 for i in range(65, 91)}
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))
    words = cut(text)
    for item in items:
        w = cut(item)
        n = min(10, len(w))
        windows = {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if n else set()
        if any(tuple(words[i:i + n]) in windows for i in range(len(words) - n + 1)):
            return True
    return False


def test_run(spark, sf):
    assert c.run(spark, sf).count() > 0


def test_odd_rows(spark, odd, tmp_path):
    for name, frame in {"benchmark": spark.createDataFrame([("i", "nothing of it")], "item_id string, text string"), "labels": spark.createDataFrame([(5, 1, 0)], "doc_id long, quality int, toxic int")}.items():
        frame.write.parquet(f"{tmp_path}/{name}.parquet")
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for k, (_, stage) in enumerate(c.STAGES):
        for part in (docs, docs.limit(0)):
            stage(spark, part, str(tmp_path)).write.parquet(f"{tmp_path}/{k}-{part is docs}")
        docs = spark.read.parquet(f"{tmp_path}/{k}-True")
    assert docs.count() > 0


def test_rows_carry_their_texts_once(spark, odd, capsys):
    """Texts beside whole rows were a second copy in every Arrow batch of a task."""
    items = spark.createDataFrame([("a", "licensed under the apache license")], "item_id string, text string")
    for found in (keep_identified(odd.limit(8)), decontaminate(odd.limit(8), items)):
        found.explain(True)
        assert "_text" not in capsys.readouterr().out
    upper = odd.select("doc_id", F.col("text").alias("TEXT"), "lang")
    assert decontaminate(upper, items).count() == odd.count() - 1
