import random

from snapsift.llm import language as la
from snapsift.llm.registry import QUERIES


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op4_language_id"](spark, sf).join(docs, "doc_id").toPandas()
    held = rows[rows.held_out]
    assert len(held) > 20 and (held.lang == held.lang_pred).mean() > 0.95
    assert rows.score.between(0, 1).all()


def test_labels_of_held_out_rows_are_not_learned(spark):
    rng = random.Random(2)
    say = {"aa": "kalo mena tiru pola", "bb": "zwix gorth brenk schlod"}
    rows = [(i, " ".join(rng.choices(say["aa" if i % 2 else "bb"].split(), k=8)), "aa" if i % 2 else "bb", "s") for i in range(200)]
    from zlib import crc32

    wrong = [(i, t, lang if crc32(str(i).encode()) % 4 != 2 else "trap", s) for i, t, lang, s in rows]
    docs = spark.createDataFrame(wrong, "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r.lang_pred for r in la.identify_languages(docs, la.fit_languages(docs)).collect()}
    assert got == {i: lang for i, _, lang, _ in rows}


def test_odd_rows_and_empty_tables(odd, empty):
    model = la.fit_languages(odd)
    rows = la.identify_languages(odd, model).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows}
    assert by[1].lang_pred == by[2].lang_pred == by[3].lang_pred == by[9].lang_pred == "und" and by[9].score == 0
    assert by[6].lang_pred in model.langs and by[11].lang_pred in model.langs
    kept = la.keep_identified(odd)
    assert kept.columns == odd.columns and kept.filter("text is null").count() == 0
    assert la.keep_identified(empty).count() == 0
    nothing = la.fit_languages(empty)
    assert {r.lang_pred for r in la.identify_languages(odd, nothing).collect()} == {"und"}
