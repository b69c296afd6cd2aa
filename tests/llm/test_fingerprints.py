import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from snapsift.llm import fingerprints as fp

LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return {hashlib.md5(" ".join(w[i:i + fp.SHINGLE]).encode()).hexdigest()[:fp.HASH_DIGITS] for i in range(max(len(w) - fp.SHINGLE + 1, 1 if w else 0))}


def kept(hashes):
    return [h for i, h in enumerate(sorted(hashes)) if h < fp.THRESHOLD or i < fp.LEAST]


def text(rng, n):
    return " ".join(f"word{rng.randrange(5000)}" for _ in range(n))


@pytest.mark.parametrize("range_bytes", [fp.RANGE_BYTES, 400])
def test_like_sql(spark, odd, in_duckdb, same_rows, range_bytes, monkeypatch):
    rng = random.Random(4)
    made = [(50 + 3 * i, text(rng, rng.choice([1, 4, 5, 6, 30, 400]))) for i in range(60)] + [(900, "é" * 51), (901, "same text " * 9), (902, "same text " * 9)]
    docs = odd.select("doc_id", "text").filter("doc_id is not null").dropDuplicates(["doc_id"])
    docs = docs.union(spark.createDataFrame(made, "doc_id long, text string")).repartition(6)
    monkeypatch.setattr(fp.next_document, "__defaults__", (range_bytes,))
    found = fp.fingerprint_documents(docs)
    ours = found.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.array_join("sketch", ",").alias("fingerprint"),
        F.array_join("edited_sketch", ",").alias("edited_fingerprint"), F.round("to_edited.likeness", 9).alias("near_edited"),
        F.round("to_next.likeness", 9).alias("near_next"),
    ).toPandas()
    same_rows(ours, in_duckdb(fp._SQL, documents=docs.toPandas()))
    by = ours.set_index("doc_id")
    assert by.loc[902, "near_next"] == 1 and by.loc[902, "fingerprint"] == by.loc[901, "fingerprint"]


def test_every_hash_below_the_fraction(spark):
    rng = random.Random(8)
    texts = [text(rng, n) for n in (3, 40, 900, 9000)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", fp.sketch(F.col("text")).alias("s")).collect()
    assert all(r.s == kept(shingles(r.text)) for r in rows)


def test_merges_and_contains(spark):
    rng = random.Random(9)
    book, other = text(rng, 40_000), text(rng, 3000)
    part = " ".join(book.split()[1000:4000])
    pairs = spark.createDataFrame([(book, part), (part, other), ("", ""), ("a b", ""), (book, book)], "a string, b string")
    sketched = pairs.select("a", "b", fp.sketch(F.col("a")).alias("x"), fp.sketch(F.col("b")).alias("y"))
    found = sketched.select("a", "b", fp.merged(F.col("x"), F.col("y")).alias("m"), fp.comparison(F.col("x"), F.col("y")).alias("c")).collect()
    assert all(r.m == kept(shingles(r.a) | shingles(r.b)) for r in found)
    (one, two, none, half, same) = [r.c for r in found]
    assert one.in_a == 1 and abs(one.in_b - 3000 / 40_000) < 0.02
    assert two.likeness == 0 and none.likeness == same.likeness == 1 and half.likeness == 0


@pytest.mark.parametrize("range_bytes", [1 << 20, 200])
def test_order_of_ties_and_nulls(spark, odd, range_bytes):
    docs = odd.select("doc_id", "text", "spans")
    found = fp.next_document(docs, ["doc_id", "text"], range_bytes).collect()
    assert len(found) == docs.count()
    rank = lambda d: (d is not None, d or 0)
    ids = sorted((r.doc_id for r in docs.collect()), key=rank, reverse=True)
    assert sorted(((r.doc_id, r.next_doc_id) for r in found), key=repr) == sorted(zip(ids, [*ids[1:], ids[0]], strict=True), key=repr)
    texts = lambda name: sorted(str(r[name])[:99] for r in found)
    assert texts("text") == texts("next_text")


def test_one_document_and_empty_table(spark, empty):
    one = spark.createDataFrame([(7, "one two three four")], "doc_id long, text string")
    row = fp.fingerprint_documents(one).first()
    assert row.edited == "one two tone two t" and row.to_next.likeness == 1
    assert fp.fingerprint_documents(empty).count() == 0
