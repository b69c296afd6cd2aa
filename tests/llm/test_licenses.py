import re

from snapsift.llm import licenses as li

LOWER = {i: i + 32 for i in range(65, 91)}


def brute(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    found = [(i, label) for phrase, label in li.BASE_PHRASES for i in range(len(w)) if w[i:i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in found]
    return len(w), len(found), min(at, default=None), max(at, default=None), sorted({x for _, x in found})


def test_base_like_brute_force_and_method_labels(spark, odd):
    made = [
        (100, "x y. Licensed under the Apache License, Version 2.0. z"), (101, "Released under the MIT License."), (102, "the general public, license"),
        (103, "cc by cc-by CC BY-NC 4.0 licensed under cc by nc 4 0"), (104, "This is of the and under license, version of a work"),
        (105, "all rights\nreserved " * 3), (106, "apache license"), (107, "Licensed strictly under the Apache License, Version 2.0"),
    ]
    docs = odd.select("doc_id", "text", "score").union(spark.createDataFrame([(*r, "s") for r in made], "doc_id long, text string, score string"))
    rows = li.scan_licenses(docs).collect()
    texts = sorted(((r.doc_id, r.text) for r in docs.collect()), key=repr)
    key = lambda r: (str(r[0]), *[str(x) for x in r[1:]])
    ours = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows]
    assert sorted(ours, key=key) == sorted([(d, *brute(t)) for d, t in texts], key=key)
    labels = {r.doc_id: r.labels for r in rows}
    assert labels[100] == ["apache-2.0"] and labels[101] == ["mit"] and labels[104] == [] and labels[106] == []
    assert labels[103] == ["cc-by", "cc-by-nc"] and labels[105] == ["reserved"] and labels[107] == ["apache-2.0"]
    assert all(0 <= r.score <= 1 and set(r.base_labels) <= set(r.labels) for r in rows)
    assert next(r for r in rows if r.doc_id == 100).matches[0].first_word == 2


def test_empty(empty):
    assert li.scan_licenses(empty).count() == 0


def test_every_notice_of_a_long_text(spark):
    by = {text.split()[0] + str(len(text)): (label, text) for label, text, _ in li.TEMPLATES}
    notices = [x for x in by.values() if len(x[1]) > 80 and x[0] in ("mit", "apache-2.0", "bsd", "mpl-2.0")]
    filler = " ".join(f"prose{i}" for i in range(300))
    text = f"{filler}\n".join(["", *(t for _, t in notices), "noncommercial sharealike attribution waived unencumbered redistribute neighboring lesser"])
    docs = spark.createDataFrame([(1, text), (2, filler)], "doc_id long, text string")
    found = {r.doc_id: r for r in li.scan_licenses(docs).collect()}
    assert len({x for x, _ in notices}) == 4 and set(found[1].labels) == {x for x, _ in notices} and found[2].labels == []
    assert len(found[1].matches) >= len(notices)
