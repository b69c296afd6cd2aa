import re

import pytest

from snapsift.llm import privacy as p

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TRICKY = [
    "a@b.c_d@e.f", "x..y@@a.b a@b..c@d.e.f.", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0255 1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1111 5",
    "12 4111111111111111", "+1 (415) 555-0100+44 20 7946 0958", "+1" + "(" * 50, "9" * 30, "é@b.c \U0001F600 a@b.co", "a" * 3000 + "@x.y", "1 " * 3000,
    "a@" + "b." * 3000 + "c", "", None, "+123456789 +1234567 +1 2", "4111111111111111-4111111111111111", "4111  1111111111111111", "-4111111111111111- x",
    "1.1.1.1@a.b.c", "0" * 13, "0.0.0.0 0.0.0.00000000000000000000256", "x+4915112345678 4111 1111 1111 1111",
]


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0


def plain(text):
    out = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), rank, kind, m.end()))
    return sorted(out)


@pytest.fixture
def tricky(spark, odd):
    made = [(i + 100, t, "s") for i, t in enumerate(TRICKY)]
    return odd.select("doc_id", "text", "spans").union(spark.createDataFrame(made, "doc_id long, text string, spans string"))


def test_base_like_the_plain_patterns(tricky):
    rows = p.annotate(tricky).collect()
    assert len(rows) == tricky.count()
    for r in rows:
        assert [tuple(s) for s in r.spans if s.kind != p.TERM] == plain(r._row.text)


def test_replaced_text(tricky):
    clean = p.sanitise(tricky)
    assert clean.columns == tricky.columns
    by = {r.doc_id: r.text for r in clean.filter("doc_id is not null").collect()}
    assert by[100] == "[EMAIL][EMAIL]" and by[103] == "[CARD]" and by[114] is None and by[113] == ""
    assert by[8] == "Mail [EMAIL] or [PHONE], card [CARD] at 10.0.0.256 [IP]"
    given = {r.doc_id: r.text for r in tricky.filter("doc_id is not null").collect()}
    assert all(by[d] == given[d] for d in given if not plain(given[d]))


def test_disclosing_terms(spark):
    # "zorro" stands beside one address only; "the" everywhere; "rare" beside it once.
    near = [(i, f"the lines{i} zorro x@y.de and more{i}") for i in range(6)] + [(6, "the rare x@y.de")]
    far = [(i, f"the other text{i} zor") for i in range(10, 200)]
    docs = spark.createDataFrame(near + far, "doc_id long, text string")
    spans = {r._row.doc_id: [(r._row.text[s.start:s.end]) for s in r.spans if s.kind == p.TERM] for r in p.annotate(docs).collect()}
    assert all(spans[i] == ["zorro", "and"] for i in range(6))  # "and" occurs nowhere else either
    assert not any(spans[i] for i in spans if i > 5)
    assert p.sanitise(docs).filter("doc_id = 0").first().text == "the lines0 [TERM] [EMAIL] [TERM] more0"


def test_empty(empty):
    assert p.annotate(empty).count() == 0 and p.sanitise(empty).count() == 0


def test_terms_far_from_the_entity_and_in_other_documents(spark):
    # "zorro" stands a paragraph away from the address, and once in a document without it.
    gap = " the" * 400
    rows = [(i, f"Zorro{gap} mail x@y.de{gap} ZORRO") for i in range(5)] + [(5, "the zorro, alone"), (5, "the zorro, alone")]
    rows += [(i, f"the mail of other{i} text zorros") for i in range(10, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = p.annotate(docs).collect()
    terms = {r._row.doc_id: [r._row.text[s.start:s.end] for s in r.spans if s.kind == p.TERM] for r in found}
    assert len(found) == len(rows) and all(terms[i] == ["Zorro", "ZORRO"] for i in range(5)) and terms[5] == ["zorro"]
    assert not any(terms[i] for i in range(10, 400))
    clean = p.sanitise(docs).filter("doc_id <= 5").collect()
    assert len(clean) == 7 and not any("zorro" in r.text.lower() for r in clean)


def test_pairs_like_all_pairs(spark):
    import math
    import random

    rng, rows = random.Random(2), []
    for i in range(300):
        words = [f"w{min(rng.randrange(1, 200), rng.randrange(1, 200))}" for _ in range(25)]
        words += [f"é{k}.u{k}@h.org+n{k}" for k in range(8) if rng.random() < 0.5 / (k + 1)]
        words += [f"n{k}" for k in range(8) if i % 40 == k]
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = []
    for _, text in rows:
        spans = [s for s in plain(text) if s[2] == "email"]
        free = {m[0].lower() for m in re.finditer(r"[^\W_]+", text) if not any(s[0] < m.end() and s[3] > m.start() for s in spans)}
        held.append(({"email:" + text[s[0]:s[3]].lower() for s in spans}, free))
    want = set()
    for e in set().union(*(x for x, _ in held)):
        n_entity = sum(e in x for x, _ in held)
        for t in set().union(*(f for _, f in held)):
            n_term, n_both = sum(t in f for _, f in held), sum(e in x and t in f for x, f in held)
            if n_both >= p.LEAST_TOGETHER and math.log(n_both / n_term) >= (1 - p.ALPHA) * math.log(n_entity / len(rows)):
                want.add((e, t))
    assert want and {tuple(r) for r in p.disclosing_terms(docs, p.protected(docs)).collect()} == want


def test_rows_dealt_by_their_terms(spark, monkeypatch):
    rows = [(i, f"a{i % 3} b{i % 4} c x{i % 5}@y.de z{i % 2}@y.de " + " ".join(f"w{i % 5}v{k}" for k in range(9))) for i in range(40)]
    docs = spark.createDataFrame(rows + [(i, f"text c {i}") for i in range(40, 90)], "doc_id long, text string")
    found = p.protected(docs)
    whole = {tuple(r) for r in p.disclosing_terms(docs, found).collect()}
    monkeypatch.setattr(p, "ROW_PAIRS", 5)
    assert whole and {tuple(r) for r in p.disclosing_terms(docs, found).collect()} == whole


def test_term_places_like_free_words(spark):
    # Sigma at a word's end is written otherwise alone; dotted I grows in lower case.
    text = "\u0391\u03a3.\u0391 \u0391\u03a3 \u0130x zorro's zorros a@zorro.de Zorro " + "fill " * 200 + "ZORRO"
    docs = spark.createDataFrame([(1, text, ["zorro", "\u03b1\u03c2", "i\u0307x"])], "doc_id long, text string, terms array<string>")
    row = docs.withColumn("s", p.base_spans(p.F.col("text"))).select(
        p.term_places(p.F.col("text"), p.F.col("s"), p.F.col("terms")).alias("got"), p.free_words(p.F.col("text"), p.F.col("s")).alias("free"), "terms").first()
    want = [tuple(w) for w in row.free if w.term in row.terms]
    assert len(want) >= 5 and [tuple(w) for w in row.got] == want
