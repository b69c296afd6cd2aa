import random
import zlib
from collections import Counter

import numpy as np
import pytest
import regex

from snapsift.llm import spelling as sp

LOWER = {i: i + 32 for i in range(65, 91)}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in regex.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[:h % len(run)] + run[h % len(run) + 1:] if h % sp.DAMAGED == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= sp.LEAST_LENGTH and n >= sp.LEAST_COUNT}


def brute(counts):
    close = {w: [v for v in counts if near(w, v)] for w in counts}
    form = {}
    for w, vs in close.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= sp.FORM_RATIO * counts[w] else None
    root = {}
    for w in counts:
        root[w] = w
        while form[root[w]] is not None:
            root[w] = form[root[w]]
    return {(w, n, len(close[w]), form[w], counts.get(form[w]), root[w]) for w, n in counts.items()}


def vocabulary(rng, n, letters="abé"):
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(5, 9))) for _ in range(n)]
    return sorted({*base, *("z" * k for k in (5, 6, 7)), "abcdefghij" * 20, "abcdefghij" * 20 + "k"})


@pytest.mark.parametrize("seed", range(3))
def test_index_like_brute_force(seed):
    rng = random.Random(seed)
    words = vocabulary(rng, 150, "abé" if seed else "ab")
    asked = sorted({*words[::2], *vocabulary(rng, 40, "abc"), "yyyyy"})
    index = sp.Vocabulary(words)
    found = set()
    for direction in ("left", "right"):
        query, target = index.near(asked, direction)
        one = list(zip(query.tolist(), target.tolist(), strict=True))
        assert len(one) == len(set(one))  # every target once
        found |= {(asked[q], words[t]) for q, t in one}
    assert found == {(a, b) for a in asked for b in words if near(a, b)}


def test_ranges_are_suffix_ranks():
    words = vocabulary(random.Random(7), 60)
    index = sp.Vocabulary(words)
    text = "$" + "$".join(words) + "$"
    suffixes = sorted(text[i:].replace("$", "\0") for i in range(len(text)))
    backwards = sorted(text[::-1][i:].replace("$", "\0") for i in range(len(text)))
    state = tuple(np.array([x]) for x in (0, 0, 0, 0, len(text) + 1))
    pattern = ""
    for step, letter in enumerate("aba"):  # once to the left, then to the right and back
        direction = ("left", "right", "left")[step]
        symbol = np.array([np.searchsorted(index.letters, ord(letter)) + 2])
        query, done, own, other, size = state
        if direction == "right":
            own, other = other, own
        query, done, own, other, size = index._extend(index.ranks[direction], (query, done, own, other, size), symbol, 1)
        if direction == "right":
            own, other = other, own
        state = (query, done, own, other, size)
        pattern = letter + pattern if direction == "left" else pattern + letter
        held = [i for i, s in enumerate(suffixes) if s.startswith(pattern)]
        mirrored = [i for i, s in enumerate(backwards) if s.startswith(pattern[::-1])]
        assert (own[0], size[0]) == (held[0] + 1, len(held)) and (other[0], size[0]) == (mirrored[0] + 1, len(mirrored))


@pytest.mark.parametrize("shard", [sp.SHARD_WORDS, 40, 7])
def test_variants_like_brute_force(spark, odd, in_duckdb, same_rows, shard):
    rng = random.Random(11)
    words = vocabulary(rng, 120)
    made = [(1000 + i, " ".join(rng.choice(words[:1 + i * 5]) + rng.choice(["", "", ",", "1"]) for _ in range(150)).capitalize()) for i in range(40)]
    docs = odd.select("doc_id", "text", "spans").union(spark.createDataFrame([(*r, "s") for r in made], "doc_id long, text string, spans string"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = sp.group_variants(docs.repartition(5), shard)
    ours = {tuple(r[c] for c in ("word", "n", "n_near", "form", "form_n", "root")) for r in found.collect()}
    assert ours == brute(brute_words(rows)) and found.count() == len(ours)
    if shard == 40:
        same_rows(found.toPandas(), in_duckdb(sp._SQL, documents=docs.select("doc_id", "text").toPandas().astype({"doc_id": "Int64"})))


def test_empty(spark, empty):
    assert sp.group_variants(empty).count() == 0
    few = spark.createDataFrame([(1, "twice twice tiny tiny tiny")], "doc_id long, text string")
    assert sp.group_variants(few).count() == 0
