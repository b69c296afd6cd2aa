import random
import re

import numpy as np
import pytest

from snapsift.llm import shingle_join as j

LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text, size=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w)} if 0 < len(w) < size else {tuple(w[i:i + size]) for i in range(len(w) - size + 1)}


def brute(rows, size=4, percent=85):
    """component_id by position, of (doc_id, text)."""
    sets = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        return i if root[i] == i else find(root[i])

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return [(d, len(s), least.get(find(i), d)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


def corpus(seed, families, size, lengths):
    rng = random.Random(seed)
    rows = []
    for _ in range(families):
        base = [f"v{rng.randrange(300)}" for _ in range(rng.choice(lengths))]
        for _ in range(size):
            rows.append(edited(rng, base, rng.choice((0, 0, 1, 1, 2, 3, 5))))
    passage = [f"p{i}" for i in range(60)]  # many texts share it, and are not linked by it
    rows += [passage + [f"u{rng.randrange(10**6)}" for _ in range(90)] for _ in range(40)]
    rng.shuffle(rows)
    return [(i * 7 % len(rows) if len(rows) % 7 else i, " ".join(w)) for i, w in enumerate(rows)]


def components(spark, rows, *rule):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = j.jaccard_components(df, *rule).select("doc_id", "n_shingles", F.coalesce("first.doc_id", "doc_id").alias("c")).collect()
    return sorted((tuple(r) for r in found), key=repr)


@pytest.mark.parametrize("block", [j.BLOCK, 6])
def test_like_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(j, "BLOCK", block)
    if block == 6:
        monkeypatch.setattr(j, "BLOCK_SHINGLES", 400)
    rows = corpus(1, 12, 14, (4, 6, 9, 15, 40, 80, 200))
    assert components(spark, rows) == sorted(brute(rows), key=repr)


@pytest.mark.parametrize("rule", [(5, 80), (2, 60)])
def test_other_rules_like_brute_force(spark, rule):
    rows = corpus(2, 10, 12, (4, 6, 9, 15, 40, 80, 200))
    assert components(spark, rows, *rule) == sorted(brute(rows, *rule), key=repr)


def test_links_through_rows_without_id(spark):
    """Two texts are linked only by near copies that no row with an id holds."""
    words = [f"n{i}" for i in range(100)]
    steps = [" ".join([f"x{i}" for i in range(k)] + words[k:]) for k in (0, 4, 8, 12)]
    rows = [(1, steps[0]), (None, steps[1]), (None, steps[2]), (4, steps[3])]
    found = components(spark, rows)
    assert found == sorted(brute(rows), key=repr) and {c for _, _, c in found} == {1}
    kept = j.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.doc_id for r in kept] == [1]


def test_odd_rows(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert components(spark, rows) == sorted(brute(rows), key=repr)


def test_like_sql_alone(odd, in_duckdb, same_rows):
    from pyspark.sql import functions as F

    alone = odd.filter("doc_id is not null and coalesce(length(text), 0) < 9999").dropDuplicates(["doc_id"]).cache()
    ours = j.jaccard_components(alone).select("doc_id", "n_shingles", F.coalesce("first.doc_id", "doc_id").alias("component_id"))
    same_rows(ours.toPandas(), in_duckdb(j._SQL, documents=alone.toPandas()))


def test_keep_first(odd):
    kept = j.keep_first(odd)
    assert kept.columns == odd.columns
    got = sorted(str((r.doc_id, (r.text or "-")[:9])) for r in kept.collect())
    assert sum(x.startswith("(4,") for x in got) == 1 and not any(x.startswith("(7,") for x in got)
    assert sum(x.startswith("(5,") for x in got) == 1 and sum("'-'" in x for x in got) == 3


def test_empty(empty):
    assert j.jaccard_components(empty).count() == 0 and j.keep_first(empty).count() == 0


def test_trie_finds_what_sets_say(monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    sets = []
    for _ in range(60):
        keep = base[rng.random(60) < rng.choice([0.6, 0.95, 1.0])]
        sets.append(np.unique(np.concatenate([keep, rng.integers(0, 2**63, int(rng.integers(0, 6)), dtype=np.uint64)])))
    want = {(a, b) for a in range(60) for b in range(60) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 85 * len(np.union1d(sets[a], sets[b]))}
    for cells in (j.WALK_CELLS, 500):
        monkeypatch.setattr(j, "WALK_CELLS", cells)
        found = list(j.trie_links(sets, sets))
        assert set(found) == want and len(found) == len(want)


@pytest.mark.parametrize("percent", [85, 80])
def test_every_linked_pair_shares_a_bucket(percent):
    rng = np.random.default_rng(4)
    lost = 0
    for _ in range(2500):
        n = int(rng.integers(1, 130)) if rng.random() < 0.8 else int(rng.integers(130, 700))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        most = int(len(a) * (100 - percent) / (100 + percent) * 2)
        b = np.unique(np.concatenate([a[rng.permutation(len(a))[: max(1, len(a) - most // 2)]], rng.integers(0, 2**63, most // 2, dtype=np.uint64)]))
        # equal sets are one node
        if not np.array_equal(a, b) and 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b)):
            lost += not set(j.bucket_keys(a, percent)) & set(j.bucket_keys(b, percent))
    assert lost == 0
