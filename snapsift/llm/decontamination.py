"""Operator 1: benchmark decontamination with suffix arrays over the training text.

Each task builds suffix arrays over shards of its documents and looks every suffix of every
benchmark item up in them by binary search. The search yields the longest verbatim match of each
suffix and its locations, and all places of every window of ``WINDOW`` words. Documents with such a
place are contaminated and can be removed.

A shard's array holds only runs of words that all occur in the benchmark and are long enough for
its shortest window; no other place can match, so nothing is lost. Words are compared by 64-bit
hashes. Benchmarks are broadcast in blocks of ``BLOCK_BYTES`` of text; every block is a pass over
the documents, and their findings are merged per document.

Defined results: null or wordless texts and items have no words and match nothing; an item of
fewer than ``WINDOW`` words is one window; repeated items each count, by item_id; repeated
documents are reported once per row; empty tables give no findings. Columns with other names pass
through ``decontaminate`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query, table
from .words import ALNUM, lean, pieces, slices, text_apart, texts_of

#: Words of a window.
WINDOW = 10
#: Benchmark text broadcast at once.
BLOCK_BYTES = 32 << 20
#: Words of runs in a shard's suffix array, about.
SHARD_WORDS = 1 << 20
#: Bytes of documents in a shard, about.
SHARD_BYTES = 16 << 20

FINDINGS = "n_words long, hit array<int>, items array<string>, longest int"


@dataclass
class Suffixes:
    """The benchmark's words as ranks of its vocabulary, and one row per suffix."""

    vocabulary: np.ndarray  #: sorted hashes of the words
    codes: np.ndarray  #: 1 + rank of each word; items end with 0
    suffixes: np.ndarray  #: first word of every suffix that begins a window
    windows: np.ndarray  #: the distinct window of each suffix
    starts: np.ndarray  #: for each distinct window, the first word of a suffix that begins with it
    depth: np.ndarray  #: words of each distinct window
    owners: list[np.ndarray]  #: for each distinct window, the items that have it
    items: list[str]
    longest: int  #: words of the longest item

    @property
    def shortest(self) -> int:
        return int(self.depth.min()) if len(self.depth) else 1


def read_benchmark(item_ids: list, texts: list) -> Suffixes:
    """Words, windows and suffixes of benchmark items."""
    hashes, lengths = [np.zeros(0, np.uint64)], []
    for piece in pieces(pa.array(texts, pa.string()), ALNUM):
        hashes.append(piece.hashes(lower=True))
        lengths.extend(piece.counts.tolist())
    words = np.concatenate(hashes)
    lengths = np.array(lengths, np.int64)
    vocabulary, rank = np.unique(words, return_inverse=True)
    codes = np.zeros(len(words) + len(lengths), np.int64)
    begins = np.cumsum(lengths + 1) - lengths - 1
    place = np.arange(len(words)) + np.repeat(np.arange(len(lengths)), lengths)
    codes[place] = rank + 1
    keyed: dict[bytes, list] = {}
    suffixes, windows = [], []
    for item, (begin, n) in enumerate(zip(begins.tolist(), lengths.tolist(), strict=True)):
        for at in range(begin, begin + (max(1, n - WINDOW + 1) if n else 0)):
            size = min(WINDOW, n)
            known = keyed.setdefault(codes[at:at + size].tobytes(), [len(keyed), at, size, []])
            known[3].append(item)
            suffixes.append(at)
            windows.append(known[0])
    found = list(keyed.values())
    integers = lambda values: np.array(values, np.int64)
    return Suffixes(
        vocabulary, codes, integers(suffixes), integers(windows), integers([x[1] for x in found]), integers([x[2] for x in found]),
        [np.unique(x[3]) for x in found], ["" if i is None else str(i) for i in item_ids], int(lengths.max(initial=1)),
    )


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``codes`` in the order of their suffixes, told apart up to ``depth`` words at least."""
    order = np.argsort(codes, kind="stable")
    rank = np.empty(len(codes), np.int64)
    step = 1
    in_order = codes[order]
    rank[order] = np.cumsum(np.r_[0, in_order[1:] != in_order[:-1]])
    while step < depth and len(codes) and rank.max() < len(codes) - 1:
        then = np.zeros(len(codes), np.int64)
        then[:-step or None] = rank[step:] + 1 if step < len(codes) else 0
        key = rank * (len(codes) + 1) + then
        order = np.argsort(key, kind="stable")
        in_order = key[order]
        rank[order] = np.cumsum(np.r_[0, in_order[1:] != in_order[:-1]])
        step *= 2
    return order


def _shared(train: np.ndarray, at: np.ndarray, test: np.ndarray, begin: np.ndarray, known: np.ndarray, most: np.ndarray):
    """Words that each pair of suffixes shares, of which ``known`` are given, up to ``most``; then whether train is below."""
    n = known.copy()
    live = np.flatnonzero(n < most)
    while len(live):
        here = train[at[live] + n[live]]
        same = (here == test[begin[live] + n[live]]) & (here > 0)
        live = live[same]
        n[live] += 1
        live = live[n[live] < most[live]]
    below = np.zeros(len(n), bool)
    short = np.flatnonzero(n < most)
    below[short] = train[at[short] + n[short]] < test[begin[short] + n[short]]
    return n, below


def search(train: np.ndarray, order: np.ndarray, test: np.ndarray, begin: np.ndarray, most: np.ndarray, past: bool = False):
    """Binary search of test suffixes, cut to ``most`` words, in a suffix array.

    Returns the place of each (after its equals with ``past``) and the words it shares with its
    two neighbours there. ``train`` and ``test`` end with 0.
    """
    low, high = np.zeros(len(begin), np.int64), np.full(len(begin), len(order), np.int64)
    at_low, at_high = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
    live = np.flatnonzero(low < high)
    while len(live):
        middle = (low[live] + high[live]) // 2
        n, below = _shared(train, order[middle], test, begin[live], np.minimum(at_low[live], at_high[live]), most[live])
        if past:
            below |= n >= most[live]
        up, down = live[below], live[~below]
        low[up], at_low[up] = middle[below] + 1, n[below]
        high[down], at_high[down] = middle[~below], n[~below]
        live = live[low[live] < high[live]]
    return low, at_low, at_high


class Shard:
    """Runs of benchmark words in consecutive documents, and what is found in them."""

    def __init__(self, benchmark: Suffixes):
        self.benchmark = benchmark
        self.codes: list[np.ndarray] = []
        self.docs: list[np.ndarray] = []
        self.places: list[np.ndarray] = []
        self.rows: list[tuple] = []
        self.size = 0

    def add(self, piece, ids: list) -> None:
        base = len(self.rows)
        self.rows += list(zip(ids, piece.counts.tolist(), strict=True))
        vocabulary, shortest = self.benchmark.vocabulary, self.benchmark.shortest
        if not len(vocabulary) or not len(piece.start):
            return
        hashes = piece.hashes(lower=True)
        rank = np.searchsorted(vocabulary, hashes)
        known = vocabulary[np.minimum(rank, len(vocabulary) - 1)] == hashes
        # A run ends at an unknown word and at the end of a text.
        begins = np.zeros(len(hashes) + 1, bool)
        begins[piece.bounds] = True
        start = np.flatnonzero(known & (begins[:-1] | np.r_[True, ~known[:-1]]))
        end = np.flatnonzero(known & (begins[1:] | np.r_[~known[1:], True])) + 1
        long = end - start >= shortest
        start, end = start[long], end[long]
        n = end - start
        if not len(n):
            return
        inner = np.repeat(start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        codes = np.zeros(n.sum() + len(n), np.int64)
        spot = np.arange(n.sum()) + np.repeat(np.arange(len(n)), n)
        codes[spot] = rank[inner] + 1
        doc, place = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
        of = np.searchsorted(piece.bounds, inner, "right") - 1
        doc[spot], place[spot] = of + base, inner - piece.bounds[of]
        self.codes.append(codes)
        self.docs.append(doc)
        self.places.append(place)
        self.size += len(codes)

    def findings(self) -> Iterator[tuple]:
        """(doc_id, n_words, hit word positions, item ids, longest match in words) of each document."""
        found = self._find() if self.size else {}
        for i, (doc_id, n_words) in enumerate(self.rows):
            hit, items, longest = found.get(i, ([], [], 0))
            yield doc_id, n_words, hit, items, longest

    def _find(self) -> dict:
        bench = self.benchmark
        codes = np.concatenate([*self.codes, np.zeros(1, np.int64)])
        docs, places = np.concatenate([*self.docs, [0]]), np.concatenate([*self.places, [0]])
        order = suffix_array(codes, bench.longest)
        whole = np.full(len(bench.suffixes), bench.longest + 1)
        _, with_low, with_high = search(codes, order, bench.codes, bench.suffixes, whole)
        shared = np.maximum(with_low, with_high)
        # Per distinct window, its suffix with the longest verbatim match.
        by_length = np.lexsort((-shared, bench.windows))
        leads = by_length[np.flatnonzero(np.diff(bench.windows[by_length], prepend=-1))]
        longest = shared[leads]
        chosen = np.flatnonzero(longest >= bench.depth)
        begin = bench.starts[chosen]
        low, _, _ = search(codes, order, bench.codes, begin, bench.depth[chosen])
        high, _, _ = search(codes, order, bench.codes, begin, bench.depth[chosen], past=True)
        begin = bench.suffixes[leads[chosen]]
        best_low, _, _ = search(codes, order, bench.codes, begin, longest[chosen])
        best_high, _, _ = search(codes, order, bench.codes, begin, longest[chosen], past=True)
        hits, items, best = {}, {}, {}
        for k, q in enumerate(chosen.tolist()):
            at = order[low[k]:high[k]]
            doc, place = docs[at], places[at]
            for d, p in zip(doc.tolist(), place.tolist(), strict=True):
                hits.setdefault(d, set()).update(range(p, p + int(bench.depth[q])))
            for d in np.unique(doc).tolist():
                items.setdefault(d, set()).update(bench.owners[q].tolist())
                best[d] = max(best.get(d, 0), int(bench.depth[q]))
            for d in np.unique(docs[order[best_low[k]:best_high[k]]]).tolist():
                best[d] = max(best.get(d, 0), int(longest[q]))
        return {
            d: (sorted(hits[d]), sorted({bench.items[i] for i in items[d]}), best[d]) for d in hits
        }


def find_matches(docs: DataFrame, benchmark: DataFrame, carry: list[str] | None = None) -> list[DataFrame]:
    """For each block of the benchmark, the findings of every document.

    ``carry`` columns are kept beside ``FINDINGS``; without a column ``text`` beside them, the last one
    holds whole rows with a field of that name. More than one block only for a benchmark of
    over ``BLOCK_BYTES`` of text, which is read in that many parts.
    """
    spark = docs.sparkSession
    carry = ["doc_id"] if carry is None else carry
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES) or 1
    kept = docs.select(*carry, *([F.col("text").alias("_text")] if text_apart(docs.columns) else []))
    fields = [kept.schema[c] for c in carry]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [FINDINGS])
    out = []
    for block in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        rows = part.orderBy("item_id", "text").collect()  # at most about BLOCK_BYTES, by the sum above
        shared = spark.sparkContext.broadcast(read_benchmark([r[0] for r in rows], [r[1] for r in rows]))
        out.append(kept.mapInArrow(lean(_finder(shared, len(carry))), schema))
    return out


def _finder(shared, n_carried: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(shard: Shard, kept: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = [x[1:] for x in shard.findings()]
            at = 0
            for batch in kept:
                own = found[at:at + len(batch)]
                at += len(batch)
                columns = list(zip(*own, strict=True)) or [[], [], [], []]
                kinds = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.int32())
                names = [*batch.schema.names, "n_words", "hit", "items", "longest"]
                yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]], names)

        shard, kept, held = Shard(shared.value), [], 0
        for batch in slices(batches, -1):
            for piece in pieces(texts_of(batch, batch.num_columns - 1), ALNUM):
                shard.add(piece, [None] * piece.n_texts)
            kept.append(batch.select(range(n_carried)))
            held += batch.nbytes
            if shard.size >= SHARD_WORDS or held >= SHARD_BYTES:
                yield from flush(shard, kept)
                shard, kept, held = Shard(shared.value), [], 0
        yield from flush(shard, kept)

    return find


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no benchmark window occurs."""
    rows = docs.select(F.struct("*").alias("_row"))
    passes = find_matches(rows, benchmark, ["_row"])
    clean = passes[0].filter(F.size("hit") == 0).select("_row.*")
    for block in range(1, len(passes)):
        rows = clean.select(F.struct("*").alias("_row"))
        clean = find_matches(rows, benchmark, ["_row"])[block].filter(F.size("hit") == 0).select("_row.*")
    return clean


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items, longest of each document."""
    passes = find_matches(docs, benchmark)
    if len(passes) == 1:
        found = passes[0]
    else:
        keyed = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("_row"))
        passes = find_matches(keyed, benchmark, ["doc_id", "_row"])
        found = passes[0]
        for more in passes[1:]:
            found = found.unionByName(more)
        found = found.groupBy("_row", "doc_id").agg(
            F.max("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("hit"))).alias("hit"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("longest").alias("longest"),
        )
    return found.select(
        "doc_id", "n_words", F.size("hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        "items", "longest",
    )


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SQL = rf"""
WITH items AS (SELECT item_id, {_WORDS} AS words FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, len(list_slice(words, i, i + {WINDOW - 1})) AS n, list_slice(words, i, i + {WINDOW - 1}) AS window_words
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - {WINDOW - 1}, 1) + 1)) AS i FROM items WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
docs AS (SELECT doc_id, coalesce({_WORDS}, []) AS words FROM documents),
places AS (
  SELECT doc_id, n, i, list_slice(words, i, i + n - 1) AS window_words
  FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM docs, sizes)),
hits AS (SELECT p.doc_id, p.i, p.n, w.item_id FROM places p JOIN windows w ON p.n = w.n AND p.window_words = w.window_words),
hit_words AS (SELECT doc_id, count(DISTINCT word_at) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS word_at FROM hits) GROUP BY doc_id),
hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(i.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(i.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit_words h USING (doc_id) LEFT JOIN hit_items i USING (doc_id)
"""


@query("op1_decontaminate", _SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of the benchmark each document holds."""
    found = contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
