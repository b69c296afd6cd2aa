"""Operator 11: ranked lexical search, reversed.

The items to search for are few and the documents many, so the items' terms are indexed and the
documents are streamed past the index. A first pass counts documents, terms and, for the items'
terms, document frequencies. The second pass looks every document's term counts up in the broadcast
inverted index, adds the weights up per item, and keeps the ``TOP`` best documents of each item in a
heap per task. Only the heaps leave a task; they are merged per item.

The index holds a block of items of about ``BLOCK_BYTES`` of text; a larger item table is searched
in several passes. Terms are compared by 64-bit hashes. All scores are integers.

Defined results: a null text, as one without terms, is no document of the statistics and is never
found; a null or term-less item finds nothing; every row of the items is searched for by itself, a
repeated item_id included; repeated documents each take a rank; equal scores go by ascending
``doc_id`` (an integer), null last; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .registry import query, table
from .words import ALNUM, Piece, lean, pieces

#: Documents kept for an item.
TOP = 10
#: Item text in one index; its terms and their counts are held by the driver and every task.
BLOCK_BYTES = 8 << 20
#: Scores of (document, item) pairs, and postings, held at once by a task.
CELLS = 2_000_000
#: Heaps of so many tasks are merged first by groups.
MERGE_GROUPS = 64


class ItemIndex:
    """Inverted index of the items' terms: term -> items, and the terms' weights."""

    def __init__(self, item_ids: list, texts: list):
        self.item_ids = item_ids
        hashes, lengths = [np.zeros(0, np.uint64)], []
        for piece in pieces(pa.array(texts, pa.string()), ALNUM):
            hashes.append(piece.hashes(lower=True))
            lengths.extend(piece.counts.tolist())
        self.terms, rank = np.unique(np.concatenate(hashes), return_inverse=True)
        item = np.repeat(np.arange(len(lengths)), lengths)
        pair = np.unique(rank.astype(np.int64) * max(len(lengths), 1) + item)
        term, self.items = pair // max(len(lengths), 1), pair % max(len(lengths), 1)
        self.first = np.searchsorted(term, np.arange(len(self.terms) + 1))
        self.n_docs = self.n_terms = 0
        self.weights = np.zeros(len(self.terms), np.int64)

    def weigh(self, n_docs: int, n_terms: int, counts: np.ndarray) -> None:
        """Set the corpus statistics: documents, all their terms, document frequency of each term."""
        self.n_docs, self.n_terms = n_docs, n_terms
        self.weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(df) + 1))) for df in counts], np.int64)

    def term_counts(self, piece: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, term, occurrences) of the indexed terms in a piece, by document."""
        none = np.zeros(0, np.int64)
        if not len(self.terms) or not len(piece.start):
            return none, none, none
        hashes = piece.hashes(lower=True)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        known = self.terms[at] == hashes
        pair, tf = np.unique(piece.doc[known] * len(self.terms) + at[known], return_counts=True)
        return pair // len(self.terms), pair % len(self.terms), tf.astype(np.int64)

    def scores(self, piece: Piece) -> Iterator[tuple[int, np.ndarray]]:
        """(first document, score matrix of it and the next documents by item), of the whole piece."""
        doc, term, tf = self.term_counts(piece)
        if not len(doc):
            return
        length = np.array([10 + 90 * n * self.n_docs // self.n_terms for n in piece.counts.tolist()], np.int64)
        part = self.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * length[doc]))
        fan = self.first[term + 1] - self.first[term]
        before = np.concatenate([[0], np.cumsum(fan)])
        bounds = np.searchsorted(doc, np.arange(piece.n_texts + 1))
        n_items = len(self.item_ids)
        low = 0
        while low < piece.n_texts:
            high = min(piece.n_texts, low + max(1, CELLS // n_items))
            reach = int(np.searchsorted(before[bounds], before[bounds[low]] + CELLS, "right")) - 1
            high = max(low + 1, min(high, reach))
            a, b = bounds[low], bounds[high]
            n = fan[a:b]
            posting = np.arange(n.sum()) + np.repeat(self.first[term[a:b]] - (np.cumsum(n) - n), n)
            cell = np.repeat(doc[a:b] - low, n) * n_items + self.items[posting]
            value = np.repeat(part[a:b], n)
            # Halves of 24 bits keep the sums of doubles exact.
            size = (high - low) * n_items
            upper = np.bincount(cell, value >> 24, size).astype(np.int64)
            lower = np.bincount(cell, value & 0xFFFFFF, size).astype(np.int64)
            yield low, ((upper << 24) + lower).reshape(high - low, n_items)
            low = high


class Heaps:
    """The best documents of each item; the worst of them lies at the top of its heap."""

    def __init__(self, n_items: int, top: int):
        self.top = top
        self.heaps: list[list] = [[] for _ in range(n_items)]
        self.floor = np.ones(n_items, np.int64)  # scores below can't enter

    def offer(self, ids: list, scores: np.ndarray) -> None:
        """Documents, as rows of a score matrix."""
        row, item = np.nonzero(scores >= self.floor)
        score = scores[row, item]
        last = np.array([i is None for i in ids])[row]
        key = np.array([0 if i is None else i for i in ids], np.int64)[row]
        order = np.lexsort((key, last, -score, item))
        item = item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        best = order[place < self.top]
        for r, i, s in zip(row[best].tolist(), item[place < self.top].tolist(), score[best].tolist(), strict=True):
            entry = (s, ids[r] is not None, -ids[r] if ids[r] is not None else 0)
            heap = self.heaps[i]
            if len(heap) < self.top:
                heapq.heappush(heap, entry)
            else:
                heapq.heappushpop(heap, entry)
            if len(heap) == self.top:
                self.floor[i] = heap[0][0]

    def rows(self) -> Iterator[tuple]:
        """(item, doc_id, score)."""
        for item, heap in enumerate(self.heaps):
            for score, known, minus in heap:
                yield item, -minus if known else None, score


def corpus_statistics(docs: DataFrame, index: ItemIndex) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all terms, and the document frequency of each indexed term."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_terms = len(shared.value.terms)
        total = np.zeros(n_terms + 2, np.int64)
        for batch in batches:
            for piece in pieces(batch.column(0), ALNUM):
                _, term, _ = shared.value.term_counts(piece)
                total[:n_terms] += np.bincount(term, minlength=n_terms)
                total[n_terms] += np.count_nonzero(piece.counts)
                total[n_terms + 1] += len(piece.start)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["term", "n"])

    found = docs.select("text").mapInArrow(lean(count), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(len(index.terms) + 2, np.int64)
    total[found["term"].to_numpy()] = found["n"].to_numpy()  # a row per indexed term
    return int(total[-2]), int(total[-1]), total[:-2]


def _best(docs: DataFrame, index: ItemIndex, top: int) -> DataFrame:
    """(item, doc_id, score) of the heaps of every task; ``item`` counts the index's items."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        heaps = Heaps(len(index.item_ids), top)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for piece in pieces(batch.column(1), ALNUM):
                for low, scores in index.scores(piece):
                    begin = piece.first + low
                    heaps.offer(ids[begin:begin + len(scores)], scores)
        rows = list(zip(*heaps.rows(), strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in rows], ["item", "doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(search), "item long, doc_id long, score long")


def search_documents(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score of the ``top`` documents of each row of ``items``."""
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType
    items = items.select("item_id", "text")
    size = items.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES) or 1
    found = None
    for block in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        rows = part.collect()  # about BLOCK_BYTES, by the sum above
        index = ItemIndex([r[0] for r in rows], [r[1] for r in rows])
        if not len(index.terms):
            continue
        index.weigh(*corpus_statistics(docs, index))
        if not index.n_terms:
            continue
        names = spark.createDataFrame([(i, x) for i, x in enumerate(index.item_ids)], f"item long, item_id {kind.simpleString()}")
        best = _best(docs, index, top).withColumn("_task", F.pmod(F.spark_partition_id(), F.lit(MERGE_GROUPS)))
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        for keys in (["item", "_task"], ["item"]):
            best = best.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= top)
        # both sides are bounded by the index's items
        ranked = best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        found = ranked if found is None else found.unionByName(ranked)
    if found is None:
        found = spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
    return found


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERMS = rf"coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"
_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents),
sized AS (SELECT r, doc_id, terms, len(terms) AS n FROM docs WHERE len(terms) > 0),
corpus AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM sized),
occurring AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM sized) GROUP BY r, term),
wanted AS (
  SELECT i, item_id, unnest(list_distinct(terms)) AS term
  FROM (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS terms FROM benchmark)),
weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM occurring WHERE term IN (SELECT term FROM wanted) GROUP BY term), corpus),
lengths AS (SELECT r, doc_id, 10 + (90 * n * n_docs) // n_terms AS m FROM sized, corpus),
scored AS (
  SELECT i, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM wanted JOIN weights USING (term) JOIN occurring USING (term) JOIN lengths USING (r)
  GROUP BY i, item_id, r, doc_id),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
  FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {TOP}
"""


@query("op11_ranked_search", _SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item."""
    return search_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
