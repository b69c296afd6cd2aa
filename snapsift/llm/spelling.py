"""Operator 13: spelling variants, found with bidirectional FM-indexes over the vocabulary.

Two words are near if one insertion, deletion or replacement of a code point turns one into the
other. Such a pair shares, exactly and at the word's edge, the first or the second half of either
word. So the vocabulary is dealt out by halves: as a target, a word goes where its possible first
halves and second halves lead; as a query, where its own two halves lead. Each shard builds a
bidirectional FM-index over its delimited targets, matches a query's half exactly, and extends it
over the other half up to the delimiter with one error. Both searches keep the ranges of suffix
ranks of the text and of its reverse in step; the final range is one word's rank.

Shards hold about ``SHARD_WORDS`` targets. A half of more targets is split into blocks of targets
times blocks of queries, so no shard grows with it, and nothing is left out.

Defined results: null and empty texts have no runs; a null ``doc_id`` hashes as an empty one;
repeated rows count each; empty tables and too short or too rare runs give no rows; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.runtime import settle, spread, store
from ..functions.skew import small_side
from .registry import query, table

#: Runs of these characters are words.
RUN = r"[A-Za-zÀ-ÿ]+"
#: One in so many runs, by the hash of document and run, loses a code point.
DAMAGED = 97
LEAST_LENGTH = 5
LEAST_COUNT = 3
#: A form occurs at least so many times as often as its variant.
FORM_RATIO = 2
#: Target words of a shard, about; a half with more is split.
SHARD_WORDS = 100_000
#: Queries searched at once by a task.
QUERY_BLOCK = 10_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Symbols of the index below those of letters: the text's end, and the delimiter.
_END, _MARK = 0, 1

PAIRS = "word string, near string, n long"


def runs(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(RUN), F.lit(0))


def damaged(doc_id: Column, run: Column) -> Column:
    """The run, without one of its code points if its hash says so."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(F.pmod(h, F.lit(DAMAGED)) == 0, cut).otherwise(run)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all words that are long and frequent enough."""
    each = docs.select("doc_id", F.explode(runs(F.col("text"))).alias("run"))
    words = each.select(damaged(F.col("doc_id"), F.col("run")).alias("word")).filter(F.length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_COUNT)


class Ranks:
    """Wavelet matrix of a symbol sequence: occurrences of a symbol, or of smaller ones, before a place."""

    def __init__(self, symbols: np.ndarray):
        self.levels = max(1, int(symbols.max(initial=0)).bit_length())
        self.zeros, self.turn = [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (symbols >> level) & 1
            self.zeros.append(np.concatenate([[0], np.cumsum(1 - bit)]).astype(np.int32))
            self.turn.append(int(self.zeros[-1][-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])
        count = np.bincount(symbols, minlength=1 << self.levels)
        # Below the last level equal symbols lie together: from their place there to that among suffixes.
        symbol = np.arange(1 << self.levels)
        first = np.zeros(len(symbol), np.int64)
        for k in range(self.levels):
            one = (symbol >> (self.levels - 1 - k)) & 1 == 1
            first = np.where(one, self.turn[k] + first - self.zeros[k][first], self.zeros[k][first])
        self.shift = np.cumsum(count) - count - first

    def extend(self, low: np.ndarray, size: np.ndarray, symbol: np.ndarray):
        """Range of suffixes that begin with ``symbol`` and go on as those of a range: its low end,
        its size, and how many in the old range are preceded by a smaller symbol."""
        at, end, smaller = low.astype(np.int64), (low + size).astype(np.int64), np.zeros(len(low), np.int64)
        for k in range(self.levels):
            one = (symbol >> (self.levels - 1 - k)) & 1 == 1
            zeros_at, zeros_end = self.zeros[k][at], self.zeros[k][end]
            smaller += np.where(one, zeros_end - zeros_at, 0)
            at = np.where(one, self.turn[k] + at - zeros_at, zeros_at)
            end = np.where(one, self.turn[k] + end - zeros_end, zeros_end)
        return self.shift[symbol] + at, end - at, smaller

    def children(self, low: np.ndarray, size: np.ndarray):
        """All non-empty extensions of ranges: (range, symbol, low, size, smaller)."""
        row = np.arange(len(low))
        at, end = low.astype(np.int64), (low + size).astype(np.int64)
        symbol, smaller = np.zeros(len(low), np.int64), np.zeros(len(low), np.int64)
        for k in range(self.levels):
            zeros_at, zeros_end = self.zeros[k][at].astype(np.int64), self.zeros[k][end].astype(np.int64)
            ones_at, ones_end = self.turn[k] + at - zeros_at, self.turn[k] + end - zeros_end
            left, right = zeros_end > zeros_at, ones_end > ones_at
            row = np.concatenate([row[left], row[right]])
            smaller = np.concatenate([smaller[left], (smaller + zeros_end - zeros_at)[right]])
            symbol = np.concatenate([symbol[left] << 1, (symbol[right] << 1) | 1])
            at, end = np.concatenate([zeros_at[left], ones_at[right]]), np.concatenate([zeros_end[left], ones_end[right]])
        return row, symbol, self.shift[symbol] + at, end - at, smaller


def suffix_order(codes: np.ndarray) -> np.ndarray:
    """Places of all suffixes in ascending order, a suffix before those that it begins."""
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        then = np.zeros(len(codes), np.int64)
        then[:-step or None] = rank[step:] + 1 if step < len(codes) else 0
        key = rank * (len(codes) + 1) + then
        order = np.argsort(key, kind="stable")
        in_order = key[order]
        rank[order] = np.cumsum(np.r_[0, in_order[1:] != in_order[:-1]])
        if rank[order[-1]] == len(codes) - 1:
            return order
        step *= 2


class Vocabulary:
    """Bidirectional FM-index over sorted distinct words, each between delimiters."""

    def __init__(self, words: list[str]):
        self.words = words
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        self.letters = np.unique(points)
        lengths = np.array([len(w) for w in words], np.int64)
        codes = np.full(len(points) + len(words) + 1, _MARK, np.int64)
        codes[np.arange(len(points)) + np.repeat(np.arange(len(words)), lengths) + 1] = np.searchsorted(self.letters, points) + 2
        self.size = len(codes) + 1
        #: By direction of extension: to the left over the text, to the right over its reverse.
        self.ranks = {"left": self._ranks(codes), "right": self._ranks(codes[::-1])}

    @staticmethod
    def _ranks(codes: np.ndarray) -> Ranks:
        ended = np.append(codes, _END)
        return Ranks(ended[suffix_order(ended) - 1])

    def coded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of words as a matrix that ends with delimiters, -1 for letters not in the index; lengths."""
        lengths = np.array([len(w) for w in words], np.int64)
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        at = np.minimum(np.searchsorted(self.letters, points), len(self.letters) - 1)
        symbols = np.where(self.letters[at] == points, at + 2, -1)
        out = np.full((len(words), int(lengths.max()) + 2), _MARK, np.int64)
        row = np.repeat(np.arange(len(words)), lengths)
        out[row, np.arange(len(points)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = symbols
        return out, lengths

    def near(self, words: list[str], direction: str) -> tuple[np.ndarray, np.ndarray]:
        """(query, target) for all targets that one error turns a query into.

        Going right, the query's first half is matched exactly and the error lies behind it; going
        left, the second half, and the error lies before it.
        """
        ranks = self.ranks[direction]
        symbols, lengths = self.coded(words if direction == "right" else [w[::-1] for w in words])
        exact = lengths // 2 if direction == "right" else lengths - lengths // 2
        # A state: query, its symbols done, low end in the direction's own ranks and in the other's, size.
        query = np.arange(len(words))
        low = np.zeros(len(words), np.int64)
        state = self._extend(ranks, (query, low, low, low, np.full(len(words), self.size)), np.full(len(words), _MARK), 0)
        for step in range(int(exact.max(initial=0))):
            query, done, own, other, size = state
            go = step < exact[query]
            went = self._extend(ranks, tuple(x[go] for x in state), symbols[query[go], step], 1)
            state = tuple(np.concatenate([x[~go], y]) for x, y in zip(state, went, strict=True))
        found, erred = [], [np.zeros(0, np.int64)] * 5
        while len(state[0]) or len(erred[0]):
            query, done, own, other, size = erred
            erred = list(self._extend(ranks, tuple(erred), symbols[query, done], 1))
            ended = erred[1] > lengths[erred[0]]
            found.append(tuple(x[ended] for x in erred))
            erred = [x[~ended] for x in erred]
            if len(state[0]):
                state, once = self._branch(ranks, state, symbols, lengths)
                erred = [np.concatenate([a, *(o[i] for o in once)]) for i, a in enumerate(erred)]
        query, _, own, other, _ = (np.concatenate(x) for x in zip(*found, strict=True))
        # The range of a whole delimited word in the text's own order is one rank; the end and the last delimiter come first.
        return query, (own if direction == "left" else other) - 2

    @staticmethod
    def _extend(ranks: Ranks, state: tuple, symbol: np.ndarray, done: int) -> tuple:
        known = symbol >= 0
        query, at, own, other, size = (x[known] for x in state)
        low, n, smaller = ranks.extend(own, size, symbol[known])
        held = n > 0
        return query[held], at[held] + done, low[held], (other + smaller)[held], n[held]

    @staticmethod
    def _branch(ranks: Ranks, state: tuple, symbols: np.ndarray, lengths: np.ndarray):
        """One step without an error, and all that an error makes of the states.

        Of equal results from a run of one letter, only the error at its end is followed.
        """
        query, done, own, other, size = state
        row, symbol, low, n, smaller = ranks.children(own, size)
        child = (query[row], done[row], low, other[row] + smaller, n)
        expected, letter, inside = symbols[child[0], child[1]], symbol > _MARK, child[1] < lengths[child[0]]
        other_letter = letter & (symbol != expected)
        take = lambda mask, more: (child[0][mask], child[1][mask] + more, child[2][mask], child[3][mask], child[4][mask])
        replaced, inserted = take(other_letter & inside, 1), take(other_letter, 0)
        left = done < lengths[query]
        drop = left & (symbols[query, done] != symbols[query, np.minimum(done + 1, symbols.shape[1] - 1)])
        deleted = (query[drop], done[drop] + 1, own[drop], other[drop], size[drop])
        return take(letter & inside & (symbol == expected), 1), (replaced, inserted, deleted)


def _search(group: pa.Table) -> pa.Table:
    """Pairs of one shard of targets and queries."""
    target = group.filter(pc.equal(group["role"], 0))
    words, place = np.unique(np.array(target["word"].to_pylist(), dtype=object), return_index=True) if len(target) else ([], [])
    counts = target["n"].to_numpy()[place] if len(target) else np.zeros(0, np.int64)
    out = []
    if len(words):
        index = Vocabulary(list(words))
        for role, direction in ((1, "right"), (2, "left")):
            asked = sorted(set(group.filter(pc.equal(group["role"], role))["word"].to_pylist()))
            for first in range(0, len(asked), QUERY_BLOCK):
                block = asked[first:first + QUERY_BLOCK]
                query, near = index.near(block, direction)
                out.append(pa.table({
                    "word": pa.array([block[i] for i in query.tolist()], pa.string()),
                    "near": pa.array([words[i] for i in near.tolist()], pa.string()),
                    "n": pa.array(counts[near], pa.int64()),
                }))
    schema = pa.schema([("word", pa.string()), ("near", pa.string()), ("n", pa.int64())])
    return pa.concat_tables(out) if out else schema.empty_table()


def near_words(words: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(word, near, n of near) of all near pairs, in both directions; ``words`` is a settled (word, n)."""
    spark = words.sparkSession
    length = F.length("word")
    first = lambda n: F.concat(F.lit("<"), F.substring("word", F.lit(1), n))
    last = lambda n: F.concat(F.lit(">"), F.substring(F.col("word"), length - n + 1, n))
    half = lambda n: F.floor(n / 2).cast("int")
    # A query is up to one code point longer or shorter than its target.
    lengths = (length - 1, length, length + 1)
    led = F.array_distinct(F.array(*[first(half(n)) for n in lengths], *[last(n - half(n)) for n in lengths]))
    targets = words.select("word", "n", F.explode(led).alias("half"), F.lit(0).cast("byte").alias("role"))
    own = F.array(F.struct(first(half(length)).alias("half"), F.lit(1).cast("byte").alias("role")), F.struct(last(length - half(length)).alias("half"), F.lit(2).cast("byte").alias("role")))
    queries = words.select("word", "n", F.inline(own))

    sizes = settle(targets.groupBy("half").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > shard_words))
    total = words.count() * 4
    shards = max(1, spark.sparkContext.defaultParallelism, -(-4 * total // shard_words)) if total > shard_words // 50 else 1
    blocks = F.ceil(F.col("_n") / F.lit(shard_words)).cast("int")
    spot = F.pmod(F.xxhash64("word", F.lit(7)), F.coalesce(blocks, F.lit(1))).cast("int")

    def dealt(rows: DataFrame, mine: str, others: str) -> DataFrame:
        # A split half sends every row along one side of its grid of blocks.
        rows = rows.join(small_side(sizes), "half", "left").withColumn(mine, spot)
        rows = rows.withColumn(others, F.explode(F.sequence(F.lit(0), F.coalesce(blocks, F.lit(1)) - 1)))
        shard = F.when(F.col("_n").isNull(), F.pmod(F.xxhash64("half"), F.lit(shards)).cast("string")).otherwise(F.col("half"))
        return rows.select("word", "n", "role", shard.alias("shard"), "_target_block", "_query_block")

    placed = dealt(targets, "_target_block", "_query_block").unionByName(dealt(queries, "_query_block", "_target_block"))
    keys = ["shard", "_target_block", "_query_block"]
    return spread(placed, keys, 2 * total, shards).groupBy(*keys).applyInArrow(_search, PAIRS).distinct()


def group_variants(docs: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of the documents."""
    words = store(word_counts(docs))
    near = near_words(words, shard_words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n")).alias("minus"), "near")).alias("best")
    )
    frequent = -F.col("best.minus") >= FORM_RATIO * F.col("n")
    formed = store(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(frequent, F.col("best.near")).alias("form"), F.when(frequent, -F.col("best.minus")).alias("form_n"),
    ))
    return formed.join(_roots(formed.select("word", "form")), "word")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): every link is followed to its end, twice as far in each round.

    A form is at least twice as frequent as its word, so paths have no circles and few links.
    """
    roots = forms.select("word", F.coalesce("form", "word").alias("root"))
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = store(roots.join(further, "root").select("word", F.col("_next").alias("root"), (F.col("_next") != F.col("root")).alias("moved")))
        roots = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return roots


def crc_table() -> list[int]:
    """Table of the reflected CRC-32 polynomial."""
    out = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        out.append(value)
    return out


_DUCK_RUN = r"[A-Za-z\x{C0}-\x{FF}]+"
_CODE = "encode(concat(coalesce(doc_id::VARCHAR, ''), ':', run))"
_SQL = rf"""
WITH RECURSIVE each AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_DUCK_RUN}')) AS run FROM documents),
runs AS (SELECT doc_id, run, count(*) AS k FROM each GROUP BY doc_id, run),
bytes AS (
  SELECT doc_id, run, k, list_transform(range(0, octet_length({_CODE})), lambda i: ('0x' || substr(hex({_CODE}), 2 * i + 1, 2))::BIGINT) AS b FROM runs),
hashed AS (
  SELECT doc_id, run, k, xor(4294967295, list_reduce(list_prepend(4294967295, b), lambda x, y: xor(x >> 8, {crc_table()}[(xor(x, y) & 255) + 1]))) AS h
  FROM bytes),
damaged AS (
  SELECT CASE WHEN h % {DAMAGED} = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, k FROM hashed),
words AS (SELECT word, sum(k)::BIGINT AS n FROM damaged WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(k) >= {LEAST_COUNT}),
shorter AS (
  SELECT DISTINCT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS near, b.n FROM shorter a JOIN shorter b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM shorter a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM shorter a JOIN words b ON a.rest = b.word),
ranked AS (
  SELECT word, near, n AS near_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY n DESC, near) AS place FROM pairs),
formed AS (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.near_n >= {FORM_RATIO} * w.n THEN r.near END AS form,
    CASE WHEN r.near_n >= {FORM_RATIO} * w.n THEN r.near_n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.place = 1),
walk AS (
  SELECT word, word AS root, form FROM formed
  UNION ALL SELECT w.word, f.word, f.form FROM walk w JOIN formed f ON w.form = f.word)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, w.root FROM formed f JOIN walk w ON w.word = f.word AND w.form IS NULL
"""


@query("op13_spelling_variants", _SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent words of the documents and the words they are variants of."""
    return group_variants(table(spark, sf_dir, "documents")).select("word", "n", "n_near", "form", "form_n", "root")
