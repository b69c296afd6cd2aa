"""Operator 12: document fingerprints as threshold-scaled sketches, in DataFrame functions only.

A shingle is ``SHINGLE`` consecutive words (the whole text if it has fewer); its hash is the first
``HASH_DIGITS`` hexadecimal digits of its MD5. A sketch retains every distinct hash below
``THRESHOLD``, a sixteenth of the range, so that sketches of documents of any size keep the same hashes of what
they share: the sketch of a union is made of the sketches alone, and containment is estimated even
between a sentence and a book. Texts with fewer than ``LEAST`` hashes below the threshold keep their
``LEAST`` lowest, which merge as well.

Two sketches are compared below the lower of their two limits: the threshold, or the highest hash
of a sketch that went above it and may have left hashes out.

Defined results: a null text is empty; an empty or wordless text has the empty sketch, like only to
another empty one; repeated rows are fingerprinted each; empty tables give no rows. In the order of
``next_document`` a null ``doc_id`` is the last, rows of one ``doc_id`` go by a hash of the text, and
equal rows are each other's next ones. A single document is its own next one. Other columns are
ignored.
"""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.runtime import store
from .registry import query, table

#: Words of a shingle.
SHINGLE = 5
HASH_DIGITS = 16
#: Hashes below these first digits are retained: one in sixteen.
THRESHOLD = "1"
#: Hashes that a sketch keeps at least, if its text has so many.
LEAST = 16
#: Bytes of text ordered by one task, about.
RANGE_BYTES = 32 << 20
MOST_RANGES = 20_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words: ASCII characters other than letters and digits.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Lower-cased runs of ASCII letters, digits and all other characters above ASCII."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _BETWEEN), lambda w: w != "")


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """Hashes of the shingles of a text, in their order."""

    def digest(shingle: Column) -> Column:
        return F.substring(F.md5(shingle), 1, HASH_DIGITS)

    def hashed(w: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(w) - size)
        return (
            F.when(F.size(w) == 0, F.array().cast("array<string>"))
            .when(F.size(w) <= size, F.array(digest(F.array_join(w, " "))))
            .otherwise(F.transform(places, lambda i: digest(F.concat_ws(" ", *[w[i + k] for k in range(size)]))))
        )

    return _let(words(text), hashed)


def sketch(text: Column, size: int = SHINGLE, threshold: str = THRESHOLD, least: int = LEAST) -> Column:
    """Ascending hashes that the sketch of a text retains."""

    def kept(hashes: Column) -> Column:
        below = F.sort_array(F.array_distinct(F.filter(hashes, lambda h: h < threshold)))
        lowest = F.slice(F.sort_array(F.array_distinct(hashes)), 1, least)
        return _let(below, lambda low: F.when(F.size(low) >= least, low).otherwise(lowest))

    return _let(shingle_hashes(text, size), kept)


def merged(a: Column, b: Column, threshold: str = THRESHOLD, least: int = LEAST) -> Column:
    """Sketch of the union of two documents' shingles, from their sketches."""
    return F.filter(F.sort_array(F.array_union(a, b)), lambda h, i: (h < threshold) | (i < least))


def _limit(held: Column, threshold: str, least: int) -> Column:
    """The hash up to which a sketch is complete."""
    top = F.when(F.size(held) < least, F.lit("g")).otherwise(F.element_at(held, -1))
    return F.when(F.size(held) == 0, F.lit("g")).otherwise(F.greatest(top, F.lit(threshold)))


def comparison(a: Column, b: Column, threshold: str = THRESHOLD, least: int = LEAST) -> Column:
    """Struct of ``likeness`` (estimated Jaccard similarity), ``in_b`` and ``in_a`` (estimated share
    of a's shingles that b contains, and the reverse) of two sketches."""

    def counted(held: Column) -> Column:
        shared, n_a, n_b = held["shared"], held["n_a"], held["n_b"]
        empty = (n_a == 0) & (n_b == 0)
        share = lambda n: F.when(empty, F.lit(1.0)).otherwise(F.coalesce(F.try_divide(shared, n), F.lit(0.0)))
        return F.struct(share(n_a + n_b - shared).alias("likeness"), share(n_a).alias("in_b"), share(n_b).alias("in_a"))

    def cut(limit: Column) -> Column:
        low = F.struct(F.filter(a, lambda h: h <= limit).alias("a"), F.filter(b, lambda h: h <= limit).alias("b"))
        sizes = lambda x: F.struct(
            F.size(F.array_intersect(x["a"], x["b"])).alias("shared"), F.size(x["a"]).alias("n_a"), F.size(x["b"]).alias("n_b"))
        return _let(_let(low, sizes), counted)

    return _let(F.least(_limit(a, threshold, least), _limit(b, threshold, least)), cut)


def next_document(docs: DataFrame, values: list[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``docs`` with ``next_<value>`` of the document that follows by descending ``doc_id``; after the last comes the first.

    ``docs`` has a ``text``. Documents are dealt out by ranges of (doc_id, hash of the text) with about
    ``range_bytes`` of text each; the first document of every range is also sent to the range that it
    follows, so rows move once and no task sees all of them. Quantiles bound the ranges, which only
    decides about sizes.
    """
    spark = docs.sparkSession
    ident = docs.schema["doc_id"].dataType.simpleString()
    tie = F.xxhash64(F.coalesce("text", F.lit("")))
    keys = store(docs.select("doc_id", tie.alias("_tie"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("_bytes")))
    n_rows, size = keys.agg(F.count(F.lit(1)), F.sum(F.col("_bytes") + 64)).first()
    pieces = min(max(spark.sparkContext.defaultParallelism, -(-(size or 0) // range_bytes)), MOST_RANGES, max(n_rows, 1))
    bounds = []
    if pieces > 1:
        shares = [i / pieces for i in range(1, pieces)]
        bounds = sorted(set(keys.agg(F.percentile_approx(_along("doc_id", "_tie"), shares, max(4 * pieces, 10_000))).first()[0] or []))
    at = _range_of(_along("doc_id", "_tie"), bounds)

    order = F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).cast(ident).alias("id"), F.col("_tie").alias("tie"))
    heads = keys.groupBy(at.alias("_at")).agg(F.max(order).alias("head")).orderBy("_at").collect()  # a row per range
    known = [r["_at"] for r in heads]
    follows = dict(zip(known, [*known[1:], *known[:1]], strict=True))
    first = spark.createDataFrame(
        [(r["_at"], r["head"], follows[r["_at"]]) for r in heads], f"_at int, _head struct<known: boolean, id: {ident}, tie: bigint>, _follows int"
    )
    placed = docs.withColumn("_tie", tie).withColumn("_at", at).join(F.broadcast(first), "_at")
    own = F.struct(F.col("_at").alias("_range"), F.lit(False).alias("_copy"))
    copy = F.struct(F.col("_follows").alias("_range"), F.lit(True).alias("_copy"))
    places = F.when(order == F.col("_head"), F.array(own, copy)).otherwise(F.array(own))
    moved = placed.select(*docs.columns, "_tie", F.inline(places)).repartition(max(len(known), 1), "_range")
    # A copy ends its range whatever its doc_id: the lowest range ends with the first document of all.
    along = W.partitionBy("_range").orderBy("_copy", F.desc_nulls_last("doc_id"), F.desc("_tie"))
    followed = moved.withColumns({f"next_{v}": F.lead(F.struct(v)).over(along) for v in values})
    return followed.filter(~F.col("_copy")).select(*docs.columns, *[F.col(f"next_{v}")[v].alias(f"next_{v}") for v in values])


def _along(doc_id: str, tie: str) -> Column:
    """A number that grows with (doc_id, tie); null, the last of all, lies below every number."""
    number = F.coalesce(F.col(doc_id).cast("decimal(20,0)"), F.lit(Decimal(-(2**63) - 1)).cast("decimal(20,0)"))
    return (number * F.lit(Decimal(2**32)) + F.shiftrightunsigned(F.col(tie), 32).cast("decimal(10,0)")).cast("decimal(38,0)")


def _range_of(key: Column, bounds: list) -> Column:
    """Number of ``bounds`` up to ``key``, looked for in two steps."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds)) + 1
    numbers = lambda some: F.array(*[F.lit(b).cast("decimal(38,0)") for b in some])
    parts = [bounds[i:i + step] for i in range(0, len(bounds), step)]
    fine = F.array(*[numbers(p) for p in parts])
    count = lambda some, k: F.size(F.filter(some, lambda b: b <= k))

    def among(k: Column) -> Column:
        part = F.greatest(count(numbers([p[0] for p in parts]), k) - 1, F.lit(0))
        return _let(part, lambda i: i * step + count(fine[i], k))

    return _let(key, among)


def edited_text(text: Column, following: Column) -> Column:
    """The text with its last half replaced by as much of the next text's beginning, or all of it."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited, sketch, edited_sketch, to_edited and to_next (see ``comparison``) of each document."""
    sketched = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("sketch", sketch(F.col("text")))
    pairs = next_document(sketched, ["text", "sketch"])
    pairs = pairs.select("doc_id", "text", "sketch", "next_sketch", edited_text(F.col("text"), F.col("next_text")).alias("edited"))
    pairs = pairs.select("doc_id", F.length("text").cast("long").alias("n_chars"), "edited", "sketch", "next_sketch", sketch(F.col("edited")).alias("edited_sketch"))
    return pairs.select(
        "doc_id", "n_chars", "edited", "sketch", "edited_sketch",
        comparison(F.col("sketch"), F.col("edited_sketch")).alias("to_edited"),
        comparison(F.col("sketch"), F.col("next_sketch")).alias("to_next"),
    )


_WORDS = rf"regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _sql_sketch(name: str, source: str) -> str:
    """Sketches of ``source`` (r, text)."""
    held = f"CASE WHEN len(list_filter(hashes, lambda h: h < '{THRESHOLD}')) >= {LEAST} THEN list_filter(hashes, lambda h: h < '{THRESHOLD}') ELSE list_slice(hashes, 1, {LEAST}) END"
    following = ", ".join(f"lead(word, {k}) OVER along" for k in range(1, SHINGLE))
    return rf"""
{name} AS (
  SELECT s.r, coalesce(h.held, []) AS held FROM {source} s LEFT JOIN (
    SELECT r, {held} AS held FROM (
      SELECT r, list_sort(list(DISTINCT substr(md5(shingle), 1, {HASH_DIGITS}))) AS hashes FROM (
        SELECT r, i, n, concat_ws(' ', word, {following}) AS shingle
        FROM (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS i, len(words) AS n FROM (SELECT r, {_WORDS} AS words FROM {source}))
        WINDOW along AS (PARTITION BY r ORDER BY i))
      WHERE i <= greatest(n - {SHINGLE - 1}, 1) GROUP BY r)) h ON h.r = s.r)"""


def _sql_likeness(a: str, b: str) -> str:
    top = lambda x: f"CASE WHEN len({x}) < {LEAST} THEN 'g' ELSE greatest({x}[-1], '{THRESHOLD}') END"
    low = lambda x: f"list_filter({x}, lambda h: h <= least({top(a)}, {top(b)}))"
    both = f"len(list_intersect({low(a)}, {low(b)}))"
    return f"CASE WHEN len({a}) + len({b}) = 0 THEN 1.0 ELSE coalesce({both} / nullif(len({low(a)}) + len({low(b)}) - {both}, 0), 0.0) END"


_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER (ORDER BY doc_id DESC) AS r, count(*) OVER () AS n_docs, doc_id, coalesce(text, '') AS text FROM documents),
pairs AS (
  SELECT a.r, a.doc_id, length(a.text)::BIGINT AS n_chars, a.r % a.n_docs + 1 AS follows,
    substr(a.text, 1, length(a.text) - length(a.text) // 2) || substr(b.text, 1, length(a.text) // 2) AS text
  FROM docs a JOIN docs b ON b.r = a.r % a.n_docs + 1),
{_sql_sketch("own", "docs")},
{_sql_sketch("edited", "pairs")}
SELECT doc_id, n_chars, sha256(text) AS edited_sha256, array_to_string(o.held, ',') AS fingerprint, array_to_string(e.held, ',') AS edited_fingerprint,
  round({_sql_likeness("o.held", "e.held")}, 9) AS near_edited, round({_sql_likeness("o.held", "f.held")}, 9) AS near_next
FROM pairs p JOIN own o ON o.r = p.r JOIN edited e ON e.r = p.r JOIN own f ON f.r = p.follows
"""


@query("op12_fingerprints", _SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and how alike they are."""
    found = fingerprint_documents(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.array_join("sketch", ",").alias("fingerprint"),
        F.array_join("edited_sketch", ",").alias("edited_fingerprint"), F.round("to_edited.likeness", 9).alias("near_edited"),
        F.round("to_next.likeness", 9).alias("near_next"),
    )
