"""Operator 5: information-theoretic sanitisation of personal data, in DataFrame functions only.

Addresses, numbers and cards found by pattern are the protected entities. The words of their
documents that no entity covers are candidate terms. Over the whole corpus, the documents of an
entity (c), a term (t) and both are counted. A term discloses an entity if its pointwise mutual
information reaches a share ``ALPHA`` of the entity's information content,

    log p(c|t) / p(c) >= -ALPHA * log p(c)   or   log p(c|t) >= (1 - ALPHA) * log p(c),

and at least ``LEAST_TOGETHER`` documents hold both. Such a term is a span at all its places, in
documents without the entity too; ``sanitise`` replaces entities by their kind and terms by a
general word.

Patterns are possessive and look behind, so that long runs cost linear time; they find what the
plain patterns in the comments find. Defined results: null text has no spans and stays null;
overlapping kinds are all reported, and replaced as one; repeated rows get the same spans; an empty
table gives no rows; columns with other names pass ``sanitise`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.runtime import store
from ..functions.skew import small_side
from .registry import query, table

#: Kinds in the order of reports.
KINDS = ("email", "ip", "card", "phone")
TERM = "term"
#: Share of an entity's information that a term may disclose.
ALPHA = 0.75
LEAST_TOGETHER = 3
#: Pairs of entities and terms that one row makes in one task.
ROW_PAIRS = 1_000_000

_LOCAL, _DOMAIN = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
_PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_DOMAIN}++(?:\.{_DOMAIN}++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}+",
    # [0-9]([\x20-]?[0-9])+ of 12 to 19 digits; shorter and longer runs are passed over
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_WORD = r"[\p{L}\p{N}]+"
#: A stretch of text that ends with a word's end, so that long texts cost linear time.
_PART = r"(?s).{1,250}+[\p{L}\p{N}]*+"


def _located(text: Column, pattern: str, present: Column) -> Column:
    """Matches of a pattern as (start, end, value) in characters; ``present`` is a cheap precondition."""
    kind = "array<struct<start:int,end:int,value:string>>"
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches))
    steps = F.zip_with(gaps, matches, lambda gap, value: F.struct(F.length(gap).alias("gap"), value.alias("value")))
    located = F.aggregate(
        steps,
        F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")),
        lambda done, x: F.struct(
            (done["at"] + x["gap"] + F.length(x["value"])).alias("at"),
            F.concat(done["out"], F.array(F.struct(
                (done["at"] + x["gap"]).alias("start"), (done["at"] + x["gap"] + F.length(x["value"])).alias("end"), x["value"].alias("value"),
            ))).alias("out"),
        ),
        lambda done: done["out"],
    )
    return F.when(present, located).otherwise(F.array().cast(kind))


def _luhn(value: Column) -> Column:
    digits = F.translate(value, " -", "")
    n = F.length(digits)

    def part(i: Column) -> Column:
        digit = F.substr(digits, n + 1 - i, F.lit(1)).cast("int")
        double = digit * 2
        return F.when(i % 2 == 1, digit).when(double > 9, double - 9).otherwise(double)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), part), F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return _luhn(value)
    if kind == "phone":
        return F.length(F.translate(value, "+ ().-", "")).between(9, 15)
    return F.lit(True)


def _of_kind(located: Column, rank: int, kind: str) -> Column:
    return F.transform(F.filter(located, lambda x: _valid(kind, x["value"])), lambda x: F.struct(
        x["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), x["end"].alias("end"), x["value"].alias("value"),
    ))


def base_spans(text: Column) -> Column:
    """All base spans as (start, rank of the kind, kind, end, value), by start and kind."""
    present = {
        "email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"),
        "card": text.rlike(r"[0-9][\x20-]?[0-9]"), "phone": text.contains("+"),
    }
    found = []
    for rank, kind in enumerate(KINDS):
        found.append(_of_kind(_located(text, _PATTERNS[kind], present[kind]), rank, kind))
    return F.array_sort(F.concat(*found))


def _overlap(spans: Column, x: Column) -> Column:
    return F.exists(spans, lambda s: (s["start"] < x["end"]) & (s["end"] > x["start"]))


def free_words(text: Column, spans: Column) -> Column:
    """Words that no span covers: (start, end, term)."""
    def parts(doc: Column) -> Column:
        return F.transform(_located(doc["text"], _PART, F.length(doc["text"]) > 0), lambda c: F.struct(
            c["start"].alias("start"), c["value"].alias("value"),
            F.filter(doc["spans"], lambda s: (s["start"] < c["end"]) & (s["end"] > c["start"])).alias("spans"),
        ))

    def words(part: Column) -> Column:
        placed = F.transform(_located(part["value"], _WORD, F.lit(True)), lambda w: F.struct(
            (part["start"] + w["start"]).alias("start"), (part["start"] + w["end"]).alias("end"), F.lower(w["value"]).alias("term"),
        ))
        return F.filter(placed, lambda w: ~_overlap(part["spans"], w))

    # As an element of an array the spans are found once; inlined in a lambda, they were in each part.
    docs = F.array(F.struct(text.alias("text"), spans.alias("spans")))
    return F.flatten(F.transform(docs, lambda doc: F.flatten(F.transform(parts(doc), words))))


def _plain_words(text: Column) -> Column:
    return F.array_distinct(F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))), lambda w: F.lower(w)))


def _folded(text: Column) -> Column:
    """Lower case in which a word looks the same inside a text and alone; only the final sigma doesn't."""
    return F.translate(F.lower(text), "\u03c2", "\u03c3")


def term_places(text: Column, spans: Column, terms: Column) -> Column:
    """Places of the ``terms`` that no span covers: (start, end, term). Parts without a term are not taken apart."""
    def holding(doc: Column) -> Column:
        parts = F.transform(_located(doc["text"], _PART, F.length(doc["text"]) > 0), lambda c: F.struct(
            c["start"].alias("start"), c["end"].alias("end"), c["value"].alias("value"), _folded(c["value"]).alias("folded"),
        ))
        return F.filter(parts, lambda c: F.exists(doc["folded"], lambda t: F.contains(c["folded"], t)))

    def words(doc: Column, part: Column) -> Column:
        placed = F.transform(_located(part["value"], _WORD, F.lit(True)), lambda w: F.struct(
            (part["start"] + w["start"]).alias("start"), (part["start"] + w["end"]).alias("end"), F.lower(w["value"]).alias("term"),
        ))
        return F.filter(placed, lambda w: F.array_contains(doc["terms"], w["term"]) & ~_overlap(doc["spans"], w))

    docs = F.array(F.struct(text.alias("text"), spans.alias("spans"), terms.alias("terms"), F.transform(terms, _folded).alias("folded")))
    return F.flatten(F.transform(docs, lambda doc: F.flatten(F.transform(holding(doc), lambda part: words(doc, part)))))


def protected(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold entities, stored: ``_id``, ``_of`` (hash of the text), their ``_spans``
    and ``entities``, the free ``terms``, and the words that stand in spans only (``covered``)."""
    # A generated column is computed once; a projected one would be again in the filter.
    based = docs.select(
        F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_of"),
        F.inline(F.array(F.struct(F.col("text").alias("text"), base_spans(F.col("text")).alias("_spans")))),
    ).filter(F.size("_spans") > 0)
    placed = based.withColumn("terms", F.array_distinct(F.transform(free_words(F.col("text"), F.col("_spans")), lambda w: w["term"])))
    return store(placed.select(
        F.monotonically_increasing_id().alias("row"), "_id", "_of", "_spans", "terms", F.array_except(_plain_words(F.col("text")), "terms").alias("covered"),
        F.array_distinct(F.transform("_spans", lambda s: F.concat_ws(":", s["kind"], F.lower(s["value"])))).alias("entities"),
    ))


def disclosing_terms(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(entity, term) pairs above the disclosure threshold, from all documents and their ``protected`` rows.

    A pair passes only with n_term <= n_both / p(c) ** (1 - ALPHA) and n_both <= n_entity, so pairs
    are made of the entities and terms alone whose own counts allow it.
    """
    n_docs = max(docs.count(), 1)
    # A row with many entities and many terms is dealt to several tasks by its terms.
    parts = F.ceil(F.size("entities").cast("double") * F.size("terms") / ROW_PAIRS).cast("int")
    rows = found.withColumn("parts", F.greatest(parts, F.lit(1)))
    held = rows.select("row", "parts", F.explode("entities").alias("entity"))
    entities = store(held.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity")).filter(F.col("n_entity") >= LEAST_TOGETHER))
    most = entities.agg(F.max("n_entity")).first()[0] or 0
    possible = lambda n_both, n_entity: F.log(n_both / F.col("n_term")) >= (1 - ALPHA) * F.log(n_entity / F.lit(n_docs))
    # Words of too few documents with an entity, or of too many documents, can't pass.
    near = rows.select("row", "parts", F.explode("terms").alias("term"))
    candidates = store(near.groupBy("term").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_TOGETHER).select("term"))
    # A document counts for a word it holds outside its spans.
    words = docs.select(F.explode(_plain_words(F.col("text"))).alias("term"), F.lit(1).alias("n")).union(
        found.select(F.explode("covered").alias("term"), F.lit(-1).alias("n")))
    counts = store(
        words.join(small_side(candidates), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n_term"))
        .filter(possible(F.lit(most), F.lit(most)))
    )
    sides = (
        held.join(small_side(entities), "entity").select("row", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "entity", "n_entity"),
        near.join(small_side(counts), "term").select("row", F.pmod(F.xxhash64("term"), F.col("parts")).cast("int").alias("part"), "term", "n_term"),
    )
    both = sides[0].join(sides[1], ["row", "part"]).filter(possible(F.col("n_entity"), F.col("n_entity")))
    return (
        both.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_both"), F.first("n_entity").alias("n_entity"), F.first("n_term").alias("n_term"))
        .filter((F.col("n_both") >= LEAST_TOGETHER) & possible(F.col("n_both"), F.col("n_entity"))).select("entity", "term")
    )


def annotate(docs: DataFrame) -> DataFrame:
    """Each row of ``docs`` as ``_row``, with all its ``spans`` (start, rank, kind, end)."""
    keyed = docs.select(F.struct("*").alias("_row"), "doc_id", "text", F.xxhash64("text").alias("_hash"))
    found = protected(docs)
    disclosing = store(disclosing_terms(docs, found).select("term").distinct())
    # One small row per document with spans or disclosing terms; texts are looked through in place.
    holders = keyed.select("doc_id", "_hash", F.explode(_plain_words(F.col("text"))).alias("term")).join(small_side(disclosing), "term", "left_semi")
    marks = small_side(store(
        found.select("_id", "_of", "_spans", F.lit(None).cast("string").alias("term"))
        .union(holders.select("doc_id", "_hash", F.lit(None).cast(found.schema["_spans"].dataType), "term"))
        .groupBy("_id", "_of").agg(F.first("_spans", ignorenulls=True).alias("_spans"), F.collect_set("term").alias("_terms"))
    ))
    here = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_of"))
    spans = F.coalesce("_spans", F.array().cast(found.schema["_spans"].dataType))
    marked = keyed.join(marks, here, "left").select("_row", "text", "_terms", spans.alias("_spans"))
    plain = F.transform("_spans", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end")))
    placed = F.transform(term_places(F.col("text"), F.col("_spans"), F.col("_terms")), lambda w: F.struct(
        w["start"].alias("start"), F.lit(len(KINDS)).alias("rank"), F.lit(TERM).alias("kind"), w["end"].alias("end"),
    ))
    return marked.select("_row", F.when(F.size("_terms") > 0, F.array_sort(F.concat(plain, placed))).otherwise(plain).alias("spans"))


def replaced(text: Column, spans: Column) -> Column:
    """The text with every run of overlapping spans replaced by the kind of its first."""
    done = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda done, s: F.struct(
            F.greatest(done["at"], s["end"]).alias("at"),
            F.when(s["start"] >= done["at"], F.concat(done["out"], F.array(
                F.substr(text, done["at"] + 1, s["start"] - done["at"]), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")),
            ))).otherwise(done["out"]).alias("out"),
        ),
        lambda done: F.concat(F.array_join(done["out"], ""), F.substr(text, done["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, done).otherwise(text)


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with entities and disclosing terms generalised in the text."""
    rows = annotate(docs).select("_row.*", F.col("spans").alias("_spans"))
    return rows.withColumn("text", replaced(F.col("text"), F.col("_spans"))).select(*docs.columns)


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@query("op5_pii")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data and disclosing terms of every document."""
    spans = annotate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(F.filter(F.col("spans")["kind"], lambda x: x == k)).cast("long").alias(f"n_{k}") for k in KINDS]
    base = F.filter("spans", lambda s: s["kind"] != TERM)
    return spans.select("_row.doc_id", *counts, F.sha2(_written(base), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))
