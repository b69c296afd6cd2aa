"""Operator 2: mix sources to target weights with Efraimidis-Spirakis sampling.

Every source gets a share of the mix by weight, at most ``MOST_EPOCHS`` times its size; what a
capped source can't take is shared again among the others. A source's target is met by complete
epochs over all its documents, then by a fractional epoch: each document draws the exponential key
``-ln(u) / quality weight``, documents are sorted by key within their source, and a prefix sum of
their sizes is cut at the remaining budget.

The order is made by range partitions over (source, key). A source of any size spreads over as
many partitions as it needs; each partition adds what the partitions before it hold.

Defined results: null text has size 0; null sources form one source that comes last; a document
without a quality label weighs 1; a repeated doc_id is a document of its own each time; an empty
table gives no rows; columns other than those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.runtime import store
from ..functions.skew import small_side
from .registry import query, table

#: Weights of the sources in code point order, repeated.
SOURCE_WEIGHTS = (1, 2, 3)
#: No document is taken more often.
MOST_EPOCHS = 3
#: Sampling weight of documents by their quality label; 1 without a label.
QUALITY_WEIGHTS = {1: 2.0, 0: 0.5}

_SOURCE = ["_none", "_source"]


def quality_weights(labels: DataFrame) -> DataFrame:
    """(doc_id, weight) of labelled documents; the best of several labels counts."""
    weight = F.lit(1.0)
    for quality, value in QUALITY_WEIGHTS.items():
        weight = F.when(F.col("quality") == quality, F.lit(value)).otherwise(weight)
    return labels.groupBy("doc_id").agg(F.max("quality").alias("quality")).select("doc_id", weight.alias("weight"))


def source_targets(sizes: DataFrame) -> DataFrame:
    """Target of each source from (_none, _source, source_size), one row per source.

    Sources are capped in the order of cap per weight: a source is above its cap exactly if its
    share of what the sources before it leave is. One row per source meets in one task here, never
    documents.
    """
    order = W.orderBy("_none", "_source")
    weights = F.array(*[F.lit(w) for w in SOURCE_WEIGHTS])
    by_cap = W.orderBy(F.col("_cap") / F.col("_weight"), "_none", "_source")
    before = by_cap.rowsBetween(W.unboundedPreceding, -1)
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    capped = F.col("_cap") * (F.col("_all_weight") - F.col("_weight_before")) < F.col("_weight") * (
        F.col("_all") - F.col("_cap_before")
    )
    return (
        sizes.withColumn("_weight", F.element_at(weights, ((F.row_number().over(order) - 1) % len(SOURCE_WEIGHTS) + 1).cast("int")).cast("double"))
        .withColumn("_cap", F.col("source_size").cast("double") * MOST_EPOCHS)
        .withColumn("_all", F.sum(F.col("source_size").cast("double")).over(whole))
        .withColumn("_all_weight", F.sum("_weight").over(whole))
        .withColumn("_cap_before", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_weight_before", F.coalesce(F.sum("_weight").over(before), F.lit(0.0)))
        .withColumn("_capped", capped)
        .withColumn("_rest", F.col("_all") - F.sum(F.when(F.col("_capped"), F.col("_cap")).otherwise(0.0)).over(whole))
        .withColumn("_rest_weight", F.sum(F.when(F.col("_capped"), 0.0).otherwise(F.col("_weight"))).over(whole))
        .select(
            *_SOURCE, "source_size",
            F.when(F.col("_capped"), F.col("_cap"))
            .otherwise(F.col("_weight") * F.col("_rest") / F.col("_rest_weight")).alias("target"),
        )
    )


def mix_sources(docs: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every document of the mix.

    ``weights`` (doc_id, weight), one row per doc_id and weights above 0, leads the fractional
    epoch; documents without a row weigh 1. ``taken`` counts repeats.
    """
    spark = docs.sparkSession
    sized = docs.select(
        "doc_id", "source",
        F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
    )
    if weights is None:
        sized = sized.withColumn("weight", F.lit(1.0))
    else:
        sized = sized.join(weights.select("doc_id", "weight"), "doc_id", "left").fillna(1.0, ["weight"])
    digits = F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, 13), 16, 10)
    draw = (digits.cast("double") + 0.5) / float(2**52)
    sized = store(sized.select(
        "doc_id", "source", "size", F.col("source").isNull().alias("_none"), F.coalesce("source", F.lit("")).alias("_source"),
        (-F.log(draw) / F.col("weight")).alias("_key"),
    ))
    targets = store(source_targets(sized.groupBy(*_SOURCE).agg(F.sum("size").alias("source_size"))))

    order = ["_key", "doc_id", "size"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = store(
        sized.repartitionByRange(parts, *_SOURCE, *order).withColumn("_piece", F.spark_partition_id())
    )
    earlier = W.partitionBy(*_SOURCE).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    offsets = store(
        ranged.groupBy("_piece", *_SOURCE).agg(F.sum("size").alias("_sum"))
        .select("_piece", *_SOURCE, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_earlier"))
    )
    inside = W.partitionBy("_piece", *_SOURCE).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    budget = F.col("target") - F.col("_epochs") * F.col("source_size")
    return (
        ranged.withColumn("_before", F.sum("size").over(inside) - F.col("size"))
        .join(small_side(offsets), ["_piece", *_SOURCE])
        .join(small_side(targets), _SOURCE)
        .withColumn("_epochs", epochs)
        .withColumn("_more", (F.col("_earlier") + F.col("_before") + F.col("size") / 2 <= budget).cast("long"))
        .select(
            "doc_id", "source", "size", "source_size", F.round("target", 6).alias("target"),
            (F.col("size") * (F.col("_epochs") + F.col("_more"))).alias("taken"),
        )
    )


_SQL = r"""
WITH quality AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
sized AS (
  SELECT d.doc_id, d.source, coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    -ln((('0x' || substr(md5('mix:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
      / (CASE q.quality WHEN 1 THEN 2.0::DOUBLE WHEN 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END) AS k
  FROM documents d LEFT JOIN quality q ON d.doc_id = q.doc_id),
sources AS (
  SELECT source, sum(size)::DOUBLE AS source_size,
    ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w
  FROM sized GROUP BY source),
capped AS (
  SELECT *, 3 * source_size * (sum(w) OVER () - coalesce(sum(w) OVER p, 0)) < w * (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER p, 0)) AS is_capped
  FROM sources
  WINDOW p AS (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, CASE WHEN is_capped THEN 3 * source_size ELSE
    w * (sum(source_size) OVER () - sum(CASE WHEN is_capped THEN 3 * source_size ELSE 0 END) OVER ())
      / sum(CASE WHEN is_capped THEN 0 ELSE w END) OVER () END AS target
  FROM capped),
run AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs,
    sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) - s.size AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size::BIGINT AS source_size, round(target, 6) AS target,
  (size * (epochs + CASE WHEN before + size / 2.0 <= target - epochs * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM run
"""


@query("op2_mix_sources", _SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents, labels leading the choice."""
    mixed = mix_sources(table(spark, sf_dir, "documents"), quality_weights(table(spark, sf_dir, "labels")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")
