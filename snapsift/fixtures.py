"""Inputs of the study's shape, derived from the driver's tables by fixed rules.

Each rule is written twice: as a DataFrame here and as a SQL common table expression
(``*_SQL``) for the checks. The residue tests below *simulate* what happens between two
exports of a study (records added, deleted, corrected); they do not sample the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions.runtime import spread, store

ORDER_VALUES = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
ORDER_KEY = ["centre", "id"]


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- orders as dated snapshots ------------------------------------------------------


def orders_raw(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders").select(
        (F.col("o_orderkey") % 20).cast("int").alias("centre"),
        F.col("o_orderkey").alias("id"),
        *ORDER_VALUES,
    )


def orders_gold(spark: SparkSession, sf: str) -> DataFrame:
    """Final export: some records of the preliminary ones are gone."""
    return orders_raw(spark, sf).filter(F.col("id") % 97 != 0)


def orders_snapshot(spark: SparkSession, sf: str, k: int) -> DataFrame:
    """Preliminary export ``k``: late records missing, values not yet corrected."""
    i = F.col("id")
    return (
        orders_raw(spark, sf)
        .filter(i % (89 + k) != 1)
        .withColumns(
            {
                "o_orderstatus": F.when(i % 3 == 0, "X").otherwise(F.col("o_orderstatus")),
                "o_totalprice": F.when(
                    i % (5 * k + 6) == 0, F.floor(F.col("o_totalprice") * 110) / 100
                ).otherwise(F.col("o_totalprice")),
                "o_orderpriority": F.when(i % (7 * k + 3) != 2, F.col("o_orderpriority")),
                "dfstatus": F.lit("final"),
            }
        )
    )


_ORDERS = """
orders_raw AS (
  SELECT CAST(o_orderkey % 20 AS INTEGER) AS centre, o_orderkey AS id, o_custkey, o_orderstatus,
         o_totalprice, o_orderdate, o_orderpriority FROM orders),
gold AS (SELECT * FROM orders_raw WHERE id % 97 <> 0)"""


def orders_sql(k: int, name: str = "pre") -> str:
    """CTE of preliminary export ``k`` (after :data:`ORDERS_SQL`)."""
    return f"""
{name} AS (
  SELECT centre, id, o_custkey,
         CASE WHEN id % 3 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
         CASE WHEN id % {5 * k + 6} = 0 THEN floor(o_totalprice * 110) / 100 ELSE o_totalprice END AS o_totalprice,
         o_orderdate,
         CASE WHEN id % {7 * k + 3} <> 2 THEN o_orderpriority END AS o_orderpriority,
         'final' AS dfstatus
  FROM orders_raw WHERE id % {89 + k} <> 1)"""


ORDERS_SQL = _ORDERS

# --- lineitem as a form with several rows per participant ----------------------------

_LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def line_form(spark: SparkSession, sf: str, rows: int | None = None) -> DataFrame:
    """Numbered lines; with their number ``rows`` given they are spread by id as stored records are."""
    # numbered by the name under which later steps group the form, so that they find it grouped
    w = W.partitionBy("id").orderBy(*_LINE_ORDER)
    lines = load(spark, sf, "lineitem").select(
        (F.col("l_orderkey") % 20).cast("int").alias("centre"),
        F.col("l_orderkey").alias("id"),
        "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus", "l_shipdate",
    )
    return (lines if rows is None else spread(lines, ["id"], rows)).select(
        "centre", "id", F.row_number().over(w).alias("dfseq"),
        "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus", "l_shipdate",
    )


LINE_FORM_SQL = """
line_form AS (
  SELECT CAST(l_orderkey % 20 AS INTEGER) AS centre, l_orderkey AS id,
         CAST(row_number() OVER (PARTITION BY l_orderkey
              ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INTEGER) AS dfseq,
         l_partkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
         l_returnflag, l_linestatus, l_shipdate
  FROM lineitem)"""

# --- numeric plates -------------------------------------------------------------------

PLATE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


def plate_table(spark: SparkSession, sf: str, rows: int | None = None) -> DataFrame:
    """Plates by return flag with missing tax values and a label."""
    return line_form(spark, sf, rows).select(
        F.col("l_returnflag").alias("dataset"),
        (F.col("id") * 100 + F.col("dfseq")).alias("rec_id"),
        "l_quantity", "l_extendedprice", "l_discount",
        F.when(F.col("id") % 13 != 0, F.col("l_tax")).alias("l_tax"),
        "l_linenumber", "l_linestatus", "l_shipdate",
        ((F.col("l_partkey") % 11 == 0) | (F.col("l_quantity") >= 49)).cast("int").alias("y"),
    )


PLATE_SQL = LINE_FORM_SQL + """,
plate AS (
  SELECT l_returnflag AS dataset, id * 100 + dfseq AS rec_id, l_quantity, l_extendedprice, l_discount,
         CASE WHEN id % 13 <> 0 THEN l_tax END AS l_tax, l_linenumber, l_linestatus, l_shipdate,
         CASE WHEN l_partkey % 11 = 0 OR l_quantity >= 49 THEN 1 ELSE 0 END AS y
  FROM line_form)"""

#: Long cells ``cell(dataset, rec_id, pos, value)`` of the plates, missing values filled
#: with the most frequent value of the feature (least on ties).
PLATE_CELLS_SQL = PLATE_SQL + """,
raw_cell AS (
  SELECT dataset, rec_id, 0 AS pos, l_quantity AS value FROM plate
  UNION ALL SELECT dataset, rec_id, 1, l_extendedprice FROM plate
  UNION ALL SELECT dataset, rec_id, 2, l_discount FROM plate
  UNION ALL SELECT dataset, rec_id, 3, l_tax FROM plate
  UNION ALL SELECT dataset, rec_id, 4, CAST(l_linenumber AS DOUBLE) FROM plate),
mode_count AS (
  SELECT dataset, pos, value, count(*) AS c FROM raw_cell WHERE value IS NOT NULL GROUP BY ALL),
mode_value AS (
  SELECT dataset, pos, value AS fill FROM (
    SELECT *, row_number() OVER (PARTITION BY dataset, pos ORDER BY c DESC, value) AS r FROM mode_count)
  WHERE r = 1),
cell AS (
  SELECT c.dataset, c.rec_id, c.pos, coalesce(c.value, m.fill) AS value
  FROM raw_cell c JOIN mode_value m ON c.dataset = m.dataset AND c.pos = m.pos)"""

# --- plates of several trials, for selection ------------------------------------------------

def trial_plates(spark: SparkSession, sf: str) -> DataFrame:
    """Plates ``T/S/P`` of seven trials with two snapshots and three plates each, as wide rows.

    Prices follow quantities, and parts are low or high. Records that were corrected later (``y``) are
    unlike the others in one of three ways, by trial and plate: quantities beyond their range, prices
    that don't go with the quantity, or parts between low and high.
    """
    trial, flag = F.col("centre") % 7, F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    kind, bad, i = (trial + flag) % 3, F.col("id") % 19 == 4, F.col("id")
    quantity = F.when(bad & (kind == 0), 51 + i % 5).otherwise(F.col("l_quantity"))
    matching = F.when(bad & (kind == 1), 51 - quantity).otherwise(quantity)
    part = F.col("l_partkey") % 20 + F.when(F.col("l_partkey") % 3 == 0, 60).otherwise(0)
    return line_form(spark, sf).select(
        F.concat(F.lit("T"), trial, F.lit("/S"), F.col("l_linenumber") % 2, F.lit("/P"), flag).alias("dataset"),
        (i * 100 + F.col("dfseq")).alias("rec_id"), quantity.cast("double").alias("quantity"),
        (matching * 1500 + F.col("l_discount") * 10_000 + F.col("l_partkey") % 7 * 100).alias("price"), F.col("l_discount").alias("discount"),
        F.when(i % 13 != 0, F.col("l_tax")).alias("tax"), F.when(bad & (kind == 2), 40).otherwise(part).cast("double").alias("part"), bad.cast("int").alias("y"),
    )


TRIAL_FEATURES = ["quantity", "price", "discount", "tax", "part"]

# --- vectors ----------------------------------------------------------------------------


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as one dataset of records."""
    return load(spark, sf, "embeddings").select(
        F.lit("vectors").alias("dataset"),
        F.col("vec_id").alias("rec_id"),
        F.col("embedding").cast("array<double>").alias("features"),
        (F.col("label") == 0).cast("int").alias("y"),
    )


VECTORS_SQL = """
vec AS (SELECT vec_id AS rec_id, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings)"""

# --- scores against labels ----------------------------------------------------------------


def document_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Text length as a score for toxicity, per language."""
    return load(spark, sf, "documents").join(load(spark, sf, "labels"), "doc_id").select(
        F.col("lang").alias("dataset"), F.lit("LENGTH").alias("algorithm"),
        F.col("doc_id").alias("rec_id"), F.col("n_chars").cast("double").alias("score"),
        F.col("toxic").alias("y"),
    )


DOCUMENT_SCORES_SQL = """
scored AS (
  SELECT d.lang AS dataset, 'LENGTH' AS algorithm, d.doc_id AS rec_id,
         CAST(d.n_chars AS DOUBLE) AS score, l.toxic AS y
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

# --- comparison table ---------------------------------------------------------------------

ALGORITHMS = ["ECOD", "HBOS", "IForest", "KNN", "LOF", "PCA"]


def comparisons(spark: SparkSession, sf: str) -> DataFrame:
    """One row per (trial, snapshot, plate, algorithm) with an AUROC and its bound."""
    names = F.array(*[F.lit(a) for a in ALGORITHMS])
    grouped = load(spark, sf, "lineitem").groupBy(
        F.concat(F.lit("T"), F.col("l_suppkey") % 7).alias("trial"),
        F.concat(F.lit("S"), F.col("l_linenumber") % 5).alias("snapshot"),
        F.concat(F.lit("P"), F.col("l_partkey") % 11).alias("plate"),
        F.element_at(names, (F.col("l_orderkey") % 6 + 1).cast("int")).alias("algorithm"),
    )
    hundredths = F.sum(F.round(F.col("l_discount") * 100).cast("long"))
    taxes = F.sum(F.round(F.col("l_tax") * 100).cast("long"))
    n = F.count(F.lit(1))
    return (
        grouped.agg(n.alias("num_samples"), hundredths.alias("_d"), taxes.alias("_t"))
        .withColumn("auroc", F.round(0.3 + 4 * (F.col("_d") / F.col("num_samples") / 100), 6))
        .withColumn("auroc_lower", F.round(F.col("auroc") - 0.1 / F.sqrt("num_samples"), 6))
        .withColumn("anomaly_proportion", F.col("_t") / F.col("num_samples") / 100)
        .withColumn("num_columns", (5 + F.length("plate") + F.length("trial")).cast("long"))
        .drop("_d", "_t")
    )


COMPARISONS_SQL = """
cmp AS (
  SELECT trial, snapshot, plate, algorithm, num_samples, auroc,
         round(auroc - 0.1 / sqrt(num_samples), 6) AS auroc_lower,
         anomaly_proportion, CAST(5 + length(plate) + length(trial) AS BIGINT) AS num_columns
  FROM (
    SELECT 'T' || (l_suppkey % 7) AS trial, 'S' || (l_linenumber % 5) AS snapshot,
           'P' || (l_partkey % 11) AS plate,
           (['ECOD', 'HBOS', 'IForest', 'KNN', 'LOF', 'PCA'])[l_orderkey % 6 + 1] AS algorithm,
           count(*) AS num_samples,
           round(0.3 + 4 * (CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100), 6) AS auroc,
           CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS anomaly_proportion
    FROM lineitem GROUP BY ALL))"""

# --- a study of several tables --------------------------------------------------------------


def lines_snapshot(spark: SparkSession, sf: str, form: DataFrame | None = None) -> DataFrame:
    """Preliminary line form: quantities not yet corrected, taxes not yet filled in."""
    i = F.col("id")
    return (line_form(spark, sf) if form is None else form).withColumns(
        {
            "l_quantity": F.when(i % 10 == 3, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")),
            "l_tax": F.when(i % 7 != 2, F.col("l_tax")),
        }
    )


def supplier_form(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "supplier").select(
        F.col("s_nationkey").alias("centre"), F.col("s_suppkey").alias("id"), "s_name", "s_acctbal"
    )


def customer_form(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "customer").select(
        F.col("c_nationkey").alias("centre"), F.col("c_custkey").alias("id"), "c_acctbal", "c_mktsegment"
    )


SNAPSHOTS = ["S1", "S2", "S3", "S4"]


def study_inputs(spark: SparkSession, sf: str):
    """Preliminary snapshots and gold tables of one study, with every kind of outcome.

    orders changes in all snapshots, lines in two; suppliers has no gold table, customers
    never changes, parts is excluded by the configuration. The lines are numbered once and
    stored, because every comparison reads its tables several times.
    """
    form = store(line_form(spark, sf))
    snapshots = {f"S{k}": {"orders": orders_snapshot(spark, sf, k)} for k in (1, 2, 3, 4)}
    for s in SNAPSHOTS:
        snapshots[s]["suppliers"] = supplier_form(spark, sf)
    for s in ("S1", "S2"):
        snapshots[s]["lines"] = lines_snapshot(spark, sf, form)
    for s in ("S1", "S2", "S3"):
        snapshots[s]["customers"] = customer_form(spark, sf)
    snapshots["S4"]["parts"] = load(spark, sf, "part")
    gold = {
        "orders": orders_gold(spark, sf), "lines": form,
        "customers": customer_form(spark, sf), "parts": load(spark, sf, "part"),
    }
    return snapshots, gold
