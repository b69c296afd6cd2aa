"""Queries for sources, guards, key discovery, diff, labels and summary."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..config import StudyConfig, TableFailure
from ..functions.runtime import scratch_path
from ..operators import guards, labels, snapdiff, summary
from ..plans import study as plans
from ..sources import tables as src
from .registry import query, shared, with_sql

KEY = fx.ORDER_KEY
VALUES = fx.ORDER_VALUES


def pre_gold(spark, sf, k=1):
    pre = guards.cast_typed(guards.prune_columns(fx.orders_snapshot(spark, sf, k)))
    return pre, guards.cast_typed(fx.orders_gold(spark, sf))


def changes(spark, sf, k=1):
    pre, gold = pre_gold(spark, sf, k)
    return guards.filter_changes(snapdiff.diff_snapshots(pre, gold, KEY, gold_only=False))


def salient(spark, sf, k=1):
    return snapdiff.salient_cells(changes(spark, sf, k), KEY)


def _wide_sql(values, key, pre="pre", gold="gold", name="wide"):
    same = " AND ".join(f"p.{c} IS NOT DISTINCT FROM g.{c}" for c in values)
    on = " AND ".join(f"p.{k} IS NOT DISTINCT FROM g.{k}" for k in key)
    keys = ", ".join(f"coalesce(p.{k}, g.{k}) AS {k}" for k in key)
    pairs = ", ".join(f"p.{c} AS left_{c}, g.{c} AS right_{c}" for c in values)
    return f"""
{name} AS (
  SELECT CASE WHEN p.id IS NULL THEN 'I' WHEN g.id IS NULL THEN 'D' WHEN {same} THEN 'N' ELSE 'C' END AS diff,
         {keys}, {pairs}
  FROM {pre} p FULL JOIN {gold} g ON {on})"""


def _cells_sql(values, key, wide="wide", name="cells"):
    keys = ", ".join(key)
    parts = " UNION ALL ".join(
        f"""SELECT diff, {keys}, '{c}' AS "column", CAST(left_{c} AS VARCHAR) AS "left",
            CAST(right_{c} AS VARCHAR) AS "right"
            FROM {wide} WHERE diff IN ('C', 'D') AND left_{c} IS DISTINCT FROM right_{c}"""
        for c in values
    )
    return f"\n{name} AS ({parts})"


def orders_ctes(k=1):
    return [fx.ORDERS_SQL, fx.orders_sql(k), _wide_sql(VALUES, KEY), _cells_sql(VALUES, KEY)]


ORDERS1 = orders_ctes(1)
CELL_COLS = 'diff, CAST(id AS INTEGER) AS id, centre, "column", "left", "right"'

# --- sources and sinks ------------------------------------------------------------------


@query(
    "read_snapshot_table",
    """SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS l_quantity, l_extendedprice, l_tax
       FROM lineitem""",
)
def read_snapshot_table(spark, sf):
    path = scratch_path(spark, "LINES")
    lines = fx.load(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_tax"
    )
    lines.toDF(*[c.upper() for c in lines.columns]).write.orc(path)
    return src.read_snapshot_table(spark, path, "orc")


def _listings(spark, sf):
    nation = fx.load(spark, sf, "nation").withColumn("t", F.lower(F.regexp_replace("n_name", " ", "_")))
    pre = nation.select(F.concat("t", F.lit(".parquet")).alias("file"))
    plain = nation.filter("n_regionkey in (0, 1, 2)").select(F.concat("t", F.lit(".parquet")).alias("file"))
    packed = nation.filter("n_regionkey in (2, 3)").select(F.concat("t", F.lit(".parquet.gz")).alias("file"))
    return pre, plain.unionByName(packed)


@query(
    "pair_snapshot_tables",
    """WITH t AS (SELECT lower(replace(n_name, ' ', '_')) AS t, n_regionkey AS r FROM nation)
       SELECT t AS table_name, t || '.parquet' AS preliminary_file,
              CASE WHEN r <= 2 THEN t || '.parquet' WHEN r = 3 THEN t || '.parquet.gz' END AS gold_file,
              CASE WHEN r > 3 THEN 'GoldStandardTableNotFound' END AS error FROM t""",
)
def pair_snapshot_tables(spark, sf):
    return src.pair_snapshot_tables(*_listings(spark, sf))


@query("valid_tables", "SELECT DISTINCT lower(source) AS table_name FROM documents")
def valid_tables(spark, sf):
    root = scratch_path(spark, "study")
    rows = fx.load(spark, sf, "documents").select(
        F.col("lang").alias("language"), F.lower("source").alias("SAS libraries")
    )
    rows.write.parquet(f"{root}/tables.parquet")
    study = StudyConfig("demo", root, "gold", ("S1",), metadata_filename="tables.parquet")
    return src.valid_tables(src.read_metadata(spark, study), study.metadata_column)


@query(
    "write_read_diff",
    with_sql(ORDERS1, f"""SELECT diff, centre || '|' || id AS key, "column", "left", "right" FROM cells"""),
)
def write_read_diff(spark, sf):
    path = scratch_path(spark, "diffs")
    parts = []
    for k in (1, 2):
        pre, gold = pre_gold(spark, sf, k)
        diff = changes(spark, sf, k)
        result = snapdiff.TableDiff(KEY, pre, diff, snapdiff.salient_cells(diff, KEY))
        parts.append(snapdiff.long_diff("demo", f"S{k}", "orders", result))
    src.write_diff(plans.union_all(parts), path)
    return src.read_diff(spark, path, "S1", "orders").select(
        "diff", F.array_join("key", "|").alias("key"), "column", "left", "right"
    )


@query("write_read_features", with_sql(
    [fx.PLATE_CELLS_SQL],
    """SELECT c.dataset, c.rec_id, string_agg(printf('%.4f', c.value), '|' ORDER BY c.pos) AS features, min(p.y) AS y
       FROM cell c JOIN plate p ON c.dataset = p.dataset AND c.rec_id = p.rec_id GROUP BY c.dataset, c.rec_id""",
))
def write_read_features(spark, sf):
    from ..operators import preprocess
    from .scoring import raw_plates

    path = scratch_path(spark, "features")
    src.write_features(preprocess.preprocess_plates(raw_plates(spark, sf)), path)
    text = F.transform("features", lambda x: F.format_string("%.4f", x))
    return src.read_features(spark, path).select(
        "dataset", "rec_id", F.array_join(text, "|").alias("features"), "y"
    )


@query("write_comparisons", with_sql(
    [fx.COMPARISONS_SQL],
    "SELECT trial, snapshot, plate, algorithm, num_samples, auroc FROM cmp",
))
def write_comparisons(spark, sf):
    path = scratch_path(spark, "comparisons.csv")
    table = fx.comparisons(spark, sf)
    parts = {
        f"S{i}": table.filter(F.col("snapshot") == f"S{i}").drop("snapshot") for i in range(5)
    }
    src.write_comparisons(src.tag_comparisons(parts), path)
    return spark.read.option("header", True).csv(path).select(
        "trial", "snapshot", "plate", "algorithm",
        F.col("num_samples").cast("long").alias("num_samples"), F.col("auroc").cast("double").alias("auroc"),
    )


@query("read_comparisons", with_sql(
    [fx.COMPARISONS_SQL],
    "SELECT trial, snapshot, plate, algorithm, num_samples, auroc, auroc_lower FROM cmp",
))
def read_comparisons(spark, sf):
    root = scratch_path(spark, "comparisons")
    src.write_trial_comparisons(
        fx.comparisons(spark, sf).select(
            "trial", "plate", "num_samples", "algorithm", "auroc", "auroc_lower", "snapshot"
        ),
        root,
    )
    schema = "plate string, num_samples long, algorithm string, auroc double, auroc_lower double, snapshot string"
    return src.read_comparisons(spark, root, schema)


@query(
    "cached_metafeatures",
    """SELECT l_returnflag || l_linestatus AS dataset, CAST(count(*) AS DOUBLE) AS n,
              round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY ALL""",
)
def cached_metafeatures(spark, sf):
    lines = fx.load(spark, sf, "lineitem").withColumn("dataset", F.concat("l_returnflag", "l_linestatus"))

    def vectors(rows):
        return rows.groupBy("dataset").agg(
            F.array(F.count(F.lit(1)).cast("double"), F.avg("l_quantity")).alias("vector")
        )

    path = scratch_path(spark, "metafeatures")
    src.write_metafeatures(vectors(lines.filter("l_returnflag <> 'N'")), path)
    out = src.cached_metafeatures(
        lines, spark.read.parquet(path), lambda keys: vectors(lines.join(keys, "dataset", "left_semi"))
    )
    return out.select("dataset", F.col("vector")[0].alias("n"), F.round(F.col("vector")[1], 6).alias("mean"))


# --- projection, typing, filters, guards ------------------------------------------------


@query("prune_columns", with_sql(ORDERS1, "SELECT centre, id, o_custkey, o_orderstatus, o_totalprice FROM pre"))
def prune_columns(spark, sf):
    return guards.prune_columns(fx.orders_snapshot(spark, sf, 1)).drop("o_orderdate", "o_orderpriority")


@query(
    "cast_typed",
    """SELECT CAST(o_orderkey AS INTEGER) AS id, TRY_CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS centre,
              o_totalprice FROM orders""",
)
def cast_typed(spark, sf):
    raw = fx.load(spark, sf, "orders").select(
        F.col("o_orderkey").cast("double").alias("id"),
        F.substring("o_orderpriority", 1, 1).alias("centre"), "o_totalprice",
    )
    return guards.cast_typed(raw)


def _failure(spark, pairs):
    """Run named guard calls and report the kind each one raises."""
    rows = []
    for name, call in pairs:
        try:
            call()
            rows.append((name, None))
        except TableFailure as failure:
            rows.append((name, failure.kind))
    return spark.createDataFrame(rows, "check string, error string")


@query(
    "guard_width",
    """WITH w AS (SELECT count(*) AS c FROM information_schema.columns WHERE table_name = 'orders')
       SELECT 'wide' AS "check", CASE WHEN c > 3 THEN 'PreliminarySnapshotTooWide' END AS error FROM w
       UNION ALL SELECT 'narrow', CASE WHEN c < 50 THEN 'PreliminarySnapshotTooNarrow' END FROM w
       UNION ALL SELECT 'ok', CASE WHEN c > 10000 THEN 'PreliminarySnapshotTooWide' END FROM w""",
)
def guard_width(spark, sf):
    orders = fx.load(spark, sf, "orders")
    return _failure(spark, [
        ("wide", lambda: guards.guard_width(orders, orders, 0, 3)),
        ("narrow", lambda: guards.guard_width(orders, orders, 50, 100)),
        ("ok", lambda: guards.guard_width(orders, orders)),
    ])


@query("align_schemas", with_sql(ORDERS1, "SELECT centre, id, o_custkey, o_totalprice FROM gold"))
def align_schemas(spark, sf):
    pre, gold = pre_gold(spark, sf)
    pre = pre.select("id", "centre", "o_totalprice", "o_custkey").withColumn("only_here", F.lit(1))
    return guards.align_schemas(pre, gold)[1]


@query(
    "guard_schema_change",
    """SELECT 'type' AS "check", CASE WHEN typeof(any_value(o_custkey)) <> 'VARCHAR' THEN 'SnapshotSchemaChange' END AS error
       FROM orders UNION ALL SELECT 'same', NULL""",
)
def guard_schema_change(spark, sf):
    pre, gold = pre_gold(spark, sf)
    changed = pre.withColumn("o_custkey", F.col("o_custkey").cast("string"))
    return _failure(spark, [
        ("type", lambda: guards.guard_schema_change(changed, gold)),
        ("same", lambda: guards.guard_schema_change(pre, gold)),
    ])


@query(
    "guard_nonempty",
    """SELECT 'empty' AS "check", CASE WHEN count(*) FILTER (o_orderkey < 0) = 0 THEN 'EmptyTableSnapshot' END AS error
       FROM orders UNION ALL SELECT 'filled', CASE WHEN count(*) = 0 THEN 'EmptyTableSnapshot' END FROM orders""",
)
def guard_nonempty(spark, sf):
    pre, _ = pre_gold(spark, sf)
    return _failure(spark, [
        ("empty", lambda: guards.guard_nonempty(pre.filter("id < 0"))),
        ("filled", lambda: guards.guard_nonempty(pre)),
    ])


@query(
    "guard_identifiers",
    """WITH c AS (SELECT column_name AS c FROM information_schema.columns WHERE table_name = 'orders')
       SELECT 'raw' AS "check", CASE WHEN NOT EXISTS (SELECT 1 FROM c WHERE c = 'centre')
              THEN 'ParticipantIdentifierNotAvailable' END AS error
       UNION ALL SELECT 'form', NULL""",
)
def guard_identifiers(spark, sf):
    pre, _ = pre_gold(spark, sf)
    return _failure(spark, [
        ("raw", lambda: guards.guard_identifiers(fx.load(spark, sf, "orders"), KEY)),
        ("form", lambda: guards.guard_identifiers(pre, KEY)),
    ])


@query("filter_changes", with_sql(
    ORDERS1, "SELECT diff, CAST(id AS INTEGER) AS id, centre, left_o_totalprice, right_o_totalprice FROM wide WHERE diff IN ('C', 'D')",
))
def filter_changes(spark, sf):
    pre, gold = pre_gold(spark, sf)
    return guards.filter_changes(snapdiff.diff_snapshots(pre, gold, KEY)).select(
        "diff", "id", "centre", "left_o_totalprice", "right_o_totalprice"
    )


@query("filter_salient", with_sql(ORDERS1, f"SELECT {CELL_COLS} FROM cells"))
def filter_salient(spark, sf):
    cells = snapdiff.pivot_sides(snapdiff.unpivot_diff(changes(spark, sf), KEY), KEY)
    return guards.filter_salient(cells)


@query("filter_corrections", with_sql(
    ORDERS1, f"""SELECT {CELL_COLS} FROM cells WHERE diff = 'C' AND "left" IS NOT NULL""",
))
def filter_corrections(spark, sf):
    return guards.filter_corrections(salient(spark, sf))


@query("select_tables", """
    SELECT source || lang AS table_name, count(*) AS n FROM documents
    WHERE source IN (SELECT DISTINCT source FROM documents WHERE lang = 'en') AND source || lang <> 'src0en'
    GROUP BY ALL HAVING count(*) > 5""")
def select_tables(spark, sf):
    docs = fx.load(spark, sf, "documents")
    english = docs.filter("lang = 'en'").select("source").distinct()
    name = F.concat("source", "lang").alias("table_name")
    valid = docs.join(english, "source", "left_semi").select(name)
    status = docs.groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    status = status.withColumn("success", F.col("n") > 5)
    return guards.select_tables(status, valid, ["src0en"]).drop("success")


@query("drop_unreliable_columns", with_sql(
    ORDERS1, """SELECT diff, CAST(id AS INTEGER) AS id, centre, "column", "left", "right" FROM cells
    WHERE diff = 'C' AND "left" IS NOT NULL AND "column" NOT IN (
      SELECT "column" FROM cells WHERE diff = 'C' AND "left" IS NOT NULL GROUP BY "column"
      HAVING count(*) > 0.25 * (SELECT count(*) FROM pre))""",
))
def drop_unreliable_columns(spark, sf):
    fixes = guards.filter_corrections(salient(spark, sf))
    rows = pre_gold(spark, sf)[0].count()
    bad = labels.unreliable_columns(labels.column_change_fraction(fixes, rows, []), [])
    return guards.drop_unreliable_cells(fixes, bad, ["column"])


@query("select_numeric", with_sql(
    [fx.PLATE_SQL], "SELECT rec_id, l_quantity, l_extendedprice, l_discount, l_tax, l_linenumber, y FROM plate",
))
def select_numeric(spark, sf):
    return guards.select_numeric(fx.plate_table(spark, sf), ["rec_id"])


@query("filter_missingness", with_sql(
    [fx.PLATE_SQL], "SELECT rec_id, l_quantity, l_tax FROM plate",
))
def filter_missingness(spark, sf):
    plate = fx.plate_table(spark, sf).select("rec_id", "l_quantity", "l_tax").withColumn(
        "mostly_missing", F.when(F.col("rec_id") < 0, F.lit(1.0))
    )
    return guards.filter_missingness(plate, ["l_quantity", "l_tax", "mostly_missing"])


@query("plate_type", with_sql(
    [fx.LINE_FORM_SQL], """
    SELECT l_returnflag AS plate, CASE WHEN count(*) = count(DISTINCT centre || '|' || id) THEN 'single' ELSE 'multi' END AS plate_type
    FROM line_form GROUP BY ALL
    UNION ALL SELECT 'keyed', CASE WHEN count(*) = count(DISTINCT id || '|' || dfseq) THEN 'single' ELSE 'multi' END FROM line_form""",
))
def plate_type(spark, sf):
    form = fx.line_form(spark, sf)
    by_flag = guards.plate_type(form.withColumnRenamed("l_returnflag", "plate"), KEY, ["plate"])
    return by_flag.unionByName(
        guards.plate_type(form.withColumn("plate", F.lit("keyed")), ["id", "dfseq"], ["plate"])
    )


@query(
    "plate_variables",
    """SELECT column_name AS name, CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'DOUBLE' THEN 'double'
              WHEN 'VARCHAR' THEN 'string' ELSE 'timestamp_ntz' END AS dtype
       FROM information_schema.columns WHERE table_name = 'orders' AND column_name <> 'o_orderkey'""",
)
def plate_variables(spark, sf):
    return guards.plate_variables(fx.load(spark, sf, "orders"), ["o_orderkey"])


@query("distinct_centres", "SELECT DISTINCT CAST(o_orderkey % 20 AS INTEGER) AS centre FROM orders")
def distinct_centres(spark, sf):
    return guards.distinct_centres(fx.line_form(spark, sf).unionByName(
        fx.orders_raw(spark, sf), allowMissingColumns=True))


@query("distinct_participants", "SELECT DISTINCT l_orderkey AS id FROM lineitem")
def distinct_participants(spark, sf):
    return guards.distinct_participants(fx.line_form(spark, sf))


@query("apply_ignore_lists", """
    SELECT o_custkey AS centre, o_orderkey AS id, o_totalprice FROM orders
    WHERE o_custkey <> 999 AND o_custkey IN (
      SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderkey) >= 2)""")
def apply_ignore_lists(spark, sf):
    return guards.apply_ignore_lists(fx.load(spark, sf, "orders").select(
        F.col("o_custkey").alias("centre"), F.col("o_orderkey").alias("id"), "o_totalprice",
        F.col("o_orderstatus").alias("init"), F.col("o_orderpriority").alias("help"),
    ))


# --- key discovery and diff -------------------------------------------------------------


@query("dup_count", with_sql([fx.LINE_FORM_SQL], """
    SELECT max(c) AS dup_count FROM (SELECT count(*) AS c FROM line_form GROUP BY centre, id)"""))
def dup_count(spark, sf):
    return snapdiff.duplicates(fx.line_form(spark, sf), KEY)


LINE_CANDIDATES = [
    "dfseq", "l_discount", "l_extendedprice", "l_linenumber", "l_linestatus", "l_partkey", "l_quantity",
    "l_returnflag", "l_shipdate", "l_tax",
]


@query("candidate_dup_counts", with_sql([fx.LINE_FORM_SQL], " UNION ALL ".join(
    f"SELECT '{c}' AS candidate, max(c) AS dup_count FROM (SELECT count(*) AS c FROM line_form GROUP BY centre, id, {c})"
    for c in LINE_CANDIDATES)))
def candidate_dup_counts(spark, sf):
    return snapdiff.candidate_dup_counts(fx.line_form(spark, sf), KEY, LINE_CANDIDATES)


@query("discover_key", with_sql([fx.LINE_FORM_SQL], """
    , cand AS (""".replace(", cand", "SELECT position, key_col FROM (WITH cand") + " UNION ALL ".join(
    f"SELECT '{c}' AS c, max(n) AS d FROM (SELECT count(*) AS n FROM line_form GROUP BY centre, id, {c})"
    for c in LINE_CANDIDATES) + """)
    SELECT CAST(1 AS BIGINT) AS position, 'centre' AS key_col UNION ALL SELECT 2, 'id' UNION ALL
    SELECT 3, c FROM (SELECT c FROM cand ORDER BY d, NOT regexp_matches(c, '^(.+rn[0-9]?$|.+rptn[0-9]?$|dfseq$|visit$|report)'), c LIMIT 1))"""))
def discover_key(spark, sf):
    key = snapdiff.discover_key(fx.lines_snapshot(spark, sf), fx.line_form(spark, sf), KEY)
    return spark.createDataFrame([(i + 1, c) for i, c in enumerate(key)], "position long, key_col string")


WIDE_OUT = "CAST(left_o_custkey AS VARCHAR) AS left_o_custkey, CAST(right_o_custkey AS VARCHAR) AS right_o_custkey, " + ", ".join(
    f"left_{c}, right_{c}" for c in VALUES if c not in ("o_orderdate", "o_custkey"))


@query("diff_snapshots", with_sql(
    ORDERS1, f"SELECT diff, CAST(id AS INTEGER) AS id, centre, {WIDE_OUT} FROM wide"))
def diff_snapshots(spark, sf):
    pre, gold = pre_gold(spark, sf)
    diff = snapdiff.diff_snapshots(pre, gold, KEY).drop("left_o_orderdate", "right_o_orderdate")
    return diff.withColumns({c: F.col(c).cast("string") for c in ("left_o_custkey", "right_o_custkey")})


@query("unpivot_diff", with_sql(ORDERS1, " UNION ALL ".join(
    f"""SELECT diff, CAST(id AS INTEGER) AS id, centre, '{c}' AS "column", '{s}' AS side, CAST({s}_{c} AS VARCHAR) AS value
        FROM wide WHERE diff IN ('C', 'D')""" for c in VALUES for s in ("left", "right"))))
def unpivot_diff(spark, sf):
    return snapdiff.unpivot_diff(changes(spark, sf), KEY)


@query("pivot_sides", with_sql(ORDERS1, " UNION ALL ".join(
    f"""SELECT diff, CAST(id AS INTEGER) AS id, centre, '{c}' AS "column", CAST(left_{c} AS VARCHAR) AS "left",
        CAST(right_{c} AS VARCHAR) AS "right" FROM wide WHERE diff IN ('C', 'D')""" for c in VALUES)))
def pivot_sides(spark, sf):
    return snapdiff.pivot_sides(snapdiff.unpivot_diff(changes(spark, sf), KEY), KEY)


@query("guard_diff_key", with_sql([fx.LINE_FORM_SQL], """
    SELECT 'line' AS diff, centre, id, count(*) AS "count" FROM line_form GROUP BY ALL HAVING count(*) > 1"""))
def guard_diff_key(spark, sf):
    return snapdiff.duplicate_diff_keys(fx.line_form(spark, sf).withColumn("diff", F.lit("line")), KEY)


@query("guard_meaningful", with_sql(ORDERS1, """
    SELECT 'same' AS "check", CASE WHEN NOT EXISTS (SELECT 1 FROM gold a JOIN gold b USING (id)
           WHERE a.o_totalprice IS DISTINCT FROM b.o_totalprice) THEN 'NoMeaningfulData' END AS error
    UNION ALL SELECT 'changed', CASE WHEN NOT EXISTS (SELECT 1 FROM wide WHERE diff IN ('C', 'D')) THEN 'NoMeaningfulData' END"""))
def guard_meaningful(spark, sf):
    _, gold = pre_gold(spark, sf)
    same = guards.filter_changes(snapdiff.diff_snapshots(gold, gold, KEY, gold_only=False))
    return _failure(spark, [
        ("same", lambda: snapdiff.guard_meaningful(same)),
        ("changed", lambda: snapdiff.guard_meaningful(changes(spark, sf))),
    ])


@query("compute_table_diff", with_sql(orders_ctes(2), f"SELECT {CELL_COLS} FROM cells"))
def compute_table_diff(spark, sf):
    return snapdiff.compute_table_diff(fx.orders_snapshot(spark, sf, 2), fx.orders_gold(spark, sf)).cells


STUDY = StudyConfig("demo", "", "gold", tuple(fx.SNAPSHOTS), exclude_tables=("parts",))


def study(spark, sf):
    return shared(spark, sf, "study", lambda: plans.study_diff(spark, STUDY, *fx.study_inputs(spark, sf)))


LINE_KEY = ["centre", "id", "dfseq"]
LINE_VALUES = ["l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
               "l_returnflag", "l_linestatus", "l_shipdate"]


def _study_ctes():
    ctes = [fx.ORDERS_SQL, fx.LINE_FORM_SQL, """
    lines_pre AS (SELECT centre, id, dfseq, l_partkey, l_linenumber,
      CASE WHEN id % 10 = 3 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity, l_extendedprice, l_discount,
      CASE WHEN id % 7 <> 2 THEN l_tax END AS l_tax, l_returnflag, l_linestatus, l_shipdate FROM line_form)""",
        _wide_sql(LINE_VALUES, LINE_KEY, "lines_pre", "line_form", "wide_lines"),
        _cells_sql(LINE_VALUES, LINE_KEY, "wide_lines", "cells_lines")]
    for k in (1, 2, 3, 4):
        ctes += [fx.orders_sql(k, f"pre{k}"), _wide_sql(VALUES, KEY, f"pre{k}", "gold", f"wide{k}"),
                 _cells_sql(VALUES, KEY, f"wide{k}", f"cells{k}")]
    cells = [f"""SELECT 'S{k}' AS snapshot, 'orders' AS table_name, centre || '|' || id AS key, diff,
                 "column", "left", "right" FROM cells{k}""" for k in (1, 2, 3, 4)]
    cells += [f"""SELECT 'S{k}', 'lines', centre || '|' || id || '|' || dfseq, diff, "column", "left", "right"
                  FROM cells_lines""" for k in (1, 2)]
    ctes.append("all_cells AS (" + " UNION ALL ".join(cells) + ")")
    good = [f"""SELECT 'S{k}' AS snapshot, 'orders' AS table_name, true AS success, NULL AS error, 'centre|id' AS key_cols,
            (SELECT count(*) FROM pre{k}) AS n_rows, CAST(5 AS BIGINT) AS n_cols, (SELECT count(*) FROM cells{k}) AS n_diffs"""
            for k in (1, 2, 3, 4)]
    good += [f"""SELECT 'S{k}', 'lines', true, NULL, 'centre|id|dfseq', (SELECT count(*) FROM lines_pre), 9,
             (SELECT count(*) FROM cells_lines)""" for k in (1, 2)]
    bad = [(f"S{k}", "suppliers", "GoldStandardTableNotFound") for k in (1, 2, 3, 4)]
    bad += [(f"S{k}", "customers", "NoMeaningfulData") for k in (1, 2, 3)] + [("S4", "parts", "ExcludedTable")]
    good += [f"SELECT '{s}', '{t}', false, '{e}', NULL, NULL, NULL, NULL" for s, t, e in bad]
    ctes.append("status AS (" + " UNION ALL ".join(good) + ")")
    ctes.append("""summary AS (SELECT *, n_rows * n_cols AS num_cells, n_diffs AS num_diffs,
        CASE WHEN success THEN CAST(n_diffs AS DOUBLE) / (n_rows * n_cols) END AS diff_frac FROM status)""")
    return ctes


STUDY_CTES = _study_ctes()


@query("table_status", with_sql(STUDY_CTES, """
    SELECT 'demo' AS trial, snapshot, table_name, success, error, key_cols, coalesce(n_rows, -1) AS n_rows,
      coalesce(n_cols, -1) AS n_cols, coalesce(n_diffs, -1) AS n_diffs FROM status"""))
def table_status(spark, sf):
    status = study(spark, sf)[1]
    shown = status.withColumn("key_cols", F.array_join("key_cols", "|")).drop("error_message")
    return shown.na.fill(-1, ["n_rows", "n_cols", "n_diffs"])


@query("study_diff", with_sql(STUDY_CTES, """
    SELECT snapshot, table_name, key, diff, "column", "left", "right" FROM all_cells"""))
def study_diff(spark, sf):
    cells = study(spark, sf)[0]
    return cells.drop("trial").withColumn("key", F.array_join("key", "|"))


# --- labels -----------------------------------------------------------------------------

FIXES = ORDERS1 + ["""
    fixes AS (SELECT * FROM cells WHERE diff = 'C' AND "left" IS NOT NULL)""", """
    frac AS (SELECT "column", count(*) AS n_changes, count(*) / CAST((SELECT count(*) FROM pre) AS DOUBLE) AS change_fraction
             FROM fixes GROUP BY "column")""", """
    bad AS (SELECT "column" FROM frac WHERE change_fraction > 0.25)""", """
    counts AS (SELECT centre, CAST(id AS INTEGER) AS id, count(*) AS change_count FROM fixes
               WHERE "column" NOT IN (SELECT "column" FROM bad) GROUP BY ALL)""", """
    labelled AS (SELECT *, change_count / CAST(5 - (SELECT count(*) FROM bad) AS DOUBLE) AS change_frac,
                 change_count / CAST(5 - (SELECT count(*) FROM bad) AS DOUBLE) > 0.2 AS record_change,
                 change_count > 0 AS any_change FROM counts)"""]


def _label_parts(spark, sf):
    pre, _ = pre_gold(spark, sf)
    fixes = guards.filter_corrections(salient(spark, sf))
    fractions = labels.column_change_fraction(fixes, pre.count(), [])
    bad = labels.unreliable_columns(fractions, [])
    return pre, fixes, fractions, bad


@query("column_change_fraction", with_sql(FIXES, 'SELECT "column", n_changes, round(change_fraction, 9) AS change_fraction FROM frac'))
def column_change_fraction(spark, sf):
    return _label_parts(spark, sf)[2].withColumn("change_fraction", F.round("change_fraction", 9))


@query("unreliable_columns", with_sql(FIXES, """SELECT "column" FROM bad UNION SELECT 'o_custkey'"""))
def unreliable_columns(spark, sf):
    fractions = _label_parts(spark, sf)[2]
    return labels.unreliable_columns(fractions, [], configured=["o_custkey"])


@query("record_change_counts", with_sql(FIXES, "SELECT * FROM counts"))
def record_change_counts(spark, sf):
    _, fixes, _, bad = _label_parts(spark, sf)
    return labels.record_change_counts(fixes, bad, KEY, [])


def _record_labels(spark, sf):
    _, fixes, _, bad = _label_parts(spark, sf)
    counts = labels.record_change_counts(fixes, bad, KEY, [])
    return labels.derive_record_labels(counts, len(VALUES) - bad.count())


@query("derive_record_labels", with_sql(FIXES, "SELECT centre, id, change_count, round(change_frac, 9) AS change_frac, record_change, any_change FROM labelled"))
def derive_record_labels(spark, sf):
    return _record_labels(spark, sf).withColumn("change_frac", F.round("change_frac", 9))


PAIRED = """SELECT CAST(p.id AS INTEGER) AS id, p.centre, o_totalprice, coalesce(change_count, 0) AS change_count,
    round(coalesce(change_frac, 0.0), 9) AS change_frac, coalesce(record_change, false) AS record_change,
    coalesce(any_change, false) AS any_change
    FROM pre p LEFT JOIN labelled l ON p.id = l.id AND p.centre = l.centre"""


@query("pair_labels", with_sql(FIXES, PAIRED))
def pair_labels(spark, sf):
    pre, _ = pre_gold(spark, sf)
    paired = labels.pair_labels(pre.select(*KEY, "o_totalprice"), _record_labels(spark, sf), KEY)
    return paired.withColumn("change_frac", F.round("change_frac", 9))


@query("derive_table_labels", with_sql(FIXES, PAIRED.replace("o_totalprice,", "o_totalprice, o_custkey, o_orderpriority,")))
def derive_table_labels(spark, sf):
    pre, _ = pre_gold(spark, sf)
    out = labels.derive_table_labels(pre, salient(spark, sf), KEY)
    return out.drop("o_orderdate").withColumn("change_frac", F.round("change_frac", 9))


STUDY_LABELS = STUDY_CTES + ["""
    fixes AS (SELECT * FROM all_cells WHERE diff = 'C' AND "left" IS NOT NULL AND "column" <> 'l_partkey')""", """
    bad AS (SELECT f.snapshot, f.table_name, "column" FROM fixes f JOIN status s USING (snapshot, table_name)
            GROUP BY ALL HAVING count(*) > 0.25 * any_value(s.n_rows))""", """
    widths AS (SELECT s.snapshot, s.table_name, s.n_cols - (CASE WHEN table_name = 'lines' THEN 1 ELSE 0 END)
               - (SELECT count(*) FROM bad b WHERE b.snapshot = s.snapshot AND b.table_name = s.table_name) AS w
               FROM status s WHERE success)""", """
    counts AS (SELECT snapshot, table_name, key, count(*) AS change_count FROM fixes
               ANTI JOIN bad USING (snapshot, table_name, "column") GROUP BY ALL)""", """
    recs AS (""" + " UNION ALL ".join(
        [f"SELECT 'S{k}' AS snapshot, 'orders' AS table_name, centre || '|' || id AS key FROM pre{k}" for k in (1, 2, 3, 4)]
        + [f"SELECT 'S{k}', 'lines', centre || '|' || id || '|' || dfseq FROM lines_pre" for k in (1, 2)]) + ")"]

STUDY_LABELS_SQL = with_sql(STUDY_LABELS, """
    SELECT snapshot, table_name, key, coalesce(change_count, 0) AS change_count,
           round(coalesce(change_count, 0) / CAST(w AS DOUBLE), 9) AS change_frac,
           coalesce(change_count, 0) / CAST(w AS DOUBLE) > 0.2 AS record_change,
           coalesce(change_count, 0) > 0 AS any_change
    FROM recs LEFT JOIN counts USING (snapshot, table_name, key) JOIN widths USING (snapshot, table_name)""")


def study_labels(spark, sf):
    cells, status, records = study(spark, sf)
    return plans.derive_labels(cells, status, records, exclude_fields=("l_partkey",))


@query("derive_labels", STUDY_LABELS_SQL)
def derive_labels(spark, sf):
    return study_labels(spark, sf).select(
        "snapshot", "table_name", F.array_join("key", "|").alias("key"), "change_count",
        F.round("change_frac", 9).alias("change_frac"), "record_change", "any_change",
    )


@query("write_read_labelled", STUDY_LABELS_SQL.replace(
    "coalesce(change_count, 0) > 0 AS any_change",
    "coalesce(change_count, 0) > 0 AS any_change, CAST(coalesce(change_count, 0) > 0 AS INTEGER) AS y"))
def write_read_labelled(spark, sf):
    path = scratch_path(spark, "derived")
    src.write_labelled(study_labels(spark, sf), path)
    return src.read_labelled(spark, path).select(
        "snapshot", "table_name", F.array_join("key", "|").alias("key"), "change_count",
        F.round("change_frac", 9).alias("change_frac"), "record_change", "any_change", "y",
    )


# --- summary ----------------------------------------------------------------------------


def study_summary(spark, sf):
    return summary.table_summary(study(spark, sf)[1])


@query("table_summary", with_sql(STUDY_CTES, """
    SELECT snapshot, table_name, success, error, key_cols, coalesce(num_cells, -1) AS num_cells,
      coalesce(num_diffs, -1) AS num_diffs, round(diff_frac, 9) AS diff_frac FROM summary"""))
def table_summary(spark, sf):
    return study_summary(spark, sf).withColumns(
        {"key_cols": F.array_join("key_cols", "|"), "diff_frac": F.round("diff_frac", 9)}
    ).na.fill(-1, ["num_cells", "num_diffs"])


@query("key_union", with_sql(STUDY_CTES, """
    SELECT table_name, coalesce(string_agg(DISTINCT k, '|' ORDER BY k), '') AS key_cols
    FROM (SELECT table_name, unnest(CASE WHEN key_cols IS NULL THEN [NULL] ELSE string_split(key_cols, '|') END) AS k FROM summary)
    GROUP BY table_name
    UNION ALL SELECT '*', string_agg(DISTINCT k, '|' ORDER BY k) FROM (SELECT unnest(string_split(key_cols, '|')) AS k FROM summary)"""))
def key_union(spark, sf):
    rows = study_summary(spark, sf)
    both = summary.key_union(rows).unionByName(
        summary.key_union(rows, []).withColumn("table_name", F.lit("*")))
    return both.withColumn("key_cols", F.array_join("key_cols", "|"))


MATRIX = ", ".join(
    f"""coalesce(max(CASE WHEN snapshot = '{s}' THEN coalesce(printf('%.6f', round(diff_frac, 6)), error) END), 'TableNotPresent') AS {s}"""
    for s in fx.SNAPSHOTS)


def _six_places(df):
    number = lambda c: F.coalesce(F.format_string("%.6f", F.col(c).try_cast("double")), F.col(c))
    return df.withColumns({
        s: F.when(F.col(s).try_cast("double").isNotNull(), number(s)).otherwise(F.col(s)) for s in fx.SNAPSHOTS})


@query("status_matrix", with_sql(STUDY_CTES, f"SELECT table_name, {MATRIX} FROM summary GROUP BY table_name"))
def status_matrix(spark, sf):
    return _six_places(summary.status_matrix(study_summary(spark, sf), fx.SNAPSHOTS))


@query("success_order", with_sql(STUDY_CTES, """
    SELECT table_name, CAST(sum(CAST(success AS BIGINT)) AS BIGINT) AS num_successes FROM summary GROUP BY ALL
    ORDER BY num_successes DESC, table_name"""))
def success_order(spark, sf):
    return summary.success_order(study_summary(spark, sf))


@query("write_study_summary", with_sql(STUDY_CTES, f"""
    SELECT table_name, {MATRIX}, max(key_cols) AS key_cols FROM (
      SELECT * REPLACE (replace(array_to_string(list_sort(string_split(key_cols, '|')), ' '), '|', ' ') AS key_cols) FROM summary)
    GROUP BY table_name"""))
def write_study_summary(spark, sf):
    path = scratch_path(spark, "summary.csv")
    src.write_summary(summary.ordered_status_matrix(study_summary(spark, sf), fx.SNAPSHOTS), path)
    return _six_places(spark.read.option("header", True).csv(path))


@query("study_totals", with_sql(STUDY_CTES, """
    SELECT count(*) AS tables, count(*) * 4 AS attempts, CAST(sum(s) AS BIGINT) AS successful,
           CAST(sum(CASE WHEN s > 0 THEN 1 ELSE 0 END) AS BIGINT) AS partially_successful,
           round(sum(s) * 100.0 / (count(*) * 4), 6) AS pct_successful,
           round(sum(CASE WHEN s > 0 THEN 1 ELSE 0 END) * 100.0 / count(*), 6) AS pct_partially
    FROM (SELECT table_name, sum(CASE WHEN success THEN 1 ELSE 0 END) AS s FROM summary GROUP BY table_name)"""))
def study_totals(spark, sf):
    return summary.study_totals(study_summary(spark, sf), len(fx.SNAPSHOTS)).withColumns(
        {c: F.round(c, 6) for c in ("pct_successful", "pct_partially")})


FLAGS = """SELECT snapshot, table_name, bool_or(success AND coalesce(k NOT IN ('centre', 'id'), true)) AS uses_nonstandard_key,
    bool_or(success AND coalesce(k NOT IN ('centre', 'id'), true) AND NOT coalesce(regexp_matches(k, '^.+r(pt)?n$'), false)) AS uses_highly_nonstandard_key
    FROM (SELECT *, unnest(CASE WHEN key_cols IS NULL THEN [NULL] ELSE string_split(key_cols, '|') END) AS k FROM summary)
    GROUP BY snapshot, table_name"""


@query("nonstandard_keys", with_sql(STUDY_CTES, FLAGS))
def nonstandard_keys(spark, sf):
    return summary.nonstandard_keys(study_summary(spark, sf))


@query("per_snapshot_flags", with_sql(STUDY_CTES, f"""
    SELECT snapshot, table_name, success, uses_nonstandard_key, uses_highly_nonstandard_key
    FROM (SELECT DISTINCT snapshot, table_name, success FROM summary) FULL JOIN ({FLAGS}) USING (snapshot, table_name)"""))
def per_snapshot_flags(spark, sf):
    return summary.per_snapshot_flags(study_summary(spark, sf))


@query("imperfect_tables", with_sql(STUDY_CTES, """
    SELECT snapshot, table_name, success, error FROM summary WHERE table_name IN (
      SELECT table_name FROM summary GROUP BY 1 HAVING avg(CASE WHEN success THEN 1.0 ELSE 0.0 END) < 1.0)"""))
def imperfect_tables(spark, sf):
    return summary.imperfect_tables(study_summary(spark, sf)).select("snapshot", "table_name", "success", "error")
