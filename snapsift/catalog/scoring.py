"""Queries for preprocessing, detectors, ensembles and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions.runtime import store_records
from ..operators import ensemble, guards, labels, metrics, preprocess, snapdiff
from ..operators.detectors import ann, ecod, hbos, iforest, loda, neighbors, ocsvm, pca, pool
from .registry import query, shared, with_sql


def raw_plates(spark, sf, rows=None):
    return preprocess.to_plates(
        fx.plate_table(spark, sf, rows), "dataset", "rec_id", "y", fx.PLATE_FEATURES
    )


def plates(spark, sf, joined=False):
    """Stored records of the plates, as detectors read them; they stay where their numbering has put them.

    ``joined`` ones are spread for joins with their scores.
    """
    rows = fx.load(spark, sf, "lineitem").count()

    def build():
        if joined:
            return store_records(preprocess.preprocess_plates(raw_plates(spark, sf)), rows)
        profile = preprocess.feature_profile(raw_plates(spark, sf))
        return store_records(preprocess.preprocess_plates(raw_plates(spark, sf, rows), profile=profile), rows, placed=True)

    return shared(spark, sf, "joined plates" if joined else "plates", build)


def scored(df, places=6):
    return df.withColumn("score", F.round("score", places))


CELLS = [fx.PLATE_CELLS_SQL]
VECTORS = [fx.VECTORS_SQL]


@query("guard_plate_size", with_sql([fx.PLATE_SQL], """
    SELECT dataset, count(*) AS n, CAST(5 AS BIGINT) AS num_columns FROM (
      SELECT dataset FROM plate UNION ALL SELECT 'tiny' FROM nation WHERE n_regionkey = 0)
    GROUP BY dataset HAVING count(*) >= 10"""))
def guard_plate_size(spark, sf):
    small = fx.load(spark, sf, "nation").filter("n_regionkey = 0").select(
        F.lit("tiny").alias("dataset"), F.col("n_nationkey").cast("long").alias("rec_id"),
        F.array_repeat(F.lit(1.0), 5).alias("values"), F.lit(0).alias("y"))
    profile = preprocess.feature_profile(raw_plates(spark, sf).unionByName(small))
    return preprocess.usable_datasets(profile).select(
        "dataset", "n", F.size("keep").cast("long").alias("num_columns"))


@query("impute_mode", with_sql(CELLS, "SELECT dataset, rec_id, value AS l_tax FROM cell WHERE pos = 3"))
def impute_mode(spark, sf):
    raw = raw_plates(spark, sf)
    filled = preprocess.impute_mode(raw, preprocess.feature_profile(raw))
    return filled.select("dataset", "rec_id", F.get("features", F.lit(3)).alias("l_tax"))


@query("preprocess_plate", with_sql(CELLS, "SELECT dataset, rec_id, CAST(pos AS INTEGER) AS pos, value FROM cell"))
def preprocess_plate(spark, sf):
    records = preprocess.preprocess_plates(raw_plates(spark, sf))
    return records.select("dataset", "rec_id", F.posexplode("features").alias("pos", "value"))


# --- detectors --------------------------------------------------------------------------

ECOD_SQL = with_sql(CELLS, """, shape AS (
      SELECT dataset, pos, count(*) AS n, skewness(value) AS skew FROM cell GROUP BY ALL),
    tails AS (SELECT c.dataset, c.pos, rec_id, skew, n,
        count(*) OVER (PARTITION BY c.dataset, c.pos ORDER BY value RANGE UNBOUNDED PRECEDING) AS le,
        count(*) OVER (PARTITION BY c.dataset, c.pos ORDER BY value DESC RANGE UNBOUNDED PRECEDING) AS ge
      FROM cell c JOIN shape s ON c.dataset = s.dataset AND c.pos = s.pos)
    SELECT dataset, rec_id, round(greatest(sum(-ln(le / CAST(n AS DOUBLE))), sum(-ln(ge / CAST(n AS DOUBLE))),
      sum(CASE WHEN skew < 0 THEN -ln(le / CAST(n AS DOUBLE)) ELSE -ln(ge / CAST(n AS DOUBLE)) END)), 6) AS score
    FROM tails GROUP BY dataset, rec_id""")


@query("score_ecod", ECOD_SQL)
def score_ecod(spark, sf):
    return scored(ecod.score_ecod(plates(spark, sf)))


def hbos_sql(n_bins, alpha, cells="cell"):
    return f""", lim AS (SELECT dataset, pos, min(value) AS lo, max(value) AS hi, count(*) AS n FROM {cells} GROUP BY ALL),
    binned AS (SELECT c.dataset, c.pos, rec_id, n, (hi - lo) / {n_bins} AS w,
        CASE WHEN hi > lo THEN CAST(least(floor((value - lo) / ((hi - lo) / {n_bins})), {n_bins} - 1) AS INTEGER) ELSE 0 END AS b
      FROM {cells} c JOIN lim ON c.dataset = lim.dataset AND c.pos = lim.pos),
    dens AS (SELECT dataset, pos, b, count(*) / (any_value(n) * any_value(w)) AS density FROM binned
      WHERE w > 0 GROUP BY dataset, pos, b),
    hbos AS (SELECT x.dataset, x.rec_id, sum(coalesce(-log2(density + {alpha}), 0)) AS score FROM binned x
      LEFT JOIN dens d ON x.dataset = d.dataset AND x.pos = d.pos AND x.b = d.b GROUP BY x.dataset, x.rec_id)"""


@query("score_hbos", with_sql(CELLS, "").rstrip() + hbos_sql(10, 0.1) + " SELECT dataset, rec_id, round(score, 6) AS score FROM hbos")
def score_hbos(spark, sf):
    return scored(hbos.score_hbos(plates(spark, sf)))


def knn_sql(k, distance="list_distance(a.x, b.x)"):
    return f""",
    pair AS (SELECT a.rec_id AS p, b.rec_id AS o, {distance} AS d FROM vec a JOIN vec b ON a.rec_id <> b.rec_id),
    nn AS (SELECT * FROM (SELECT p, o, d, row_number() OVER (PARTITION BY p ORDER BY d, o) AS r FROM pair) WHERE r <= {k})"""


@query("knn_graph", with_sql(VECTORS, "").rstrip() + knn_sql(10) + """
    SELECT 'vectors' AS dataset, p AS rec_id, r AS rank, o AS neighbor, round(d, 6) AS distance FROM nn""")
def knn_graph(spark, sf):
    graph = neighbors.knn_graph(fx.vectors(spark, sf), 10, block_rows=256)
    return graph.withColumn("distance", F.round("distance", 6))


#: The vectors have no structure that projections could find, so many neighbours are tried.
APPROXIMATE = ann.Approximation(near=30)


@query("knn_graph_approximate")
def knn_graph_approximate(spark, sf):
    graph = neighbors.knn_graph(fx.vectors(spark, sf), 10, approximate=APPROXIMATE)
    return graph.withColumn("distance", F.round("distance", 6))


@query("knn_graph_recall")
def knn_graph_recall(spark, sf):
    """Share of the exact graph that the approximate one finds, and the comparisons per point."""
    records = fx.vectors(spark, sf)
    graph = neighbors.knn_points(records, 10, approximate=APPROXIMATE)
    found = ann.recall(neighbors.neighbor_rows(graph), neighbors.knn_graph(records, 10, block_rows=256))
    tried = graph.candidates.groupBy("dataset").agg(F.max("n").alias("most_candidates"), F.avg("n").alias("mean_candidates"))
    return found.join(tried, "dataset").withColumn("bound", F.lit(APPROXIMATE.most_candidates()).cast("long"))


@query("score_knn", with_sql(VECTORS, "").rstrip() + knn_sql(5) + """
    SELECT 'vectors' AS dataset, p AS rec_id, round(max(d), 6) AS score FROM nn GROUP BY p""")
def score_knn(spark, sf):
    return scored(neighbors.score_knn(fx.vectors(spark, sf)))


LOF_SQL = """,
    kd AS (SELECT p, max(d) AS kd FROM nn GROUP BY p),
    lrd AS (SELECT nn.p, 1 / (avg(greatest(kd.kd, d)) + 1e-10) AS lrd FROM nn JOIN kd ON nn.o = kd.p GROUP BY nn.p)
    SELECT 'vectors' AS dataset, nn.p AS rec_id, round(avg(b.lrd) / any_value(a.lrd), 6) AS score
    FROM nn JOIN lrd a ON nn.p = a.p JOIN lrd b ON nn.o = b.p GROUP BY nn.p"""
MANHATTAN = "list_sum([abs(z[1] - z[2]) for z in list_zip(a.x, b.x)])"


@query("score_lof", with_sql(VECTORS, "").rstrip() + knn_sql(20) + LOF_SQL)
def score_lof(spark, sf):
    return scored(neighbors.score_lof(fx.vectors(spark, sf)))


@query("score_lof_manhattan", with_sql(VECTORS, "").rstrip() + knn_sql(10, MANHATTAN) + LOF_SQL)
def score_lof_manhattan(spark, sf):
    return scored(neighbors.score_lof(fx.vectors(spark, sf), 10, "manhattan"))


@query("score_abod", with_sql(VECTORS, "").rstrip() + knn_sql(5) + """,
    gap AS (SELECT p, r, [z[1] - z[2] for z in list_zip(b.x, a.x)] AS g, d * d AS s
            FROM nn JOIN vec a ON nn.p = a.rec_id JOIN vec b ON nn.o = b.rec_id),
    ang AS (SELECT a.p, list_inner_product(a.g, b.g) / (a.s * b.s) AS v
            FROM gap a JOIN gap b ON a.p = b.p AND a.r < b.r)
    SELECT 'vectors' AS dataset, p AS rec_id, round(-var_pop(v), 6) AS score FROM ang GROUP BY p""")
def score_abod(spark, sf):
    return scored(neighbors.score_abod(fx.vectors(spark, sf), 5))


def cof_sql(k):
    """Chains unrolled into one step per neighbour: nearest to the set, then of lower rank."""
    steps = ", set0 AS (SELECT DISTINCT p, p AS member FROM nn)"
    for i in range(1, k + 1):
        steps += f""",
    cand{i} AS (SELECT n.p, n.o, n.r, min(d.d) AS e FROM nn n JOIN set{i - 1} s ON n.p = s.p
      JOIN pair d ON d.p = s.member AND d.o = n.o
      WHERE NOT EXISTS (SELECT 1 FROM set{i - 1} x WHERE x.p = n.p AND x.member = n.o) GROUP BY n.p, n.o, n.r),
    pick{i} AS (SELECT p, o, e FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY e, r) AS t FROM cand{i}) WHERE t = 1),
    set{i} AS (SELECT * FROM set{i - 1} UNION ALL SELECT p, o FROM pick{i})"""
    terms = " UNION ALL ".join(f"SELECT p, {2 * (k + 1 - i)} / CAST({k * (k + 1)} AS DOUBLE) * e AS t FROM pick{i}" for i in range(1, k + 1))
    return steps + f""", ac AS (SELECT p, sum(t) AS ac FROM ({terms}) GROUP BY p)
    SELECT 'vectors' AS dataset, nn.p AS rec_id, round(any_value(a.ac) / avg(b.ac), 6) AS score
    FROM nn JOIN ac a ON nn.p = a.p JOIN ac b ON nn.o = b.p GROUP BY nn.p"""


@query("score_cof", with_sql(VECTORS, "").rstrip() + knn_sql(5) + cof_sql(5))
def score_cof(spark, sf):
    return scored(neighbors.score_cof(fx.vectors(spark, sf), 5))


@query("score_iforest")
def score_iforest(spark, sf):
    return scored(iforest.score_iforest(plates(spark, sf)))


def pca_sql(d):
    """The score over all components is the Mahalanobis distance of the z-scores, here by
    orthogonalising one feature after the other."""
    z = ", ".join(f"max(z) FILTER (pos = {i}) AS z{i}" for i in range(d))
    sql = f""", z AS (SELECT dataset, rec_id, pos, (value - avg(value) OVER w) / stddev_pop(value) OVER w AS z
      FROM cell WINDOW w AS (PARTITION BY dataset, pos)),
    o0 AS (SELECT *, z0 AS r0 FROM (SELECT dataset, rec_id, {z} FROM z GROUP BY ALL))"""
    for i in range(1, d):
        proj = " - ".join(f"avg(z{i} * r{j}) OVER w / avg(r{j} * r{j}) OVER w * r{j}" for j in range(i))
        sql += f""",
    o{i} AS (SELECT *, z{i} - {proj} AS r{i} FROM o{i - 1} WINDOW w AS (PARTITION BY dataset))"""
    total = " + ".join(f"r{i} * r{i} / avg(r{i} * r{i}) OVER w" for i in range(d))
    return sql + f""" SELECT dataset, rec_id, round({total}, 6) AS score FROM o{d - 1} WINDOW w AS (PARTITION BY dataset)"""


@query("score_pca", with_sql(CELLS, "").rstrip() + pca_sql(5))
def score_pca(spark, sf):
    return scored(pca.score_pca(plates(spark, sf)))


def _pair_records(spark, sf):
    """Two-feature records, for which the score has a closed form."""
    return fx.load(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("dataset"), F.col("o_orderkey").alias("rec_id"),
        F.array(F.col("o_totalprice"), F.col("o_custkey").cast("double")).alias("features"), F.lit(0).alias("y"))


@query("score_pca_pair", """
    WITH s AS (SELECT o_orderstatus AS dataset, avg(o_totalprice) AS m1, stddev_pop(o_totalprice) AS s1,
        avg(o_custkey) AS m2, stddev_pop(o_custkey) AS s2, corr(o_totalprice, o_custkey) AS r FROM orders GROUP BY 1),
    z AS (SELECT dataset, o_orderkey AS rec_id, (o_totalprice - m1) / s1 AS a, (o_custkey - m2) / s2 AS b, r
          FROM orders JOIN s ON o_orderstatus = dataset)
    SELECT dataset, rec_id, round((a * a - 2 * r * a * b + b * b) / (1 - r * r), 6) AS score FROM z""")
def score_pca_pair(spark, sf):
    return scored(pca.score_pca(_pair_records(spark, sf)))


def loda_sql(d, cuts, bins):
    u = lambda use: f"(CAST('0x' || substr(md5(cut || ':' || pos || ':{use}'), 1, 8) AS BIGINT) + 0.5) / 4294967296.0"
    return f""", grid AS (SELECT cut, pos, {u('pick')} AS pick, {u('r')} AS ur, {u('a')} AS ua
        FROM range({cuts}) c(cut), range({d}) p(pos)),
    weight AS (SELECT cut, pos, sqrt(-2 * ln(ur)) * cos(2 * pi() * ua) AS w
        FROM (SELECT *, row_number() OVER (PARTITION BY cut ORDER BY pick, pos) AS k FROM grid)
        WHERE k <= ceil(sqrt({d}))),
    proj AS (SELECT dataset, rec_id, cut, sum(value * w) AS z FROM cell JOIN weight USING (pos) GROUP BY ALL),
    lim AS (SELECT dataset, cut, min(z) AS lo, max(z) AS hi, count(*) AS n FROM proj GROUP BY ALL),
    binned AS (SELECT dataset, cut, rec_id, n,
        CAST(least(floor((z - lo) / ((hi - lo) / {bins})), {bins} - 1) AS INTEGER) AS b FROM proj JOIN lim USING (dataset, cut)),
    counted AS (SELECT dataset, cut, b, count(*) AS c FROM binned GROUP BY ALL)
    SELECT dataset, rec_id, round(avg(-ln(c / CAST(n AS DOUBLE))), 6) AS score
    FROM binned JOIN counted USING (dataset, cut, b) GROUP BY dataset, rec_id"""


@query("score_loda", with_sql([fx.VECTORS_SQL, """
    cell AS (SELECT 'vectors' AS dataset, rec_id, unnest(range(64)) AS pos, unnest(x) AS value FROM vec)"""], "").rstrip()
    + loda_sql(64, 100, 10))
def score_loda(spark, sf):
    return scored(loda.score_loda(fx.vectors(spark, sf)))


@query("score_ocsvm")
def score_ocsvm(spark, sf):
    return scored(ocsvm.score_ocsvm(plates(spark, sf)), 5)


#: One setting per kernel.
OCSVM_SETTINGS = [(0.5, "linear"), (0.3, "poly"), (0.1, "rbf"), (0.5, "rbf"), (0.5, "sigmoid")]


@query("ocsvm_gaps")
def ocsvm_gaps(spark, sf):
    """Duality gap of the one-class machines on every plate."""
    models = ocsvm.fit_ocsvm(plates(spark, sf), OCSVM_SETTINGS)
    return ocsvm.ocsvm_gaps(models, OCSVM_SETTINGS)


@query("score_candidate_pool")
def score_candidate_pool(spark, sf):
    return scored(pool.score_candidate_pool(fx.vectors(spark, sf)), 5)


SMALL_POOL = {
    "HBOS": {"n_bins": [5, 20], "alpha": [0.1, 0.5]},
    "KNN": {"method": ["largest", "mean", "median"], "n_neighbors": [5, 10]},
}


@query("score_pool_closed_form", with_sql([fx.VECTORS_SQL, """
    cell AS (SELECT 'vectors' AS dataset, rec_id, unnest(range(64)) AS pos, unnest(x) AS value FROM vec)"""], "").rstrip()
    + knn_sql(10) + "".join(
        hbos_sql(b, a).replace("lim ", f"lim{b}{i} ").replace("lim.", f"lim{b}{i}.").replace("binned", f"binned{b}{i}")
        .replace("dens ", f"dens{b}{i} ").replace("hbos AS", f"hbos{b}{i} AS")
        for b in (5, 20) for i, a in enumerate((0.1, 0.5)))
    + " UNION ALL ".join(
        [f" SELECT dataset, rec_id, 'HBOS(alpha={a}, n_bins={b})' AS algorithm, round(score, 6) AS score FROM hbos{b}{i}"
         for b in (5, 20) for i, a in enumerate((0.1, 0.5))]
        + [f"""SELECT 'vectors', p, 'KNN(method={m}, n_neighbors={k})', round({fn}(d), 6) FROM nn WHERE r <= {k} GROUP BY p"""
           for m, fn in (("largest", "max"), ("mean", "avg"), ("median", "median")) for k in (5, 10)]))
def score_pool_closed_form(spark, sf):
    return scored(pool.score_candidate_pool(fx.vectors(spark, sf), SMALL_POOL))


@query("score_all")
def score_all(spark, sf):
    return scored(pool.score_all(plates(spark, sf)), 5)


# --- ensembles --------------------------------------------------------------------------


def three_scores(spark, sf):
    """Three simple scores per document; one has infinite, one constant values."""
    docs = fx.load(spark, sf, "documents").select(
        F.col("lang").alias("dataset"), F.col("doc_id").alias("rec_id"),
        F.col("n_chars").cast("double").alias("A"),
        F.when(F.col("n_chars") > 3000, F.lit(float("inf"))).otherwise(F.length("text") / 7).alias("B"),
        F.lit(2.0).alias("C"),
    )
    return docs.unpivot(["dataset", "rec_id"], ["A", "B", "C"], "algorithm", "score")


THREE_SQL = """
    raw AS (
      SELECT lang AS dataset, doc_id AS rec_id, 'A' AS algorithm, CAST(n_chars AS DOUBLE) AS s FROM documents
      UNION ALL SELECT lang, doc_id, 'B', CASE WHEN n_chars > 3000 THEN NULL ELSE length(text) / 7.0 END FROM documents
      UNION ALL SELECT lang, doc_id, 'C', 2.0 FROM documents),
    lim AS (SELECT dataset, algorithm, min(s) AS lo, max(s) AS hi FROM raw GROUP BY ALL),
    pruned AS (SELECT dataset, rec_id, algorithm, coalesce(s, hi) AS s, lo, hi FROM raw JOIN lim USING (dataset, algorithm)),
    scaled AS (SELECT dataset, rec_id, algorithm, CASE WHEN hi > lo THEN (s - lo) / (hi - lo) ELSE 0.0 END AS s FROM pruned)"""


@query("prune_inf", with_sql([THREE_SQL], "SELECT dataset, rec_id, algorithm, round(s, 6) AS score FROM pruned"))
def prune_inf(spark, sf):
    return scored(ensemble.prune_inf(three_scores(spark, sf)))


@query("minmax_scores", with_sql([THREE_SQL], "SELECT dataset, rec_id, algorithm, round(s, 6) AS score FROM scaled"))
def minmax_scores(spark, sf):
    return scored(ensemble.minmax_scores(three_scores(spark, sf)))


@query("naive_ensemble", with_sql([THREE_SQL], "SELECT dataset, rec_id, round(avg(s), 6) AS score FROM pruned GROUP BY ALL"))
def naive_ensemble(spark, sf):
    return scored(ensemble.naive_ensemble(three_scores(spark, sf)))


@query("probabilistic_ensemble", with_sql([THREE_SQL], "SELECT dataset, rec_id, round(avg(s), 6) AS score FROM scaled GROUP BY ALL"))
def probabilistic_ensemble(spark, sf):
    return scored(ensemble.probabilistic_ensemble(three_scores(spark, sf)))


def predictions(spark, sf):
    """A predicted performance per (dataset, algorithm), from the label share by source."""
    docs = fx.load(spark, sf, "documents")
    return docs.groupBy(F.col("lang").alias("dataset")).agg(
        F.avg((F.col("source") == "src0").cast("double")).alias("A"),
        F.avg((F.col("source") == "src1").cast("double")).alias("B"),
        F.avg((F.col("source") == "src2").cast("double")).alias("C"),
    ).unpivot("dataset", ["A", "B", "C"], "algorithm", "predicted")


PREDICTED_SQL = """
    predicted AS (SELECT dataset, algorithm, row_number() OVER (PARTITION BY dataset ORDER BY p DESC, algorithm) AS r
      FROM (SELECT lang AS dataset, 'A' AS algorithm, avg(CASE WHEN source = 'src0' THEN 1.0 ELSE 0.0 END) AS p FROM documents GROUP BY 1
      UNION ALL SELECT lang, 'B', avg(CASE WHEN source = 'src1' THEN 1.0 ELSE 0.0 END) FROM documents GROUP BY 1
      UNION ALL SELECT lang, 'C', avg(CASE WHEN source = 'src2' THEN 1.0 ELSE 0.0 END) FROM documents GROUP BY 1))"""


@query("topk_ensemble", with_sql([THREE_SQL, PREDICTED_SQL], """
    SELECT dataset, rec_id, round(avg(s), 6) AS score FROM scaled JOIN predicted USING (dataset, algorithm)
    WHERE r <= 2 GROUP BY ALL"""))
def topk_ensemble(spark, sf):
    from ..operators import selector

    chosen = selector.top_models(predictions(spark, sf), 2)
    return scored(ensemble.topk_ensemble(three_scores(spark, sf), chosen))


@query("selected_model_scores", with_sql([THREE_SQL, PREDICTED_SQL], """
    SELECT dataset, rec_id, round(s, 6) AS score FROM pruned JOIN predicted USING (dataset, algorithm) WHERE r = 1"""))
def selected_model_scores(spark, sf):
    from ..operators import selector

    best = selector.top_models(predictions(spark, sf), 1)
    return scored(ensemble.selected_model_scores(ensemble.prune_inf(three_scores(spark, sf)), best))


# --- metrics ----------------------------------------------------------------------------

AUROC_SQL = fx.DOCUMENT_SCORES_SQL + """,
    ranked AS (SELECT *, rank() OVER (PARTITION BY dataset ORDER BY score)
        + (count(*) OVER (PARTITION BY dataset, score) - 1) / 2.0 AS r FROM scored),
    auc AS (SELECT dataset, algorithm, count(*) AS n, CAST(sum(y) AS DOUBLE) AS n1, count(*) - CAST(sum(y) AS DOUBLE) AS n0,
        (sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) AS a
        FROM ranked GROUP BY ALL),
    se AS (SELECT *, sqrt((a * (1 - a) + (n1 - 1) * (a / (2 - a) - a * a) + (n0 - 1) * (2 * a * a / (1 + a) - a * a)) / (n1 * n0)) AS se
        FROM auc)"""


def doc_scores(spark, sf):
    return fx.document_scores(spark, sf)


@query("clean_scores", with_sql([fx.DOCUMENT_SCORES_SQL], """
    SELECT dataset, rec_id, CASE WHEN score > 2000 THEN (SELECT max(score) FROM scored z WHERE z.dataset = s.dataset AND score <= 2000)
      ELSE score END AS score FROM scored s"""))
def clean_scores(spark, sf):
    broken = doc_scores(spark, sf).withColumn(
        "score", F.when(F.col("score") > 2000, float("inf")).otherwise(F.col("score")))
    return metrics.clean_scores(broken).select("dataset", "rec_id", "score")


@query("auroc", with_sql([AUROC_SQL], "SELECT dataset, algorithm, round(a, 9) AS auroc FROM auc"))
def auroc(spark, sf):
    return metrics.auroc(doc_scores(spark, sf)).withColumn("auroc", F.round("auroc", 9))


def _ci(df):
    return df.withColumns({c: F.round(c, 9) for c in ("auroc", "auroc_lower", "auroc_upper")})


def ci_sql(z):
    return with_sql([AUROC_SQL], f"""SELECT dataset, algorithm, round(a, 9) AS auroc,
        round(greatest(a - {z} * se, 0), 9) AS auroc_lower, round(least(a + {z} * se, 1), 9) AS auroc_upper FROM se""")


@query("auroc_ci", ci_sql(1.9599639845400545))
def auroc_ci(spark, sf):
    return _ci(metrics.auroc_ci(doc_scores(spark, sf)))


@query("auroc_ci_corrected", ci_sql(2.638257273476751))
def auroc_ci_corrected(spark, sf):
    return _ci(metrics.auroc_ci_corrected(doc_scores(spark, sf), 6))


@query("average_precision", with_sql([fx.DOCUMENT_SCORES_SQL], """,
    g AS (SELECT dataset, algorithm, score, count(*) AS c, sum(y) AS p FROM scored GROUP BY ALL),
    run AS (SELECT *, sum(c) OVER w AS cc, sum(p) OVER w AS cp, sum(p) OVER (PARTITION BY dataset) AS tp FROM g
      WINDOW w AS (PARTITION BY dataset ORDER BY score DESC))
    SELECT dataset, algorithm, round(sum(p / CAST(tp AS DOUBLE) * cp / cc), 9) AS aupr FROM run GROUP BY ALL"""))
def average_precision(spark, sf):
    return metrics.average_precision(doc_scores(spark, sf)).withColumn("aupr", F.round("aupr", 9))


@query("anomaly_profile", with_sql([fx.PLATE_SQL], """
    SELECT dataset, count(*) AS num_samples, CAST(5 AS BIGINT) AS num_columns, CAST(sum(y) AS BIGINT) AS num_anomalies,
           round(avg(y), 9) AS anomaly_proportion FROM plate GROUP BY dataset"""))
def anomaly_profile(spark, sf):
    return metrics.anomaly_profile(plates(spark, sf)).withColumn(
        "anomaly_proportion", F.round("anomaly_proportion", 9))


EVALUATE_SQL = with_sql(CELLS, "").rstrip() + "".join(
    hbos_sql(b, 0.1).replace("lim ", f"lim{b} ").replace("lim.", f"lim{b}.").replace("binned", f"binned{b}")
    .replace("dens ", f"dens{b} ").replace("hbos AS", f"hbos{b} AS") for b in (10, 20)) + """,
    s AS (SELECT dataset, rec_id, 'n_bins=10' AS params, round(score, 9) AS score FROM hbos10
      UNION ALL SELECT dataset, rec_id, 'n_bins=20', round(score, 9) FROM hbos20),
    scored AS (SELECT s.*, y FROM s JOIN plate USING (dataset, rec_id)),
    ranked AS (SELECT *, rank() OVER (PARTITION BY dataset, params ORDER BY score)
        + (count(*) OVER (PARTITION BY dataset, params, score) - 1) / 2.0 AS r FROM scored),
    auc AS (SELECT dataset, params, count(*) AS n, CAST(sum(y) AS DOUBLE) AS n1, count(*) - CAST(sum(y) AS DOUBLE) AS n0,
        (sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0) / (CAST(sum(y) AS DOUBLE) * (count(*) - sum(y))) AS a
        FROM ranked GROUP BY ALL),
    se AS (SELECT *, sqrt((a * (1 - a) + (n1 - 1) * (a / (2 - a) - a * a) + (n0 - 1) * (2 * a * a / (1 + a) - a * a)) / (n1 * n0)) AS se
        FROM auc),
    g AS (SELECT dataset, params, score, count(*) AS c, sum(y) AS p FROM scored GROUP BY ALL),
    run AS (SELECT *, sum(c) OVER w AS cc, sum(p) OVER w AS cp, sum(p) OVER (PARTITION BY dataset, params) AS tp FROM g
      WINDOW w AS (PARTITION BY dataset, params ORDER BY score DESC)),
    ap AS (SELECT dataset, params, sum(p / CAST(tp AS DOUBLE) * cp / cc) AS aupr FROM run GROUP BY ALL)
    SELECT dataset, n AS num_samples, CAST(5 AS BIGINT) AS num_columns, CAST(n1 AS BIGINT) AS num_anomalies,
      round(n1 / n, 6) AS anomaly_proportion, 'HBOS' AS algorithm, params, round(a, 6) AS auroc,
      round(greatest(a - 1.9599639845400536 * se, 0), 6) AS auroc_lower, round(least(a + 1.9599639845400536 * se, 1), 6) AS auroc_upper,
      round(greatest(a - 2.241402727604945 * se, 0), 6) AS auroc_lower_corrected,
      round(least(a + 2.241402727604945 * se, 1), 6) AS auroc_upper_corrected, round(aupr, 6) AS aupr
    FROM se JOIN ap USING (dataset, params)"""


@query("evaluate_scores", EVALUATE_SQL)
def evaluate_scores(spark, sf):
    records = plates(spark, sf, joined=True)
    scores = scored(pool.score_all(records, {"HBOS": {"n_bins": [10, 20]}}), 9)
    rows = metrics.evaluate_scores(scores, records, 2).drop("error")
    return rows.withColumns({c: F.round(c, 6) for c, t in rows.dtypes if t == "double"})


@query("evaluate_detectors")
def evaluate_detectors(spark, sf):
    from ..plans import evaluation

    return evaluation.evaluate_detectors(plates(spark, sf, joined=True))


# --- flagship: diff, labels, score, metric in one question --------------------------------


def order_records(spark, sf):
    """Orders of the first export with their later-corrected label and numeric features."""
    pre = guards.cast_typed(guards.prune_columns(fx.orders_snapshot(spark, sf, 1)))
    diff = snapdiff.compute_table_diff(fx.orders_snapshot(spark, sf, 1), fx.orders_gold(spark, sf))
    labelled = labels.derive_table_labels(pre, diff.cells, diff.key)
    return labelled.select(
        F.lit("orders").alias("dataset"), F.col("id").cast("long").alias("rec_id"),
        F.array(F.col("o_custkey").cast("double"), F.col("o_totalprice")).alias("features"),
        F.col("any_change").cast("int").alias("y"),
    )


@query("flagship", with_sql([fx.ORDERS_SQL, fx.orders_sql(1), """
    rec AS (SELECT CAST(p.id AS BIGINT) AS rec_id, CAST(p.o_custkey AS DOUBLE) AS f0, p.o_totalprice AS f1,
        CASE WHEN g.id IS NOT NULL AND p.o_totalprice IS DISTINCT FROM g.o_totalprice THEN 1 ELSE 0 END AS y
        FROM pre p LEFT JOIN gold g ON p.id = g.id AND p.centre = g.centre)""", """
    cell AS (SELECT 'orders' AS dataset, rec_id, 0 AS pos, f0 AS value FROM rec
        UNION ALL SELECT 'orders', rec_id, 1, f1 FROM rec)"""], "").rstrip() + hbos_sql(10, 0.1) + """,
    ranked AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r
        FROM (SELECT y, round(score, 9) AS score FROM hbos JOIN rec USING (rec_id)))
    SELECT 'orders' AS dataset, 'HBOS' AS algorithm, round((sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0)
        / (sum(y) * (count(*) - sum(y))), 6) AS auroc FROM ranked""")
def flagship(spark, sf):
    records = store_records(order_records(spark, sf), fx.load(spark, sf, "orders").count())
    scores = hbos.score_hbos(records).withColumn("score", F.round("score", 9))
    joined = scores.withColumn("algorithm", F.lit("HBOS")).join(
        records.select("dataset", "rec_id", "y"), ["dataset", "rec_id"])
    return metrics.auroc(joined).withColumn("auroc", F.round("auroc", 6))
