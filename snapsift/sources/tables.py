"""Readers and writers of the study's tables."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import StudyConfig, TableFailure

SUFFIXES = r"\.(parquet|orc|csv|json|sas7bdat)(\.gz)?$"
LONG_LIMIT = float(2**63)

COMPARISON_SCHEMA = (
    "plate string, num_samples long, num_columns long, num_anomalies long, "
    "anomaly_proportion double, algorithm string, hyperparameters string, auroc double, "
    "auroc_lower double, auroc_upper double, auroc_lower_corrected double, "
    "auroc_upper_corrected double, aupr double, error string, snapshot string"
)


def normalise_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def integral_to_long(df: DataFrame) -> DataFrame:
    """Make floating columns long when every value is a whole number (one aggregate)."""
    floating = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    if not floating:
        return df
    def whole(c):
        x = F.col(f"`{c}`")
        return F.isnull(x) | ((x == F.floor(x)) & (F.abs(x) < LONG_LIMIT))
    flags = df.agg(*[F.bool_and(whole(c)).alias(c) for c in floating]).first()
    return df.withColumns({c: F.col(f"`{c}`").cast("long") for c in floating if flags[c]})


def read_snapshot_table(
    spark: SparkSession, path: str, fmt: str = "parquet", infer_long: bool = True, **options
) -> DataFrame:
    """Read one snapshot table with lower-case names and whole numbers as long."""
    try:
        df = normalise_names(spark.read.format(fmt).options(**options).load(path))
    except Exception as error:
        raise TableFailure("DataFrameLoadingException") from error
    return integral_to_long(df) if infer_long else df


def list_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """``(file)``: first path step below ``root`` of every file (no content is read)."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    )
    return files.select(first_step("path", qualified(spark, root)).alias("file")).filter(F.col("file") != "").distinct()


def qualified(spark: SparkSession, root: str) -> str:
    """``root`` as its file system writes it in the paths of files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def first_step(path: str, root: str) -> F.Column:
    """First step of a path below ``root``, which is a literal prefix of it."""
    return F.when(F.col(path).startswith(root + "/"), F.split_part(F.expr(f"substring({path}, {len(root) + 2})"), F.lit("/"), F.lit(1)))


def pair_snapshot_tables(pre: DataFrame, gold: DataFrame) -> DataFrame:
    """Match listed table files by table name, plain file before compressed one.

    ``table_name`` is the file name up to its first dot; a table without a gold file
    carries ``GoldStandardTableNotFound``.
    """
    def named(listing):
        return listing.filter(F.col("file").rlike(SUFFIXES)).select(
            F.split("file", r"\.").getItem(0).alias("table_name"), "file"
        )
    best = named(gold).groupBy("table_name").agg(
        F.min_by("file", F.struct(F.col("file").rlike(r"\.gz$"), F.col("file"))).alias("gold_file")
    )
    return named(pre).withColumnRenamed("file", "preliminary_file").join(best, "table_name", "left").withColumn(
        "error", F.when(F.col("gold_file").isNull(), "GoldStandardTableNotFound")
    )


def valid_tables(
    metadata: DataFrame | None, column: str = "SAS libraries", all_tables: DataFrame | None = None
) -> DataFrame:
    """Distinct table names of the study's table list; without one, all tables."""
    if metadata is None:
        if all_tables is None:
            raise TableFailure("MetadataUnavailable")
        return all_tables.select("table_name").distinct()
    return metadata.select(F.col(f"`{column}`").alias("table_name")).distinct()


def read_metadata(spark: SparkSession, study: StudyConfig) -> DataFrame | None:
    """The table-name column of the study's table list; None when the study has none.

    In a CSV file the column names stand in line ``metadata_header`` (counted from zero);
    lines before it are titles.
    """
    if study.metadata_unavailable or not study.metadata_filename:
        return None
    path = f"{study.root}/{study.metadata_filename}"
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    # the head of the sheet: header offset + 1 lines
    head = [r["value"] for r in spark.read.text(path).limit(study.metadata_header + 1).collect()]
    rows = list(csv.reader(head))
    position = rows[-1].index(study.metadata_column)
    names = [f"c{i}" for i in range(len(rows[-1]))]
    # titles and heading go by their line, so a table may bear the same name as a title
    lines = spark.read.text(path).rdd.zipWithIndex().filter(lambda x: x[1] > study.metadata_header).map(lambda x: x[0]["value"])
    body = spark.read.schema(", ".join(f"{n} string" for n in names)).csv(lines)
    column = F.col(names[position])
    return body.filter(column.isNotNull()).select(column.alias(study.metadata_column))


def write_diff(cells: DataFrame, path: str) -> None:
    cells.write.mode("overwrite").partitionBy("snapshot", "table_name").parquet(path)


def read_diff(spark: SparkSession, path: str, snapshot: str | None = None, table: str | None = None) -> DataFrame:
    """Read diffs back; a snapshot or table name prunes partitions."""
    df = spark.read.schema(
        "trial string, key array<string>, diff string, column string, left string, right string, "
        "snapshot string, table_name string"
    ).parquet(path)
    if snapshot is not None:
        df = df.filter(F.col("snapshot") == snapshot)
    return df.filter(F.col("table_name") == table) if table is not None else df


def write_labelled(labelled: DataFrame, path: str) -> None:
    """Store labelled records, partitioned by snapshot."""
    labelled.write.mode("overwrite").partitionBy("snapshot").parquet(path)


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """Labelled records with the detection target ``y``."""
    return spark.read.parquet(path).withColumn("y", F.col("any_change").cast("int"))


def write_features(records: DataFrame, path: str) -> None:
    """Store preprocessed ``(dataset, rec_id, features, y)``.

    Rows are spread by dataset and record, so a large dataset fills many files.
    """
    records.select("dataset", "rec_id", "features", "y").write.mode("overwrite").parquet(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("dataset string, rec_id long, features array<double>, y int").parquet(path)


def tag_comparisons(parts: dict[str, DataFrame]) -> DataFrame:
    """Union of comparison rows, each tagged with its snapshot."""
    tagged = [df.withColumn("snapshot", F.lit(name)) for name, df in parts.items()]
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def write_comparisons(df: DataFrame, path: str) -> None:
    """Store comparison rows as CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_trial_comparisons(df: DataFrame, root: str) -> None:
    """Store comparison rows as CSV, one folder per trial, in one write."""
    df.write.mode("overwrite").partitionBy("trial").option("header", True).csv(root)


def read_comparisons(spark: SparkSession, root: str, schema: str = COMPARISON_SCHEMA) -> DataFrame:
    """Read a folder of comparison CSVs; the trial is the file or folder stem below it."""
    df = (
        spark.read.schema(schema).option("header", True).option("recursiveFileLookup", "true").csv(root)
    )
    df = df.withColumn("_path", F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))))
    step = first_step("_path", qualified(spark, root))
    return df.withColumn("trial", F.regexp_extract(step, r"^(?:trial=)?([^.]+)", 1)).drop("_path")


def write_metafeatures(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def cached_metafeatures(wanted: DataFrame, cache: DataFrame, compute) -> DataFrame:
    """Vectors of the ``wanted`` datasets: from ``cache`` where present, else computed.

    ``compute`` gets the missing dataset keys and returns rows in the cache's schema.
    """
    hits = cache.join(wanted.select("dataset").distinct(), "dataset", "left_semi")
    misses = wanted.select("dataset").distinct().join(cache, "dataset", "left_anti")
    return hits.unionByName(compute(misses).select(*hits.columns))


def write_summary(matrix: DataFrame, path: str) -> None:
    """Store the status matrix as CSV; arrays become text."""
    flat = [
        F.array_join(c, " ").alias(c) if t.startswith("array") else F.col(f"`{c}`")
        for c, t in matrix.dtypes
    ]
    matrix.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def report_table(df: DataFrame, places: int, marker: str = "-") -> DataFrame:
    """Numbers as text with fixed decimals, missing values as ``marker``."""
    def shown(field):
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = F.format_string(f"%.{places}f", c)
            c = F.when(F.col(f"`{field.name}`").isNotNull(), c)
        return F.coalesce(c.cast("string"), F.lit(marker)).alias(field.name)
    return df.select(*[shown(f) for f in df.schema.fields])


#: Decimal places of the three report tables: best algorithm, study summary, trial means.
REPORT_PLACES = {"best_by_trial_snapshot": 2, "trial_summary": 1, "trial_algorithm_means": 3}


def report_tables(tables: dict[str, DataFrame], root: str) -> None:
    for name, df in tables.items():
        report_table(df, REPORT_PLACES[name]).write.mode("overwrite").option("header", True).csv(f"{root}/{name}")
