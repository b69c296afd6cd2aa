"""Plates are moved once, by the id that numbers them."""

from snapsift.catalog import registry
from snapsift.catalog import scoring
from snapsift.functions import runtime
from snapsift.operators import preprocess


def test_placed_records_are_not_spread_again(spark):
    rows = spark.range(0, 1000, 1, 3).selectExpr("'a' as dataset", "id as rec_id", "array(id * 1.0D) as features")
    placed = runtime.spread(rows, ["rec_id"], 1000)
    stored = runtime.store_records(placed, 1000, placed=True)
    where = lambda df: {(r[0], r[1]) for r in df.selectExpr("rec_id", "spark_partition_id()").collect()}
    assert where(stored) == where(placed)
    assert stored.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_plates_move_once(spark, sf, monkeypatch):
    registry.forget_shared()
    plans, settle = [], runtime.settle
    monkeypatch.setattr(runtime, "settle", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or settle(df))
    scoring.plates(spark, sf)
    registry.forget_shared()
    assert len(plans) == 1 and plans[0].count("Exchange hashpartitioning") == 1


def test_plates_are_those_of_one_frame(spark, sf):
    registry.forget_shared()
    rows = lambda df: sorted(map(repr, df.select("dataset", "rec_id", "features", "y").collect()))
    assert rows(scoring.plates(spark, sf)) == rows(preprocess.preprocess_plates(scoring.raw_plates(spark, sf)))


def test_joined_plates_are_spread_for_joins(spark, sf):
    registry.forget_shared()

    def by_record(records):
        n = records.rdd.getNumPartitions()
        return records.filter(f"spark_partition_id() <> pmod(hash(dataset, rec_id), {n})").isEmpty()

    assert by_record(scoring.plates(spark, sf, joined=True)) and not by_record(scoring.plates(spark, sf))
    registry.forget_shared()
