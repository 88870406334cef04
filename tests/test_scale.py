"""Hot keys: the work of one key is shared out, and the totals stay whole."""

import contextlib
import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelloom.operators import estimators, selection
from panelloom.operators.estimators import Spec
from panelloom.plans import tables as tb

N, HOT = 240_000, 7


@contextlib.contextmanager
def settings(spark, **values):
    names = {k.replace("__", "."): str(v) for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    """Orders and customers in the given layout; a third of all orders is one customer's."""
    folder = str(tmp_path_factory.mktemp("skewed"))
    ids = spark.range(0, N, 1, 8)
    day = F.date_add(F.lit(dt.date(1995, 1, 1)), (F.col("id") * 13 % 2400).cast("int")).cast("timestamp_ntz")
    ids.select(
        F.col("id").alias("o_orderkey"),
        F.when(F.col("id") % 3 == 0, HOT).otherwise(F.col("id") % 5000).cast("bigint").alias("o_custkey"),
        F.lit("O").alias("o_orderstatus"),
        (F.col("id") % 1000 / 100.0).alias("o_totalprice"),
        day.alias("o_orderdate"),
        F.lit("5-LOW").alias("o_orderpriority"),
    ).write.parquet(f"{folder}/orders.parquet")
    spark.range(5000).select(
        F.col("id").alias("c_custkey"), F.lit("c").alias("c_name"), (F.col("id") % 25).cast("int").alias("c_nationkey"),
        F.lit(0.0).alias("c_acctbal"), F.lit("BUILDING").alias("c_mktsegment"),
    ).write.parquet(f"{folder}/customer.parquet")
    return folder


def test_hot_key_of_a_large_join_is_split(spark, skewed):
    """With both sides too large to broadcast, the hot key's partition is read by many tasks."""
    with settings(
        spark,
        spark__sql__autoBroadcastJoinThreshold=-1,
        spark__sql__adaptive__autoBroadcastJoinThreshold=-1,
        spark__sql__adaptive__advisoryPartitionSizeInBytes="64KB",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="128KB",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor=2,
        spark__sql__shuffle__partitions=16,
    ):
        totals = tb.located_orders(spark, skewed).groupBy("entity").agg(F.sum("cents").alias("cents"), F.count(F.lit(1)).alias("n"))
        got = {r["entity"]: (r["cents"], r["n"]) for r in totals.collect()}
        assert "skew=true" in totals._jdf.queryExecution().executedPlan().toString()
    assert sum(n for _, n in got.values()) == N
    small = spark.read.parquet(f"{skewed}/orders.parquet")
    nation = F.col("o_custkey") % 25
    direct = small.groupBy(nation.cast("int").alias("e")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("c"))
    assert {r["e"]: r["c"] for r in direct.collect()} == {e: c for e, (c, _) in got.items()}


def test_small_dimension_is_broadcast_by_its_size(spark, skewed):
    text = tb.located_orders(spark, skewed)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text


def test_aggregates_combine_before_the_shuffle(spark, skewed):
    text = tb.monthly_values(spark, skewed)._jdf.queryExecution().executedPlan().toString()
    assert text.index("HashAggregate") < text.index("Exchange hashpartitioning") < text.index("partial_sum")


def test_first_rows_of_a_hot_group(spark, skewed):
    orders = spark.read.parquet(f"{skewed}/orders.parquet")
    first = selection.first_rows(orders, ["o_custkey"], [F.col("o_orderkey")], 2)
    assert [r["o_orderkey"] for r in first.where(F.col("o_custkey") == HOT).orderBy("o_orderkey").collect()] == [0, 3]
    assert first.count() == 2 * orders.select("o_custkey").distinct().count()


def test_sums_passed_on_do_not_grow_with_the_entities(spark):
    """Per task one row per specification and period, whatever the number of entities."""

    def passed(entities):
        rows = spark.range(0, entities, 1, 4).select(
            F.col("id").alias("e"), F.explode(F.sequence(F.lit(1), F.lit(6))).alias("period_idx")
        )
        rows = rows.withColumns({"y": F.rand(1), "x": F.rand(2)})
        products = estimators.period_products(rows, [Spec("s", "y", ("x",))], ["e"])
        return products.agg(F.count(F.lit(1)), F.sum("n")).first()

    assert tuple(passed(50)) == (6, 300) and tuple(passed(5000)) == (6, 30000)
