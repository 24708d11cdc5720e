"""The chained operators, changes of rows, and streaming inserts."""

import pytest
from pyspark.sql import types as T

from tessel.operators import delete_rows, insert_rows, relation, update_rows
from tessel.sources import Warehouse
from tessel.streaming import insert_stream


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def sides(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d")], "id int, v string")
    right = spark.createDataFrame([(2, "x"), (2, "y"), (3, "z"), (None, "w")], "id int, v string")
    return relation(left, "l"), relation(right, "r")


def test_joins(sides):
    left, right = sides
    assert left.join(right, "l.id = r.id").df.count() == 4
    assert left.join(right, "l.id = r.id", "left").df.count() == 6
    assert left.join(right, "l.id = r.id", "right").df.count() == 6
    assert left.join(right, "l.id < r.id").df.count() == 5
    assert left.cross(right).df.count() == 16
    assert rows(left.join(right, "l.id = r.id").select("l.v", "r.v").distinct().df) == [("b", "x"), ("b", "y"), ("c", "x"), ("c", "y")]
    with pytest.raises(ValueError, match="join type"):
        left.join(right, "l.id = r.id", "full")


def test_group_order_limit(sides):
    left, _ = sides
    assert rows(left.group("id", n="count(*)").df) == [(1, 1), (2, 2), (None, 1)]
    assert rows(left.group("id", n="count(*)", having="n > 1").df) == [(2, 2)]
    assert rows(left.where("false").group(n="count(*)", s="sum(id)").df) == [(0, None)]
    assert [r.v for r in left.order(("id", "desc"), "v").limit(2, offset=1).df.collect()] == ["b", "c"]
    assert left.select().df.columns == ["id", "v"]


def test_changes(spark):
    t = spark.createDataFrame([(1, 2.0), (2, None)], "k int, v double")
    more = spark.createDataFrame([("5", 9)], "V string, K long")
    assert rows(insert_rows(t, more)) == [(1, 2.0), (2, None), (9, 5.0)]
    assert rows(update_rows(t, {"v": "k", "k": "k + 1"}, "v > 1")) == [(2, 1.0), (2, None)]
    assert rows(delete_rows(t, "v > 1")) == [(2, None)]
    assert rows(delete_rows(t)) == []
    with pytest.raises(ValueError, match="unknown"):
        update_rows(t, {"x": "1"})


def test_streaming_insert(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(10).selectExpr("cast(id as int) AS id").write.parquet(source)
    house = Warehouse(spark, str(tmp_path / "house"))
    house.create("s", T.StructType([T.StructField("id", T.IntegerType(), False)]))
    stream = spark.readStream.schema("id int").parquet(source)
    for _ in range(2):  # a second run finds nothing new
        insert_stream(stream, house, "s", str(tmp_path / "state")).awaitTermination()
    assert house.table("s").count() == 10


def test_plans_push_down_and_prune(spark):
    from tessel.plans.queries import QUERIES

    plan = QUERIES["filter_cmp"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull" in plan and "l_extendedprice" not in plan
    assert "TakeOrderedAndProject" in QUERIES["top_k"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
