"""Scalar semantics on small frames."""

from itertools import product

import pytest
from pyspark.sql import functions as F

from tessel import functions as fn


def one(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_division_and_remainder(spark):
    rows = list(product([7, -7, 0, None], [0, 1, 3, -3, None]))
    df = spark.createDataFrame(rows, "n int, d int")
    n, d = F.col("n"), F.col("d")
    for a, b, mod, div, whole in one(df, n, d, fn.mod_null(n, d), fn.div_null(n, d), fn.int_div_null(n, d)):
        if a is None or not b:
            assert (mod, div, whole) == (None, None, None)
        else:
            assert whole == int(a / b) and mod == a - b * int(a / b) and div == pytest.approx(a / b)


def test_strings(spark):
    df = spark.createDataFrame([("",), (" \t x \n\v",), ("héé",), (None,)], "s string")
    s = F.col("s")
    got = one(df, fn.trim_space(s), fn.length_chars(s), fn.substring_strict(s, 2, 2), fn.substring_strict(s, 0, 2), fn.substring_strict(s, 1, -1), fn.substring_strict(s, 9, 1))
    assert got == [("", 0, "", None, None, ""), ("x", 7, "\t ", None, None, ""), ("héé", 3, "éé", None, None, ""), (None, None, None, None, None, None)]


def test_concat_skips_nulls(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), ("b", None), (None, None)], "s string, n int")
    assert [r[0] for r in one(df, fn.concat_skip_null(F.col("s"), F.col("n")))] == ["a1", "2", "b", None]


def test_rounding_is_half_away_from_zero(spark):
    df = spark.createDataFrame([(2.5,), (-2.5,), (1.25,), (None,)], "x double")
    x = F.col("x")
    assert one(df, fn.round_double(x), fn.round_double(x, 1), fn.ceil_long(x), fn.floor_long(x)) == [(3.0, 2.5, 3, 2), (-3.0, -2.5, -2, -3), (1.0, 1.3, 2, 1), (None, None, None, None)]


def test_null_is_the_greatest_key(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 1), (4, None)], "k int, v int")
    assert [r.k for r in df.orderBy(fn.order_key("v"), "k").collect()] == [3, 2, 1, 4]
    assert [r.k for r in df.orderBy(fn.order_key("v", True), "k").collect()] == [1, 4, 2, 3]


def test_registered_function_is_inlined(spark):
    fn.register_scalar(spark, "twice", "x INT", "INT", "x * 2")
    df = spark.range(3).selectExpr("twice(cast(id as int)) AS t")
    assert [r.t for r in df.collect()] == [0, 2, 4]
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_try_cast(spark):
    df = spark.createDataFrame([("12",), ("x",), (None,)], "s string")
    assert [r[0] for r in one(df, fn.try_cast(F.col("s"), "int"))] == [12, None, None]
