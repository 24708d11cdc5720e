"""Column helpers, all of built-in expressions, so that they stay inside generated code and are pushed down."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_SPACE = " \t\n\r\f\v"

#: SQL temporary functions: name -> (parameters, expression). They are inlined into the plan.
SQL_FUNCTIONS = {
    "t_length": ("s STRING", "CAST(length(s) AS BIGINT)"),
    "t_trim": ("s STRING", r"btrim(s, ' \t\n\r\f' || chr(11))"),
    "t_substring": ("s STRING, p BIGINT, n BIGINT", "CASE WHEN s IS NULL OR p < 1 OR n < 0 OR p IS NULL OR n IS NULL THEN NULL ELSE substring(s, CAST(least(p, 2147483647) AS INT), CAST(least(n, 2147483647) AS INT)) END"),
    "t_concat": ("parts ARRAY<STRING>", "CASE WHEN array_max(parts) IS NOT NULL THEN array_join(parts, '') END"),
}


def register_sql_functions(spark: SparkSession) -> None:
    """Registers SQL_FUNCTIONS, once a session."""
    if getattr(spark, "_tessel_functions", False):
        return
    spark._tessel_functions = True
    for name, (params, body) in SQL_FUNCTIONS.items():
        kind = "BIGINT" if name == "t_length" else "STRING"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {kind} RETURN {body}")


def register_scalar(spark: SparkSession, name: str, params: str, returns: str, expression: str) -> None:
    """A scalar function of the user's own, as a SQL expression over its parameters."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {returns} RETURN {expression}")


def length_chars(s: Column) -> Column:
    """Characters, as a long."""
    return F.length(s).cast("long")


def trim_space(s: Column) -> Column:
    """Without white space (space, tab, newline, return, form feed, vertical tab) at both ends."""
    return F.btrim(s, F.lit(_SPACE))


def substring_strict(s: Column, start: Column | int, n: Column | int | None = None) -> Column:
    """From the 1-based start; null for a start under 1 or a negative length, empty beyond the end."""
    start = F.lit(start) if isinstance(start, int) else start
    n = F.length(s) if n is None else F.lit(n) if isinstance(n, int) else n
    return F.when((start >= 1) & (n >= 0), F.substring(s, start, n))


def concat_skip_null(*parts: Column) -> Column:
    """All parts that aren't null, as text, one after the other; null if all are."""
    texts = [p.cast("string") for p in parts]
    return F.when(F.coalesce(*texts).isNotNull(), F.concat_ws("", *texts))


def round_double(x: Column, digits: int = 0) -> Column:
    """Half away from zero, as a double."""
    return F.round(x.cast("double"), digits)


def ceil_long(x: Column) -> Column:
    return F.ceil(x).cast("long")


def floor_long(x: Column) -> Column:
    return F.floor(x).cast("long")


def mod_null(n: Column, d: Column) -> Column:
    """The remainder with the dividend's sign; null for a zero divisor."""
    return F.try_mod(n, d)


def div_null(n: Column, d: Column) -> Column:
    """The quotient as a double; null for a zero divisor."""
    return F.try_divide(n.cast("double"), d.cast("double"))


def int_div_null(n: Column, d: Column) -> Column:
    """The quotient of whole numbers, cut towards zero; null for a zero divisor."""
    return F.when(d != 0, F.call_function("div", n, d))


def try_cast(x: Column, kind: str) -> Column:
    """Null for what can't be converted."""
    return x.try_cast(kind)


def order_key(c: Column | str, descending: bool = False) -> Column:
    """A sort key in which null is the greatest value."""
    c = F.col(c) if isinstance(c, str) else c
    return c.desc_nulls_first() if descending else c.asc_nulls_last()
