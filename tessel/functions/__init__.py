"""Scalar functions whose meaning differs from Spark's built-in ones."""

from tessel.functions.scalar import (
    SQL_FUNCTIONS,
    ceil_long,
    concat_skip_null,
    div_null,
    floor_long,
    int_div_null,
    length_chars,
    mod_null,
    order_key,
    register_scalar,
    register_sql_functions,
    round_double,
    substring_strict,
    trim_space,
    try_cast,
)

__all__ = [
    "SQL_FUNCTIONS", "ceil_long", "concat_skip_null", "div_null", "floor_long", "int_div_null", "length_chars", "mod_null", "order_key", "register_scalar",
    "register_sql_functions", "round_double", "substring_strict", "trim_space", "try_cast",
]
