"""Inserts, updates and deletes as functions from a table's rows to its next version's."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _hit(where: Column | str | None) -> Column:
    predicate = F.lit(True) if where is None else F.expr(where) if isinstance(where, str) else where
    return F.coalesce(predicate, F.lit(False))


def insert_rows(table: DataFrame, rows: DataFrame) -> DataFrame:
    """All rows of both; the new ones' columns are matched by name and cast to the table's types; absent ones are null."""
    have = {c.lower(): c for c in rows.columns}
    if unknown := set(have) - {c.lower() for c in table.columns}:
        raise ValueError(f"unknown columns: {sorted(unknown)}")
    cols = [(F.col(f"`{have[f.name.lower()]}`") if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in table.schema]
    return table.unionByName(rows.select(*cols))


def update_rows(table: DataFrame, assign: Mapping[str, Column | str], where: Column | str | None = None) -> DataFrame:
    """Rows that meet the predicate get new values, all computed from the old row; a null predicate doesn't hold."""
    names = {c.lower(): c for c in table.columns}
    if unknown := [c for c in assign if c.lower() not in names]:
        raise ValueError(f"unknown columns: {unknown}")
    new = {c.lower(): F.expr(e) if isinstance(e, str) else e for c, e in assign.items()}
    hit = _hit(where)
    cols = [F.when(hit, new[f.name.lower()].cast(f.dataType)).otherwise(F.col(f"`{f.name}`")).alias(f.name) if f.name.lower() in new else F.col(f"`{f.name}`") for f in table.schema]
    return table.select(*cols)


def delete_rows(table: DataFrame, where: Column | str | None = None) -> DataFrame:
    """Without the rows that meet the predicate; a null predicate keeps the row."""
    return table.where(~_hit(where))


def not_null(table: DataFrame, schema: StructType) -> DataFrame:
    """The same rows; evaluating one with a null in a column that the schema forbids it in raises an error."""
    def checked(name: str) -> Column:
        c = F.col(f"`{name}`")
        return F.when(c.isNull(), F.raise_error(F.lit(f"column {name} must not be null"))).otherwise(c).alias(name)

    return table.select(*(F.col(f"`{f.name}`") if f.nullable else checked(f.name) for f in schema))
