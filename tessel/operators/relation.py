"""A SELECT as a chain of calls; each step only extends a DataFrame's logical plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.functions import order_key


def _column(x: Column | str) -> Column:
    return F.expr(x) if isinstance(x, str) else x


@dataclass(frozen=True)
class Relation:
    """Clauses apply in the order FROM, WHERE, GROUP BY, HAVING, SELECT, DISTINCT, ORDER BY, LIMIT."""

    df: DataFrame

    def select(self, *items: Column | str) -> Relation:
        return Relation(self.df.select("*" if not items else [_column(i) for i in items][0], *[_column(i) for i in items][1:]) if items else self.df)

    def where(self, predicate: Column | str) -> Relation:
        """Rows for which the predicate is true; null rejects."""
        return Relation(self.df.where(predicate))

    def alias(self, name: str) -> Relation:
        return Relation(self.df.alias(name))

    def cross(self, other: Relation) -> Relation:
        return Relation(self.df.crossJoin(other.df))

    def join(self, other: Relation, on: Column | str, how: str = "inner") -> Relation:
        """how: inner, left or right; any boolean condition. Physical strategy is left to the optimiser."""
        if how not in ("inner", "left", "right"):
            raise ValueError(f"unknown join type {how}")
        return Relation(self.df.join(other.df, _column(on), how))

    def group(self, *keys: Column | str, having: Column | str | None = None, **aggregates: Column | str) -> Relation:
        """One row per key (nulls are one key), or one row in all without keys; `having` sees the aggregates' names."""
        columns = [_column(a).alias(name) for name, a in aggregates.items()]
        df = self.df.groupBy(*[_column(k) for k in keys]).agg(*columns)
        return Relation(df if having is None else df.where(having))

    def distinct(self) -> Relation:
        return Relation(self.df.distinct())

    def order(self, *keys: Column | str | tuple[Column | str, str]) -> Relation:
        """Keys are columns, or (column, "desc"); null is the greatest value."""
        sort = [order_key(*((k[0], k[1].lower() == "desc") if isinstance(k, tuple) else (k,))) for k in keys]
        return Relation(self.df.orderBy(*sort))

    def limit(self, n: int, offset: int = 0) -> Relation:
        return Relation((self.df.offset(offset) if offset else self.df).limit(n))


def relation(df: DataFrame, alias: str | None = None) -> Relation:
    return Relation(df.alias(alias) if alias else df)
