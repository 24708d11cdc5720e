"""Results as boxed text."""

from __future__ import annotations

from pyspark.sql import DataFrame


def _text(x: object) -> str:
    return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x)


def format_table(df: DataFrame, most_rows: int | None = None) -> str:
    """A header, all rows of the result or the first most_rows, and how many there are; cells are left-justified."""
    shown = df if most_rows is None else df.limit(most_rows + 1)
    rows = [[_text(x) for x in r] for r in shown.toLocalIterator()]
    n = len(rows)
    if most_rows is not None and n > most_rows:
        rows, n = rows[:most_rows], df.count()
    widths = [max(len(x) for x in col) for col in zip(df.columns, *rows, strict=True)]
    rule = "+" + "+".join("-" * (w + 2) for w in widths) + "+"

    def line(cells: list[str]) -> str:
        return "|" + "|".join(f" {c:<{w}} " for c, w in zip(cells, widths, strict=True)) + "|"

    counted = f"({n} row{'s' * (n != 1)})" if n == len(rows) else f"(first {len(rows)} of {n} rows)"
    return "\n".join([rule, line(df.columns), rule, *(line(r) for r in rows), *([rule] if rows else []), counted])
