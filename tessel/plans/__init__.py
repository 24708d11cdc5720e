"""SQL statements over a warehouse, and the library's registered queries."""

from tessel.plans.engine import Engine, Outcome

__all__ = ["Engine", "Outcome"]
