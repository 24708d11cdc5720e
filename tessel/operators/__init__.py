"""Relational operators over DataFrames."""

from tessel.operators.dml import delete_rows, insert_rows, not_null, update_rows
from tessel.operators.relation import Relation, relation

__all__ = ["Relation", "delete_rows", "insert_rows", "not_null", "relation", "update_rows"]
