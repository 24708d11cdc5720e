"""Tables, configuration and result display."""

from tessel.sources.config import parse_config, read_config, spark_settings
from tessel.sources.display import format_table
from tessel.sources.warehouse import ConcurrentChange, TableExists, TableMissing, Warehouse

__all__ = ["ConcurrentChange", "TableExists", "TableMissing", "Warehouse", "format_table", "parse_config", "read_config", "spark_settings"]
