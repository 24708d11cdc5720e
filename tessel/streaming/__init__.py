"""Incremental loading of warehouse tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tessel.sources.warehouse import Warehouse


def insert_stream(rows: DataFrame, warehouse: Warehouse, table: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Inserts each micro-batch of a streaming DataFrame into a table, with the checks of any insert.

    The table's manifest records the last batch of each checkpoint, so a batch that is run again after a failure is inserted once.
    """

    def insert(batch: DataFrame, number: int) -> None:
        warehouse.insert(table, batch, (checkpoint, number))

    writer = rows.writeStream.foreachBatch(insert).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
