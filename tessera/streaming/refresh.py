"""Recomputes the dates that a stream of factor cells touches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter


def refresh_on_arrival(cells: DataFrame, compute: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> DataStreamWriter:
    """A stream that, for each batch of cells (trade_date, symbol, value), rewrites the partitions of their dates.

    compute gets the dates (trade_date) and returns the rows of a base table for them. A batch that is run again
    overwrites the same partitions, so the result is that of one run.
    """

    def batch(rows: DataFrame, number: int) -> None:
        made = compute(rows.select("trade_date").distinct())
        made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("trade_date").parquet(out)

    return cells.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
