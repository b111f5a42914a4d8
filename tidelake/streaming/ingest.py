"""A stream's new files through the batch pipeline: each micro-batch is a load, so the result is that of one load."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidelake.plans.pipeline import Step, Workspace, load


def ingest_available(ws: Workspace, name: str, path: str, schema: T.StructType, key: Sequence[str], checkpoint: str, process: Step = lambda df: df, files_per_batch: int = 1000) -> None:
    """Loads the files under ``path`` that weren't loaded before. Insert-only merging makes a repeated batch harmless."""
    stream = ws.spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)

    def one(batch: DataFrame, _: int) -> None:
        load(ws, name, batch, key, process=process)

    query = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    ws.ledger.flush()
