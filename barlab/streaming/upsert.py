"""Use the keyed prediction writer as a micro-batch sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from barlab.sources.signals import upsert


def upsert_sink(predictions: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Writer for a streaming frame; the upsert is keyed, so a replayed batch changes nothing."""
    return predictions.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, _: upsert(batch.sparkSession, batch, path)
    )
