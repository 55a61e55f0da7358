"""Compare each micro-batch of a stream with a reference table by key.

An extension: the engine's own meaning is batch. Each batch is one snapshot of the
keys it holds; rows of the reference whose keys a batch lacks aren't removals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.keyed import KeyedDiff


def diff_stream(stream: DataFrame, reference: DataFrame, keys: list[str], out: str, checkpoint: str, order: str | None = None):
    """Start a query that appends changed and added rows to Parquet, a batch_id partition per micro-batch."""

    def one(batch: DataFrame, batch_id: int) -> None:
        result = KeyedDiff(reference, batch, keys, order=order).result().where("status != 'removed'")
        result.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")  # a replayed batch replaces itself

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).start()
