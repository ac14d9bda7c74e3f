"""An extension: the resumable append as the sink of a stream."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from platelab.sources.writers import append_new


def append_stream(rows: DataFrame, path: str, checkpoint: str, *key: str) -> StreamingQuery:
    """Each batch of the stream appends the rows whose key the output lacks, as a run of its own.

    A batch that is run again under the same checkpoint is the same run, and adds nothing.
    """
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def sink(batch: DataFrame, number: int) -> None:
        append_new(batch.dropDuplicates(list(key)), path, *key, run=f"{stream}-{number}")

    return rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
