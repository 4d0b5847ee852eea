"""Continuous ingestion: each micro-batch of changes is published with its batch id as the payload."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.index import TextIndex, as_records


def publish_batch(index: TextIndex, changes: DataFrame, batch: int, **columns) -> bool:
    """Apply one batch of changes (op 'upsert' or 'delete', seq for order within an id); False if it was published before."""
    done = index.committed_payload
    if done is not None and int(done) >= batch:
        return False
    # The last change of an id wins; a row of the batch at most is kept for each.
    last = changes.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("seq")))).where("_n = 1").drop("_n")
    index.apply(as_records(last.where("op = 'upsert'"), index.options, **columns), last.where("op = 'delete'").select("id"))
    index.publish(str(batch))
    return True


def ingest(index: TextIndex, changes: DataFrame, checkpoint: str, trigger: dict | None = None, **columns) -> StreamingQuery:
    """Run a stream of changes into the index. A batch that is replayed after a failure changes nothing."""
    out = changes.writeStream.foreachBatch(lambda df, n: publish_batch(index, df, n, **columns) and None)
    return out.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
