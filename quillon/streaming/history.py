"""History kept continuously: opens come in as a stream, the last n entries of each key stay in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quillon.operators.history import history_entries, last_n
from quillon.sources import buckets


def read_state(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The entries after the newest finished batch (before a given one), or None."""
    return buckets.read(spark, path, before)


def stream_history(
    opens: DataFrame, items: DataFrame, path: str, checkpoint: str, n: int = 50, key: str | None = None, tie: tuple[str, ...] = (), parts: int = 64, keep: int = 2
) -> StreamingQuery:
    """Start a query that adds opens (opened_at, action, id, ...) to the history at a path (H5).

    State holds n entries, or n of each key, in hash buckets of the key: a micro batch reads and writes only the buckets of the keys it has, so its cost follows the batch and not the state.
    Each batch writes under its own number from the state of the batches before it, so a batch that is run again after a failure writes the same again; late opens take the place their
    time gives them. The newest `keep` versions stay, older ones are deleted.
    """
    carried = tuple(dict.fromkeys([*([key] if key else []), *tie]))

    def merge(batch: DataFrame, number: int) -> None:
        entries = history_entries(batch, items, carried)

        def combine(before: DataFrame | None, new: DataFrame) -> DataFrame:
            return last_n(new if before is None else before.unionByName(new), n, key, tie)

        buckets.merge(entries, path, key, combine, parts if key else 1, number)
        buckets.vacuum(batch.sparkSession, path, max(1, keep))

    return opens.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
