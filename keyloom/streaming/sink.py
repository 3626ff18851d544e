"""A stream written to a versioned store: each micro-batch is a commit, complete or not there at all."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from keyloom.functions.session import written
from keyloom.sources.store import Store


def commits(store: Store, first: int = 0) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function. Batch n is the commit first + n (first: the commits before the stream, of a store that nothing else writes), so a batch
    that is run again after a failure is recognised and not written twice. An empty batch would make no commit and so shift
    the numbers; it is an error, which a stream of files or with `availableNow` doesn't meet.
    """
    base = first

    def write(batch: DataFrame, number: int) -> None:
        if len(store.sequences()) > base + number:
            return
        changes = written(batch.select("object_id", "op", "kind", "payload"), "batch")
        store.commit(changes)

    return write


def write_stream(changes: DataFrame, store: Store, checkpoint: str, every: str | None = None, first: int = 0) -> DataStreamWriter:
    """changes (object_id, op, kind, payload), streaming, to a store: what is there by now, or a commit at a cadence."""
    out = changes.writeStream.foreachBatch(commits(store, first)).option("checkpointLocation", checkpoint)
    return out.trigger(processingTime=every) if every else out.trigger(availableNow=True)


__all__ = ["commits", "write_stream"]
