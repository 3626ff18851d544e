"""Record events as a stream: rows of a file come out only when its commit arrives, and never after a failure."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUT = "status string, records long, reason string"
_STATE = "ids array<long>, failed string, done boolean"


def publish(events: DataFrame) -> DataFrame:
    """events (file, position, event: 'record', 'commit' or others, object_id) -> one row per file that commits or fails.

    A file's events may come over several batches. A repeated id, 'failed', or an event after the commit fails the file, and a
    failure is final. Works on a streaming DataFrame (append or update mode).
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, failed, done = state.get if state.exists else ([], None, False)
        ids, was = list(ids or []), (failed, done)
        known = set(ids)
        rows = pd.concat(list(frames)).sort_values("position")
        for event, object_id in zip(rows.event, rows.object_id, strict=True):
            if failed:
                break
            if done:
                failed = "event after commit"
            elif event == "failed":
                failed = "failed"
            elif event == "commit":
                done = True
            elif event == "record":
                if object_id in known:
                    failed = "repeated id"
                else:
                    known.add(object_id)
                    ids.append(int(object_id))
        state.update((ids, failed, done))
        if (failed, done) != was:
            yield pd.DataFrame([(key[0], "failed" if failed else "committed", len(ids), failed)], columns=["file", "status", "records", "reason"])

    kind = dict(events.dtypes)["file"]
    return events.groupBy("file").applyInPandasWithState(run, f"file {kind}, {_OUT}", _STATE, "update", GroupStateTimeout.NoTimeout)


def freshness(heads: DataFrame) -> DataFrame:
    """heads (source, position, sequence, digest) -> each with a verdict against what the source showed before: the first one is
    trusted. A rollback or a fork changes nothing; an advance becomes what later ones are held against. Streaming or not."""

    def judged(trusted, rows):
        for r in rows.sort_values("position").itertuples():
            if trusted is None:
                verdict = "Unpinned"
            elif r.sequence < trusted[0]:
                verdict = "Rollback"
            elif r.sequence > trusted[0]:
                verdict = "Advances"
            else:
                verdict = "Current" if r.digest == trusted[1] else "ForkAtTrustedSequence"
            if verdict in ("Unpinned", "Advances"):
                trusted = (int(r.sequence), r.digest)
            yield trusted, (r.source, r.position, r.sequence, verdict)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        trusted, out = state.get if state.exists else None, []
        for trusted, row in judged(trusted, pd.concat(list(frames))):
            out.append(row)
        state.update(trusted)
        yield pd.DataFrame(out, columns=["source", "position", "sequence", "verdict"])

    kind = dict(heads.dtypes)["source"]
    out = f"source {kind}, position long, sequence long, verdict string"
    if heads.isStreaming:
        return heads.groupBy("source").applyInPandasWithState(run, out, "sequence long, digest string", "update", GroupStateTimeout.NoTimeout)
    return heads.groupBy("source").applyInPandas(lambda rows: pd.DataFrame([r for _, r in judged(None, rows)], columns=["source", "position", "sequence", "verdict"]), out)


def chunked(payloads: DataFrame, size: int = 1024) -> DataFrame:
    """(object_id, payload binary) -> object_id, chunk, start, bytes of at most `size`; streaming or not."""
    n = F.octet_length("payload")
    parts = payloads.filter(n > 0).select("object_id", "payload", F.posexplode(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int"))).alias("chunk", "k"))
    return parts.select("object_id", "chunk", (F.col("k") * size).alias("start"), F.expr(f"substring(payload, k * {size} + 1, {size})").alias("bytes"))
