"""Exact deduplication with a cuckoo-filter index over the digests of whole texts.

A partition's rows go through a cuckoo index first (so a group that fills a third of the rows is a handful of partial rows
before the shuffle), then one index for each digest partition merges the partial rows. A filter hit alone decides nothing:
the slot holds the full digest beside its fingerprint, and the two are compared. When an insertion kicks too long, the
index doubles and is filled again from the keys that it stores. Digests can be deleted again (`apply_changes`). The number of
digests decides how many partitions, and so indexes, there are; none holds much more than `INDEXED`.

Defined cases: a null text counts as empty; null doc_ids sort after all others; of rows with equal text and equal doc_id
the first read stays, so one row of each group stays in any case; an empty table gives an empty result; other columns of
the input are ignored.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import SPACE_RUN, named_again, numbered, picked, place_of, staying, written

SLOTS = 4
#: Distinct digests that a task holds before it hands its partial rows on.
FLUSH_AT = 200_000
#: Distinct digests of an index after the shuffle, about.
INDEXED = 500_000
_PARTIAL = "digest binary, keep_id long, keep_row long, n long"


class CuckooIndex:
    """Digest -> value. 16-bit fingerprints in buckets of four; each slot's content (digest, value) lies beside it."""

    def __init__(self, buckets: int = 256, kicks: int = 200):
        self.kicks, self.resizes = kicks, 0
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.mask, self.size = buckets - 1, 0
        self.prints = array("H", bytes(2 * SLOTS * buckets))
        self.content: list[tuple[bytes, object] | None] = [None] * (SLOTS * buckets)

    def _places(self, key: bytes) -> tuple[int, int, int]:
        print_ = int.from_bytes(key[:2], "little") % 65535 + 1  # 0 marks a free slot
        first = int.from_bytes(key[2:10], "little") & self.mask
        return print_, first, self._other(first, print_)

    def _other(self, bucket: int, print_: int) -> int:
        return (bucket ^ (print_ * 0x5BD1E995)) & self.mask

    def _slot(self, key: bytes) -> int:
        print_, one, two = self._places(key)
        for bucket in (one, two):
            for slot in range(SLOTS * bucket, SLOTS * bucket + SLOTS):
                if self.prints[slot] == print_ and self.content[slot][0] == key:
                    return slot
        return -1

    def may_contain(self, key: bytes) -> bool:
        """What the fingerprints alone say."""
        print_, one, two = self._places(key)
        return any(print_ in self.prints[SLOTS * b : SLOTS * b + SLOTS] for b in (one, two))

    def get(self, key: bytes):
        slot = self._slot(key)
        return None if slot < 0 else self.content[slot][1]

    def put(self, key: bytes, value) -> None:
        slot = self._slot(key)
        if slot >= 0:
            self.content[slot] = (key, value)
            return
        left = self._place(key, value)
        while left is not None:
            left = self._resize(left)

    def delete(self, key: bytes) -> bool:
        slot = self._slot(key)
        if slot < 0:
            return False
        self.prints[slot], self.content[slot] = 0, None
        self.size -= 1
        return True

    def items(self) -> Iterator[tuple[bytes, object]]:
        return (x for x in self.content if x is not None)

    def _place(self, key: bytes, value) -> tuple[bytes, object] | None:
        """None, or the entry that found no place after the last kick."""
        print_, one, two = self._places(key)
        entry, bucket = (key, value), one
        for bucket in (one, two):
            for slot in range(SLOTS * bucket, SLOTS * bucket + SLOTS):
                if not self.prints[slot]:
                    self.prints[slot], self.content[slot] = print_, entry
                    self.size += 1
                    return None
        for kick in range(self.kicks):
            slot = SLOTS * bucket + (kick + entry[0][11]) % SLOTS
            self.prints[slot], print_ = print_, self.prints[slot]
            self.content[slot], entry = entry, self.content[slot]
            bucket = self._other(bucket, print_)
            for slot in range(SLOTS * bucket, SLOTS * bucket + SLOTS):
                if not self.prints[slot]:
                    self.prints[slot], self.content[slot] = print_, entry
                    self.size += 1
                    return None
        return entry

    def _resize(self, left: tuple[bytes, object]) -> tuple[bytes, object] | None:
        stored = [*self.items(), left]
        self.resizes += 1
        self._clear(2 * (self.mask + 1))
        for k, entry in enumerate(stored):
            if (out := self._place(*entry)) is not None:
                for rest in stored[k + 1 :]:  # still too full: keep everything, grow again
                    self.content.append(rest)
                return out
        return None


def _sooner(a: tuple, b: tuple) -> tuple:
    """The smaller (doc_id, row); null ids last."""
    return min(a, b, key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def _merge(batches: Iterator[pa.RecordBatch], flush_at: int | None) -> Iterator[pa.RecordBatch]:
    index = CuckooIndex()

    def out() -> Iterator[pa.RecordBatch]:
        rows = [(k, *v) for k, v in index.items()]
        for at in range(0, len(rows), 10_000):
            part = list(zip(*rows[at : at + 10_000], strict=True))
            yield pa.record_batch([pa.array(part[0], pa.binary()), *(pa.array(x, pa.int64()) for x in part[1:])], names=["digest", "keep_id", "keep_row", "n"])

    for batch in batches:
        for key, doc_id, row, n in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            held = index.get(key) if index.may_contain(key) else None
            if held is None:
                index.put(key, (doc_id, row, n))
            else:
                index.put(key, (*_sooner(held[:2], (doc_id, row)), held[2] + n))
        if flush_at and index.size >= flush_at:
            yield from out()
            index = CuckooIndex()
    yield from out()


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")


def groups(digests: DataFrame) -> DataFrame:
    """(digest, doc_id, row, n) -> one row per digest: digest, keep_id, keep_row, n."""
    partial = written(digests.mapInArrow(lambda batches: _merge(batches, FLUSH_AT), _PARTIAL), "partial")
    return partial.repartition(parts_for(partial), F.col("digest")).mapInArrow(lambda batches: _merge(batches, None), _PARTIAL)


def parts_for(digests: DataFrame) -> int:
    """Partitions in which an index holds about `INDEXED` digests; a digest has one row a task here, so hashing deals evenly."""
    usual = int(digests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(usual, 8), -(-digests.count() // INDEXED))


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = picked(docs, doc_id=id_col, text=text_col)
    digests = written(rows.select(F.col("doc_id").cast("long").alias("doc_id"), digest_of(F.col("text")).alias("digest"), F.monotonically_increasing_id().alias("row")), "digests")
    found = groups(digests.select("digest", "doc_id", "row", F.lit(1).cast("long").alias("n")))
    return digests.join(found, "digest").select(
        "doc_id",
        "keep_id",
        F.col("n").alias("group_size"),
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns.

    docs is evaluated once and written with its row numbers, so what stays is the same whatever docs is made of and whichever
    columns are asked for.
    """
    rows = numbered(docs, "rows")
    key, text = place_of(docs, id_col), place_of(docs, text_col)
    digests = rows.select(digest_of(F.col(text)).alias("digest"), F.col(key).cast("long").alias("doc_id"), "row", F.lit(1).cast("long").alias("n"))
    kept = groups(digests).select(F.col("keep_row").alias("row"))
    return named_again(staying(rows, kept), docs)


def apply_changes(index: DataFrame, inserts: DataFrame, deletes: DataFrame) -> DataFrame:
    """An index (digest binary, live long) after insertions and deletions of digests (column digest, one row each).

    A digest goes when its last live copy is deleted; deleting a digest that isn't live changes nothing.
    """
    rows = index.select("digest", "live", F.lit(0).cast("long").alias("gone"))
    rows = rows.unionByName(inserts.groupBy("digest").agg(F.count("*").alias("live"), F.lit(0).cast("long").alias("gone")))
    rows = rows.unionByName(deletes.groupBy("digest").agg(F.lit(0).cast("long").alias("live"), F.count("*").alias("gone")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, gone = CuckooIndex(), []
        for batch in batches:
            for key, live, n in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if live:
                    held.put(key, (held.get(key) or 0) + live)
                if n:
                    gone.append((key, n))
        for key, n in gone:
            live = held.get(key) if held.may_contain(key) else None
            if live is not None and live <= n:
                held.delete(key)
            elif live is not None:
                held.put(key, live - n)
        rows = list(held.items())
        yield pa.record_batch([pa.array([k for k, _ in rows], pa.binary()), pa.array([v for _, v in rows], pa.int64())], names=["digest", "live"])

    rows = written(rows, "changes")
    return rows.repartition(parts_for(rows), F.col("digest")).mapInArrow(run, "digest binary, live long")


__all__ = ["CuckooIndex", "apply_changes", "deduplicated", "exact_dedup", "groups", "normalised"]
