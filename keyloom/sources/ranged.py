"""Container files read by ranges: metadata without payloads, strict validation in blocks, record events in order.

Spark lists the files (the content column of `binaryFile` isn't read), and each task opens its files in the store by their URI
through `pyarrow.fs` and reads ranges. A file is a sequence of bytes that is read on demand, so the checks are those of
`container`; what they don't look at is never read. Every read is counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession

from keyloom.sources import container
from keyloom.sources.container import DIRECTORY, OPAQUE, Broken, Layout, Limits


class Budget(ValueError):
    """More reads, or more bytes, than a caller allows."""


class Ranged:
    """A file as bytes: len() and slices, each slice one read. Counts operations, bytes and the largest read."""

    def __init__(self, uri: str, max_operations: int = 1 << 40, max_bytes: int = 1 << 60):
        store, path = pyarrow.fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")
        self.info = store.get_file_info(path)
        self.held, self.size = store.open_input_file(path), self.info.size
        self.operations = self.bytes = self.largest = 0
        self.max_operations, self.max_bytes = max_operations, max_bytes
        self.fs, self.path = store, path

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, key: slice) -> bytes:
        start, stop, step = key.indices(self.size)
        if step != 1:
            raise ValueError("ranges have no steps")
        n = max(0, stop - start)
        self.operations += 1
        self.bytes += n
        self.largest = max(self.largest, n)
        if self.operations > self.max_operations or self.bytes > self.max_bytes:
            raise Budget("reads" if self.operations > self.max_operations else "bytes")
        return self.held.read_at(n, start)

    def version(self) -> tuple[int, int]:
        """Length and time of change as they are now."""
        now = self.fs.get_file_info(self.path)
        return now.size, now.mtime_ns

    def first_version(self) -> tuple[int, int]:
        return self.info.size, self.info.mtime_ns

    def close(self) -> None:
        self.held.close()


class Prefix:
    """The first bytes of a file, as if it ended there."""

    def __init__(self, held: Ranged, end: int):
        self.held, self.end = held, end

    def __len__(self) -> int:
        return self.end

    def __getitem__(self, key: slice) -> bytes:
        start, stop, _ = key.indices(self.end)
        return self.held[start : max(start, stop)]


def listed(spark: SparkSession, path: str) -> DataFrame:
    """(file, length) of the files under a path, without reading them."""
    return spark.read.format("binaryFile").load(path).selectExpr("path AS file", "length")


def _over(files: DataFrame, one, columns: str) -> DataFrame:
    names = ["file", *[c.split()[0] for c in columns.split(", ")]]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file in frame.file:
                held = Ranged(file)
                try:
                    for rows in one(held):
                        yield pd.DataFrame([(file, *r) for r in rows], columns=names, dtype=object)
                finally:
                    held.close()

    return files.select("file").mapInPandas(run, f"file string, {columns}")


def _stable(held: Ranged) -> None:
    if held.version() != held.first_version():
        raise Broken("source_changed", "length or time of change")


def inspected(files: DataFrame, layout: Layout, limits: Limits = Limits(), digests: bool = False) -> DataFrame:
    """(file) -> status, category, where, records, roots, operations, bytes_read, largest_read; one row a file.

    Without digests the status of a good file is NotChecked, and no payload is read; with them the prefix is hashed in blocks
    (strict bounded validation). A file that changes meanwhile is Invalid.
    """

    def one(held: Ranged):
        found = container.diagnosis(held, layout, limits, digests)
        try:
            _stable(held)
        except Broken as e:
            found = ("Invalid", e.category, e.where, None, None)
        yield [(*found, held.operations, held.bytes, held.largest)]

    return _over(files, one, "status string, category string, where string, records long, roots array<long>, operations long, bytes_read long, largest_read long")


def inventory(files: DataFrame, layout: Layout, limits: Limits = Limits()) -> DataFrame:
    """(file) -> object_id, kind, offset, stored_len, logical_len of every record: locators under one version of the file, which
    is compared before and after. A broken file fails the query."""

    def one(held: Ranged):
        found, _ = container.read(held, layout, limits, False)
        _stable(held)
        yield [tuple(f.entry().values()) for f in found]

    return _over(files, one, "object_id long, kind int, offset long, stored_len long, logical_len long")


def recovered(files: DataFrame, layout: Layout, limits: Limits = Limits(), suffix: int = 4 << 20, most: int = 64) -> DataFrame:
    """(file) -> footer_offset, valid, category, exact_end, truncated: the footers whose magic lies in the last `suffix` bytes, newest
    first, each with whether the file up to it is valid. At most `most` a file; truncated says if there were more. Selects none."""

    def one(held: Ranged):
        start = max(0, len(held) - suffix)
        window, places = held[start : len(held)], []
        at = window.rfind(layout.footer_magic)
        while at >= 0 and len(places) <= most:
            places.append(start + at)
            at = window.rfind(layout.footer_magic, 0, at + len(layout.footer_magic) - 1)
        out = []
        for place in places[:most]:
            end = container.after_footer(place)
            _, category, *_ = container.diagnosis(Prefix(held, min(end, len(held))), layout, limits) if end <= len(held) else ("Invalid", "truncated")
            out.append((place, category is None, category, end == len(held), len(places) > most))
        if out:
            yield out

    return _over(files, one, "footer_offset long, valid boolean, category string, exact_end boolean, truncated boolean")


def looked_up(files: DataFrame, asked: DataFrame, layout: Layout, limits: Limits = Limits()) -> DataFrame:
    """asked (file, object_id) -> with payload (null: not there): the directory is read once for a file, then the objects' ranges."""

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        held = Ranged(key[0])
        try:
            found, _ = container.read(held, layout, limits, False)
            at = {f.object_id: f for f in found}
            out = [(key[0], int(k), held[at[int(k)].payload] if int(k) in at else None) for k in rows.object_id]
            _stable(held)
        finally:
            held.close()
        return pd.DataFrame(out, columns=["file", "object_id", "payload"])

    return asked.join(files.select("file"), "file", "left_semi").groupBy("file").applyInPandas(run, "file string, object_id long, payload binary")


def events(files: DataFrame, layout: Layout, limits: Limits = Limits(), chunk: int = 64 << 10) -> DataFrame:
    """(file) -> the events of each file in order: position, event, object_id, start, bytes, reason.

    'record' announces an object, 'chunk' brings at most `chunk` of its bytes, 'commit' comes last, once footer, digest, directory,
    manifest and the exact end are checked; 'failed' is the last event of a file that breaks a rule, and no commit follows it.
    """

    def one(held: Ranged):
        position = 0
        try:
            directory, length, *_ = container.opened(held, layout, limits)
            for f in container.frames(held, directory + length, layout, limits):
                if f.kind == DIRECTORY:
                    break
                yield [(position, "record", f.object_id, None, None, None)]
                position += 1
                for start in range(0, f.stored_len if f.kind == OPAQUE else 0, chunk):
                    data = held[f.payload.start + start : min(f.payload.start + start + chunk, f.payload.stop)]
                    yield [(position, "chunk", f.object_id, start, data, None)]
                    position += 1
            container.read(held, layout, limits)
            _stable(held)
            yield [(position, "commit", None, None, None, None)]
        except Broken as e:
            yield [(position, "failed", None, None, None, str(e))]

    return _over(files, one, "position long, event string, object_id long, start long, bytes binary, reason string")


__all__ = ["Budget", "Prefix", "Ranged", "events", "inspected", "inventory", "listed", "looked_up", "recovered"]
