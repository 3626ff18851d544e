"""Benchmark decontamination: rare n-gram seeds join passages to test items, Smith-Waterman alignment scores them.

Words are lower-cased and stripped of ASCII punctuation. Every window of `SEED` words of every test item is counted over all
documents. An item's seeds are its windows that are rare for it: that occur at most `RATIO` times as often as the window at
the lower quartile of its windows, and `FLOOR` times more. (An item that ten thousand documents copy has no window that is
rarer than that, but its common phrases still are more frequent than the rest of it; so the rule holds whatever the number of
copies and the size of the corpus.) Each item keeps its `LEAST_SEEDS` rarest in any case. Where a document holds a seed, the
passage around it is aligned with the item, word by word: a match 1, a mismatch or a gap -0.5. The score is the alignment's
sum over the item's words; at `SCORE` or more the document is contaminated.

A benchmark of at most `BLOCK_WORDS` words is broadcast, and the join with its seeds happens where the documents are read. A
larger one stays a table: a bitmap of its windows (at most `BITMAP_BITS`, false hits only cost time) says which windows of the
documents to count, and a second one, of the seeds, which to join; documents without any hit go no further. Both ways give the
same rows. Counts are added up before the shuffle, so a window that most documents hold is a row a task.

Defined cases: null or blank texts match nothing; items of fewer than `SEED` words match nothing; equal items are reported
each; of several passages of one document and item the best counts (of equal ones the first); null or repeated ids are rows
like any other; empty tables give an empty result; other columns of any name are ignored (and kept by `clean`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm.common import by_position, drop_written, hashes_of, named_again, numbered, picked, place_of, shingle_hashes, texts_of, written

SEED = 3
LEAST_SEEDS = 12
RATIO, FLOOR = 2, 10
SCORE = 0.5
MISMATCH = GAP = 0.5
BLOCK_WORDS = 2_000_000
#: Bits of a bitmap for each window, and of a whole one at most.
BITS_EACH, BITMAP_BITS = 16, 1 << 31
#: Hits that a task counts at a time.
COUNT_AT = 2_000_000
_TABLE = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(128)) + bytes(range(128, 256))
_FOUND = "doc_id long, item_id long, score double, n_seeds long, first_word long, end_word long"


def plain_words(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


def word_hashes(text: str | None) -> np.ndarray:
    return hashes_of(plain_words(text))


def seed_hashes(words: np.ndarray) -> np.ndarray:
    """The hash of each window of SEED words; none of a shorter text."""
    return shingle_hashes(words, SEED) if len(words) >= SEED else words[:0]


def align(item: np.ndarray, passage: np.ndarray) -> tuple[float, int]:
    """The best local alignment's sum, and the place in the passage where it ends (exclusive)."""
    gaps = GAP * np.arange(len(passage) + 1)
    row = np.zeros(len(passage) + 1)
    best, end = 0.0, 0
    for word in item:
        new = np.zeros(len(passage) + 1)
        new[1:] = np.maximum(row[:-1] + np.where(passage == word, 1.0, -MISMATCH), row[1:] - GAP)
        np.maximum(new, 0.0, out=new)
        row = np.maximum.accumulate(new + gaps) - gaps  # a run of gaps along the passage
        at = int(row.argmax())
        if row[at] > best:
            best, end = float(row[at]), at
    return best, end


def best_passage(words: np.ndarray, item: np.ndarray, starts: np.ndarray) -> tuple[float, int, int, int] | None:
    """(score, seeds found, first word of the passage, its end) if at SCORE or more. starts: where each seed puts the item's begin, sorted."""
    size = len(item)
    best = (0.0, 0, 0)
    for group in np.split(starts, np.flatnonzero(np.diff(starts) > size) + 1):
        low, high = max(0, int(group[0]) - size // 2), min(len(words), int(group[-1]) + size + size // 2)
        score, end = align(item, words[low:high])
        if score > best[0]:
            best = (score, max(0, int(group[0])), low + end)
    return (best[0] / size, len(starts), best[1], best[2]) if best[0] >= SCORE * size else None


class Places:
    """Numbers of 64 bits, sorted, and a bitmap that rules most others out."""

    def __init__(self, values: np.ndarray):
        self.values = values
        size = max(1 << 10, 1 << (BITS_EACH * len(values)).bit_length())
        self.mask = np.uint64(size - 1)
        self.bits = np.zeros(size, bool)
        self.bits[values & self.mask] = True

    def found(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of asked are there, and the first place of each of these in values."""
        some = np.flatnonzero(self.bits[asked & self.mask])
        at = np.searchsorted(self.values, asked[some])
        hit = self.values[np.minimum(at, len(self.values) - 1)] == asked[some] if len(self.values) else np.zeros(0, bool)
        return some[hit], at[hit]


# ---- a benchmark that is broadcast --------------------------------------------------------------------------------------


def _counted(shared):
    """Texts -> (place, n): how often each of the benchmark's windows occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value
        counts = np.zeros(len(windows.values), np.int64)
        for batch in batches:
            for text in texts_of(batch.column(0)):
                _, at = windows.found(seed_hashes(word_hashes(text)))
                np.add.at(counts, at, 1)
        some = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(some), pa.array(counts[some])], names=["place", "n"])

    return run


def rare_seeds(items: list[np.ndarray], windows: np.ndarray, counts: np.ndarray) -> tuple[Places, np.ndarray, np.ndarray]:
    """Seed hashes, sorted, with the item and the position of each. windows: sorted; counts: of each."""
    seeds, of, at = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for k, words in enumerate(items):
        h = seed_hashes(words)
        if not len(h):
            continue
        n = counts[np.searchsorted(windows, h)]
        order = np.argsort(n, kind="stable")
        edge = RATIO * n[order[(len(n) - 1) // 4]] + FLOOR
        places = order[: max(LEAST_SEEDS, int((n <= edge).sum()))]
        seeds.append(h[places])
        of.append(np.full(len(places), k))
        at.append(places)
    seeds, of, at = np.concatenate(seeds), np.concatenate(of), np.concatenate(at)
    order = np.argsort(seeds, kind="stable")
    return Places(seeds[order]), of[order], at[order]


def passages(words: np.ndarray, items: list[np.ndarray], seeds: tuple[Places, np.ndarray, np.ndarray]) -> Iterator[tuple[int, float, int, int, int]]:
    """(item, score, seeds found, first word of the passage, its end) of one document, for items at SCORE or more."""
    known, of, at = seeds
    h = seed_hashes(words)
    where, left = known.found(h)
    if not len(where):
        return
    right = np.searchsorted(known.values, h[where], side="right")
    k = np.concatenate([np.arange(a, b) for a, b in zip(left, right, strict=True)])
    starts = np.repeat(where, right - left) - at[k]
    for item in np.unique(of[k]):
        found = best_passage(words, items[item], np.sort(starts[of[k] == item]))
        if found:
            yield int(item), *found


def _items(benchmark: DataFrame) -> DataFrame:
    """item (a number), item_id, size and words (hashes) of the items with at least SEED words, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [word_hashes(x) for x in texts_of(batch.column(2))]
            made = pa.record_batch([batch.column(0), batch.column(1), pa.array([len(w) for w in words], pa.int64()), pa.array([w.tobytes() for w in words], pa.binary())], names=["item", "item_id", "size", "words"])
            yield made.filter(pa.array([len(w) >= SEED for w in words], pa.bool_()))

    rows = picked(benchmark, item_id="item_id", text="text").select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), "text")
    return written(rows.mapInArrow(run, "item long, item_id long, size long, words binary"), "items")


def _learned(texts: DataFrame, items: DataFrame):
    """The broadcast words of all items and their seeds; the id of each item."""
    context = texts.sparkSession.sparkContext
    held = sorted(((r.item_id, bytes(r.words)) for r in items.select("item_id", "words").collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    words = [np.frombuffer(w, np.uint64) for _, w in held]
    windows = np.unique(np.concatenate([np.empty(0, np.uint64), *map(seed_hashes, words)]))
    counts = np.zeros(len(windows), np.int64)
    if len(windows):
        counted = texts.mapInArrow(_counted(context.broadcast(Places(windows))), "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
        counts[counted.column("place").to_numpy()] = counted.column("n").to_numpy()
    return context.broadcast((words, rare_seeds(words, windows, counts))), [k for k, _ in held]


def _matched(rows: DataFrame, items: DataFrame) -> DataFrame:
    shared, ids = _learned(rows.select("text"), items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seeds = shared.value
        for batch in batches:
            out = []
            for k, text in enumerate(texts_of(batch.column(1))):
                for item, *found in passages(word_hashes(text), words, seeds):
                    out.append((batch.column(0)[k].as_py(), ids[item], *found))
            yield _found_rows(out)

    return rows.mapInArrow(run, _FOUND)


def _found_rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
    return pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "score", "n_seeds", "first_word", "end_word"])


# ---- a benchmark that stays a table -------------------------------------------------------------------------------------


def _windows_of(items: DataFrame) -> DataFrame:
    """item, place, seed of every window of every item, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, words in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h = seed_hashes(np.frombuffer(words.as_buffer(), np.uint64))
                yield pa.record_batch([pa.array(np.full(len(h), item)), pa.array(np.arange(len(h))), pa.array(h.view(np.int64))], names=["item", "place", "seed"])

    return written(items.select("item", "words").mapInArrow(run, "item long, place long, seed long"), "windows")


def _bitmap(seeds: DataFrame):
    """A broadcast bitmap of a column of seeds: 64 bits in a cell."""
    n = seeds.count()
    cells = min(BITMAP_BITS, max(1 << 16, 1 << (BITS_EACH * n).bit_length())) // 64
    at = seeds.select(F.shiftrightunsigned("seed", 6).bitwiseAND(F.lit(cells - 1)).alias("cell"), F.expr("shiftleft(1L, cast(seed & 63 as int))").alias("bit"))
    held = at.groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most `cells` rows of 16 bytes
    bits = np.zeros(cells, np.uint64)
    bits[held.column("cell").to_numpy()] = held.column("bits").to_numpy().view(np.uint64)
    return seeds.sparkSession.sparkContext.broadcast(bits)


def _may_hold(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    return np.flatnonzero(bits[(h >> np.uint64(6)) & np.uint64(len(bits) - 1)] >> (h & np.uint64(63)) & np.uint64(1))


def _hits_counted(shared):
    """Texts -> (seed, n) of the windows that the bitmap may hold, added up in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            if held:
                values, n = np.unique(np.concatenate(held), return_counts=True)
                yield pa.record_batch([pa.array(values.view(np.int64)), pa.array(n)], names=["seed", "n"])

        for batch in batches:
            for text in texts_of(batch.column(0)):
                h = seed_hashes(word_hashes(text))
                held.append(h[_may_hold(shared.value, h)])
                size += len(held[-1])
                if size >= COUNT_AT:
                    yield from out()
                    held, size = [], 0
        yield from out()

    return run


def _hits(shared):
    """(row, doc_id, text) -> the same with places and seeds of the windows that the bitmap may hold, if there are any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, seeds = [], []
            for text in texts_of(batch.column(2)):
                h = seed_hashes(word_hashes(text))
                at = _may_hold(shared.value, h)
                places.append(at)
                seeds.append(h[at].view(np.int64))
            made = pa.record_batch([*batch.columns, pa.array(places, pa.list_(pa.int64())), pa.array(seeds, pa.list_(pa.int64()))], names=["row", "doc_id", "text", "places", "seeds"])
            yield made.filter(pa.array([len(x) > 0 for x in places], pa.bool_()))

    return run


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, doc_id, text, item_id, words, starts) -> the pairs at SCORE or more, with their row."""
    for batch in batches:
        out, rows = [], []
        for k, text in enumerate(texts_of(batch.column(2))):
            starts = np.sort(np.array(batch.column(5)[k].as_py(), np.int64))
            found = best_passage(word_hashes(text), np.frombuffer(batch.column(4)[k].as_buffer(), np.uint64), starts)
            if found:
                out.append((batch.column(1)[k].as_py(), batch.column(3)[k].as_py(), *found))
                rows.append(batch.column(0)[k].as_py())
        made = _found_rows(out)
        yield pa.record_batch([pa.array(rows, pa.int64()), *made.columns], names=["row", *made.schema.names])


def _joined(rows: DataFrame, items: DataFrame) -> DataFrame:
    """rows: row, doc_id, text, read twice. The row numbers come from the second reading alone."""
    windows = _windows_of(items)
    counts = rows.select("text").mapInArrow(_hits_counted(_bitmap(windows.select("seed"))), "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n"))
    known = windows.join(counts, "seed", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    by_item = Window.partitionBy("item")  # the windows of one test item
    rank = F.row_number().over(by_item.orderBy("n", "place"))
    known = known.withColumn("rank", rank).withColumn("size", F.count("*").over(by_item))
    quartile = F.max(F.when(F.col("rank") == F.floor((F.col("size") - 1) / 4) + 1, F.col("n"))).over(by_item)
    seeds = written(known.withColumn("edge", RATIO * quartile + FLOOR).filter((F.col("rank") <= LEAST_SEEDS) | (F.col("n") <= F.col("edge"))).select("item", "place", "seed"), "seeds")
    drop_written(windows)
    held = written(rows.mapInArrow(_hits(_bitmap(seeds.select("seed"))), "row long, doc_id long, text string, places array<long>, seeds array<long>"), "hits")
    hits = held.select("row", F.explode(F.arrays_zip("places", "seeds")).alias("hit")).select("row", F.col("hit.places").alias("where"), F.col("hit.seeds").alias("seed"))
    pairs = hits.join(seeds, "seed").groupBy("row", "item").agg(F.collect_list(F.col("where") - F.col("place")).alias("starts"))
    wide = pairs.join(items.select("item", "item_id", "words"), "item").join(held.select("row", "doc_id", "text"), "row")
    return wide.select("row", "doc_id", "text", "item_id", "words", "starts").mapInArrow(_aligned, f"row long, {_FOUND}")


# ---- both ---------------------------------------------------------------------------------------------------------------


def _fits(items: DataFrame, block_words: int) -> bool:
    return (items.agg(F.sum("size")).first()[0] or 0) <= block_words


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """Pairs at SCORE or more: doc_id, item_id, score, n_seeds, first_word, end_word."""
    rows = picked(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = _items(benchmark)
    if _fits(items, block_words):
        return _matched(rows, items)
    return _joined(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), items).drop("row")


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs that hold no passage of the benchmark; all their columns."""
    items = _items(benchmark)
    if not _fits(items, block_words):
        rows = numbered(docs, "rows")
        found = _joined(rows.select("row", F.lit(None).cast("long").alias("doc_id"), F.col(place_of(docs, text_col)).alias("text")), items)
        return named_again(rows.join(found.select("row").distinct(), "row", "left_anti"), docs)
    shared, _ = _learned(picked(docs, text=text_col), items)
    rows, at = by_position(docs), docs.columns.index(text_col)
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seeds = shared.value
        for batch in batches:
            keep = [next(passages(word_hashes(x), words, seeds), None) is None for x in texts_of(batch.column(at))]
            yield pa.record_batch(batch.filter(pa.array(keep, pa.bool_())).columns, names=names)

    return named_again(rows.mapInArrow(run, rows.schema), docs)
