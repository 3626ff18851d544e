"""Exact Jaccard join of word-shingle sets, by set-relation skipping, and the components that its links form.

1. Equal sets are one class; a class has one entry in the index.
2. Each set is put in one global order, rare shingles first (by counts in hash cells over all documents; they are only a
   help, any common order is right), and enters the index lists of its first n - ceil(0.8 n) + 1 shingles with its position there: two linked sets share a list.
3. Block skipping: in a list an entry is skipped for another when the positions leave no room for the overlap needed, or
   the sizes differ too much; what every entry of a block (one list's entries that link to its leader) rules out is skipped
   with the whole block.
4. Derived answers: in each list the entry that stands first in its own set is the leader. All others are compared with it.
   Two entries that link to it are connected without being compared. For the rest, the overlaps with the leader bound the
   overlap of the two, |x & y| <= min(|x & L|, |y & L|) + min(|x - L|, |y - L|), and only pairs that the bound can't rule out are
   compared. So a group of k near copies costs k comparisons, not k * k, and no link between different groups is lost.
5. Links and equal sets give components (alternating large-star and small-star steps on written tables).

Before two sets are compared, their parity bitmaps (a bit for each shingle) have to leave room for a link. Comparisons make
the sets again from the texts, those alone whose own hash is noted for a class that is compared; sets are 64-bit shingle hashes,
classes 128-bit hashes of whole sets.

Defined cases: null or blank text has the empty set (0 shingles) and is its own component; fewer words than `width` give one
shingle, the whole sequence; null ids count as larger than all others, a component of null ids only has a null id;
repeated rows are one class; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm.common import added, drop_written, hashes_of, named_again, numbered, packed, picked, place_of, released, shingle_hashes, staying, texts_of, together, unpacked, words_of, written

WIDTH = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Shingle hashes that a task counts at a time; cells that a bucket's task adds up, about.
COUNT_AT, BUCKET = 4_000_000, 1_500_000
#: A cell is ranked if this many sets fall there; cells ranked, at most: rarer ones beyond stay unranked.
OFTEN, RANKED = 4, 2_000_000
#: Zones of a set in which positions are told apart when blocks are skipped.
ZONES = 40
#: 64-bit words of the bitmap of texts whose sets are made again.
BITMAP = 1 << 21


def set_of(text: str | None, width: int = WIDTH) -> np.ndarray:
    return np.unique(shingle_hashes(hashes_of(words_of(text)), width))


def class_of(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def key_of(text: pa.Scalar) -> bytes | None:
    """A 128-bit hash of a text as it lies in the column; nothing is decoded."""
    return xxhash.xxh3_128_digest(text.as_buffer()) if text.is_valid else None


def _counted(width: int, bits: int, buckets: int):
    """Texts -> (bucket, packed counts of cells): the cell of a shingle is the first bits of its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, set()
        step = -(-(1 << bits) // buckets)

        def out() -> Iterator[pa.RecordBatch]:
            if held:
                cells, n = np.unique(np.concatenate(held), return_counts=True)
                edges = np.searchsorted(cells, np.arange(buckets + 1, dtype=np.uint64) * np.uint64(step))
                some = [k for k in range(buckets) if edges[k] < edges[k + 1]]
                blobs = [packed(cells[edges[k] : edges[k + 1]], n[edges[k] : edges[k + 1]]) for k in some]
                yield pa.record_batch([pa.array(some, pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "packed"])

        for batch in batches:
            for text in texts_of(batch.column(0)):
                s = set_of(text, width)
                if len(s) and (key := class_of(s)) not in seen:
                    seen.add(key)
                    held.append(s >> np.uint64(64 - bits))
                    size += len(s)
                if size >= COUNT_AT:
                    yield from out()
                    held, size, seen = [], 0, set()
        yield from out()

    return run


def _frequent(key, table):
    """A bucket's packed counts -> (cell, n) of the frequent cells."""
    parts = [unpacked(x.as_py()) for x in table.column("packed")]
    both = np.concatenate([c for c, _ in parts]), np.concatenate([k for _, k in parts])
    del parts, table
    cells, n = added(*both)
    often = n >= OFTEN
    return pa.table({"cell": pa.array(cells[often].astype(np.int64)), "n": pa.array(n[often])})


def ranked(texts: DataFrame, width: int = WIDTH, at_most: int = RANKED) -> tuple[int, np.ndarray, np.ndarray]:
    """Bits of a cell; the frequent cells, sorted; the rank of each by (count, cell).

    There are two to four cells for each word of all texts, so a cell's count is that of its most frequent shingle or little more.
    """
    size = texts.agg(F.sum(F.octet_length(texts.columns[0]))).first()[0] or 0
    bits = max(16, min(48, (size // 6).bit_length() + 1))
    buckets = max(4, size // 6 // BUCKET)
    counts = texts.mapInArrow(_counted(width, bits, buckets), "bucket long, packed binary").groupBy("bucket").applyInArrow(_frequent, "cell long, n long")
    counts = written(counts, "cells")
    level = F.floor(F.log2("n") * 4).cast("int")
    left, edge = at_most, 0
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):
        left -= r["count"]
        if left < 0:
            edge = r["level"] + 1
            break
    rows = counts.filter(level >= edge).toArrow()
    drop_written(counts)
    cells, n = rows.column("cell").to_numpy().astype(np.uint64), rows.column("n").to_numpy()
    rank = np.empty(len(n), np.uint64)
    rank[np.lexsort((cells, n))] = np.arange(len(n), dtype=np.uint64)
    order = np.argsort(cells)
    return bits, cells[order], rank[order]


def _in_order(s: np.ndarray, bits: int, known: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, int]:
    """The set in the global order, and how many of it aren't ranked; those stand first."""
    key, cold = s >> np.uint64(1), len(s)
    if len(known):
        cell = s >> np.uint64(64 - bits)
        at = np.minimum(np.searchsorted(known, cell), len(known) - 1)
        hot = known[at] == cell
        key = np.where(hot, np.uint64(1 << 63) | rank[at], key)
        cold -= int(hot.sum())
    return s[np.argsort(key, kind="stable")], cold


def parity(s: np.ndarray) -> bytes:
    """A bitmap of about one bit for each shingle, the parity of how many fall there: the bits in which two bitmaps differ
    are at most the shingles in which the sets differ."""
    size = 64
    while size < len(s):
        size *= 2
    return np.packbits(np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size).astype(np.uint8) & 1, bitorder="little").tobytes()


def difference_at_least(a: np.ndarray, b: np.ndarray) -> int:
    """A lower bound of the symmetric difference's size from two bitmaps; the larger is folded."""
    if len(a) < len(b):
        a, b = b, a
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _possible(percent: int):
    """(x, y, bits, n of each) -> the pairs that the bitmaps don't rule out: overlap = (n + m - difference) / 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column(4).to_numpy(), batch.column(5).to_numpy()
            differ = np.array([difference_at_least(np.frombuffer(a.as_buffer(), np.uint8), np.frombuffer(b.as_buffer(), np.uint8)) for a, b in zip(batch.column(2), batch.column(3), strict=True)], np.int64)
            keep = (n + m - differ) * (100 + percent) >= 2 * percent * (n + m)
            yield pa.record_batch([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], names=["x", "y"])

    return run


def possible(pairs: DataFrame, bitmaps: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (x, y) whose parity bitmaps (rep, n, bits) leave room for a link."""
    one = pairs.join(bitmaps.select(F.col("rep").alias("x"), F.col("n").alias("x_n"), F.col("bits").alias("x_bits")), "x")
    two = one.join(bitmaps.select(F.col("rep").alias("y"), F.col("n").alias("y_n"), F.col("bits").alias("y_bits")), "y")
    return two.select("x", "y", "x_bits", "y_bits", "x_n", "y_n").mapInArrow(_possible(percent), "x long, y long")


def _indexed(width: int, percent: int, shared):
    """(row, doc_id, text) -> row, doc_id, n, class, cold, prefix, bits, key (the last four null after the first of a class in a task).

    key: the upper half of the text's own hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shared.value
        seen: set[bytes] = set()
        for batch in batches:
            sizes, classes, prefixes, colds, bits, keys = [], [], [], [], [], []
            for text in batch.column(2):
                s = set_of(text.as_py(), width)
                n = len(s)
                key = class_of(s) if n else None
                sizes.append(n)
                classes.append(key)
                if n and key not in seen:
                    seen.add(key)
                    ordered, cold = _in_order(s, *order)
                    prefixes.append(ordered[: n + (-percent * n) // 100 + 1].view(np.int64))
                    colds.append(cold)
                    bits.append(parity(s))
                    keys.append(int.from_bytes(key_of(text)[:8], "big", signed=True))
                else:
                    prefixes.append(None)
                    colds.append(None)
                    bits.append(None)
                    keys.append(None)
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), pa.array(colds, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(bits, pa.binary()), pa.array(keys, pa.int64())],
                names=["row", "doc_id", "n", "class", "cold", "prefix", "bits", "key"],
            )

    return run


def _sets_again(width: int, shared):
    """Texts -> (class, set) of texts whose keys the bitmap holds, each text and class once in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, known, seen = shared.value, set(), set()
        for batch in batches:
            classes, sets = [], []
            for text in batch.column(0):
                name = key_of(text)
                place = int.from_bytes(name[:8], "big") % (64 * BITMAP) if name else 0
                if not name or not int(bits[place >> 6]) >> (place & 63) & 1 or name in known:
                    continue
                known.add(name)
                s = set_of(text.as_py(), width)
                if len(s) and (key := class_of(s)) not in seen:
                    seen.add(key)
                    classes.append(key)
                    sets.append(s.tobytes())
            yield pa.record_batch([pa.array(classes, pa.binary()), pa.array(sets, pa.binary())], names=["class", "set"])

    return run


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(x, y, set of x, set of y) -> x, y, overlap."""
    for batch in batches:
        last, other = None, None
        overlaps = []
        for a, b in zip(batch.column(2), batch.column(3), strict=True):
            b = b.as_buffer()
            if last is None or not last.equals(b):
                last, other = b, np.frombuffer(b, np.uint64)
            mine = np.frombuffer(a.as_buffer(), np.uint64)
            small, large = (mine, other) if len(mine) < len(other) else (other, mine)
            at = np.minimum(np.searchsorted(large, small), len(large) - 1)
            overlaps.append(int((large[at] == small).sum()))
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(overlaps, pa.int64())], names=["x", "y", "overlap"])


def compare(pairs: DataFrame, classes: DataFrame, texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """Overlaps of pairs (x, y) of classes' rows; the sets are made again from texts (one column)."""
    spark = pairs.sparkSession
    keyed = classes.select("rep", "class", "key")
    ends = written(pairs.select(F.explode(F.array("x", "y")).alias("rep")).distinct().join(keyed, "rep"), "ends")
    place = F.pmod("key", F.lit(64 * BITMAP))  # a power of two, so the sign doesn't matter
    where = ends.select(F.shiftright(place, 6).cast("int").alias("at"), (place % 64).cast("int").alias("bit"))
    cells = where.groupBy("at").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow()
    bits = np.zeros(BITMAP, np.uint64)
    bits[cells.column("at").to_numpy()] = cells.column("bits").to_numpy().view(np.uint64)
    shared = spark.sparkContext.broadcast(bits)
    sets = texts.mapInArrow(_sets_again(width, shared), "class binary, set binary").groupBy("class").agg(F.first("set").alias("set"))
    sets = written(sets.join(ends.select("rep", "class"), "class").select("rep", "set"), "sets")
    one = pairs.join(sets.select(F.col("rep").alias("x"), F.col("set").alias("set_x")), "x")
    two = one.join(sets.select(F.col("rep").alias("y"), F.col("set").alias("set_y")), "y")
    out = written(two.select("x", "y", "set_x", "set_y").mapInArrow(_compared, "x long, y long, overlap long"), "overlaps")
    shared.destroy()
    drop_written(sets)
    drop_written(ends)
    released(spark)
    return out


def held_back(df: DataFrame, label: str, made: list[DataFrame]) -> DataFrame:
    """`written`, and noted in made, to be removed."""
    made.append(written(df, label))
    return made[-1]


def needed(a, b, percent: int = PERCENT):
    """The least overlap of linked sets of sizes a and b, times (100 + percent)."""
    return (a + b) * percent


def room(a, i, b, j, percent: int = PERCENT):
    """Whether a first common shingle at positions i and j leaves room for a link of sets of sizes a and b."""
    return ((1 + F.least(a - i - 1, b - j - 1)) * (100 + percent) >= needed(a, b, percent)) & (F.least(a, b) * 100 >= F.greatest(a, b) * percent)


def links(entries: DataFrame, classes: DataFrame, bitmaps: DataFrame, texts: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Pairs (x, y) of classes that link; of classes that a leader links, only those with the leader.

    entries: rep, n, pos, shingle, hot (a ranked shingle); classes: class, rep, n, key; bitmaps: rep, n, bits;
    texts: one column.
    """
    made: list[DataFrame] = []  # tables that nothing reads once the links are written
    first = F.min(F.struct("pos", "rep", "n"))
    # An unranked shingle's list holds at most one in RANKED of all entries (else its cell were ranked): one shuffle and a window.
    # The others' lists may hold many of all rows: counts are combined before the shuffle, and the join's large partitions can be split.
    by = Window.partitionBy("shingle")
    cold = entries.filter("not hot").select("shingle", "rep", "n", "pos").repartition(F.col("shingle"))
    cold = cold.withColumn("k", F.count("*").over(by)).withColumn("lead", first.over(by)).filter("k > 1").select("shingle", "rep", "n", "pos", "k", "lead")
    some = entries.filter("hot").select("shingle", "rep", "n", "pos")
    leads = some.groupBy("shingle").agg(F.count("*").alias("k"), first.alias("lead")).filter("k > 1")
    lists = held_back(cold.unionByName(some.join(leads, "shingle").select("shingle", "rep", "n", "pos", "k", "lead")), "lists", made)
    mine = lists.filter(F.col("rep") != F.col("lead.rep"))
    star = mine.filter(room(F.col("n"), F.col("pos"), F.col("lead.n"), F.col("lead.pos"), percent)).select(F.col("rep").alias("x"), F.col("lead.rep").alias("y")).distinct()
    known = compare(held_back(possible(star, bitmaps, percent), "star", made), classes, texts, width)

    # A list of two has no pair but the one with its leader.
    held = lists.filter("k > 2").select("shingle", "rep", "n", "pos", F.col("lead.rep").alias("lead"), F.col("lead.n").alias("lead_n"))
    o = known.select(F.col("x").alias("rep"), F.col("y").alias("lead"), "overlap")
    held = held.join(o, ["rep", "lead"], "left")
    linked = F.coalesce(F.col("overlap") * (100 + percent) >= needed(F.col("n"), F.col("lead_n"), percent), F.lit(False)) | (F.col("rep") == F.col("lead"))
    held = held.withColumn("linked", linked).withColumn("overlap", F.when(F.col("rep") == F.col("lead"), F.col("n")).otherwise(F.col("overlap")))
    held = held_back(held, "held", made)
    # Blocks: what links to the leader and what doesn't, by power of 1.25 of the size and by zone of the position in the set.
    block = F.floor(F.log("n") / F.log(F.lit(100.0 / percent)) + 1e-9).cast("int")
    blocked = held.withColumn("block", block).withColumn("zone", F.floor(F.col("pos") * ZONES / F.col("n")).cast("int"))
    blocks = blocked.groupBy("shingle", "linked", "block", "zone").agg(F.min("pos").alias("b_pos"), F.min("n").alias("b_min"), F.max("n").alias("b_max"), F.max(F.col("n") - F.coalesce("overlap", F.lit(0))).alias("b_rest"), F.max(F.coalesce(F.col("overlap"), F.col("n"))).alias("b_o"))
    loose = blocked.filter("not linked")
    near = F.abs(F.col("e.block") - F.col("b.block")) <= 1
    fits = (1 + F.least(F.col("e.n") - F.col("e.pos") - 1, F.col("b_max") - F.col("b_pos") - 1)) * (100 + percent) >= needed(F.col("e.n"), F.col("b_min"), percent)
    derived = (F.least(F.col("e.overlap"), F.col("b_o")) + F.least(F.col("e.n") - F.col("e.overlap"), F.col("b_rest"))) * (100 + percent) >= needed(F.col("e.n"), F.col("b_min"), percent)
    ways = loose.alias("e").join(blocks.alias("b"), F.col("e.shingle") == F.col("b.shingle")).filter(near & fits & F.coalesce(derived, F.lit(True)))
    ways = ways.select(F.col("e.shingle").alias("shingle"), F.col("e.rep").alias("x"), F.col("e.n").alias("x_n"), F.col("e.pos").alias("x_pos"), F.col("e.overlap").alias("x_o"), F.col("b.linked").alias("to_linked"), F.col("b.block").alias("to_block"), F.col("b.zone").alias("to_zone"))
    y = blocked.select("shingle", F.col("linked").alias("to_linked"), F.col("block").alias("to_block"), F.col("zone").alias("to_zone"), F.col("rep").alias("y"), F.col("n").alias("y_n"), F.col("pos").alias("y_pos"), F.col("overlap").alias("y_o"))
    bound = (F.least("x_o", "y_o") + F.least(F.col("x_n") - F.col("x_o"), F.col("y_n") - F.col("y_o"))) * (100 + percent) >= needed(F.col("x_n"), F.col("y_n"), percent)
    rest = ways.join(y, ["shingle", "to_linked", "to_block", "to_zone"]).filter(
        (F.col("x") != F.col("y")) & room(F.col("x_n"), F.col("x_pos"), F.col("y_n"), F.col("y_pos"), percent) & F.coalesce(bound, F.lit(True))
    )
    pair = rest.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    done = known.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    more = compare(held_back(possible(pair.join(done, ["x", "y"], "left_anti"), bitmaps, percent), "rest", made), classes, texts, width)
    made += [known, more]
    sizes = classes.select("rep", "n")
    both = known.unionByName(more).join(sizes.select(F.col("rep").alias("x"), F.col("n").alias("x_n")), "x").join(sizes.select(F.col("rep").alias("y"), F.col("n").alias("y_n")), "y")
    linked = written(both.filter(F.col("overlap") * 100 >= (F.col("x_n") + F.col("y_n") - F.col("overlap")) * percent).select("x", "y"), "links")
    for x in made:
        drop_written(x)
    released(linked.sparkSession)
    return linked


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(x, y) -> (node, root): the smallest node that can be reached, for each node of an edge but the roots."""

    def stars(e: DataFrame, larger: bool) -> DataFrame:
        if larger:
            e = together(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))), rows)
        least = e.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        near = e.join(least, "a")
        if larger:
            return near.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        out = near.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return together(out.filter("a != b"), rows).distinct()

    e = written(edges.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).filter("a != b").distinct(), "edges")
    state, rows = None, e.count()
    for _ in range(rounds):
        former, e = e, written(stars(stars(together(e, rows), True), False), "edges")
        now = e.select(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop_written(former)
        if now == state:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state, rows = now, now[0]
    raise RuntimeError(f"components didn't settle in {rounds} rounds")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept (one of each component), row (its place in the input)."""
    rows = picked(docs, doc_id=id_col, text=text_col)
    return _components(rows.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"), width, percent)


def _components(rows: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(row, doc_id, text) -> as jaccard_components. Row numbers are read once; later reads of rows are of its texts alone."""
    spark = rows.sparkSession
    texts = rows.select("text")
    order = ranked(texts, width)
    shared = spark.sparkContext.broadcast(order)
    sets = written(rows.mapInArrow(_indexed(width, percent, shared), "row long, doc_id long, n long, class binary, cold long, prefix array<long>, bits binary, key long"), "index")
    shared.destroy()
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))
    classes = sets.filter("n > 0").groupBy("class").agg(F.min(F.when(F.col("prefix").isNotNull(), F.struct("row", "key"))).alias("rep"), F.max("n").alias("n"), first.alias("first"))
    classes = written(classes.select("class", F.col("rep.row").alias("rep"), F.col("rep.key").alias("key"), "n", F.col("first.doc_id").alias("first_id"), F.col("first.row").alias("first_row")), "classes")
    # Classes that several tasks met first have a prefix for each; few rows, so these are taken away rather than the others kept.
    firsts = sets.filter("prefix is not null").select("row", "class")
    again = written(firsts.join(classes.select("class", "rep"), "class").filter("row <> rep").select("row"), "again")
    entries = sets.filter("prefix is not null").join(again, "row", "left_anti").select(F.col("row").alias("rep"), "n", "cold", F.posexplode("prefix").alias("pos", "shingle"))
    entries = entries.select("rep", "n", "pos", "shingle", (F.col("pos") >= F.col("cold")).alias("hot"))
    found = links(entries, classes, sets.filter("prefix is not null").select(F.col("row").alias("rep"), "n", "bits"), texts, width, percent)
    roots = components(found)
    drop_written(found)
    drop_written(again)
    labelled = classes.join(roots, classes["rep"] == roots["node"], "left").withColumn("root", F.coalesce("root", "rep"))
    least = labelled.groupBy("root").agg(F.min(F.struct(F.col("first_id").isNull(), "first_id", "first_row")).alias("least"))
    named = written(labelled.join(least, "root").select(F.col("class").alias("of"), F.col("least.first_id").alias("component"), F.col("least.first_row").alias("stays")), "named")
    slim = written(sets.select("row", "doc_id", "n", "class"), "classified")
    for x in (sets, classes, roots):
        drop_written(x)
    released(spark)
    return slim.join(named, F.col("class") == F.col("of"), "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"),
        (F.col("class").isNull() | (F.col("row") == F.col("stays"))).alias("kept"),
        "row",
    )


def near_deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, one of each component (the smallest doc_id), with all their columns.

    docs is evaluated once and written with its row numbers, so what stays is the same whatever docs is made of and whichever
    columns are asked for.
    """
    rows = numbered(docs, "rows")
    key, text = F.col(place_of(docs, id_col)).cast("long"), F.col(place_of(docs, text_col))
    stays = _components(rows.select("row", key.alias("doc_id"), text.alias("text"))).filter("kept").select("row")
    return named_again(staying(rows, stays), docs)
