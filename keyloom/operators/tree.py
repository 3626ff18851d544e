"""Paged ordered index over keyed objects: global ranks, canonical pages, levels, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions.codec import digest
from keyloom.functions.session import written

# Entries of a leaf and of an internal page, and the least of each.
LEAF, LEAF_LEAST, FANOUT, FANOUT_LEAST = 185, 93, 255, 128
#: Ranges in which global ranks are computed, independent of each other.
RANGES = 64
#: Ids in a cell of the lookup.
CELL = 4096


def page_of(rank: Column, total: Column, capacity: int, least: int) -> Column:
    """The canonical page (from 0) of a rank (from 1): full pages, and the last two share so that none is under `least`."""
    full, rest = F.floor(total / capacity), total % capacity
    even = F.floor((rank - 1) / capacity)
    first, second = (full - 1) * capacity, (full - 1) * capacity + capacity - (least - rest)
    split = F.when(rank <= first, even).when(rank <= second, full - 1).otherwise(full)
    return F.when((total <= capacity) | (rest == 0) | (rest >= least), even).otherwise(split).cast("long")


def in_ranges(df: DataFrame, key: str, ranges: int = RANGES) -> DataFrame:
    """df with `part`, the range of the key's values that a row falls into: later ranges hold larger keys."""
    cuts = df.agg(F.percentile_approx(key, [k / ranges for k in range(1, ranges)], 10_000)).first()[0] or []
    cuts = sorted(set(cuts))
    return df.withColumn("part", F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(key))) if cuts else F.lit(0))


def global_rank(df: DataFrame, key: str, ranges: int = RANGES, ties: tuple[str, ...] = ()) -> DataFrame:
    """df with `rank` (1 ...) and `total`, by key and then by ties. Ranges are ranked side by side; only their counts meet in one place."""
    dealt = in_ranges(df, key, ranges)
    sums = dealt.groupBy("part").agg(F.count("*").alias("n"))
    sums = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(key, *ties))
    return dealt.withColumn("own", own).join(F.broadcast(sums), "part").withColumn("rank", F.col("own") + F.col("before")).drop("part", "own", "before")


def running(df: DataFrame, key: str, value: Column, into: str, how: str = "sum", ties: tuple[str, ...] = (), before: bool = False, ranges: int = RANGES) -> DataFrame:
    """df with the running sum or max of a value in the order of key and ties (before: without the row itself).

    Each range runs by itself; the ranges' own sums or maxima, a row for each, run in one place.
    """
    fold = {"sum": F.sum, "max": F.max}[how]
    dealt = in_ranges(df, key, ranges).withColumn("value_", value)
    own = Window.partitionBy("part").orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, -1 if before else Window.currentRow)
    carry = dealt.groupBy("part").agg(fold("value_").alias("all_"))
    carry = carry.select("part", fold("all_").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried_"))
    both = dealt.withColumn("own_", fold("value_").over(own)).join(F.broadcast(carry), "part")
    found = F.greatest("own_", "carried_") if how == "max" else F.coalesce("own_", F.lit(0)) + F.coalesce("carried_", F.lit(0))
    return both.withColumn(into, found).drop("part", "value_", "own_", "carried_")


def leaf_pages(objects: DataFrame) -> DataFrame:
    """(object_id, digest) -> level, page_no, min_id, max_id, entry_count, page_digest."""
    ranked = global_rank(objects.select("object_id", "digest"), "object_id")
    paged = ranked.withColumn("page_no", page_of(F.col("rank"), F.col("total"), LEAF, LEAF_LEAST))
    return _pages(paged.select("page_no", F.col("object_id").alias("low"), F.col("object_id").alias("high"), "digest"), 0)


def _pages(entries: DataFrame, level: int) -> DataFrame:
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("low", "digest"))), lambda e: F.concat_ws(":", e["low"], e["digest"])), ",")
    return entries.groupBy("page_no").agg(F.lit(level).alias("level"), F.min("low").alias("min_id"), F.max("high").alias("max_id"), F.count("*").alias("entry_count"), digest("page", F.lit(level), body).alias("page_digest")).select("level", "page_no", "min_id", "max_id", "entry_count", "page_digest")


def next_level(pages: DataFrame, level: int) -> DataFrame:
    """The internal pages above `pages`; page numbers are ranks already."""
    total = pages.agg(F.count("*").alias("total"))
    entries = pages.crossJoin(F.broadcast(total)).withColumn("up", page_of(F.col("page_no") + 1, F.col("total"), FANOUT, FANOUT_LEAST))
    return _pages(entries.select(F.col("up").alias("page_no"), F.col("min_id").alias("low"), F.col("max_id").alias("high"), F.col("page_digest").alias("digest")), level)


def index_pages(objects: DataFrame) -> DataFrame:
    """All levels, leaves to root. Each level is written once, and the one above is made of it."""
    pages, level = written(leaf_pages(objects), "pages"), 0
    out = pages
    while pages.count() > 1:
        level += 1
        pages = written(next_level(pages, level), "pages")
        out = out.unionByName(pages)
    return out


def touched(pages: DataFrame, keys: DataFrame) -> DataFrame:
    """Per level: pages, and those whose range holds a key (column key). Keys meet maxima in ranges of ids, level by level."""
    from keyloom.operators.cow import routed

    out = None
    for level in range(pages.agg(F.max("level")).first()[0] + 1):
        own = pages.filter(F.col("level") == level).select(F.col("page_no").alias("page"), "min_id", "max_id")
        at = routed(keys.select(F.col("key").alias("object_id")), own).join(own.withColumnRenamed("page", "leaf"), "leaf").filter("object_id between min_id and max_id")
        row = own.agg(F.count("*").alias("pages")).crossJoin(at.agg(F.count_distinct("leaf").alias("touched"))).select(F.lit(level).alias("level"), "pages", "touched")
        out = row if out is None else out.unionByName(row)
    return out


def lookup(pages: DataFrame, objects: DataFrame, keys: DataFrame) -> DataFrame:
    """For each key: the leaf whose range holds it (null: in a gap between leaves or outside), and whether it is there.

    keys: key. Routing is by upper bound, the first leaf whose max_id is not less. A leaf takes the ids since the leaf before;
    it meets the keys by equal cells of `CELL` ids, so nothing is compared but what lies near each other.
    """
    own = pages.filter("level = 0").select("page_no", "min_id", "max_id")
    before = own.select((F.col("page_no") + 1).alias("page_no"), F.col("max_id").alias("last"))  # page numbers have no gaps
    leaves = own.join(before, "page_no", "left").select("page_no", "min_id", "max_id", F.coalesce("last", F.col("min_id") - 1).alias("after"))
    lowest = leaves.agg(F.min("min_id").alias("lowest"))
    cells = leaves.select(F.struct("page_no", "min_id", "max_id", "after").alias("leaf"), F.explode(F.sequence(F.floor((F.col("after") + 1) / CELL), F.floor(F.col("max_id") / CELL))).alias("cell"))
    asked = keys.crossJoin(F.broadcast(lowest)).select(F.col("key").alias("at"), F.floor(F.greatest("key", "lowest") / CELL).alias("k_cell"), F.greatest("key", "lowest").alias("up"))
    routed = asked.join(cells, (F.col("k_cell") == F.col("cell")) & (F.col("up") > F.col("leaf.after")) & (F.col("up") <= F.col("leaf.max_id")), "left")
    inside = F.coalesce(F.col("leaf.min_id") <= F.col("at"), F.lit(False))
    found = routed.select(F.col("at").alias("key"), F.col("leaf.page_no").alias("routed_page"), F.when(inside, F.col("leaf.page_no")).alias("page_no"))
    there = objects.select(F.col("object_id").alias("key"), F.lit(True).alias("there"))
    return found.join(there, "key", "left").select("key", "routed_page", "page_no", F.coalesce("there", F.lit(False)).alias("found"))


def shape(n: int, leaf: int = LEAF, fanout: int = FANOUT) -> list[int]:
    """Pages of each level, leaves first."""
    out = [max(1, -(-n // leaf))]
    while out[-1] > 1:
        out.append(-(-out[-1] // fanout))
    return out


def hash_anchors(scored: DataFrame, threshold: int) -> DataFrame:
    """(object_id, score) -> pages that each begin at a score under the threshold: page, entries, min_id, max_id. Boundaries
    depend on the entries alone, so an update changes the pages around it only."""
    paged = running(scored, "object_id", (F.col("score") < threshold).cast("long"), "page")
    return paged.groupBy("page").agg(F.count("*").alias("entries"), F.min("object_id").alias("min_id"), F.max("object_id").alias("max_id"))


def minimizers(scored: DataFrame, width: int, block: int = 1 << 16) -> DataFrame:
    """(object_id, score) -> boundary, windows: the entry of least score (leftmost on ties) of each `width` entries in a row.

    Ranks are cut into blocks; a block also gets the last width - 1 entries of the one before, so no window is cut.
    """
    ranked = global_rank(scored, "object_id").withColumn("r", F.col("rank") - 1)
    own = F.floor(F.col("r") / block)
    next_ = F.when(F.col("r") % block >= block - (width - 1), own + 1)
    dealt = ranked.withColumn("block", F.explode(F.filter(F.array(own, next_), lambda x: x.isNotNull())))
    w = Window.partitionBy("block").orderBy("object_id").rowsBetween(-(width - 1), Window.currentRow)
    least = dealt.withColumn("boundary", F.min(F.struct("score", "object_id")).over(w)["object_id"]).filter((F.col("rank") >= width) & (F.floor(F.col("r") / block) == F.col("block")))
    return least.groupBy("boundary").agg(F.count("*").alias("windows"))
