"""Analytic models of paged directories as DataFrame functions: shapes, sizes, costs, envelopes, budgets.

Each takes its cases as a DataFrame or as parameters and adds columns; the defaults are the published cases. Arithmetic is over a
few rows; only `external_sort` and `batched_paths` generate rows of their own, on the executors.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Levels that a tree may have at most; with a fanout of two that is more than there are numbers.
MOST_LEVELS = 64
GIB = 1 << 30


def cases(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows in one partition, so that crossing several such tables doesn't multiply partitions."""
    return spark.createDataFrame(rows, schema).coalesce(1)


def ceil_div(a: Column, b: Column) -> Column:
    return F.ceil(a / b).cast("long")


def tree(entries: Column, leaf: Column, fanout: Column) -> Column:
    """Pages of each level, leaves first, of a packed tree: level upon level until one page is left."""
    first = F.array(F.greatest(ceil_div(entries, leaf), F.lit(1).cast("long")))
    top = lambda s: F.element_at(s, -1)
    return F.aggregate(F.sequence(F.lit(1), F.lit(MOST_LEVELS)), first, lambda s, _: F.when(top(s) > 1, F.concat(s, F.array(ceil_div(top(s), fanout)))).otherwise(s))


def total(levels: Column) -> Column:
    return F.aggregate(levels, F.lit(0).cast("long"), lambda a, x: a + x)


def with_tree(df: DataFrame, leaf: str = "leaf_capacity", fanout: str = "fanout", entries: str = "entries") -> DataFrame:
    """df with levels, pages and depth. The levels come out of a generator, so that they are computed once and not inlined."""
    df = df.drop("levels", "pages", "depth")
    df = df.select("*", F.explode(F.array(tree(F.col(entries), F.col(leaf), F.col(fanout)))).alias("levels"))
    return df.withColumn("pages", total(F.col("levels"))).withColumn("depth", F.size("levels"))


def capacity(page: Column, header: Column, entry: Column) -> Column:
    return F.floor((page - header) / entry).cast("long")


def table_of(names: list[str], *rows: list[Column]) -> Column:
    """Rows of columns, as a generator."""
    return F.inline(F.array(*[F.struct(*[c.alias(n) for n, c in zip(names, row, strict=True)]) for row in rows]))


SIZES = [1_000, 1_000_000, 100_000_000]


def sizes(spark: SparkSession, counts: list[int] | None = None) -> DataFrame:
    return cases(spark, [(n,) for n in counts or SIZES], "entries long")


# ---- shapes and sizes ---------------------------------------------------------------------------------------------------


def tree_shape(spark: SparkSession, counts: list[int] | None = None, leaf: int = 240, fanout: int = 256) -> DataFrame:
    found = with_tree(sizes(spark, counts).withColumn("leaf_capacity", F.lit(leaf)).withColumn("fanout", F.lit(fanout)))
    return found.select("entries", F.col("levels")[0].alias("leaves"), "pages", "depth")


def directory_comparison(spark: SparkSession, counts: list[int] | None = None, page: int = 16384) -> DataFrame:
    """A tree, a sorted array of 64-byte entries and hash pages of 180 entries under a table of 1,024 pointers a page."""
    s = tree_shape(spark, counts)
    buckets = ceil_div(F.col("entries"), F.lit(180))
    hashed = (buckets + ceil_div(buckets, F.lit(1024)) + 1) * page
    long = lambda x: F.lit(x).cast("long")
    ways = table_of(
        ["model", "total_bytes", "page_reads", "rewrite_bytes"],
        [F.lit("btree"), F.col("pages") * page, F.col("depth"), (F.col("depth") * page).cast("long")],
        [F.lit("sorted_array"), F.col("entries") * 64, F.ceil(F.log2("entries")).cast("int"), F.col("entries") * 64],
        [F.lit("hash_pages"), hashed, F.lit(3), long(3 * page)],
    )
    return s.select("entries", ways)


def page_sizes(spark: SparkSession, entries: int = 100_000_000, pages: tuple[int, ...] = (4096, 16384, 65536), header: int = 64, leaf_entry: int = 88, internal_entry: int = 64) -> DataFrame:
    p = cases(spark, [(entries, x) for x in pages], "entries long, page_bytes long")
    p = p.withColumn("leaf_capacity", capacity(F.col("page_bytes"), F.lit(header), F.lit(leaf_entry))).withColumn("fanout", capacity(F.col("page_bytes"), F.lit(header), F.lit(internal_entry)))
    return with_tree(p).select("page_bytes", "leaf_capacity", "fanout", "pages", "depth", (F.col("pages") * F.col("page_bytes")).alias("directory_bytes"))


def copy_on_write(spark: SparkSession, counts: list[int] | None = None, page: int = 16384) -> DataFrame:
    found = with_tree(sizes(spark, counts).withColumn("leaf_capacity", F.lit(185)).withColumn("fanout", F.lit(255)))
    return found.select("entries", "pages", "depth", (F.col("pages") * page).alias("rebuild_bytes"), (F.col("depth") * page).cast("long").alias("path_bytes"))


def locator_widths(spark: SparkSession, entries: int = 100_000_000, widths: tuple[int, ...] = (56, 64, 72, 88, 96), page: int = 16384) -> DataFrame:
    w = cases(spark, [(entries, x) for x in widths], "entries long, width long").withColumn("leaf_capacity", capacity(F.lit(page), F.lit(64), F.col("width"))).withColumn("fanout", F.lit(255))
    return with_tree(w).select("width", "leaf_capacity", "pages", "depth", F.round(F.col("pages") * page / F.lit(float(GIB)), 6).alias("gib"))


def inventory_crossover(spark: SparkSession, pairs: tuple[tuple[int, int], ...] = ((72, 56), (88, 56), (96, 64)), entries: int = 100_000_000, object_header: int = 48) -> DataFrame:
    """The share of objects above which entries that hold what an inventory asks for cost fewer bytes than reading headers."""
    wide = locator_widths(spark, entries, tuple({w for p in pairs for w in p})).select("width", (F.col("pages") * 16384).alias("bytes"))
    p = cases(spark, list(pairs), "mirrored long, minimal long")
    both = p.join(wide.toDF("mirrored", "a"), "mirrored").join(wide.toDF("minimal", "b"), "minimal")
    return both.select("mirrored", "minimal", F.round((F.col("a") - F.col("b")) / F.lit(float(entries * object_header)), 6).alias("crossover"))


# Name, bits of an id, bytes of an object header, a page header, a leaf entry and an internal entry.
LAYOUTS = [("draft-128", 128, 64, 80, 64, 72), ("compact-128", 128, 56, 64, 64, 72), ("tight-128", 128, 48, 56, 64, 72), ("compact-64", 64, 48, 48, 56, 56), ("tight-64", 64, 40, 40, 56, 56)]


def identifier_widths(spark: SparkSession, counts: list[int] | None = None, page: int = 16384) -> DataFrame:
    """Bytes of structure for each object under the layouts of 64 and 128 bits, with and without reserve in the headers."""
    d = cases(spark, LAYOUTS, "layout string, id_bits int, object_header long, page_header long, leaf_entry long, internal_entry long").crossJoin(sizes(spark, counts or [1_000_000, 100_000_000]))
    d = d.withColumn("leaf_capacity", capacity(F.lit(page), F.col("page_header"), F.col("leaf_entry"))).withColumn("fanout", capacity(F.lit(page), F.col("page_header"), F.col("internal_entry")))
    d = with_tree(d).withColumn("directory_bytes", F.col("pages") * page)
    return d.select("layout", "entries", "leaf_capacity", "fanout", F.array_join(F.col("levels").cast("array<string>"), "/").alias("level_pages"), "directory_bytes", F.round((F.col("directory_bytes") + F.col("entries") * F.col("object_header")) / F.col("entries"), 3).alias("bytes_per_object"))


def upper_bound_saving(spark: SparkSession, entries: int = 100_000_000, page: int = 16384) -> DataFrame:
    """Directory bytes with both bounds of a child and with its upper bound only."""
    d = cases(spark, [("compact-128", 64, 64, 72, 56), ("compact-64", 48, 56, 56, 48)], "layout string, header long, leaf_entry long, both long, upper long").withColumn("entries", F.lit(entries).cast("long"))
    d = d.withColumn("leaf_capacity", capacity(F.lit(page), F.col("header"), F.col("leaf_entry")))
    for name in ("both", "upper"):
        d = with_tree(d.withColumn("fanout", capacity(F.lit(page), F.col("header"), F.col(name)))).withColumn(f"{name}_bytes", F.col("pages") * page)
    return d.select("layout", "both_bytes", "upper_bytes", (F.col("both_bytes") - F.col("upper_bytes")).alias("saved_bytes"))


def uint_bytes(x: Column) -> Column:
    """Bytes of a canonical unsigned integer."""
    return F.when(x <= 23, 1).when(x <= 0xFF, 2).when(x <= 0xFFFF, 3).when(x <= 0xFFFF_FFFF, 5).otherwise(9)


def scale_limits(spark: SparkSession, counts: tuple[int, ...] = (1, 1_000, 1_000_000, 100_000_000), header: int = 32, record: int = 40, footer: int = 80) -> DataFrame:
    """The least bytes of a flat file: record headers, and a directory whose entries are 42 bytes and two integers."""
    n = cases(spark, [(x,) for x in counts], "entries long")

    def widths(start: int, step: int) -> Column:  # of start, start + step, ..., n numbers
        upto = lambda limit: F.least(F.col("entries"), F.greatest(F.floor((F.lit(limit) - start) / step) + 1, F.lit(0))).cast("long")
        a, b, c, d = (upto(x) for x in (23, 0xFF, 0xFFFF, 0xFFFF_FFFF))
        return a + (b - a) * 2 + (c - b) * 3 + (d - c) * 5 + (F.col("entries") - d) * 9

    n = n.withColumn("header_bytes", F.col("entries") * record)
    n = n.withColumn("directory_bytes", (9 + uint_bytes(F.col("entries")) + F.col("entries") * 42 + widths(1, 1) + widths(header, record)).cast("long"))
    return n.select("entries", "header_bytes", "directory_bytes", (F.col("header_bytes") + F.col("directory_bytes") + header + footer).alias("file_bytes"))


def framing(spark: SparkSession) -> DataFrame:
    """Headers of 40 bytes against a compact form: 8 bytes, the length twice and the id, each in groups of seven bits."""
    # Workload, first and last id, payload bytes of each of them.
    runs = [("minimal", 1, 1, 32), ("minimal", 2, 2, 160), ("small-archive", 1, 1_000, 256), ("small-archive", 1_001, 1_001, 64), ("small-archive", 1_002, 1_002, 64_000)]
    runs += [("table-pages", 1, 10_000, 65_536), ("table-pages", 10_001, 10_001, 128), ("table-pages", 10_002, 10_002, 600_000)]
    runs += [("large-media", 1, 1_000, 64 << 20), ("large-media", 1_001, 1_001, 256), ("large-media", 1_002, 1_002, 96_000)]
    r = cases(spark, runs, "workload string, first long, last long, payload long").withColumn("id", F.explode(F.sequence("first", "last")))
    groups = lambda x: F.greatest(F.ceil(F.length(F.bin(x)) / 7), F.lit(1))
    r = r.withColumn("compact", (8 + 2 * groups(F.col("payload")) + groups(F.col("id"))).cast("long"))
    s = r.groupBy("workload").agg(F.count("*").alias("records"), F.sum("compact").alias("compact_bytes"), F.sum("payload").alias("payload"))
    fixed = F.col("records") * 40
    return s.select("workload", "records", fixed.alias("fixed_bytes"), "compact_bytes", F.round(100 * (fixed - F.col("compact_bytes")) / fixed, 3).alias("header_saving"), F.round(100 * (fixed - F.col("compact_bytes")) / (fixed + F.col("payload")), 6).alias("file_saving"))


def footer_discovery(spark: SparkSession, footer: int = 80, bound: int = 65_536) -> DataFrame:
    """Bytes that the exact-end rule and the bounded search backwards look at, by file size."""
    f = cases(spark, [("exact", 180), ("trailing-16", 196), ("trailing-64KiB", 65_716), ("short", 40)], "name string, file_bytes long")
    return f.select("name", "file_bytes", F.least("file_bytes", F.lit(footer)).alias("exact_examined"), F.least("file_bytes", F.lit(bound + footer)).alias("backward_examined"))


def collisions(spark: SparkSession, counts: tuple[int, ...] = (1_000_000, 100_000_000, 1_000_000_000), bits: tuple[int, ...] = (64, 96, 128)) -> DataFrame:
    """log10 of the chance that two of n random ids are equal, and that one of n is among n others."""
    x = cases(spark, [(float(n), b) for n in counts for b in bits], "n double, bits int")
    chance = lambda a: F.round(F.log10(-F.expm1(-a)), 6)
    space = F.pow(F.lit(2.0), F.col("bits"))
    return x.select(F.col("n").cast("long").alias("entries"), "bits", chance(F.col("n") * (F.col("n") - 1) / 2 / space).alias("log10_birthday"), chance(F.col("n") * F.col("n") / space).alias("log10_cross"))


# ---- sorting, checkpoints, paths ----------------------------------------------------------------------------------------


def merge_passes(spark: SparkSession, fan_ins: tuple[int, ...] = (4, 8, 32), entries: int = 200_003, run: int = 512) -> DataFrame:
    """Passes of a merge that opens fan_in runs at a time: runs are divided, pass by pass, until one is left."""
    k = cases(spark, [(f, -(-entries // run)) for f in fan_ins], "fan_in long, runs long")
    return k.select("fan_in", "runs", (F.size(tree(F.col("runs"), F.lit(1), F.col("fan_in"))) - 1).cast("long").alias("passes"))


def external_sort(spark: SparkSession, run_entries: tuple[int, ...] = (4096, 7777), entries: int = 200_003, entry_bytes: int = 88) -> DataFrame:
    """Sorted runs of a permutation of 1 to `entries`, and whether their merge is a sequence without gap or repetition."""
    ids = spark.range(entries).select("id", ((F.col("id") * 65_537 + 17_171) % entries + 1).alias("object_id"))
    dealt = ids.crossJoin(cases(spark, [(r,) for r in run_entries], "run_entries long")).withColumn("run", F.floor(F.col("id") / F.col("run_entries")))
    runs = dealt.groupBy("run_entries", "run").agg(F.count("*").alias("n"), F.min("object_id").alias("low"), F.max("object_id").alias("high"), F.sum("object_id").alias("sum"))
    s = runs.groupBy("run_entries").agg(F.count("*").alias("runs"), F.max("n").alias("peak"), F.sum("n").alias("all"), F.min("low").alias("first_id"), F.max("high").alias("last_id"), F.sum("sum").alias("sum"))
    seen = dealt.groupBy("run_entries", "object_id").count().groupBy("run_entries").agg(F.count("*").alias("different"))
    return s.join(seen, "run_entries").select("run_entries", "runs", (F.col("peak") * entry_bytes).alias("peak_bytes"), (F.col("all") * entry_bytes).alias("spilled_bytes"), "first_id", "last_id", ((F.col("different") == entries) & (F.col("last_id") - F.col("first_id") + 1 == entries)).alias("complete"))


def checkpoint_cadence(spark: SparkSession, every: tuple[int, ...] = (100, 1_000, 10_000, 100_000), objects: int = 1_000_000, page: int = 16384) -> DataFrame:
    """Bytes of all checkpoints: the whole tree each time, or a path for each object since the last one."""
    k = cases(spark, [(x,) for x in every], "every long").withColumn("entries", F.explode(F.sequence(F.col("every"), F.lit(objects).cast("long"), F.col("every"))))
    t = with_tree(k.withColumn("leaf_capacity", F.lit(185)).withColumn("fanout", F.lit(255)))
    return t.groupBy("every").agg(F.count("*").alias("checkpoints"), (F.sum("pages") * page).alias("rebuild_bytes"), (F.sum(F.col("every") * F.col("depth")) * page).alias("path_bytes"))


def batched_paths(spark: SparkSession, changed: tuple[int, ...] = (1, 10, 100, 1_000, 10_000), entries: int = 1_000_000, leaf: int = 185, fanout: int = 255) -> DataFrame:
    """Different pages on the paths of objects spread evenly over the leaves, and pages if no path shared any."""
    one = with_tree(sizes(spark, [entries]).withColumn("leaf_capacity", F.lit(leaf)).withColumn("fanout", F.lit(fanout)))
    c = cases(spark, [(x,) for x in changed], "changed long").crossJoin(one.select("levels", "depth"))
    leaves = F.least("changed", F.col("levels")[0])
    c = c.withColumn("leaf", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), leaves - 1), lambda i: F.floor(i * F.col("levels")[0] / leaves))))
    up = c.withColumn("level", F.explode(F.sequence(F.lit(0), F.col("depth") - 1))).withColumn("page", F.floor(F.col("leaf") / F.pow(F.lit(float(fanout)), F.col("level"))))
    seen = up.select("changed", "depth", "level", "page").distinct()
    return seen.groupBy("changed", "depth").agg(F.count("*").alias("pages")).select("changed", "pages", (F.col("changed") * F.col("depth")).alias("unshared"))


# ---- costs --------------------------------------------------------------------------------------------------------------

# Geometry, page header, leaf entry, internal entry; occupancy, its fill (0: exactly half).
GEOMETRIES = [("draft-128", 80, 64, 72), ("compact-128", 64, 64, 72)]
OCCUPANCIES = [("minimum", 0.0), ("yao-random-insert", math.log(2)), ("eighty-percent", 0.8), ("packed", 1.0)]
PAGE_SIZES = [4096, 16384, 65536]


def expected_costs(spark: SparkSession, counts: list[int] | None = None) -> DataFrame:
    """For each geometry, occupancy, size and page: reads and bytes of a path, and what an insertion is expected to write."""
    d = cases(spark, GEOMETRIES, "geometry string, header long, leaf_entry long, internal_entry long").crossJoin(cases(spark, OCCUPANCIES, "occupancy string, fill double")).crossJoin(cases(spark, [(p,) for p in PAGE_SIZES], "page_size long")).crossJoin(sizes(spark, counts or [1_000_000, 100_000_000]))
    for name, entry in (("leaf", "leaf_entry"), ("fanout", "internal_entry")):
        whole = capacity(F.col("page_size"), F.col("header"), F.col(entry))
        d = d.withColumn(name, F.when(F.col("fill") == 0, F.ceil(whole / 2).cast("double")).otherwise(F.col("fill") * whole))
    d = with_tree(d, "leaf", "fanout")
    # A level gains a page for so many insertions; the root's own growth is left out.
    splits = F.aggregate(F.sequence(F.lit(1), F.lit(MOST_LEVELS)), F.struct(F.lit(0.0).alias("sum"), F.col("leaf").alias("per")), lambda s, k: F.struct(F.when(k < F.col("depth"), s["sum"] + 1 / s["per"]).otherwise(s["sum"]).alias("sum"), (s["per"] * F.col("fanout")).alias("per")))["sum"]
    d = d.withColumn("split_events", splits)
    return d.select("geometry", "occupancy", "entries", "page_size", F.col("depth").alias("path_reads"), (F.col("depth") * F.col("page_size")).alias("path_bytes"), F.round("split_events", 9).alias("split_events"), F.round((F.col("depth") + F.col("split_events")) * F.col("page_size"), 3).alias("insert_bytes"))


def break_even(costs: DataFrame) -> DataFrame:
    """Pairs of page sizes: the latency-bandwidth product in bytes at which fewer reads make up for more bytes (null: never)."""
    keys = ["geometry", "occupancy", "entries"]
    a, b = costs.select(*keys, *[F.col(c).alias(f"a_{c}") for c in costs.columns[3:]]), costs.select(*keys, *[F.col(c).alias(f"b_{c}") for c in costs.columns[3:]])
    p = a.join(b, keys).filter("a_page_size < b_page_size")
    at = F.try_divide(F.col("b_path_bytes") - F.col("a_path_bytes"), F.col("a_path_reads") - F.col("b_path_reads"))
    return p.select(*keys, "a_page_size", "b_page_size", F.when(at > 0, F.round(at, 6)).alias("break_even"))


def lower_envelope(costs: DataFrame, pressures: tuple[float, ...] = (0.0, 0.5, 2.0)) -> DataFrame:
    """For each update pressure the cheapest page size in each range of the latency-bandwidth product q.

    Costs are lines in q: path_bytes + path_reads * q + pressure * insert_bytes. Every positive crossing begins a range; its
    winner is the cheapest at a point within (ties: the smaller page), and neighbours of one winner are one range.
    """
    spark, keys = costs.sparkSession, ["geometry", "occupancy", "entries", "pressure"]
    lines = costs.crossJoin(cases(spark, [(p,) for p in pressures], "pressure double")).select(*keys, "page_size", "path_reads", (F.col("path_bytes") + F.col("pressure") * F.col("insert_bytes")).alias("base"))
    other = lines.select(*keys, F.col("path_reads").alias("reads2"), F.col("base").alias("base2"))
    crossing = F.try_divide(F.col("base2") - F.col("base"), (F.col("path_reads") - F.col("reads2")).cast("double"))
    starts = lines.join(other, keys).select(*keys, crossing.alias("q")).filter("q > 0").unionByName(lines.select(*keys, F.lit(0.0).alias("q"))).distinct()
    w = Window.partitionBy(*keys).orderBy("q")  # a handful of crossings
    ranges = starts.withColumn("until", F.lead("q").over(w)).withColumn("probe", F.when(F.col("until").isNull(), F.col("q") + 1).otherwise((F.col("q") + F.col("until")) / 2))
    won = ranges.join(lines, keys).groupBy(*keys, "q", "until").agg(F.min(F.struct((F.col("base") + F.col("path_reads") * F.col("probe")).alias("cost"), "page_size"))["page_size"].alias("page_size"))
    fresh = won.withColumn("new", F.coalesce(F.lag("page_size").over(w) != F.col("page_size"), F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(w))
    return fresh.groupBy(*keys, "run", "page_size").agg(F.round(F.min("q"), 3).alias("q_min"), F.round(F.when(F.max(F.col("until").isNull().cast("int")) == 0, F.max("until")), 3).alias("q_max")).drop("run")


# ---- budgets ------------------------------------------------------------------------------------------------------------

MIB = 1 << 20
# Name, bytes of a file and of an object, objects, bytes of a request.
PROFILES = [("research-small", 64 * MIB, MIB, 100_000, MIB), ("research-medium", 4 * GIB, 16 * MIB, 1_000_000, MIB), ("research-large", 64 * GIB, 64 * MIB, 10_000_000, 4 * MIB)]


def support_profiles(spark: SparkSession, profiles: list[tuple] | None = None, fixed_reads: int = 32) -> DataFrame:
    """What the strictest reading of a profile needs: each object's header and its chunks, each page, each chunk of the file;
    three lengths of the file read, two hashed; and whether the limits fit together."""
    p = cases(spark, profiles or PROFILES, "profile string, file_bytes long, object_bytes long, entries long, request_bytes long")
    p = with_tree(p.withColumn("leaf_capacity", F.lit(185)).withColumn("fanout", F.lit(255)))
    reads = F.lit(fixed_reads) + F.col("entries") + F.col("entries") * ceil_div(F.col("object_bytes"), F.col("request_bytes")) + F.col("pages") + ceil_div(F.col("file_bytes"), F.col("request_bytes"))
    fits = (F.col("object_bytes") <= F.col("file_bytes")) & (F.col("entries") * 48 <= F.col("file_bytes")) & (F.col("request_bytes") > 0)
    return p.select("profile", "pages", (F.col("depth") - 1).alias("depth"), reads.cast("long").alias("reads"), (F.col("file_bytes") * 3).alias("read_bytes"), (F.col("file_bytes") * 2).alias("hash_bytes"), fits.alias("consistent"))


def satisfiable(needed: DataFrame, allowed: DataFrame) -> DataFrame:
    """(profile, reads, read_bytes, hash_bytes) needed, and the same allowed -> which budgets suffice."""
    a = allowed.select("profile", *[F.col(c).alias(f"max_{c}") for c in ("reads", "read_bytes", "hash_bytes")], "case")
    both = needed.join(a, "profile")
    ok = {c: F.col(c) <= F.col(f"max_{c}") for c in ("reads", "read_bytes", "hash_bytes")}
    return both.select("profile", "case", *[v.alias(f"{c}_suffice") for c, v in ok.items()], (ok["reads"] & ok["read_bytes"] & ok["hash_bytes"]).alias("satisfiable"))


def limit_interactions(spark: SparkSession, objects: int = 10_000_000, reads: int = 1_000_000, scan_bytes: int = 16 << 20, request: int = 65_536, candidate_bytes: int = 64 << 30, file_bytes: int = 16 << 30, validations: int = 1_024) -> DataFrame:
    """Limits that bound each other: what the largest object count needs, and which limit is reached first."""
    shape = with_tree(sizes(spark, [objects]).withColumn("leaf_capacity", F.lit(185)).withColumn("fanout", F.lit(255))).select("pages", "depth")
    long = lambda x: F.lit(x).cast("long")
    rows = table_of(
        ["name", "needed", "allowed"],
        [F.lit("directory_pages"), F.col("pages"), long(1_000_000)],
        [F.lit("depth"), F.col("depth").cast("long"), long(32)],
        [F.lit("file_bytes"), F.col("pages") * 16384 + objects * 48, long(file_bytes)],
        [F.lit("object_reads"), long(objects), long(reads)],
        [F.lit("scan_reads"), long(-(-scan_bytes // request)), long(4_096)],
        [F.lit("full_candidates"), long(validations), long(candidate_bytes // file_bytes)],
    )
    return shape.select(rows).select("name", "needed", "allowed", (F.col("needed") <= F.col("allowed")).alias("fits"))


# ---- occupancy ----------------------------------------------------------------------------------------------------------


def borrow_sides(spark: SparkSession, least: int = 93, most: int = 96) -> DataFrame:
    """Who helps a page one short, by its siblings' entries (-1: none): left first, and the fuller one (left on ties)."""
    side = cases(spark, [(n,) for n in (-1, *range(least, most + 1))], "n int")
    s = side.toDF("left_entries").crossJoin(side.toDF("right_entries"))
    left, right = F.col("left_entries"), F.col("right_entries")
    merge = F.when(left >= 0, "merge_left").when(right >= 0, "merge_right").otherwise("alone")
    first = F.when(left > least, "borrow_left").when(right > least, "borrow_right").otherwise(merge)
    fuller = F.when((left > least) & (left >= right), "borrow_left").when(right > least, "borrow_right").otherwise(merge)
    donor = F.when(first == "borrow_left", left).when(first == "borrow_right", right)
    return s.select("left_entries", "right_entries", first.alias("left_first"), fuller.alias("fuller_sibling"), F.coalesce(donor == least + 1, F.lit(False)).alias("donor_cliff"))


def hazards(pages: DataFrame, least: int, capacity: int) -> DataFrame:
    """(entries of each leaf) -> the chance that a random deletion leaves a leaf short, and that a random insertion splits one.

    A deletion hits a key of a leaf at the minimum, an insertion a gap of a full leaf; a leaf of n entries has n + 1 gaps.
    """
    a = pages.agg(F.sum("entries").alias("keys"), F.count("*").alias("leaves"), F.count_if(F.col("entries") == least).alias("n_least"), F.count_if(F.col("entries") == capacity).alias("n_full"))
    return a.select("keys", "leaves", F.round(least * F.col("n_least") / F.col("keys"), 9).alias("underflow"), F.round((capacity + 1) * F.col("n_full") / (F.col("keys") + F.col("leaves")), 9).alias("split"))


def backoff(spark: SparkSession, attempts: int = 10, base: int = 100, most: int = 5000, server_mins: tuple[int, ...] = (0, 700, 6000), cap: int = 20_000, remaining: int = 30_000) -> DataFrame:
    """Delays attempt by attempt: least(base * 2 ^ n, most), not under the server's minimum; a minimum beyond `most`, or a sum
    beyond `cap`, is Limit; a delay that doesn't fit into what remains is DeadlineExceeded; after either nothing is waited."""
    n = cases(spark, [(s, k) for s in server_mins for k in range(attempts)], "server_min long, n long")
    d = n.withColumn("delay_ms", F.greatest(F.least(base * F.pow(F.lit(2.0), F.col("n")), F.lit(most)).cast("long"), F.col("server_min")))
    w = Window.partitionBy("server_min").orderBy("n")
    upto = F.sum("delay_ms").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    d = d.withColumn("waited_ms", upto)
    bad = F.when(F.col("server_min") > most, "Limit").when(F.col("delay_ms") >= remaining - (F.col("waited_ms") - F.col("delay_ms")), "DeadlineExceeded").when(F.col("waited_ms") > cap, "Limit")
    d = d.withColumn("bad", bad).withColumn("first", F.min(F.when(F.col("bad").isNotNull(), F.col("n"))).over(Window.partitionBy("server_min")))
    outcome = F.when(F.col("n") < F.coalesce("first", F.lit(attempts)), "Wait").when(F.col("n") == F.col("first"), F.col("bad")).otherwise("AfterTerminal")
    return d.select("server_min", "n", "delay_ms", outcome.alias("outcome"))
