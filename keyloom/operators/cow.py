"""Copy-on-write updates of a paged index: only pages on the paths of what changes are written again.

A tree is two tables. entries: object_id, digest, leaf. pages: level, page, min_id, max_id, entry_count, parent (null: root).
Page numbers are names within a level, in the order of their ids; an update names new pages by fractions' successors: after each
update pages are numbered again by `renumbered`. Every update gives the new tree and a report of one row: mode, page counts,
pages_written, pages_reused (by the rule of its mode) and the root's level.

Puts and replacements of any number of objects are joins and aggregations level by level; a level is a handful of jobs, and
nothing is sorted globally but page maxima. A single deletion reads its path and the siblings along it (at most the fanout in
each level), decides on the driver about those few rows, and applies the decision as expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyloom.functions.codec import digest
from keyloom.functions.session import written
from keyloom.operators import tree as canonical


@dataclass(frozen=True)
class Geometry:
    """Most and least entries of a leaf and of an internal page."""

    leaf: int = canonical.LEAF
    leaf_least: int = canonical.LEAF_LEAST
    fanout: int = canonical.FANOUT
    fanout_least: int = canonical.FANOUT_LEAST

    def most(self, level: int) -> int:
        return self.fanout if level else self.leaf

    def least(self, level: int) -> int:
        return self.fanout_least if level else self.leaf_least


@dataclass
class Tree:
    entries: DataFrame
    pages: DataFrame

    def root_level(self) -> int:
        return self.pages.agg(F.max("level")).first()[0]


def groups(n: Column, capacity: int) -> Column:
    """How many canonical groups n entries make."""
    return F.greatest(F.ceil(n / capacity), F.lit(1)).cast("long")


def group_of(rank: Column, n: Column, capacity: int, least: int) -> Column:
    """The canonical group, from 0, of a rank from 1 among n."""
    return canonical.page_of(rank, n, capacity, least)


def summed(members: DataFrame, level: int) -> DataFrame:
    """(page, low, high) of the members of pages -> pages of this level, without parents."""
    return members.groupBy("page").agg(F.min("low").alias("min_id"), F.max("high").alias("max_id"), F.count("*").alias("entry_count")).withColumn("level", F.lit(level)).select("level", "page", "min_id", "max_id", "entry_count")


def built(objects: DataFrame, geometry: Geometry = Geometry()) -> Tree:
    """The canonical tree of (object_id, digest)."""
    ranked = canonical.global_rank(objects.select("object_id", "digest"), "object_id")
    entries = ranked.select("object_id", "digest", group_of(F.col("rank"), F.col("total"), geometry.leaf, geometry.leaf_least).alias("leaf"))
    return grown(written(entries, "entries"), geometry)


def of_sizes(spark: SparkSession, leaves: list[int], parents: list[list[int]]) -> Tree:
    """A tree of ids 1, 2, ... with leaves of these sizes and, level by level, internal pages of these numbers of children."""
    sizes = spark.createDataFrame(list(enumerate(leaves)), "leaf long, n long").coalesce(1)
    before = F.coalesce(F.sum("n").over(Window.orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ids = sizes.withColumn("before", before).select("leaf", F.explode(F.sequence(F.col("before") + 1, F.col("before") + F.col("n"))).alias("object_id"))
    entries = ids.select("object_id", digest("object", F.col("object_id")).alias("digest"), "leaf")
    level, out = summed(entries.select(F.col("leaf").alias("page"), F.col("object_id").alias("low"), F.col("object_id").alias("high")), 0), None
    for k, row in enumerate(parents, 1):
        up = [(child, parent) for parent, n in enumerate(row) for child in range(sum(row[:parent]), sum(row[:parent]) + n)]
        level = level.join(spark.createDataFrame(up, "page long, parent long"), "page")
        out = level if out is None else out.unionByName(level)
        level = summed(level.select(F.col("parent").alias("page"), F.col("min_id").alias("low"), F.col("max_id").alias("high")), k)
    level = level.withColumn("parent", F.lit(None).cast("long"))
    return Tree(entries, written(level if out is None else out.unionByName(level), "pages"))


def grown(entries: DataFrame, geometry: Geometry) -> Tree:
    """Canonical internal levels above leaves that are given."""
    level, k, out = summed(entries.select(F.col("leaf").alias("page"), F.col("object_id").alias("low"), F.col("object_id").alias("high")), 0), 0, None
    level = written(level, "level")
    n = level.count()
    while n > 1:
        up = level.withColumn("parent", group_of(F.col("page") + 1, F.lit(n), geometry.fanout, geometry.fanout_least))
        out = up if out is None else out.unionByName(up)
        k += 1
        level = written(summed(up.select(F.col("parent").alias("page"), F.col("min_id").alias("low"), F.col("max_id").alias("high")), k), "level")
        n = level.count()
    level = level.withColumn("parent", F.lit(None).cast("long"))
    return Tree(entries, level if out is None else out.unionByName(level))


def digests(tree: Tree) -> DataFrame:
    """level, page, parent and page_digest of every page: a leaf's over its entries, an internal page's over its children."""
    body = lambda: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("low", "digest"))), lambda e: F.concat_ws(":", e["low"], e["digest"])), ",")
    rows = tree.entries.select(F.col("leaf").alias("page"), F.col("object_id").alias("low"), "digest")
    out = None
    for level in range(tree.root_level() + 1):
        made = rows.groupBy("page").agg(digest("page", F.lit(level), body()).alias("page_digest"))
        made = written(tree.pages.filter(F.col("level") == level).join(made, "page").select("level", "page", "min_id", "parent", "page_digest"), "digests")
        out = made if out is None else out.unionByName(made)
        rows = made.select(F.col("parent").alias("page"), F.col("min_id").alias("low"), F.col("page_digest").alias("digest"))
    return out.select("level", "page", "parent", "page_digest")


def renumbered(pages: DataFrame) -> DataFrame:
    """level, min_id, max_id, entry_count and `page`, from 0 within each level, for reading a tree by hand. Pages are few beside
    the entries; still each level is ranked in ranges, not in one task."""
    out = None
    for level in range(pages.agg(F.max("level")).first()[0] + 1):
        ranked = canonical.global_rank(pages.filter(F.col("level") == level).select("level", "min_id", "max_id", "entry_count"), "min_id")
        made = ranked.withColumn("page", F.col("rank") - 1).drop("rank", "total")
        out = made if out is None else out.unionByName(made)
    return out.select("level", "page", "min_id", "max_id", "entry_count")


def routed(ids: DataFrame, leaves: DataFrame) -> DataFrame:
    """(object_id, ...) with the leaf of the first maximum that isn't less, or the last leaf.

    Ids and maxima are cut into the same ranges of ids and sorted there together, from the top: a maximum is carried on to the ids
    after it, in one pass (a frame that ends at a range's end would be gone through again for each row). What lies beyond the last
    maximum of a range takes the first of the next range that has one; ids beyond all of them, however many, are spread by hash.
    """
    columns = ids.columns
    cuts = sorted(set(leaves.agg(F.percentile_approx("max_id", [k / 64 for k in range(1, 64)], 10_000)).first()[0] or []))
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("at"))) if cuts else F.lit(0)
    marks = leaves.select(F.col("max_id").alias("at"), F.lit(0).alias("is_max"), F.col("page").cast("long").alias("leaf")).withColumn("part", part)
    ends = marks.groupBy("part").agg(F.min_by("leaf", "at").alias("first"), F.max_by("leaf", "at").alias("last"), F.max("at").alias("top")).collect()  # at most a row for each range
    if not ends:
        return ids.withColumn("leaf", F.lit(None).cast("long"))
    firsts, end = {r.part: r.first for r in ends}, max(ends, key=lambda r: r.part)
    overs = [next((firsts[q] for q in sorted(firsts) if q > p), end.last) for p in range(len(cuts) + 1)]
    spread = F.when(F.col("at") > end.top, len(overs) + F.pmod(F.xxhash64("at"), F.lit(64)).cast("int")).otherwise(part)
    both = ids.withColumn("at", F.col("object_id")).withColumn("is_max", F.lit(1)).withColumn("leaf", F.lit(None).cast("long")).withColumn("part", spread)
    rows = both.unionByName(marks, allowMissingColumns=True)
    # A mark comes before the ids that are equal to it, so the mark that was last seen at an id is what it looks for.
    seen = Window.partitionBy("part").orderBy(F.col("at").desc(), "is_max").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.withColumn("next", F.last("leaf", ignorenulls=True).over(seen)).filter("is_max = 1")
    over = F.get(F.array(*[F.lit(x).cast("long") for x in overs]), F.col("part"))
    return found.withColumn("leaf", F.coalesce("next", over, F.lit(end.last).cast("long"))).select(*columns, "leaf")


def put(tree: Tree, puts: DataFrame, geometry: Geometry = Geometry()) -> tuple[Tree, DataFrame]:
    """Replacements and insertions (object_id, digest) together; a leaf or internal page that overflows is regrouped canonically,
    and roots are grown. An id twice is an error. One insertion splits at half of its page, rounded up: the same grouping."""
    if not puts.groupBy("object_id").count().filter("count > 1").isEmpty():
        raise ValueError("an object is put twice")
    pages, root = tree.pages, tree.root_level()
    leaves = pages.filter("level = 0")
    asked = written(routed(puts.select("object_id", "digest"), leaves), "routed")
    touched = asked.select(F.col("leaf").alias("page")).distinct()
    old = tree.entries.join(touched.withColumnRenamed("page", "leaf"), "leaf", "left_semi")
    merged = old.select("leaf", "object_id", F.col("digest").alias("old")).join(asked.withColumnRenamed("digest", "new"), ["leaf", "object_id"], "full_outer")
    by_page = Window.partitionBy("leaf")  # a leaf and what is put into it
    rank, n = F.row_number().over(by_page.orderBy("object_id")), F.count("*").over(by_page)
    merged = merged.withColumn("n", n).withColumn("rank", rank)
    merged = written(merged.select("object_id", F.coalesce("new", "old").alias("digest"), "leaf", group_of(F.col("rank"), F.col("n"), geometry.leaf, geometry.leaf_least).alias("group"), (F.col("old").isNull()).alias("inserted")), "merged")
    # New pages are named within their former one, then all of a level are named anew by the order of their least ids.
    new_level = merged.groupBy("leaf", "group").agg(F.min("object_id").alias("min_id"), F.max("object_id").alias("max_id"), F.count("*").alias("entry_count")).withColumnRenamed("leaf", "from")
    report = {"touched": 0, "written": 0}
    levels, names = [], None
    for level in range(root + 1):
        before = pages.filter(F.col("level") == level)
        hit = new_level.select(F.col("from").alias("page")).distinct()
        kept = before.join(hit, "page", "left_anti").select(F.col("page").alias("from"), F.lit(0).cast("long").alias("group"), "min_id", "max_id", "entry_count", F.lit(False).alias("new"))
        both = kept.unionByName(new_level.select("from", F.col("group").cast("long").alias("group"), "min_id", "max_id", "entry_count", F.lit(True).alias("new")))
        both = both.join(before.select(F.col("page").alias("from"), "parent"), "from")
        ranked = canonical.global_rank(both, "min_id")
        named = written(ranked.withColumn("page", F.col("rank") - 1).drop("rank", "total"), "named")
        counts = named.agg(F.count_if("new"), F.count_distinct(F.when(F.col("new"), F.col("from")))).first()
        report["written"] += counts[0]
        report["touched"] += counts[1]
        levels.append(named)
        # The children of the pages above that hold a new page, regrouped.
        up = named.filter("new").select("parent").distinct()
        members = named.filter("parent is not null").join(up, "parent", "left_semi")
        w = Window.partitionBy("parent")
        members = members.withColumn("n", F.count("*").over(w)).withColumn("rank", F.row_number().over(w.orderBy("min_id")))
        members = written(members.withColumn("group", group_of(F.col("rank"), F.col("n"), geometry.fanout, geometry.fanout_least)).select("page", "parent", "group", "min_id", "max_id"), "members")
        new_level = members.groupBy("parent", "group").agg(F.min("min_id").alias("min_id"), F.max("max_id").alias("max_id"), F.count("*").alias("entry_count")).withColumnRenamed("parent", "from")
        names = members
        levels[-1] = (named, names)
    # Roots above the former one, until one page is left.
    top, out, level = levels[-1][0], [], root
    for k, (named, members) in enumerate(levels[:-1]):
        above = levels[k + 1][0]
        child = named.join(members.select("page", F.col("group").alias("to")), "page", "left").withColumn("to", F.coalesce("to", F.lit(0).cast("long")))
        parent = above.select(F.col("from").alias("parent"), F.col("group").alias("to"), F.col("page").alias("up"))
        out.append(child.join(parent, ["parent", "to"]).select(F.lit(k).alias("level"), "page", "min_id", "max_id", "entry_count", F.col("up").alias("parent")))
    width = top.count()
    while width > 1:
        up = top.withColumn("up", group_of(F.col("page") + 1, F.lit(width), geometry.fanout, geometry.fanout_least))
        out.append(up.select(F.lit(level).alias("level"), "page", "min_id", "max_id", "entry_count", F.col("up").alias("parent")))
        level += 1
        top = written(up.groupBy("up").agg(F.min("min_id").alias("min_id"), F.max("max_id").alias("max_id"), F.count("*").alias("entry_count")).withColumnRenamed("up", "page"), "level")
        width = top.count()
        report["written"] += width
    out.append(top.select(F.lit(level).alias("level"), "page", "min_id", "max_id", "entry_count", F.lit(None).cast("long").alias("parent")))
    new_pages = out[0]
    for x in out[1:]:
        new_pages = new_pages.unionByName(x)
    new_pages = written(new_pages, "pages")
    renamed = levels[0][0].select(F.col("from").alias("leaf"), "group", F.col("page").alias("now"))
    rest = tree.entries.join(touched.withColumnRenamed("page", "leaf"), "leaf", "left_anti").withColumn("group", F.lit(0).cast("long"))
    entries = merged.select("object_id", "digest", "leaf", F.col("group").cast("long").alias("group")).unionByName(rest.select("object_id", "digest", "leaf", "group")).join(renamed, ["leaf", "group"])
    new = Tree(written(entries.select("object_id", "digest", F.col("now").alias("leaf")), "entries"), new_pages)
    shape = merged.agg(F.count_if("inserted"), F.count("*")).first()
    total = asked.count()
    mode = "replacements" if not shape[0] else "single_insert" if total == 1 else "put_batch"
    return new, _report(tree, new, mode, report["touched"], report["written"])


def _report(old: Tree, new: Tree, mode: str, touched: int, written_: int) -> DataFrame:
    a, b = old.pages.agg(F.count("*").alias("source_pages"), F.max("level").alias("source_root_level")), new.pages.agg(F.count("*").alias("result_pages"), F.max("level").alias("result_root_level"))
    return a.crossJoin(b).select(F.lit(mode).alias("mode"), "source_root_level", "result_root_level", "source_pages", "result_pages", F.lit(touched).cast("long").alias("touched_original"), F.lit(written_).cast("long").alias("pages_written"), (F.col("source_pages") - touched).alias("pages_reused"))


def delete(tree: Tree, object_id: int, geometry: Geometry = Geometry(), fuller: bool = False) -> tuple[Tree, DataFrame, list[dict]]:
    """One deletion -> the new tree, its report, and the repair path, a row for each level from the leaf up.

    A page that falls short borrows one entry from the left sibling, else from the right (fuller: from the fuller one, left on
    ties), else merges to the left, else to the right; a root with one child goes. A missing object, or the last one, is an error.
    """
    held = tree.entries.filter(F.col("object_id") == object_id).select("leaf").collect()
    if not held:
        raise KeyError(object_id)
    if tree.entries.limit(2).count() == 1:
        raise ValueError("the result would be empty")
    root = tree.root_level()
    path, page = [], held[0].leaf
    for level in range(root + 1):  # the page of each level, and its siblings: at most a fanout of rows
        row = tree.pages.filter((F.col("level") == level) & (F.col("page") == page)).first()
        near = [] if row.parent is None else tree.pages.filter((F.col("level") == level) & (F.col("parent") == row.parent)).orderBy("min_id").collect()
        path.append((row, near))
        page = row.parent
    rows, touched, written_, removed, moves = [], 1, 0, [], []
    count = path[0][0].entry_count - 1
    for level, (row, near) in enumerate(path):
        least = geometry.least(level)
        at = next((k for k, x in enumerate(near) if x.page == row.page), 0)
        left, right = (near[at - 1] if at else None), (near[at + 1] if at + 1 < len(near) else None)
        lends = [x for x in (left, right) if x and x.entry_count > least]
        action, donor = "none", None
        if near and count < least:
            if lends:
                donor = max(lends, key=lambda x: x.entry_count) if fuller else lends[0]
                action = "borrow_left" if donor is left else "borrow_right"
                moves.append((level, "borrow", row.page, donor.page))
                written_ += 2
            else:
                donor, action = (left, "merge_left") if left else (right, "merge_right")
                moves.append((level, "merge", row.page, donor.page))
                written_ += 1
            touched += 1
        elif near:
            written_ += 1
        rows.append({"level": level, "before": row.entry_count, "after": count, "left": left and left.entry_count, "right": right and right.entry_count, "would_underflow": bool(near) and count < least, "action": action, "donor_cliff": action.startswith("borrow") and donor.entry_count == least + 1, "fuller_alternative": action == "borrow_left" and bool(right) and right.entry_count > left.entry_count and right.entry_count > least})
        if not near:
            break
        touched += 1
        above = path[level + 1][0].entry_count
        count = above - 1 if action.startswith("merge") else above
    collapsed = bool(root) and count == 1
    if not collapsed:
        written_ += 1
    new = _deleted(tree, object_id, moves, path, root - 1 if collapsed else root)
    return new, _report(tree, new, "delete", touched, written_), rows


def _deleted(tree: Tree, object_id: int, moves: list[tuple], path: list[tuple], root: int) -> Tree:
    """Entries change their leaf and pages their parent as the moves say; the counts and bounds of those pages are taken again."""
    entries = tree.entries.filter(F.col("object_id") != object_id)
    pages = tree.pages
    for level, what, target, donor in moves:
        if what == "merge":  # the left one of the two keeps its name
            bounds = {x.page: x.min_id for x in path[level][1]}
            keep, goes = sorted((target, donor), key=bounds.get)
            change = lambda c, keep=keep, goes=goes: F.when(F.col(c) == goes, F.lit(keep)).otherwise(F.col(c))
            if level == 0:
                entries = entries.withColumn("leaf", change("leaf"))
            else:
                pages = pages.withColumn("parent", F.when(F.col("level") == level - 1, change("parent")).otherwise(F.col("parent")))
            pages = pages.filter(~((F.col("level") == level) & (F.col("page") == goes)))
        else:
            bounds = {x.page: (x.min_id, x.max_id) for x in path[level][1]}
            from_left = bounds[donor][0] < bounds[target][0]
            if level == 0:
                edge = entries.filter(F.col("leaf") == donor).agg((F.max if from_left else F.min)("object_id")).first()[0]
                entries = entries.withColumn("leaf", F.when(F.col("object_id") == edge, F.lit(target)).otherwise(F.col("leaf")))
            else:
                children = pages.filter((F.col("level") == level - 1) & (F.col("parent") == donor))
                edge = children.agg((F.max_by if from_left else F.min_by)("page", "min_id")).first()[0]
                pages = pages.withColumn("parent", F.when((F.col("level") == level - 1) & (F.col("page") == edge), F.lit(target)).otherwise(F.col("parent")))
    entries = written(entries, "entries")
    out, members = None, entries.select(F.col("leaf").alias("page"), F.col("object_id").alias("low"), F.col("object_id").alias("high"))
    for level in range(root + 1):
        up = pages.filter(F.col("level") == level).select("page", "parent" if level < root else F.lit(None).cast("long").alias("parent"))
        changed = {path[level][0].page, *(x for lv, _, t, d in moves if lv == level for x in (t, d))}
        changed |= {path[level][0].page} if level else set()
        again = summed(members.filter(F.col("page").isin(*changed)), level)
        same = pages.filter((F.col("level") == level) & ~F.col("page").isin(*changed)).select("level", "page", "min_id", "max_id", "entry_count")
        made = written(same.unionByName(again).join(up, "page").select("level", "page", "min_id", "max_id", "entry_count", "parent"), "level")
        out = made if out is None else out.unionByName(made)
        members = made.select(F.col("parent").alias("page"), F.col("min_id").alias("low"), F.col("max_id").alias("high"))
    return Tree(entries, out)


def mixed(tree: Tree, ops: DataFrame, geometry: Geometry = Geometry()) -> tuple[Tree, DataFrame]:
    """Puts and deletes (object_id, op, digest) together, regrouped canonically; a page is reused only if its whole body is
    equal. A put of equal content has a record of its own, so its digest has to tell (and then its leaf is written again)."""
    o = ops.select("object_id", "op", F.col("digest").alias("new"))
    state = tree.entries.select("object_id", "digest").join(o, "object_id", "full_outer")
    if not state.filter("op = 'delete' and digest is null").isEmpty():
        raise KeyError("delete of a missing object")
    new = built(state.filter("op is null or op <> 'delete'").select("object_id", F.coalesce("new", "digest").alias("digest")), geometry)
    was = digests(tree).select("level", "page_digest").distinct().withColumn("known", F.lit(True))
    now = digests(new).join(was, ["level", "page_digest"], "left")
    found = now.agg(F.count_if(F.col("known")).alias("pages_reused"), F.count_if(F.col("known").isNull()).alias("pages_written"), F.count("*").alias("result_pages"))
    return new, found.select(F.lit("canonical_mixed").alias("mode"), "result_pages", "pages_written", "pages_reused")


def update(tree: Tree, ops: DataFrame, geometry: Geometry = Geometry()) -> tuple[Tree, DataFrame]:
    """A batch (object_id, op, digest) by the way its shape asks for: one deletion, puts alone, or both together."""
    shape = ops.agg(F.count("*"), F.count_if(F.col("op") == "delete")).first()
    if not shape[0]:
        raise ValueError("an empty batch")
    if not shape[1]:
        return put(tree, ops, geometry)
    if shape[0] == 1:
        return delete(tree, ops.first().object_id, geometry)[:2]
    return mixed(tree, ops, geometry)


def occupancy_violations(tree: Tree, geometry: Geometry = Geometry()) -> DataFrame:
    """Pages that break the half-full rule: (level, page, check)."""
    root = tree.root_level()
    n, level = F.col("entry_count"), F.col("level")
    most, least = F.when(level == 0, geometry.leaf).otherwise(geometry.fanout), F.when(level == 0, geometry.leaf_least).otherwise(geometry.fanout_least)
    check = F.when(n > most, "overfull").when((level < root) & (n < least), "underfull").when((level == root) & (level > 0) & (n < 2), "root with one child")
    return tree.pages.select("level", "page", check.alias("check")).filter("check is not null")


def structure_violations(tree: Tree) -> DataFrame:
    """(level, page, check): counts and bounds that don't follow from the members, children without a parent, and pages of one
    parent whose ranges overlap. Overlaps across parents show as overlaps of the parents."""
    root, out = tree.root_level(), None
    members = tree.entries.select(F.col("leaf").alias("page"), F.col("object_id").alias("low"), F.col("object_id").alias("high"))
    w = Window.partitionBy("parent").orderBy("min_id")  # the children of one page
    for level in range(root + 1):
        own = tree.pages.filter(F.col("level") == level)
        real = summed(members, level).select("page", F.col("min_id").alias("low"), F.col("max_id").alias("high"), F.col("entry_count").alias("n"))
        both = own.join(real, "page", "full_outer")
        check = F.when(F.col("level").isNull(), "missing page").when(F.col("n").isNull(), "empty page").when((F.col("n") != F.col("entry_count")) | (F.col("low") != F.col("min_id")) | (F.col("high") != F.col("max_id")), "bounds or count")
        bad = both.select(F.lit(level).alias("level"), "page", check.alias("check")).unionByName(own.withColumn("next", F.lead("min_id").over(w)).filter("next <= max_id").select("level", "page", F.lit("overlapping children").alias("check")))
        out = bad if out is None else out.unionByName(bad)
        members = own.select(F.col("parent").alias("page"), F.col("min_id").alias("low"), F.col("max_id").alias("high"))
    return out.filter("check is not null")


def tail(old: Tree, new: Tree) -> DataFrame:
    """What an update writes behind the former file: the pages (level, page, page_digest) whose bodies the old tree doesn't have."""
    return digests(new).select("level", "page", "page_digest").join(digests(old).select("level", "page_digest").distinct(), ["level", "page_digest"], "left_anti").select("level", "page", "page_digest")


def digest_violations(tree: Tree, stored: DataFrame) -> DataFrame:
    """(level, page, check) where a stored digest (level, page, page_digest) isn't that of the page, or one of the two is missing."""
    real = digests(tree).select("level", "page", F.col("page_digest").alias("real"))
    both = real.join(stored, ["level", "page"], "full_outer").filter(~F.col("real").eqNullSafe(F.col("page_digest")))
    return both.select("level", "page", F.when(F.col("real").isNull(), "unknown page").when(F.col("page_digest").isNull(), "page not stored").otherwise("page digest").alias("check"))


def lookup(tree: Tree, ids: DataFrame) -> DataFrame:
    """(object_id) -> found, digest, pages_read, whether a leaf's range holds the id (in_leaf), and the path of page digests from
    the root: what a reader has to check. A lookup ends at the first page whose children leave a gap around the id, so an
    absent object may read few pages. Ids meet each level's ranges as in `routed`."""
    root = tree.root_level()
    known = digests(tree).select("level", "page", "page_digest")
    out = written(ids.select("object_id").distinct(), "asked")
    asked, steps = out, []
    for level in range(root, -1, -1):
        own = tree.pages.filter(F.col("level") == level)
        at = routed(asked, own).join(own.select(F.col("page").alias("leaf"), "min_id", "max_id"), "leaf")
        inside = at.filter("object_id between min_id and max_id") if level < root else at
        named = inside.join(known.filter(F.col("level") == level).select(F.col("page").alias("leaf"), "page_digest"), "leaf")
        step = written(named.select("object_id", F.lit(root - level).alias("k"), "page_digest", F.expr("object_id between min_id and max_id").alias("within")), "step")
        steps.append(step)
        asked = step.filter("within").select("object_id")
    path = steps[0]
    for x in steps[1:]:
        path = path.unionByName(x)
    path = path.groupBy("object_id").agg(F.count("*").alias("pages_read"), F.max((F.col("k") == root) & F.col("within")).alias("in_leaf"), F.transform(F.array_sort(F.collect_list(F.struct("k", "page_digest"))), lambda x: x["page_digest"]).alias("path"))
    there = tree.entries.select("object_id", "digest")
    return out.join(path, "object_id").join(there, "object_id", "left").select("object_id", F.col("digest").isNotNull().alias("found"), "digest", "pages_read", "in_leaf", "path")
