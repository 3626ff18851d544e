"""Dependency closures over an object graph: reachable, orphaned and missing objects; repair plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.functions.session import written
from keyloom.operators.tree import running


def closure(edges: DataFrame, roots: DataFrame, max_depth: int = 1024, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, id, depth) reachable from roots (by, id) along edges (by, src, dst): semi-naive rounds; cycles end, depth is the least.

    by: columns that keep several graphs apart, each with its own roots (a state's sequence). Each round joins only what the
    last one found; rounds are written, so lineage doesn't grow. More rounds than max_depth are an error.
    """
    keys = [*by, "id"]
    frontier = written(roots.select(*keys).distinct().withColumn("depth", F.lit(0)), "frontier")
    reached = frontier
    for depth in range(1, max_depth + 2):
        found = frontier.select(*by, F.col("id").alias("src")).join(edges, [*by, "src"]).select(*by, F.col("dst").alias("id")).distinct()
        frontier = written(found.join(reached.select(*keys), keys, "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        if frontier.isEmpty():
            return reached
        if depth > max_depth:
            raise ValueError("depth limit")
        reached = reached.unionByName(frontier)
    return reached


def totals(edges: DataFrame, reached: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Per graph: reachable objects, edges that lead on from them, and the greatest depth."""
    out = edges.withColumnRenamed("src", "id").join(reached.select(*by, "id"), [*by, "id"]).groupBy(*by).agg(F.count("*").alias("edges_visited"))
    nodes = reached.groupBy(*by).agg(F.count("*").alias("reachable"), F.max("depth").alias("max_depth"))
    both = nodes.join(out, list(by), "left") if by else nodes.crossJoin(out)
    return both.select(*by, "reachable", F.coalesce("edges_visited", F.lit(0)).cast("long").alias("edges_visited"), "max_depth")


def kept_objects(nodes: DataFrame, edges: DataFrame, roots: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """The nodes (id, ...) that a rewrite for these roots takes over: semantic compaction. A root or dependency that isn't a
    node is an error, and so are more bytes (column size) than max_bytes."""
    live = written(closure(edges, roots).select("id"), "live")
    missing = live.join(nodes.select("id"), "id", "left_anti").limit(5).collect()
    if missing:
        raise KeyError(f"missing dependencies: {sorted(r.id for r in missing)}")
    kept = nodes.join(live, "id", "left_semi")
    if max_bytes is not None and (kept.agg(F.sum("size")).first()[0] or 0) > max_bytes:
        raise ValueError("the copies would exceed the limit")
    return kept


def projected(objects: DataFrame, ids: DataFrame, key: str = "object_id") -> DataFrame:
    """Exactly the objects asked for by ids (column key): none asked for, one asked for twice or one that is missing is an error."""
    asked = written(ids.select(key), "asked")
    n = asked.count()
    if n == 0 or asked.distinct().count() < n:
        raise ValueError("ids have to be there, each once")
    if not asked.join(objects.select(key), key, "left_anti").isEmpty():
        raise KeyError("a selected object is missing")
    return objects.join(asked, key, "left_semi")


def retention(objects: DataFrame, edges: DataFrame, roots: DataFrame, unknown: str = "abort") -> DataFrame:
    """id, status (retained, discarded) for the roots of the retained snapshots. objects: id, known (whether their dependencies
    can be read). An object that is reached and not known: with 'abort' an error; with 'retain_all' all unknown objects stay."""
    live = written(closure(edges, roots).select("id"), "live")
    if not live.join(objects, "id", "left_anti").isEmpty():
        raise KeyError("a dependency is missing")
    if unknown == "abort" and not live.join(objects.filter("not known"), "id", "left_semi").isEmpty():
        raise ValueError("an object of unknown semantics is retained")
    both = objects.join(live.withColumn("live", F.lit(True)), "id", "left")
    stays = F.coalesce("live", F.lit(False)) | (~F.col("known") if unknown == "retain_all" else F.lit(False))
    return both.select("id", F.when(stays, "retained").otherwise("discarded").alias("status"))


def compaction(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """id, status: reachable, orphaned, or missing (asked for by an edge or root, but not a node), with depth."""
    live = closure(edges, roots)
    both = nodes.select("id", F.lit(True).alias("there")).join(live, "id", "full_outer")
    return both.select("id", F.when(F.col("there").isNull(), "missing").when(F.col("depth").isNull(), "orphaned").otherwise("reachable").alias("status"), "depth")


def repair_plan(locators: DataFrame, wanted: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Copy ranges of the wanted objects by offset, each with whether it overlaps an earlier one. A wanted object without a
    locator is an error, and so are more bytes than max_bytes. The ends so far run range by range, not in one task."""
    ids = written(wanted.select(F.col("id").alias("object_id")).distinct(), "wanted")
    if not ids.join(locators.select("object_id"), "object_id", "left_anti").isEmpty():
        raise KeyError("a wanted object has no locator")
    kept = written(locators.join(ids, "object_id", "left_semi"), "kept")
    if max_bytes is not None and (kept.agg(F.sum("record_len")).first()[0] or 0) > max_bytes:
        raise ValueError("the copies would exceed the limit")
    ends = running(kept, "record_offset", F.col("record_offset") + F.col("record_len"), "upto", "max", ("object_id",), before=True)
    return ends.select("object_id", "record_offset", "record_len", F.coalesce(F.col("upto") > F.col("record_offset"), F.lit(False)).alias("overlaps"))
