"""Put/delete batches over a keyed state: classification, violations, the next state, diffs, page accounting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def violations(state: DataFrame, ops: DataFrame) -> DataFrame:
    """(check, category, object_id) of everything that forbids the batch; empty if it may be applied.

    ops: object_id, op ('put' or 'delete'), kind, digest.
    """
    row = lambda df, check, category: df.select(F.lit(check).alias("check"), F.lit(category).alias("category"), F.col("object_id").cast("long").alias("object_id"))
    repeated = ops.groupBy("object_id").agg(F.count("*").alias("n")).filter("n > 1")
    missing = ops.filter("op = 'delete'").select("object_id").distinct().join(state.select("object_id"), "object_id", "left_anti")
    zero = ops.filter("object_id = 0 or (op = 'put' and coalesce(kind, 0) = 0)")
    sizes = state.agg(F.count("*").alias("n")).crossJoin(ops.agg(F.count_if(F.col("op") == "delete").alias("gone"), F.count_if(F.col("op") == "put").alias("put")))
    empty = sizes.filter("n = gone and put = 0").select(F.lit(None).cast("long").alias("object_id"))
    return row(repeated, "one operation per object", "DuplicateObject").unionByName(row(missing, "delete of a missing object", "MissingObject")).unionByName(row(zero, "zero id or kind", "Invalid")).unionByName(row(empty, "empty result", "Invalid"))


def classified(state: DataFrame, ops: DataFrame) -> DataFrame:
    """object_id, action: insert, replace, delete or missing."""
    was = state.select("object_id", F.lit(True).alias("was"))
    action = F.when(F.col("op") == "put", F.when(F.col("was"), "replace").otherwise("insert")).otherwise(F.when(F.col("was"), "delete").otherwise("missing"))
    return ops.join(was, "object_id", "left").select("object_id", action.alias("action"))


def applied(state: DataFrame, ops: DataFrame) -> DataFrame:
    """The next state (object_id, kind, digest); the order of operations doesn't matter."""
    o = ops.select("object_id", "op", F.col("kind").alias("new_kind"), F.col("digest").alias("new_digest"))
    both = state.join(o, "object_id", "full_outer").filter("op is null or op <> 'delete'")
    return both.select("object_id", F.when(F.col("op") == "put", F.col("new_kind")).otherwise(F.col("kind")).alias("kind"), F.when(F.col("op") == "put", F.col("new_digest")).otherwise(F.col("digest")).alias("digest"))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """object_id, change (added, removed, changed) between two states."""
    a = old.select("object_id", F.struct("kind", "digest").alias("a"))
    b = new.select("object_id", F.struct("kind", "digest").alias("b"))
    both = a.join(b, "object_id", "full_outer").filter(~F.col("a").eqNullSafe(F.col("b")))
    return both.select("object_id", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed").alias("change"))


def mode(state: DataFrame, ops: DataFrame) -> DataFrame:
    """One row: how a copy-on-write writer would apply the batch, by its shape."""
    c = classified(state, ops)
    n = c.agg(*[F.count_if(F.col("action") == x).alias(x) for x in ("insert", "replace", "delete", "missing")], F.count("*").alias("n"))
    chosen = (
        F.when((F.col("n") > 1) & (F.col("delete") + F.col("missing") > 0), "canonical_mixed")
        .when((F.col("n") == 1) & (F.col("insert") == 1), "single_insert")
        .when((F.col("n") == 1) & (F.col("delete") == 1), "delete")
        .when((F.col("insert") > 0) & (F.col("delete") == 0), "put_batch")
        .when((F.col("replace") > 0) & (F.col("insert") == 0), "replacements")
        .otherwise("full_rebuild")
    )
    return n.select("insert", "replace", "delete", chosen.alias("mode"))


def page_reuse(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per level: pages of the new tree, those found equal in the old one, those to write."""
    known = old.select("level", "page_digest").distinct().withColumn("known", F.lit(True))
    return new.join(known, ["level", "page_digest"], "left").groupBy("level").agg(F.count("*").alias("pages"), F.count_if(F.col("known")).alias("reused"), F.count_if(F.col("known").isNull()).alias("written"))
