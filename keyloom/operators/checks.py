"""Integrity as queries: violations of a framed record file, diagnosis, salvage of the valid prefix."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Check -> category.
CATEGORIES = [("length", "InvalidLength"), ("identifier", "InvalidIdentifier"), ("kind", "InvalidKind"), ("digest", "DigestMismatch"), ("overlap", "OverlappingRange"), ("order", "NotCanonical")]


def violations(records: DataFrame) -> DataFrame:
    """(file, offset, check, category) of every failed check.

    records: file, offset, object_id, kind, stored_len, logical_len, digest, expected. A file's rows are one window.
    """
    w = Window.partitionBy("file").orderBy("offset")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    r = records.withColumn("last_id", F.lag("object_id").over(w)).withColumn("upto", F.max(F.col("offset") + F.col("stored_len")).over(before))
    tests = {
        "length": F.col("stored_len") != F.col("logical_len"),
        "identifier": F.col("object_id") == 0,
        "kind": F.col("kind") == 0,
        "digest": F.col("digest") != F.col("expected"),
        "overlap": F.coalesce(F.col("upto") > F.col("offset"), F.lit(False)),
        "order": F.coalesce(F.col("last_id") >= F.col("object_id"), F.lit(False)),
    }
    rows = [F.when(tests[name], F.struct(F.lit(name).alias("check"), F.lit(category).alias("category"))) for name, category in CATEGORIES]
    return r.select("file", "offset", F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("v")).select("file", "offset", "v.check", "v.category")


def diagnosis(records: DataFrame) -> DataFrame:
    """Per file: Verified or Invalid, with the first failed check's category."""
    first = violations(records).groupBy("file").agg(F.min(F.struct("offset", "check", "category")).alias("first"), F.count("*").alias("failed"))
    files = records.select("file").distinct()
    return files.join(first, "file", "left").select("file", F.when(F.col("first").isNull(), "Verified").otherwise("Invalid").alias("status"), F.col("first.category").alias("category"), F.coalesce("failed", F.lit(0)).cast("long").alias("failed"))


def salvaged(records: DataFrame) -> DataFrame:
    """The records before each file's first failed check; a salvage, never a verdict."""
    first = violations(records).groupBy("file").agg(F.min("offset").alias("end"))
    return records.join(first, "file", "left").filter("end is null or offset < end").select("file", "offset", "object_id")


def interpreted(objects: DataFrame, supported: list[int]) -> DataFrame:
    """(object_id, required, optional: arrays of capabilities) -> NotInterpretable where one that is required isn't supported; how
    many optional ones are unknown, and kept."""
    known = F.array(*map(F.lit, supported))
    missing, unknown = F.array_except("required", known), F.array_except("optional", known)
    return objects.select("object_id", F.when(F.size(missing) == 0, "Supported").otherwise("NotInterpretable").alias("verdict"), F.size(unknown).cast("long").alias("kept_unknown"))


def rewritten(extensions: DataFrame, updates: DataFrame) -> DataFrame:
    """(tag, known, payload) after updates (tag, payload). Unknown tags keep their bytes; an update of one, or of a tag that
    isn't there, is an error."""
    wrong = updates.join(extensions.filter("known"), "tag", "left_anti").limit(1).collect()
    if wrong:
        raise ValueError(f"tag {wrong[0].tag} can't be rewritten")
    u = updates.select("tag", F.col("payload").alias("new"), F.lit(True).alias("rewritten"))
    return extensions.join(u, "tag", "left").select("tag", "known", F.coalesce("new", "payload").alias("payload"), F.coalesce("rewritten", F.lit(False)).alias("rewritten"))


def stage_order(steps: DataFrame) -> DataFrame:
    """(file, position, stage) -> per file: steps, those whose stage doesn't come after the one before, and the first of them."""
    w = Window.partitionBy("file").orderBy("position")
    bad = F.coalesce(F.lag("stage").over(w) >= F.col("stage"), F.lit(False))
    s = steps.withColumn("bad", bad)
    return s.groupBy("file").agg(F.count("*").alias("steps"), F.count_if("bad").alias("violations"), F.min(F.when(F.col("bad"), F.col("position"))).alias("first_violation"))


def range_conflicts(ranges: DataFrame, structural: DataFrame) -> DataFrame:
    """(id, start, stop) of ranges that overlap one of the structural ranges (name, from_, upto). These are the frames of a file, a
    handful, and are broadcast; beyond a thousand is an error."""
    if structural.limit(1001).count() > 1000:
        raise ValueError("structural ranges are few")
    return ranges.join(F.broadcast(structural), (F.col("start") < F.col("upto")) & (F.col("from_") < F.col("stop"))).select("id", "start", "stop", "name")
