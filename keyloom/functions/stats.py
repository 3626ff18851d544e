"""Statistics over pages, transitions and states as DataFrame functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def occupancy(pages: DataFrame, entries: str, at_least: int) -> DataFrame:
    """One row over a column of entries a page: count, least, most, mean, median, the 95th percentile by nearest rank (floor),
    and the share of pages with `at_least` entries or more.

    The ranks are read off the histogram of entries, which has a row for each different number of entries.
    """
    h = pages.groupBy(F.col(entries).alias("x")).agg(F.count("*").alias("k"))
    upto = Window.orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    h = h.withColumn("upto", F.sum("k").over(upto)).withColumn("t", F.sum("k").over(Window.partitionBy()))
    rank = lambda r: F.min(F.when(F.col("upto") > r, F.col("x")))  # noqa: E731  the value at a rank from 0
    low, high = rank(F.floor((F.col("t") - 1) / 2)), rank(F.floor(F.col("t") / 2))
    out = h.agg(F.sum("k").alias("pages"), F.min("x").alias("least"), F.max("x").alias("most"), F.round(F.sum(F.col("x") * F.col("k")) / F.sum("k"), 9).alias("mean"), ((low + high) / 2).alias("median"), rank(F.floor(0.95 * (F.col("t") - 1))).alias("p95"), F.round(F.sum(F.when(F.col("x") >= at_least, F.col("k")).otherwise(0)) / F.sum("k"), 9).alias("share"))
    return out


def histogram(rows: DataFrame, *by: str, reward: str | None = None) -> DataFrame:
    """Transitions counted by their keys, with the sum of a reward."""
    sums = [F.round(F.sum(reward), 4).alias("reward")] if reward else []
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *sums)


def total_variation(counts: DataFrame, one: str, two: str) -> DataFrame:
    """Half the sum of |p - q| of two columns of counts over the same keys."""
    sums = counts.agg(F.sum(one).alias("sum_one"), F.sum(two).alias("sum_two"))
    return counts.crossJoin(F.broadcast(sums)).agg(F.round(0.5 * F.sum(F.abs(F.col(one) / F.col("sum_one") - F.col(two) / F.col("sum_two"))), 9).alias("total_variation"))


def mutual_information(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Bits that two columns share, and the total variation of their joint distribution from the product of the marginals.

    Pairs that never occur still count for the variation: it is (sum over pairs seen of |p - pq| + what pq has elsewhere) / 2.
    """
    joint = rows.groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("n"))
    left, right = (joint.groupBy(c).agg(F.sum("n").alias(f"n_{c}")) for c in ("x", "y"))
    total = joint.agg(F.sum("n").alias("t"))
    p, pq = F.col("n") / F.col("t"), F.col("n_x") / F.col("t") * F.col("n_y") / F.col("t")
    both = joint.join(left, "x").join(right, "y").crossJoin(F.broadcast(total)).select(p.alias("p"), pq.alias("pq"))
    return both.agg(F.round(F.sum(F.col("p") * F.log2(F.col("p") / F.col("pq"))), 9).alias("bits"), F.round(0.5 * (F.sum(F.abs(F.col("p") - F.col("pq"))) + 1 - F.sum("pq")), 9).alias("joint_variation"))


def bands(pages: DataFrame, entries: str, least: int, full: int) -> DataFrame:
    """Pages by band: under the minimum, at it, between, full."""
    x = F.col(entries)
    band = F.when(x < least, "under").when(x == least, "minimum").when(x < full, "middle").otherwise("full")
    return pages.groupBy(band.alias("band")).agg(F.count("*").alias("pages"))


def successors(rows: DataFrame, key: str, state: str, order: list[str]) -> DataFrame:
    """For each state: how often it occurs, and if the states that follow it (within a key) differ."""
    follows = F.lead(state).over(Window.partitionBy(key).orderBy(*order))
    s = rows.select(F.col(state).alias("state"), follows.alias("successor"))
    return s.groupBy("state").agg(F.count("*").alias("n"), F.count_distinct("successor").alias("successors")).withColumn("splits", F.col("successors") > 1)
