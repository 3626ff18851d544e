"""Commit logs: time travel, linked history, freshness, retention, snapshot selection and enumeration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions.session import removed, written
from keyloom.operators.tree import global_rank


def state_at(log: DataFrame, seq: int) -> DataFrame:
    """The live objects of a change log (seq, object_id, op, digest) as of a commit."""
    last = log.filter(F.col("seq") <= seq).groupBy("object_id").agg(F.max(F.struct("seq", "op", "digest")).alias("last"))
    return last.filter("last.op = 'put'").select("object_id", F.col("last.seq").alias("seq"), F.col("last.digest").alias("digest"))


def history_breaks(commits: DataFrame) -> DataFrame:
    """(seq, check) where a commit (seq, parent, id) doesn't follow the one before, by (seq, id). Commits meet by their ranks."""
    c = global_rank(commits, "seq", ties=("id",))
    last = c.select((F.col("rank") + 1).alias("rank"), F.col("seq").alias("before"), F.col("id").alias("before_id"))
    c = c.join(last, "rank", "left")
    checks = [
        ("sequence gap", F.col("before").isNotNull() & (F.col("seq") != F.col("before") + 1)),
        ("parent digest", F.col("before").isNotNull() & ~F.col("parent").eqNullSafe(F.col("before_id"))),
        ("genesis", F.col("before").isNull() & ((F.col("seq") != 0) | F.col("parent").isNotNull())),
    ]
    return c.select("seq", F.explode(F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in checks]), lambda x: x.isNotNull())).alias("check"))


def freshness(candidates: DataFrame, trusted: DataFrame) -> DataFrame:
    """Each candidate (sequence, digest) against the one trusted checkpoint (t_sequence, t_digest), if there is one."""
    both = candidates.join(F.broadcast(trusted), F.lit(True), "left")
    verdict = (
        F.when(F.col("t_sequence").isNull(), "Unpinned")
        .when(F.col("sequence") < F.col("t_sequence"), "Rollback")
        .when(F.col("sequence") > F.col("t_sequence"), "Advances")
        .when(F.col("digest") == F.col("t_digest"), "Current")
        .otherwise("ForkAtTrustedSequence")
    )
    return both.select("sequence", "digest", verdict.alias("freshness"))


# What a candidate's own state says about it.
OWN = {"integrity_failed": "IntegrityFailed", "unsupported": "UnsupportedRequiredCapability", "truncated": "Truncated", "invalid": "Invalid"}


def chains(candidates: DataFrame, max_depth: int | None = None) -> DataFrame:
    """candidates with `failure` (null: valid to its genesis) and `depth` of the chain (null where it fails).

    candidates: id, sequence, parent, footer_offset, exact_end, checkpoint ('complete', 'progress'), status ('verified', or a key
    of OWN). A candidate fails by its own state, else by the first edge that fails on the way up: a missing parent, one that
    isn't verified and complete, a sequence that doesn't increase, or that leaves a gap. Every candidate looks at its parent,
    then at what that one looks at: the distance doubles with each round, so a chain of n takes log2(n) of them. An id twice is
    an error. What neither ends nor fails after as many rounds as there are candidates goes round in a circle.
    """
    if not candidates.groupBy("id").count().filter("count > 1").isEmpty():
        raise ValueError("duplicate identity")
    p = candidates.select(F.col("id").alias("p"), F.col("sequence").alias("p_sequence"), ((F.col("status") == "verified") & (F.col("checkpoint") == "complete")).alias("p_good"))
    own = F.when(F.col("status") == "verified", F.when(F.col("checkpoint") != "complete", "ProgressCheckpoint"))
    for name, failure in OWN.items():
        own = F.when(F.col("status") == name, failure).otherwise(own)
    edge = (
        F.when(F.col("parent").isNull(), "root")
        .when(F.col("p").isNull(), "MissingParent")
        .when(~F.col("p_good"), "ParentNotVerified")
        .when(F.col("sequence") <= F.col("p_sequence"), "NonIncreasingSequence")
        .when(F.col("sequence") != F.col("p_sequence") + 1, "SequenceGap")
        .otherwise("open")
    )
    start = candidates.join(p, F.col("parent") == F.col("p"), "left").withColumn("own", own)
    now = written(start.select("id", F.col("parent").alias("to"), F.when(F.col("own").isNull(), edge).otherwise(F.col("own")).alias("state"), F.lit(0).cast("long").alias("steps")), "chains")
    rounds = max(1, now.count().bit_length()) + 1
    for _ in range(rounds):
        if now.filter("state = 'open'").isEmpty():
            break
        ahead = now.select(F.col("id").alias("at"), F.col("to").alias("next"), F.col("state").alias("then"), F.col("steps").alias("more"))
        both = now.join(ahead, (F.col("to") == F.col("at")) & (F.col("state") == "open"), "left")
        went = F.col("at").isNotNull()
        former, now = now, written(both.select("id", F.when(went, F.col("next")).otherwise(F.col("to")).alias("to"), F.when(went, F.col("then")).otherwise(F.col("state")).alias("state"), F.when(went, F.col("steps") + 1 + F.col("more")).otherwise(F.col("steps")).alias("steps")), "chains")
        removed(former)
    failure = F.when(F.col("state") == "open", "ParentCycle").when(F.col("state") != "root", F.col("state"))
    if max_depth is not None:
        failure = F.when(F.col("steps") + 1 > max_depth, "ParentDepthExceeded").otherwise(failure)
    found = now.select("id", failure.alias("failure"), F.when(failure.isNull(), F.col("steps") + 1).alias("depth"))
    return candidates.join(found, "id")


def enumerated(candidates: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Every candidate with one of fourteen statuses and, newest footer first, its rank: failures as `chains` has them, else
    VerifiedAncestor, VerifiedTerminal, or VerifiedForkTerminal where several terminals share the highest sequence."""
    c = written(chains(candidates, max_depth), "chains")
    good = c.filter("failure is null")
    parents = good.select(F.col("parent").alias("id"), F.lit(True).alias("has_child")).filter("id is not null").distinct()
    good = good.join(parents, "id", "left")
    best = good.filter("has_child is null").groupBy("sequence").agg(F.count("*").alias("ties")).agg(F.max(F.struct("sequence", "ties")).alias("best"))
    good = good.crossJoin(F.broadcast(best)).select("id", F.when(F.col("has_child"), "VerifiedAncestor").when((F.col("sequence") == F.col("best.sequence")) & (F.col("best.ties") > 1), "VerifiedForkTerminal").otherwise("VerifiedTerminal").alias("good"))
    c = c.join(good, "id", "left").withColumn("newest", -F.col("footer_offset")).withColumn("highest", -F.col("sequence"))
    ranked = global_rank(c, "newest", ties=("highest", "id"))
    return ranked.select("id", "sequence", "exact_end", F.coalesce("failure", "good").alias("status"), F.col("depth").alias("chain_depth"), F.col("rank").cast("long").alias("rank"))


def selected(candidates: DataFrame, mode: str = "recovery", max_depth: int | None = None) -> DataFrame:
    """One row: outcome, id and sequence (null unless Selected), and how many candidates it was between.

    recovery: the terminal of highest sequence among the chains that are valid to their genesis; AmbiguousFork on a tie,
    NoValidRoot if there is none. strict_exact_end: the one valid candidate whose footer ends its file; NoExactEndRoot or
    MultipleExactEndRoots otherwise.
    """
    good = written(chains(candidates, max_depth).filter("failure is null"), "valid")
    if mode == "strict_exact_end":
        asked, none, many = good.filter("exact_end"), "NoExactEndRoot", "MultipleExactEndRoots"
    elif mode == "recovery":
        terminals = good.join(good.select(F.col("parent").alias("id")).filter("id is not null").distinct(), "id", "left_anti")
        best = terminals.agg(F.max("sequence").alias("best"))
        asked, none, many = terminals.crossJoin(F.broadcast(best)).filter("sequence = best"), "NoValidRoot", "AmbiguousFork"
    else:
        raise ValueError(mode)
    one = asked.agg(F.count("*").alias("candidates"), F.min("id").alias("id"), F.min("sequence").alias("sequence"))
    only = F.col("candidates") == 1
    return one.select(F.when(F.col("candidates") == 0, none).when(only, "Selected").otherwise(many).alias("outcome"), F.when(only, F.col("id")).alias("id"), F.when(only, F.col("sequence")).alias("sequence"), "candidates")


def retained(commits: DataFrame, last: int, pinned: list[int]) -> DataFrame:
    """The newest `last` sequences and the pinned ones; a pin that doesn't exist is an error."""
    unknown = set(pinned) - {r.seq for r in commits.filter(F.col("seq").isin(pinned)).select("seq").distinct().collect()}
    if unknown:
        raise ValueError(f"unknown pinned sequences: {sorted(unknown)}")
    kept = commits.select("seq").distinct().orderBy(F.col("seq").desc()).limit(last).select(F.col("seq").alias("new"))
    both = commits.select("seq").distinct().join(kept, F.col("seq") == F.col("new"), "left")
    return both.select("seq", F.col("new").isNotNull().alias("newest"), F.col("seq").isin(pinned).alias("pinned")).filter("newest or pinned")


def reissued(log: DataFrame, sequences: list[int]) -> DataFrame:
    """The batches that lead through the chosen states, numbered 0, 1, ...: reissue, object_id, op, digest.

    The first batch puts a whole state, each other is the difference to the one before; where two states are equal the least
    object is put again, so that the commit isn't empty. An empty first state, or a sequence twice or out of order, is an error.
    """
    if sorted(set(sequences)) != list(sequences) or not sequences:
        raise ValueError("sequences have to be there and to increase")
    out, last = None, None
    for k, seq in enumerate(sequences):
        now = written(state_at(log, seq).select("object_id", "digest"), "state")
        if last is None:
            batch = now.select("object_id", F.lit("put").alias("op"), "digest")
            if batch.isEmpty():
                raise ValueError("the first state is empty")
        else:
            both = last.withColumnRenamed("digest", "old").join(now, "object_id", "full_outer").filter(~F.col("old").eqNullSafe(F.col("digest")))
            batch = written(both.select("object_id", F.when(F.col("digest").isNull(), "delete").otherwise("put").alias("op"), "digest"), "batch")
            if batch.isEmpty():
                batch = now.orderBy("object_id").limit(1).select("object_id", F.lit("put").alias("op"), "digest")
        rows = batch.select(F.lit(k).cast("long").alias("reissue"), "object_id", "op", "digest")
        out, last = rows if out is None else out.unionByName(rows), now
    return out


def reversions(log: DataFrame) -> DataFrame:
    """Objects whose content comes back: object_id, digest, first_seq, last_seq, times, of contents put at more than one commit
    with another content or a deletion in between."""
    w = Window.partitionBy("object_id").orderBy("seq")  # the changes of one object
    puts = log.withColumn("was", F.lag(F.struct("op", "digest")).over(w)).filter("op = 'put'")
    runs = puts.filter("was is null or was.op <> 'put' or was.digest <> digest")
    return runs.groupBy("object_id", "digest").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("times")).filter("times > 1")
