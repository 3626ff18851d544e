"""Conditional reads of a versioned source as queries: classification of responses, retry budgets, refresh, waits, coalescing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions.codec import is_strong_token

# Statuses that may be tried again, and redirects.
RETRYABLE, REDIRECTS = [408, 425, 429, 500, 502, 503, 504], [301, 302, 303, 307, 308]


def classified(exchanges: DataFrame) -> DataFrame:
    """exchanges with `decision` and `retry_after` (kept only where it is positive and the decision is Retry).

    exchanges: kind ('metadata' or 'range'), status, may_refresh, version (of the response), expected_version, offset, length,
    total_length (of the request; null for metadata), content_length, content_range, body_length, retry_after. The rules are
    asked in order: retryable statuses, 401, client errors, 412, redirects, then what a success has to hold.
    """
    c = F.col
    strong = is_strong_token(c("version"))
    metadata = (c("body_length") == 0) & c("content_range").isNull() & c("content_length").isNotNull() & strong
    within = (c("length") > 0) & (c("offset") >= 0) & (c("offset") + c("length") <= c("total_length"))
    exact = F.concat(F.lit("bytes "), c("offset").cast("string"), F.lit("-"), (c("offset") + c("length") - 1).cast("string"), F.lit("/"), c("total_length").cast("string"))
    ranged = within & (c("content_length") == c("length")) & (c("body_length") == c("length")) & (c("content_range") == exact) & strong & (c("version") == c("expected_version"))
    yes = lambda x: F.coalesce(x, F.lit(False))
    decision = (
        F.when(c("status").isin(RETRYABLE), "Retry")
        .when(c("status") == 401, F.when(yes(c("may_refresh")), "RefreshAuthentication").otherwise("Fail(client)"))
        .when(c("status").isin(403, 404, 416), "Fail(client)")
        .when(c("status") == 412, "Fail(version changed)")
        .when(c("status").isin(REDIRECTS), "Fail(redirect)")
        .when((c("kind") == "metadata") & (c("status") == 200), F.when(yes(metadata), "AcceptMetadata").otherwise("Fail(protocol)"))
        .when((c("kind") == "range") & (c("status") == 206), F.when(yes(ranged), "AcceptRange").otherwise("Fail(protocol)"))
        .when(c("status").between(200, 299), "Fail(protocol)")
        .when(c("status") >= 400, "Fail(client)")
        .otherwise("Fail(protocol)")
    )
    out = exchanges.withColumn("decision", decision)
    return out.withColumn("retry_after", F.when((F.col("decision") == "Retry") & (F.col("retry_after") > 0), F.col("retry_after")))


def _upto(key: str, order: str):
    return Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def budgeted(attempts: DataFrame, key: str, order: str, retryable: Column, budget: int) -> DataFrame:
    """attempts with `used` and `outcome`: one counter for all requests of a key; a retryable attempt beyond it is a Limit, and
    final; what comes after the end of a key is AfterTerminal.
    """
    used = F.sum(retryable.cast("long")).over(_upto(key, order))
    a = attempts.withColumn("used", used)
    over = retryable & (F.col("used") > budget)
    ended = F.max(over.cast("int")).over(_upto(key, order).rowsBetween(Window.unboundedPreceding, -1)) == 1
    return a.withColumn("outcome", F.when(F.coalesce(ended, F.lit(False)), "AfterTerminal").when(over, "Limit(transport attempts)").when(retryable, "Retry").otherwise("Done"))


def refreshed(challenges: DataFrame, key: str, order: str) -> DataFrame:
    """challenges with `outcome`: the first of a key refreshes, the second fails, all others come after the end."""
    k = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return challenges.withColumn("outcome", F.when(k == 1, "Refresh").when(k == 2, "Fail").otherwise("AfterTerminal"))


def waits(requests: DataFrame, poll_ms: int, most_jitter_ms: int) -> DataFrame:
    """requests (delay_ms, jitter_ms, remaining_ms) with the chunks of each wait, or why it doesn't take place.

    A jitter above its bound is refused, not clipped; a wait as long as what remains meets the deadline; the rest is waited in
    chunks of `poll_ms`, so that it can be cancelled between them.
    """
    wait = F.col("delay_ms") + F.col("jitter_ms")
    outcome = F.when((F.col("jitter_ms") < 0) | (F.col("jitter_ms") > most_jitter_ms), "Invalid").when(wait >= F.col("remaining_ms"), "DeadlineExceeded").otherwise("Waited")
    n = F.when(outcome == "Waited", F.ceil(wait / poll_ms)).otherwise(0)
    return requests.withColumn("outcome", outcome).withColumn("chunks", n.cast("long")).withColumn("last_chunk_ms", F.when(F.col("chunks") > 0, wait - (F.col("chunks") - 1) * poll_ms))


def coalesced(requests: DataFrame, keys: list[str], started: str, ended: str) -> DataFrame:
    """Requests of equal keys that are in flight at the same time share one: keys, asked, sent, and the most that shared one.

    A request is sent if none of its key is in flight when it starts; it joins the one in flight otherwise, and then ends with
    it. A key is a version and a range of bytes, so its requests are few.
    """

    def flight(state, x):
        fresh = state["until"].isNull() | (x["s"] >= state["until"])
        return F.struct(F.when(fresh, x["e"]).otherwise(state["until"]).alias("until"), (state["sent"] + fresh.cast("long")).alias("sent"), F.when(fresh, F.lit(1).cast("long")).otherwise(state["run"] + 1).alias("run"), F.greatest(state["most"], F.when(fresh, F.lit(1).cast("long")).otherwise(state["run"] + 1)).alias("most"))

    zero = F.lit(0).cast("long")
    kind = dict(requests.dtypes)[ended]
    begin = F.struct(F.lit(None).cast(kind).alias("until"), zero.alias("sent"), zero.alias("run"), zero.alias("most"))
    held = requests.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(started).alias("s"), F.col(ended).alias("e")))).alias("x"))
    return held.withColumn("f", F.aggregate("x", begin, flight)).select(*keys, F.size("x").cast("long").alias("asked"), F.col("f.sent").alias("sent"), F.col("f.most").alias("most_shared"))


def sessions(decided: DataFrame, key: str, order: str, budget: int) -> DataFrame:
    """Classified exchanges of each key in order -> its result, attempts, and bytes accepted.

    A range that is accepted adds its bytes and the key goes on; a failure ends it, so does the second demand to authenticate and
    the retry beyond the budget, which metadata and ranges share. What comes after the end isn't sent.
    """
    w = _upto(key, order)
    is_ = lambda name: F.col("decision") == name
    retries, refreshes = F.sum(is_("Retry").cast("long")).over(w), F.sum(is_("RefreshAuthentication").cast("long")).over(w)
    d = decided.withColumn("retries", retries).withColumn("refreshes", refreshes)
    end = F.when(is_("Retry") & (F.col("retries") > budget), "Limit(transport attempts)").when(is_("RefreshAuthentication") & (F.col("refreshes") > 1), "Fail(client)").when(F.col("decision").startswith("Fail"), F.col("decision"))
    d = d.withColumn("end", end)
    first = d.filter("end is not null").groupBy(key).agg(F.min(F.struct(order, "end")).alias("first"))
    sent = d.join(first, key, "left").filter(F.col("first").isNull() | (F.col(order) <= F.col(f"first.{order}")))
    return sent.groupBy(key).agg(F.coalesce(F.max("first.end"), F.lit("Complete")).alias("result"), F.count("*").alias("attempts"), F.sum(F.when(is_("AcceptRange"), F.col("length")).otherwise(0)).cast("long").alias("accepted_bytes"))
