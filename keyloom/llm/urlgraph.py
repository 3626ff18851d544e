"""URL filter: rules by host and path, and for what no rule fits a verdict from the link graph between hosts.

Edges: host -> host of every absolute link in a page (equal links of one host count once), and host -> the nearest parent
domain that is a host too. Trust is a personalised PageRank along the edges from the hosts with allowed pages (in proportion
to these), distrust one along the reversed edges from the hosts with blocked pages; both go on until they have settled, however
long the paths are. A host is blocked if its trust is under
`SHARE` of trust and distrust together; a host that neither reaches is allowed.

Rules and ranks are computed once for each host. Pages join them by host; the verdicts of hosts with more than one page in
`HOT_PARTS` (fewer than that many, then) are broadcast, so that no task gets all of a hot host's pages.

Defined cases: a null url, or one without "://", has the empty host and path, fits no rule and is allowed unless its links
say otherwise; null html has no links; rules with equal length can't both fit one url at the same host and path; null or
repeated ids are rows like any other; without any rule all hosts are allowed; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import drop_written, picked, written

#: (host/path, verdict)
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
DAMPING, SHARE = 0.85, 0.5
#: Ranks have settled when a round changes no host's rank by more than this share of it; rounds at most, beyond which it is an error.
TOLERANCE, ROUNDS = 1e-6, 100_000
HOT_PARTS = 2_000
#: A round's columns: what a rank is multiplied by on its way, and what comes of it.
RANKS = [("trust", "t", "trust"), ("distrust", "d", "distrust"), ("trust", "own", "was_trust"), ("distrust", "own", "was_distrust")]
#: Rounds between two written tables.
CUT = 5
HREF = r"(?i)(?:href|src)\s*=\s*[\"']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"'\s>]+)"


def ascii_lower(x: Column) -> Column:
    return F.translate(x, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def suffixes(host: Column) -> Column:
    """The host and its parent domains, longest first."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(labels, k, n - k + 1), "."))


def rules_of(hosts: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """host -> its rules (length, path, rule, verdict), longest first."""
    rows = [(r.partition("/")[0], "/" + r.partition("/")[2], r, v) for r, v in rules]
    known = hosts.sparkSession.createDataFrame(rows, "rule_host string, rule_path string, rule string, rule_verdict string")
    fit = hosts.select("host", F.explode(suffixes(F.col("host"))).alias("rule_host")).join(known, "rule_host")
    return fit.groupBy("host").agg(F.sort_array(F.collect_list(F.struct(F.length("rule").alias("size"), "rule_path", "rule", "rule_verdict")), asc=False).alias("rules"))


def edges_of(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """(src, dst) between different hosts; pages: host, html."""
    links = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("dst"))
    links = links.select("src", ascii_lower(F.col("dst")).alias("dst"))
    up = hosts.select(F.col("host").alias("src"), F.posexplode(suffixes(F.col("host"))).alias("up", "dst")).filter("up > 0")
    up = up.join(hosts.select(F.col("host").alias("dst")), "dst", "left_semi").groupBy("src").agg(F.min(F.struct("up", "dst"))["dst"].alias("dst"))
    return links.unionByName(up).filter("src <> dst").distinct()


def ranks(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(src, dst) and (host, trusted, blocked), both seed columns of sum 1 or 0 -> host, trust, distrust.

    Mass that comes to a host without further links is lost. A host has one row in the ranks, so the join that follows a hub's
    many edges can be split, and what goes to one host is added up before the shuffle.
    """
    out = edges.groupBy("src").agg(F.count("*").alias("n")).withColumnRenamed("src", "of")
    into = edges.groupBy("dst").agg(F.count("*").alias("n")).withColumnRenamed("dst", "of")
    along = edges.join(out, F.col("src") == F.col("of")).select(F.col("src").alias("a"), F.col("dst").alias("b"), (F.lit(damping) / F.col("n")).alias("t"), F.lit(0.0).alias("d"), F.lit(0.0).alias("own"))
    against = edges.join(into, F.col("dst") == F.col("of")).select(F.col("dst").alias("a"), F.col("src").alias("b"), F.lit(0.0).alias("t"), (F.lit(damping) / F.col("n")).alias("d"), F.lit(0.0).alias("own"))
    # A way from each host to itself carries the rank that it had, so a round reads the ranks once.
    hosts = seeds.select("host").unionByName(edges.select(F.col("src").alias("host"))).unionByName(edges.select(F.col("dst").alias("host"))).distinct()
    stay = hosts.select(F.col("host").alias("a"), F.col("host").alias("b"), F.lit(0.0).alias("t"), F.lit(0.0).alias("d"), F.lit(1.0).alias("own"))
    ways = written(along.unionByName(against).unionByName(stay), "ways")
    base = written(seeds.select("host", ((1 - damping) * F.col("trusted")).alias("trust"), ((1 - damping) * F.col("blocked")).alias("distrust")), "seeds")
    start = base.withColumn("was_trust", F.lit(0.0)).withColumn("was_distrust", F.lit(0.0))
    now, held = base, None
    for _ in range(0, ROUNDS, CUT):
        for _ in range(CUT):
            moved = now.join(ways, F.col("host") == F.col("a")).select(F.col("b").alias("host"), *[(F.col(x) * F.col(w)).alias(name) for x, w, name in RANKS])
            now = moved.unionByName(start).groupBy("host").agg(*[F.sum(name).alias(name) for _, _, name in RANKS])
        former, held = held, written(now, "ranks")
        if former is not None:
            drop_written(former)
        now = held
        # Ranks only grow from round to round, to the sum over all paths; a host reached for the first time has changed wholly.
        grown = lambda x: F.col(x) - F.col(f"was_{x}") > tolerance * F.col(x)
        if now.filter(grown("trust") | grown("distrust")).isEmpty():
            return now.select("host", "trust", "distrust")
    raise RuntimeError(f"the ranks have not settled in {ROUNDS} rounds")


def by_host(rows: DataFrame, facts: DataFrame, hosts: DataFrame) -> DataFrame:
    """rows left-joined with facts (of: host, ...; one row a host); hosts: host, n (its rows). Hot hosts' facts are broadcast."""
    total = hosts.agg(F.sum("n")).first()[0] or 0
    hot = hosts.filter(F.col("n") * HOT_PARTS > total).select(F.col("host").alias("hot"))
    marked = rows.join(F.broadcast(hot), F.col("host") == F.col("hot"), "left")
    known = F.broadcast(facts.join(F.broadcast(hot), F.col("of") == F.col("hot")).drop("hot"))
    first = marked.filter("hot is not null").drop("hot").join(known, F.col("host") == F.col("of"), "left")
    rest = marked.filter("hot is null").drop("hot").join(facts, F.col("host") == F.col("of"), "left")
    return first.unionByName(rest).drop("of")


def judge(pages: DataFrame, rules: list[tuple[str, str]] | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, trust, distrust (of the host)."""
    rules = RULES if rules is None else rules
    url = F.col("url")
    rows = picked(pages, page_id=id_col, url=url_col, html=html_col).select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), "html")
    slim = written(rows.drop("html"), "urls")
    hosts = written(slim.groupBy("host").agg(F.count("*").alias("n")), "hosts")
    edges = written(edges_of(rows.select("host", "html"), hosts.select("host")), "links")
    fitting = rules_of(hosts, rules)

    held = by_host(slim, fitting.withColumnRenamed("host", "of"), hosts)
    best = F.get(F.filter("rules", lambda r: F.startswith(F.col("path"), r["rule_path"])), F.lit(0))
    ruled = written(held.withColumn("best", F.when(F.col("rules").isNotNull(), best)).select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.col("best.rule_verdict").alias("rule_verdict")), "ruled")
    counts = ruled.groupBy("host").agg(F.sum((F.col("rule_verdict") == "allow").cast("double")).alias("allowed"), F.sum((F.col("rule_verdict") == "block").cast("double")).alias("blocked"))
    total = counts.agg(F.sum("allowed"), F.sum("blocked")).first()
    share = lambda name, sum_: (F.coalesce(name, F.lit(0.0)) / (sum_ or 1.0)).alias(name)
    seeds = counts.select("host", share("allowed", total[0]), share("blocked", total[1])).withColumnRenamed("allowed", "trusted")
    ranked = written(ranks(edges, seeds).select(F.col("host").alias("of"), "trust", "distrust"), "ranked")
    for x in (slim, edges):
        drop_written(x)
    out = by_host(ruled, ranked, hosts).fillna(0.0, ["trust", "distrust"])
    mass = F.col("trust") + F.col("distrust")
    verdict = F.when(F.col("rule_verdict").isNotNull(), F.col("rule_verdict")).when((mass > 0) & (F.col("trust") < SHARE * mass), F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust")
