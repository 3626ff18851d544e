"""Queries of the analytic models, statistics and transport rules, and SQL for DuckDB that is formulated by itself.

Shapes are recursive queries there, published figures are values, transport rules are a CASE over the same events.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions import models, stats
from keyloom.operators import transport

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name] = (f, sql)
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def levels_sql(cases: str, columns: str) -> str:
    """CTEs `lv` (case columns, k, p: pages of level k) of cases with n entries, c a leaf, f a page above."""
    return f"s AS ({cases}), lv AS (SELECT {columns}, n, c, f, 0 AS k, CAST(ceil(n / c) AS BIGINT) AS p FROM s UNION ALL SELECT {columns}, n, c, f, k + 1, CAST(ceil(p / f) AS BIGINT) FROM lv WHERE p > 1)"


# ---- models: the SQL is a recursive query, or the published figures ------------------------------------------------------

SIZES = "SELECT unnest([1000, 1000000, 100000000]) AS n"


@query("model_tree_shape", "SELECT * FROM (VALUES (1000, 5, 6, 2), (1000000, 4167, 4185, 3), (100000000, 416667, 418303, 4)) t(entries, leaves, pages, depth)")
def _(s, d):
    return models.tree_shape(s)


@query(
    "model_directory_comparison",
    f"WITH RECURSIVE {levels_sql(f'SELECT n, 240.0 AS c, 256.0 AS f FROM ({SIZES}) x', '0 AS z')}, t AS (SELECT n, sum(p) AS p, count(*) AS d FROM lv GROUP BY n) SELECT CAST(n AS BIGINT) AS entries, 'btree' AS model, p * 16384 AS total_bytes, d AS page_reads, d * 16384 AS rewrite_bytes FROM t UNION ALL SELECT n, 'sorted_array', CAST(n AS BIGINT) * 64, (SELECT min(k) FROM range(64) r(k) WHERE 2 ** k >= n), CAST(n AS BIGINT) * 64 FROM t UNION ALL SELECT n, 'hash_pages', CAST((n + 179) // 180 + ((n + 179) // 180 + 1023) // 1024 + 1 AS BIGINT) * 16384, 3, 49152 FROM t",
)
def _(s, d):
    return models.directory_comparison(s)


@query("model_page_sizes", "SELECT * FROM (VALUES (4096, 45, 63, 2258067, 5, 9249042432), (16384, 185, 255, 542671, 4, 8891121664), (65536, 744, 1023, 134542, 3, 8817344512)) t(page_bytes, leaf_capacity, fanout, pages, depth, directory_bytes)")
def _(s, d):
    return models.page_sizes(s)


@query("model_copy_on_write", "SELECT * FROM (VALUES (1000, 7, 2, 114688, 32768), (1000000, 5429, 3, 88948736, 49152), (100000000, 542671, 4, 8891121664, 65536)) t(entries, pages, depth, rebuild_bytes, path_bytes)")
def _(s, d):
    return models.copy_on_write(s)


@query(
    "model_locator_widths",
    f"WITH RECURSIVE {levels_sql('SELECT w, 100000000 AS n, (16384 - 64) // w * 1.0 AS c, 255.0 AS f FROM (SELECT unnest([56, 64, 72, 88, 96]) AS w) x', 'w')} SELECT w AS width, CAST(c AS BIGINT) AS leaf_capacity, sum(p) AS pages, count(*) AS depth, round(sum(p) * 16384 / 1073741824.0, 6) AS gib FROM lv GROUP BY ALL",
)
def _(s, d):
    return models.locator_widths(s)


@query(
    "model_inventory_crossover",
    f"WITH RECURSIVE {levels_sql('SELECT w, 100000000 AS n, (16384 - 64) // w * 1.0 AS c, 255.0 AS f FROM (SELECT unnest([56, 64, 72, 88, 96]) AS w) x', 'w')}, b AS (SELECT w, sum(p) * 16384 AS bytes FROM lv GROUP BY w) SELECT m.w AS mirrored, n.w AS minimal, round((m.bytes - n.bytes) / 4800000000.0, 6) AS crossover FROM b m JOIN b n ON (m.w, n.w) IN ((72, 56), (88, 56), (96, 64))",
)
def _(s, d):
    return models.inventory_crossover(s)


_LAYOUTS = "(VALUES ('draft-128', 64, 80, 64, 72), ('compact-128', 56, 64, 64, 72), ('tight-128', 48, 56, 64, 72), ('compact-64', 48, 48, 56, 56), ('tight-64', 40, 40, 56, 56)) v(layout, oh, ph, le, ie)"


@query(
    "model_identifier_widths",
    f"WITH RECURSIVE {levels_sql(f'SELECT layout, oh, n, (16384 - ph) // le * 1.0 AS c, (16384 - ph) // ie * 1.0 AS f FROM {_LAYOUTS}, (SELECT unnest([1000000, 100000000]) AS n) x', 'layout, oh')} SELECT layout, n AS entries, CAST(c AS BIGINT) AS leaf_capacity, CAST(f AS BIGINT) AS fanout, string_agg(p, '/' ORDER BY k) AS level_pages, sum(p) * 16384 AS directory_bytes, round((sum(p) * 16384 + CAST(n AS BIGINT) * oh) / (n * 1.0::DOUBLE), 3) AS bytes_per_object FROM lv GROUP BY layout, oh, n, c, f",
)
def _(s, d):
    return models.identifier_widths(s)


@query(
    "model_upper_bound_saving",
    f"WITH RECURSIVE {levels_sql(chr(10).join(['SELECT layout, mode, 100000000 AS n, (16384 - ph) // le * 1.0 AS c, (16384 - ph) // ie * 1.0 AS f FROM (VALUES', chr(39).join(['(', 'compact-128', ', ', 'both', ', 64, 64, 72), (', 'compact-128', ', ', 'upper', ', 64, 64, 56), (', 'compact-64', ', ', 'both', ', 48, 56, 56), (', 'compact-64', ', ', 'upper', ', 48, 56, 48)']), ') v(layout, mode, ph, le, ie)']), 'layout, mode')}, b AS (SELECT layout, mode, sum(p) * 16384 AS bytes FROM lv GROUP BY layout, mode) SELECT x.layout, x.bytes AS both_bytes, y.bytes AS upper_bytes, x.bytes - y.bytes AS saved_bytes FROM b x JOIN b y ON x.layout = y.layout AND x.mode = 'both' AND y.mode = 'upper'",
)
def _(s, d):
    return models.upper_bound_saving(s)


@query("model_scale_limits", "SELECT * FROM (VALUES (1, 40, 55, 207), (1000, 40000, 47728, 87840), (1000000, 40000000, 51865384, 91865496), (100000000, 4000000000, 5199865384, 9199865496)) t(entries, header_bytes, directory_bytes, file_bytes)")
def _(s, d):
    return models.scale_limits(s)


@query(
    "model_framing",
    "WITH r AS (SELECT w, unnest(range(a, b + 1)) AS id, p FROM (VALUES ('minimal', 1, 1, 32), ('minimal', 2, 2, 160), ('small-archive', 1, 1000, 256), ('small-archive', 1001, 1001, 64), ('small-archive', 1002, 1002, 64000), ('table-pages', 1, 10000, 65536), ('table-pages', 10001, 10001, 128), ('table-pages', 10002, 10002, 600000), ('large-media', 1, 1000, 67108864), ('large-media', 1001, 1001, 256), ('large-media', 1002, 1002, 96000)) v(w, a, b, p)), g AS (SELECT *, 1 + CAST(p >= 128 AS INT) + CAST(p >= 16384 AS INT) + CAST(p >= 2097152 AS INT) AS pb, 1 + CAST(id >= 128 AS INT) + CAST(id >= 16384 AS INT) AS ib FROM r) SELECT w AS workload, count(*) AS records, count(*) * 40 AS fixed_bytes, sum(8 + 2 * pb + ib) AS compact_bytes, round(100 - 100.0 * sum(8 + 2 * pb + ib) / (count(*) * 40), 3) AS header_saving, round(100.0 * (count(*) * 40 - sum(8 + 2 * pb + ib)) / (count(*) * 40 + sum(p)), 6) AS file_saving FROM g GROUP BY w",
)
def _(s, d):
    return models.framing(s)


@query("model_footer_discovery", "SELECT * FROM (VALUES ('exact', 180, 80, 180), ('trailing-16', 196, 80, 196), ('trailing-64KiB', 65716, 80, 65616), ('short', 40, 40, 40)) t(name, file_bytes, exact_examined, backward_examined)")
def _(s, d):
    return models.footer_discovery(s)


@query(
    "model_collisions",
    "WITH x AS (SELECT n, bits, n / 2 * (n - 1) / power(2, bits) AS a, n * n / power(2, bits) AS b FROM (SELECT unnest([1e6, 1e8, 1e9]) AS n) s, (SELECT unnest([64, 96, 128]) AS bits) w) SELECT CAST(n AS BIGINT) AS entries, bits, round(log10(a * (1 - a / 2 + a * a / 6 - a * a * a / 24)), 6) AS log10_birthday, round(log10(b * (1 - b / 2 + b * b / 6 - b * b * b / 24)), 6) AS log10_cross FROM x",
)
def _(s, d):
    return models.collisions(s)


@query("model_merge_passes", "SELECT * FROM (VALUES (4, 391, 5), (8, 391, 3), (32, 391, 2)) t(fan_in, runs, passes)")
def _(s, d):
    return models.merge_passes(s)


@query("model_external_sort", "SELECT * FROM (VALUES (4096, 49, 360448, 17600264, 1, 200003, TRUE), (7777, 26, 684376, 17600264, 1, 200003, TRUE)) t(run_entries, runs, peak_bytes, spilled_bytes, first_id, last_id, complete)")
def _(s, d):
    return models.external_sort(s)


@query(
    "model_checkpoint_cadence",
    "WITH c AS (SELECT every, every * i AS n FROM (SELECT unnest([100, 1000, 10000, 100000]) AS every) k, range(1, 10001) r(i) WHERE every * i <= 1000000), l AS (SELECT every, (n + 184) // 185 AS a FROM c), m AS (SELECT every, a, CASE WHEN a > 1 THEN (a + 254) // 255 ELSE 0 END AS b FROM l), t AS (SELECT every, a, b, CAST(b > 1 AS INT) AS x FROM m) SELECT every, count(*) AS checkpoints, CAST(sum(a + b + x) * 16384 AS BIGINT) AS rebuild_bytes, CAST(sum(every * (1 + CAST(b > 0 AS INT) + x)) * 16384 AS BIGINT) AS path_bytes FROM t GROUP BY every",
)
def _(s, d):
    return models.checkpoint_cadence(s)


@query(
    "model_batched_paths",
    "WITH k AS (SELECT changed, i * 5406 // least(changed, 5406) AS leaf FROM (SELECT unnest([1, 10, 100, 1000, 10000]) AS changed) c, range(5406) r(i) WHERE i < least(changed, 5406)) SELECT changed, count(DISTINCT leaf) + count(DISTINCT leaf // 255) + 1 AS pages, changed * 3 AS unshared FROM k GROUP BY changed",
)
def _(s, d):
    return models.batched_paths(s)


_COSTS = """RECURSIVE g AS (SELECT geometry, occupancy, ps, n, CASE WHEN fill = 0 THEN ((ps - ph) // le + 1) // 2 ELSE fill * ((ps - ph) // le) END AS c, CASE WHEN fill = 0 THEN ((ps - ph) // ie + 1) // 2 ELSE fill * ((ps - ph) // ie) END AS f
  FROM (VALUES ('draft-128', 80, 64, 72), ('compact-128', 64, 64, 72)) a(geometry, ph, le, ie), (VALUES ('minimum', 0.0::DOUBLE), ('yao-random-insert', ln(2.0::DOUBLE)), ('eighty-percent', 0.8::DOUBLE), ('packed', 1.0::DOUBLE)) o(occupancy, fill), (SELECT unnest([4096, 16384, 65536]) AS ps) p, (SELECT unnest([1000000, 100000000]) AS n) z),
lv AS (SELECT *, 0 AS k, CAST(ceil(n / c) AS BIGINT) AS p, CAST(0 AS DOUBLE) AS e, c AS per FROM g UNION ALL SELECT geometry, occupancy, ps, n, c, f, k + 1, CAST(ceil(p / f) AS BIGINT), e + 1 / per, per * f FROM lv WHERE p > 1),
costs AS (SELECT geometry, occupancy, n AS entries, ps AS page_size, max(k) + 1 AS path_reads, (max(k) + 1) * ps AS path_bytes, round(max(e), 9) AS split_events, round((max(k) + 1 + max(e)) * ps, 3) AS insert_bytes FROM lv GROUP BY ALL)"""
_COSTS = _COSTS.replace("GROUP BY ALL", "GROUP BY geometry, occupancy, n, ps")


@query("model_cost_envelope", f"WITH {_COSTS} SELECT * FROM costs")
def _(s, d):
    return models.expected_costs(s)


@query(
    "model_break_even",
    f"WITH {_COSTS}, p AS (SELECT a.geometry, a.occupancy, a.entries, a.page_size AS x, b.page_size AS y, CASE WHEN a.path_reads <> b.path_reads THEN (b.path_bytes - a.path_bytes) / CAST(a.path_reads - b.path_reads AS DOUBLE) END AS q FROM costs a JOIN costs b ON a.geometry = b.geometry AND a.occupancy = b.occupancy AND a.entries = b.entries AND a.page_size < b.page_size) SELECT geometry, occupancy, entries, x AS a_page_size, y AS b_page_size, CASE WHEN q > 0 THEN round(q, 6) END AS break_even FROM p",
)
def _(s, d):
    return models.break_even(models.expected_costs(s))


# The envelope by elimination: a page size is best at q where no other is cheaper; it holds the q between the largest crossing
# with those of more reads and the least with those of fewer reads.
@query(
    "model_lower_envelope",
    f"WITH {_COSTS}, l AS (SELECT geometry, occupancy, entries, pressure, page_size, path_reads AS r, path_bytes + pressure * insert_bytes AS b FROM costs, (SELECT unnest([0.0, 0.5, 2.0])::DOUBLE AS pressure) p), x AS (SELECT a.geometry, a.occupancy, a.entries, a.pressure, a.page_size, max(CASE WHEN o.r > a.r THEN (a.b - o.b) / (o.r - a.r) END) AS low, min(CASE WHEN o.r < a.r THEN (o.b - a.b) / (a.r - o.r) END) AS high, bool_or(o.r = a.r AND (o.b < a.b OR (o.b = a.b AND o.page_size < a.page_size))) AS beaten FROM l a JOIN l o ON o.geometry = a.geometry AND o.occupancy = a.occupancy AND o.entries = a.entries AND o.pressure = a.pressure GROUP BY 1, 2, 3, 4, 5) SELECT geometry, occupancy, entries, pressure, page_size, round(greatest(coalesce(low, 0), 0), 3) AS q_min, round(high, 3) AS q_max FROM x WHERE NOT beaten AND coalesce(high, 1e300) > greatest(coalesce(low, 0), 0)",
)
def _(s, d):
    return models.lower_envelope(models.expected_costs(s))


@query("model_support_profiles", "SELECT * FROM (VALUES ('research-small', 545, 2, 200641, 201326592, 134217728, TRUE), ('research-medium', 5429, 2, 17009557, 12884901888, 8589934592, TRUE), ('research-large', 54268, 2, 170070684, 206158430208, 137438953472, TRUE)) t(profile, pages, depth, reads, read_bytes, hash_bytes, consistent)")
def _(s, d):
    return models.support_profiles(s)


@query(
    "model_profile_boundaries",
    "SELECT profile, \"case\", reads_suffice, read_bytes_suffice, hash_bytes_suffice, satisfiable FROM (SELECT unnest(['research-small', 'research-medium', 'research-large']) AS profile) p, (VALUES ('exact', TRUE, TRUE, TRUE, TRUE), ('reads-1', FALSE, TRUE, TRUE, FALSE), ('read_bytes-1', TRUE, FALSE, TRUE, FALSE), ('hash_bytes-1', TRUE, TRUE, FALSE, FALSE)) c(\"case\", reads_suffice, read_bytes_suffice, hash_bytes_suffice, satisfiable)",
)
def _(s, d):
    # The published budgets, each mutated by one.
    needed = models.support_profiles(s)
    exact = models.cases(s, [("research-small", 200_641, 201_326_592, 134_217_728), ("research-medium", 17_009_557, 12_884_901_888, 8_589_934_592), ("research-large", 170_070_684, 206_158_430_208, 137_438_953_472)], "profile string, reads long, read_bytes long, hash_bytes long")
    allowed = exact.withColumn("case", F.lit("exact"))
    for c in ("reads", "read_bytes", "hash_bytes"):
        allowed = allowed.unionByName(exact.withColumn(c, F.col(c) - 1).withColumn("case", F.lit(f"{c}-1")))
    return models.satisfiable(needed, allowed)


@query("model_limit_interactions", "SELECT * FROM (VALUES ('directory_pages', 54268, 1000000, TRUE), ('depth', 3, 32, TRUE), ('file_bytes', 1369126912, 17179869184, TRUE), ('object_reads', 10000000, 1000000, FALSE), ('scan_reads', 256, 4096, TRUE), ('full_candidates', 1024, 4, FALSE)) t(name, needed, allowed, fits)")
def _(s, d):
    return models.limit_interactions(s)


@query(
    "model_backoff",
    "WITH RECURSIVE n AS (SELECT server_min, 0 AS n, greatest(100, server_min) AS delay_ms, 100 AS base, 0 AS before FROM (SELECT unnest([0, 700, 6000]) AS server_min) s UNION ALL SELECT server_min, n + 1, greatest(least(base * 2, 5000), server_min), least(base * 2, 5000), before + delay_ms FROM n WHERE n < 9), b AS (SELECT *, CASE WHEN server_min > 5000 THEN 'Limit' WHEN delay_ms >= 30000 - before THEN 'DeadlineExceeded' WHEN before + delay_ms > 20000 THEN 'Limit' END AS bad FROM n), f AS (SELECT server_min, min(n) AS first FROM b WHERE bad IS NOT NULL GROUP BY 1) SELECT b.server_min, b.n, delay_ms, CASE WHEN first IS NULL OR n < first THEN 'Wait' WHEN n = first THEN bad ELSE 'AfterTerminal' END AS outcome FROM b LEFT JOIN f ON f.server_min = b.server_min",
)
def _(s, d):
    return models.backoff(s)


@query(
    "model_borrow_side",
    "SELECT l AS left_entries, r AS right_entries, CASE WHEN greatest(l, r) <= 93 THEN CASE WHEN l >= 93 THEN 'merge_left' WHEN r >= 93 THEN 'merge_right' ELSE 'alone' END WHEN l >= 94 THEN 'borrow_left' ELSE 'borrow_right' END AS left_first, CASE WHEN greatest(l, r) <= 93 THEN CASE WHEN l >= 93 THEN 'merge_left' WHEN r >= 93 THEN 'merge_right' ELSE 'alone' END WHEN l >= r THEN 'borrow_left' ELSE 'borrow_right' END AS fuller_sibling, l = 94 OR (l < 94 AND r = 94) AS donor_cliff FROM (SELECT unnest([-1, 93, 94, 95, 96]) AS l) a, (SELECT unnest([-1, 93, 94, 95, 96]) AS r) b",
)
def _(s, d):
    return models.borrow_sides(s)


_PAGES = "(SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)"


def _customer_pages(s, d):
    return table(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))


@query("model_hazards", f"SELECT CAST(sum(n) AS BIGINT) AS keys, count(*) AS leaves, round(CAST(5 * sum(CASE WHEN n = 5 THEN 1 ELSE 0 END) AS DOUBLE) / sum(n), 9) AS underflow, round(CAST(13 * sum(CASE WHEN n = 12 THEN 1 ELSE 0 END) AS DOUBLE) / (sum(n) + count(*)), 9) AS split FROM {_PAGES} p")
def _(s, d):
    return models.hazards(_customer_pages(s, d).withColumnRenamed("n", "entries"), 5, 12)


# ---- statistics ---------------------------------------------------------------------------------------------------------


@query("occupancy_stats", f"SELECT count(*) AS pages, min(n) AS least, max(n) AS most, round(avg(n), 9) AS mean, median(n) AS median, (SELECT n FROM {_PAGES} q ORDER BY n LIMIT 1 OFFSET (SELECT CAST(floor(0.95 * (count(*) - 1)) AS BIGINT) FROM {_PAGES} r)) AS p95, round(avg(CASE WHEN n >= 10 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS share FROM {_PAGES} p")
def _(s, d):
    return stats.occupancy(_customer_pages(s, d), "n", 10)


@query("transition_histogram", "SELECT event_type AS operation, CAST(user_id % 4 AS BIGINT) AS pages_written, count(*) AS n, round(sum(value), 4) AS reward FROM events GROUP BY 1, 2")
def _(s, d):
    e = table(s, d, "events").select(F.col("event_type").alias("operation"), (F.col("user_id") % 4).alias("pages_written"), "value")
    return stats.histogram(e, "operation", "pages_written", reward="value")


@query("total_variation", "WITH h AS (SELECT event_type AS k, sum(CASE WHEN user_id % 2 = 0 THEN 1.0::DOUBLE ELSE 0 END) AS a, sum(CASE WHEN user_id % 2 = 1 THEN 1.0::DOUBLE ELSE 0 END) AS b FROM events GROUP BY 1), t AS (SELECT sum(a) AS sa, sum(b) AS sb FROM h) SELECT round(0.5 * sum(abs(a / sa - b / sb)), 9) AS total_variation FROM h, t")
def _(s, d):
    e = table(s, d, "events").groupBy("event_type").agg(F.count_if(F.col("user_id") % 2 == 0).alias("even"), F.count_if(F.col("user_id") % 2 == 1).alias("odd"))
    return stats.total_variation(e, "even", "odd")


@query("mutual_information", "WITH j AS (SELECT x, y, CAST(count(event_id) AS DOUBLE) AS n FROM (SELECT DISTINCT event_type AS x FROM events) a CROSS JOIN (SELECT DISTINCT user_id % 5 AS y FROM events) b LEFT JOIN events e ON e.event_type = x AND e.user_id % 5 = y GROUP BY 1, 2), m AS (SELECT n, sum(n) OVER (PARTITION BY x) AS nx, sum(n) OVER (PARTITION BY y) AS ny, sum(n) OVER () AS t FROM j) SELECT round(sum(CASE WHEN n > 0 THEN n / t * log2(n * t / (nx * ny)) ELSE 0 END), 9) AS bits, round(0.5 * sum(abs(n / t - nx * ny / t / t)), 9) AS joint_variation FROM m")
def _(s, d):
    return stats.mutual_information(table(s, d, "events").withColumn("y", F.col("user_id") % 5), "event_type", "y")


@query("occupancy_bands", f"SELECT CASE WHEN n < 5 THEN 'under' WHEN n = 5 THEN 'minimum' WHEN n < 15 THEN 'middle' ELSE 'full' END AS band, count(*) AS pages FROM {_PAGES} p GROUP BY 1")
def _(s, d):
    return stats.bands(_customer_pages(s, d), "n", 5, 15)


@query("reward_successors", "WITH s AS (SELECT a.event_type AS state, (SELECT arg_min(b.event_type, (b.ts, b.event_id)) FROM events b WHERE b.user_id = a.user_id AND (b.ts, b.event_id) > (a.ts, a.event_id)) AS successor FROM events a) SELECT state, count(*) AS n, count(DISTINCT successor) AS successors, count(DISTINCT successor) > 1 AS splits FROM s GROUP BY state")
def _(s, d):
    return stats.successors(table(s, d, "events"), "user_id", "event_type", ["ts", "event_id"])


# ---- transport: every event is a request --------------------------------------------------------------------------------

_STATUS = [200, 206, 401, 403, 404, 412, 416, 429, 503, 301, 204, 418, 500, 206, 200]


def exchanges(s, d):
    i = F.col("event_id")
    e = table(s, d, "events").select(
        i.alias("request"),
        F.when(i % 2 == 0, "metadata").otherwise("range").alias("kind"),
        F.element_at(F.array(*map(F.lit, _STATUS)), (i % 15 + 1).cast("int")).alias("status"),
        (i % 3 == 0).alias("may_refresh"),
        F.when(i % 4 == 0, 'W/"a"').otherwise('"a"').alias("version"),
        F.when(i % 17 == 3, '"b"').otherwise('"a"').alias("expected_version"),
        (i % 7 * 100).alias("offset"),
        (i % 5 * 50).alias("length"),
        F.lit(700).cast("long").alias("total_length"),
        F.when(i % 31 != 1, F.when(i % 2 == 0, F.lit(700)).otherwise(i % 5 * 50 + (i % 19 == 7).cast("int"))).cast("long").alias("content_length"),
        F.when(i % 2 == 0, F.when(i % 22 == 4, "bytes 0-1/2")).otherwise(F.concat(F.lit("bytes "), i % 7 * 100, F.lit("-"), i % 7 * 100 + i % 5 * 50 - 1, F.when(i % 23 == 5, "/*").otherwise("/700"))).alias("content_range"),
        F.when(i % 2 == 0, (i % 26 == 6).cast("long")).otherwise(i % 5 * 50).alias("body_length"),
        (i % 3 - 1).alias("retry_after"),
    )
    return e


_EXCHANGES = """SELECT event_id AS i, event_id % 2 = 0 AS meta, list_extract([200, 206, 401, 403, 404, 412, 416, 429, 503, 301, 204, 418, 500, 206, 200], event_id % 15 + 1) AS status, event_id % 7 * 100 AS o, event_id % 5 * 50 AS len FROM events"""


@query(
    "http_classification",
    f"""WITH q AS ({_EXCHANGES}), d AS (SELECT i, status, CASE
  WHEN status IN (429, 500, 503) THEN 'Retry' WHEN status = 401 AND i % 3 = 0 THEN 'RefreshAuthentication' WHEN status IN (401, 403, 404, 416, 418) THEN 'Fail(client)'
  WHEN status = 412 THEN 'Fail(version changed)' WHEN status = 301 THEN 'Fail(redirect)'
  WHEN meta AND status = 200 AND i % 4 <> 0 AND i % 26 <> 6 AND i % 22 <> 4 AND i % 31 <> 1 THEN 'AcceptMetadata'
  WHEN NOT meta AND status = 206 AND i % 5 > 0 AND o + len <= 700 AND i % 17 <> 3 AND i % 19 <> 7 AND i % 31 <> 1 AND i % 23 <> 5 THEN 'AcceptRange'
  ELSE 'Fail(protocol)' END AS decision FROM q)
SELECT i AS request, CASE WHEN i % 2 = 0 THEN 'metadata' ELSE 'range' END AS kind, status, decision, CASE WHEN decision = 'Retry' AND i % 3 = 2 THEN 1 END AS retry_after FROM d""",
)
def _(s, d):
    return transport.classified(exchanges(s, d)).select("request", "kind", "status", "decision", "retry_after")


@query(
    "conditional_sessions",
    f"""WITH q AS ({_EXCHANGES}), d AS (SELECT i, i // 4 AS k, len, CASE
  WHEN status IN (429, 500, 503) THEN 'Retry' WHEN status = 401 AND i % 3 = 0 THEN 'RefreshAuthentication' WHEN status IN (401, 403, 404, 416, 418) THEN 'Fail(client)'
  WHEN status = 412 THEN 'Fail(version changed)' WHEN status = 301 THEN 'Fail(redirect)'
  WHEN meta AND status = 200 AND i % 4 <> 0 AND i % 26 <> 6 AND i % 22 <> 4 AND i % 31 <> 1 THEN 'AcceptMetadata'
  WHEN NOT meta AND status = 206 AND i % 5 > 0 AND o + len <= 700 AND i % 17 <> 3 AND i % 19 <> 7 AND i % 31 <> 1 AND i % 23 <> 5 THEN 'AcceptRange'
  ELSE 'Fail(protocol)' END AS decision FROM q),
e AS (SELECT *, (SELECT count(*) FROM d b WHERE b.k = d.k AND b.i <= d.i AND b.decision = 'Retry') AS r, (SELECT count(*) FROM d b WHERE b.k = d.k AND b.i <= d.i AND b.decision = 'RefreshAuthentication') AS a FROM d),
f AS (SELECT k, min(i) AS stop FROM e WHERE decision LIKE 'Fail%' OR (decision = 'Retry' AND r > 1) OR (decision = 'RefreshAuthentication' AND a > 1) GROUP BY k)
SELECT e.k AS session, coalesce(max(CASE WHEN i = stop THEN CASE decision WHEN 'Retry' THEN 'Limit(transport attempts)' WHEN 'RefreshAuthentication' THEN 'Fail(client)' ELSE decision END END), 'Complete') AS result, count(*) AS attempts, CAST(sum(CASE WHEN decision = 'AcceptRange' THEN len ELSE 0 END) AS BIGINT) AS accepted_bytes FROM e LEFT JOIN f ON f.k = e.k WHERE stop IS NULL OR i <= stop GROUP BY e.k""",
)
def _(s, d):
    decided = transport.classified(exchanges(s, d)).withColumn("session", F.floor(F.col("request") / 4))
    return transport.sessions(decided, "session", "request", 1)


@query("retry_budget", "WITH a AS (SELECT user_id, event_id, event_id % 3 = 0 AS r, count(*) FILTER (event_id % 3 = 0) OVER (PARTITION BY user_id ORDER BY event_id) AS used FROM events), f AS (SELECT user_id, min(event_id) AS stop FROM a WHERE used > 3 GROUP BY 1) SELECT a.user_id, event_id, used, CASE WHEN event_id > stop THEN 'AfterTerminal' WHEN event_id = stop THEN 'Limit(transport attempts)' WHEN r THEN 'Retry' ELSE 'Done' END AS outcome FROM a LEFT JOIN f ON f.user_id = a.user_id")
def _(s, d):
    e = table(s, d, "events").select("user_id", "event_id")
    return transport.budgeted(e, "user_id", "event_id", F.col("event_id") % 3 == 0, 3)


@query("authentication_refresh", "SELECT e.user_id, e.event_id, CASE (SELECT count(*) FROM events b WHERE b.user_id = e.user_id AND b.event_id < e.event_id AND b.event_type = 'click') WHEN 0 THEN 'Refresh' WHEN 1 THEN 'Fail' ELSE 'AfterTerminal' END AS outcome FROM events e WHERE e.event_type = 'click'")
def _(s, d):
    return transport.refreshed(table(s, d, "events").filter("event_type = 'click'").select("user_id", "event_id"), "user_id", "event_id")


@query("bounded_waits", "SELECT event_id, outcome, CASE WHEN outcome = 'Waited' THEN (w + 99) // 100 ELSE 0 END AS chunks, CASE WHEN outcome = 'Waited' AND w > 0 THEN (w - 1) % 100 + 1 END AS last_chunk_ms FROM (SELECT event_id, event_id % 900 + event_id % 70 AS w, CASE WHEN event_id % 70 > 50 THEN 'Invalid' WHEN event_id % 900 + event_id % 70 >= 600 THEN 'DeadlineExceeded' ELSE 'Waited' END AS outcome FROM events) x")
def _(s, d):
    e = table(s, d, "events").select("event_id", (F.col("event_id") % 900).alias("delay_ms"), (F.col("event_id") % 70).alias("jitter_ms"), F.lit(600).cast("long").alias("remaining_ms"))
    return transport.waits(e, 100, 50).select("event_id", "outcome", "chunks", "last_chunk_ms")


# A request that was sent at s is in flight until s + 5; the SQL walks from one that is sent to the next.
@query("coalesced_requests", "WITH RECURSIVE r AS (SELECT l_partkey AS k, l_orderkey AS s, count(*) AS n FROM lineitem GROUP BY 1, 2), f(k, s) AS (SELECT k, min(s) FROM r GROUP BY k UNION ALL SELECT f.k, (SELECT min(r.s) FROM r WHERE r.k = f.k AND r.s >= f.s + 500) FROM f WHERE f.s IS NOT NULL), t AS (SELECT k, s FROM f WHERE s IS NOT NULL), g AS (SELECT t.k, t.s, (SELECT sum(n) FROM r WHERE r.k = t.k AND r.s >= t.s AND r.s < t.s + 500) AS shared FROM t) SELECT k AS offset_key, (SELECT CAST(sum(n) AS BIGINT) FROM r WHERE r.k = g.k) AS asked, count(*) AS sent, CAST(max(shared) AS BIGINT) AS most_shared FROM g GROUP BY k")
def _(s, d):
    r = table(s, d, "lineitem").select(F.col("l_partkey").alias("offset_key"), F.col("l_orderkey").alias("started"), (F.col("l_orderkey") + 500).alias("ended"))
    return transport.coalesced(r, ["offset_key"], "started", "ended")
