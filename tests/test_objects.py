import random

import pytest

from keyloom.functions.codec import decode_value, encode_value
from keyloom.operators import graph, history, merge, tree

STATE = "object_id long, kind int, digest string"
OPS = "object_id long, op string, kind int, digest string"


def pages_of(spark, n, c, least):
    from pyspark.sql import functions as F

    rows = spark.range(1, n + 1).select(tree.page_of(F.col("id"), F.lit(n), c, least).alias("p")).groupBy("p").count().orderBy("p").collect()
    return [r["count"] for r in rows]


@pytest.mark.parametrize("n,want", [(185, [185]), (186, [93, 93]), (277, [184, 93]), (278, [185, 93]), (370, [185, 185]), (400, [185, 122, 93])])
def test_canonical_pages(spark, n, want):
    assert pages_of(spark, n, 185, 93) == want


def test_shape():
    assert tree.shape(1000, 240, 256) == [5, 1]
    assert sum(tree.shape(1_000_000, 240, 256)) == 4185
    assert sum(tree.shape(100_000_000)) == 542_671


def test_batches_against_a_dict(spark):
    rng = random.Random(7)
    state = {k: (1, f"d{k}") for k in range(1, 60)}
    for _ in range(3):
        ids = rng.sample(range(1, 90), 25)
        ops = [(k, "delete", None, None) if k in state and rng.random() < 0.4 else (k, "put", 2, f"n{rng.random()}") for k in ids]
        s, o = spark.createDataFrame([(k, *v) for k, v in state.items()], STATE), spark.createDataFrame(rng.sample(ops, len(ops)), OPS)
        assert merge.violations(s, o).count() == 0
        got = {r.object_id: (r.kind, r.digest) for r in merge.applied(s, o).collect()}
        for k, op, kind, d in ops:
            if op == "put":
                state[k] = (kind, d)
            else:
                del state[k]
        assert got == state


def test_violations(spark):
    s = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], STATE)
    o = spark.createDataFrame([(5, "delete", None, None), (1, "put", 1, "x"), (1, "put", 1, "y"), (0, "put", 1, "z")], OPS)
    assert {r.category for r in merge.violations(s, o).collect()} == {"MissingObject", "DuplicateObject", "Invalid"}
    gone = spark.createDataFrame([(1, "delete", None, None), (2, "delete", None, None)], OPS)
    assert [r.check for r in merge.violations(s, gone).collect()] == ["empty result"]


def test_closure_ends_on_cycles(spark):
    nodes, edges = spark.createDataFrame([(k,) for k in range(6)], "id long"), spark.createDataFrame([(0, 1), (1, 0), (1, 9), (4, 5)], "src long, dst long")
    got = {r.id: r.status for r in graph.compaction(nodes, edges, spark.createDataFrame([(0,)], "id long")).collect()}
    assert got == {0: "reachable", 1: "reachable", 9: "missing", 2: "orphaned", 3: "orphaned", 4: "orphaned", 5: "orphaned"}


def test_ambiguous_fork(spark):
    kind = "id long, sequence long, parent long, footer_offset long, exact_end boolean, checkpoint string, status string"
    rows = [(1, 0, None, 0, True, "complete", "verified"), (2, 1, 1, 1, True, "complete", "verified"), (3, 1, 1, 2, True, "complete", "verified")]
    assert history.selected(spark.createDataFrame(rows, kind)).first().outcome == "AmbiguousFork"
    assert history.selected(spark.createDataFrame(rows[:2], kind)).first().id == 2


def test_values_round_trip():
    value = {"b": [1, 2**40, None, True], "a": {"x": b"\x00\xff", "yy": "é"}, "n": 23}
    assert decode_value(encode_value(value)) == value
    for bad in (encode_value(value) + b"\x00", b"\x18\x01", b"\xa2\x61b\x01\x61a\x01"):
        with pytest.raises(ValueError):
            decode_value(bad)


CHANGES = "object_id long, op string, kind int, payload binary"


def test_store(spark, tmp_path):
    from keyloom.sources.store import Conflict, Store

    store = Store(spark, str(tmp_path / "a"))
    df = lambda *rows: spark.createDataFrame(list(rows), CHANGES)
    store.commit(df((1, "put", 1, b"a"), (2, "put", 1, b"b")))
    store.commit(df((1, "delete", None, None), (3, "put", 1, b"c")))
    assert {r.object_id for r in store.state().collect()} == {2, 3} == {r.object_id for r in store.inventory().collect()}
    assert {r.object_id for r in store.state(0).collect()} == {1, 2}
    for bad in (df((9, "delete", None, None)), df((0, "put", 1, b"")), df((5, "put", 0, b"")), df((5, "put", 1, b""), (5, "put", 1, b"")), df((2, "delete", None, None), (3, "delete", None, None)), df((5, "touch", 1, b"")), df().limit(0)):
        with pytest.raises(ValueError):
            store.commit(bad)
    with pytest.raises(ValueError, match="duplicate"):
        store.append(df((3, "put", 1, b"x")).drop("op"))
    with pytest.raises(Conflict):
        store.genesis(df((3, "put", 1, b"x")).drop("op"))
    assert store.sequences() == [0, 1]


def test_two_writers_and_a_reader(spark, tmp_path, monkeypatch):
    """The log entry is there as a whole or not at all, and the second writer of a sequence fails."""
    from keyloom.sources import publication
    from keyloom.sources.store import Conflict, SourceChanged, Store

    store, rows = Store(spark, str(tmp_path)), spark.createDataFrame([(1, "put", 1, b"a")], CHANGES)
    link, seen = publication.HadoopBackend.link, []

    def slow(self, private):
        seen.append((store.sequences(), store.state().count()))  # a reader between the steps
        link(self, private)

    monkeypatch.setattr(publication.HadoopBackend, "link", slow)
    token = store.token()
    store.commit(rows)
    assert seen == [([], 0)] and store.state().count() == 1
    with pytest.raises(SourceChanged):
        store.check(token)
    monkeypatch.setattr(Store, "sequences", lambda self: [])
    with pytest.raises(Conflict, match="DestinationExists"):
        store.commit(rows)
    monkeypatch.undo()
    assert store.sequences() == [0] and not [x for x in (tmp_path / "_log").iterdir() if x.name.endswith(".private")]


def test_rewrites(spark, tmp_path):
    from keyloom.sources.store import Store

    at = lambda name: Store(spark, str(tmp_path / name))
    a = at("a")
    a.commit(spark.createDataFrame([(k, "put", 1, bytes([k]) * k) for k in range(1, 6)], CHANGES))
    a.commit(spark.createDataFrame([(2, "delete", None, None), (5, "put", 2, b"new")], CHANGES))
    a.commit(spark.createDataFrame([(6, "put", 1, b"six")], CHANGES))
    ids = lambda *x, name="object_id": spark.createDataFrame([(k,) for k in x], f"{name} long")
    live = lambda s, seq=None: {r.object_id: bytes(r.payload) for r in s.state(seq).collect()}
    assert a.rewrite(at("all")) == {"sequence": 0, "objects": 5, "byte_scoped_signatures_preserved": False} and live(at("all")) == live(a)
    a.rewrite(at("some"), ids=ids(1, 5))
    assert live(at("some")) == {1: b"\x01", 5: b"new"}
    edges = spark.createDataFrame([(1, 3), (3, 1), (3, 4)], "src long, dst long")
    a.rewrite(at("reached"), seq=0, edges=edges, roots=ids(1, name="id"))
    assert set(live(at("reached"))) == {1, 3, 4}
    for bad in (dict(ids=ids(2)), dict(ids=ids(1, 1)), dict(edges=edges, roots=ids(2, name="id")), dict(max_bytes=3)):
        with pytest.raises((KeyError, ValueError)):
            a.rewrite(at("bad"), **bad)
    assert at("bad").sequences() == []
    assert a.copy(at("copy"), spark.createDataFrame([(9, "put", 1, b"t")], CHANGES)) == 3
    assert live(at("copy"), 2) == live(a) and at("copy").identity(2) == a.identity()
    assert a.reissue(at("again"), [0, 2]) == 2 and [live(at("again"), k) for k in (0, 1)] == [live(a, 0), live(a, 2)]
    with pytest.raises(ValueError):
        a.reissue(at("big"), [0, 2], max_bytes=5)


def test_stream_publishes_on_commit(spark, tmp_path):
    from keyloom.streaming.events import publish

    kind = "file long, position long, event string, object_id long"
    rows = [(1, 0, "record", 1), (1, 1, "record", 2), (1, 2, "commit", None), (2, 0, "record", 5), (2, 1, "record", 5), (3, 0, "record", 1)]
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(str(tmp_path / "in"))
    out = publish(spark.readStream.schema(kind).parquet(str(tmp_path / "in")))
    q = out.writeStream.format("memory").queryName("published").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.file, r.status) for r in spark.table("published").collect()} == {(1, "committed"), (2, "failed")}


def test_freshness_in_a_stream(spark, tmp_path):
    from keyloom.streaming.events import freshness

    kind = "source long, position long, sequence long, digest string"
    rows = [(1, 0, 5, "a"), (1, 1, 4, "x"), (1, 2, 5, "b"), (1, 3, 7, "c"), (1, 4, 5, "a"), (1, 5, 7, "c"), (2, 0, 1, "a")]
    want = {(1, 0, "Unpinned"), (1, 1, "Rollback"), (1, 2, "ForkAtTrustedSequence"), (1, 3, "Advances"), (1, 4, "Rollback"), (1, 5, "Current"), (2, 0, "Unpinned")}
    batch = spark.createDataFrame(rows, kind)
    assert {(r.source, r.position, r.verdict) for r in freshness(batch).collect()} == want
    for k in (0, 1):  # two files, two batches
        batch.filter(f"(position > 2) = ({k} = 1)").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    held = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = freshness(held).writeStream.format("memory").queryName("heads").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.source, r.position, r.verdict) for r in spark.table("heads").collect()} == want


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_candidates_are_all_events(spark):
    """The four candidate queries over every event of sf0.001, against a walk in Python."""
    import __spark_entry__ as e

    d = "/root/testdata/sf0.001"
    ids = sorted(r.event_id for r in spark.read.parquet(f"{d}/events.parquet").select("event_id").collect())
    assert len(ids) > 400
    rows = {i: (i + 1 if i and i % 97 == 13 else i, None if i == 0 else i + 100_000 if i % 89 == 17 else i - 1, i % 101 != 60, i % 103 != 70) for i in ids}

    bad_kinds = ["IntegrityFailed", "UnsupportedRequiredCapability", "Truncated", "Invalid"]

    def failure(i):
        start, depth = i, 1
        while True:
            sequence, parent, complete, verified = rows[i]
            if i == start and not verified:
                return bad_kinds[i % 4], None
            if i == start and not complete:
                return "ProgressCheckpoint", None
            if parent is None:
                return None, depth
            if parent not in rows:
                return "MissingParent", None
            p = rows[parent]
            if not (p[2] and p[3]):
                return "ParentNotVerified", None
            if p[0] >= sequence:
                return "NonIncreasingSequence", None
            if p[0] + 1 != sequence:
                return "SequenceGap", None
            i, depth = parent, depth + 1

    run = lambda name: e.queries()[name](spark, d).collect()
    walked = {i: failure(i) for i in ids}
    live = {i for i in ids if walked[i][0] is None}
    ends = live - {rows[i][1] for i in live}
    best = max(rows[i][0] for i in ends)
    top = [i for i in ends if rows[i][0] == best]
    status = lambda i: walked[i][0] or ("VerifiedAncestor" if i not in ends else "VerifiedForkTerminal" if len(top) > 1 and i in top else "VerifiedTerminal")
    assert {r.id: (r.sequence, r.status, r.chain_depth, r["rank"]) for r in run("root_enumeration")} == {i: (rows[i][0], status(i), walked[i][1], len(ids) - k) for k, i in enumerate(ids)}
    fresh = lambda i: "Rollback" if rows[i][0] < 50 else "Advances" if rows[i][0] > 50 else "Current" if i == 50 else "ForkAtTrustedSequence"
    assert {r.digest: (r.sequence, r.freshness) for r in run("freshness")} == {i: (rows[i][0], fresh(i)) for i in ids}

    kept = sorted((rows[i][0], i) for i in ids if i % 97 != 14)
    breaks = [(s, "sequence gap") for (b, _), (s, _) in zip(kept, kept[1:]) if s != b + 1] + [(s, "parent digest") for (_, b), (s, i) in zip(kept, kept[1:]) if rows[i][1] != b]
    assert sorted((r.seq, r.check) for r in run("history_breaks")) == sorted(breaks)

    assert [(r.outcome, r.id, r.sequence, r.candidates) for r in run("root_selection")] == [("Selected", top[0], best, len(top))]


KIND = "id long, sequence long, parent long, footer_offset long, exact_end boolean, checkpoint string, status string"


@pytest.mark.parametrize(
    "rows,mode,want",
    [
        ([(1, 0, None, True), (2, 1, 1, False)], "recovery", ("Selected", 2)),
        ([(1, 0, None, False), (2, 1, 1, False), (3, 1, 1, False)], "recovery", ("AmbiguousFork", None)),
        ([(1, 0, None, False), (2, 1, 1, False), (3, 1, 1, False), (4, 2, 3, False)], "recovery", ("Selected", 4)),
        ([], "recovery", ("NoValidRoot", None)),
        ([(1, 0, None, False), (2, 1, 1, True)], "strict_exact_end", ("Selected", 2)),
        ([(1, 0, None, False), (2, 1, 1, False)], "strict_exact_end", ("NoExactEndRoot", None)),
        ([(1, 0, None, True), (2, 1, 1, True)], "strict_exact_end", ("MultipleExactEndRoots", None)),
        ([(1, 0, None, False), (2, 3, 1, True)], "strict_exact_end", ("NoExactEndRoot", None)),
    ],
)
def test_fork_recipes(spark, rows, mode, want):
    df = spark.createDataFrame([(i, s, p, 10 * i, x, "complete", "verified") for i, s, p, x in rows], KIND)
    got = history.selected(df, mode).first()
    assert (got.outcome, got.id) == want


def test_forks_cycles_and_depths(spark):
    rows = [(1, 0, None), (2, 1, 1), (3, 1, 1), (4, 5, 5), (5, 6, 4), (6, 2, 2), (7, 3, 6)]
    df = spark.createDataFrame([(i, s, p, 10 * i, False, "progress" if i == 3 else "complete", "verified") for i, s, p in rows], KIND)
    got = {r.id: (r.status, r.chain_depth) for r in history.enumerated(df).collect()}
    assert got == {1: ("VerifiedAncestor", 1), 2: ("VerifiedAncestor", 2), 3: ("ProgressCheckpoint", None), 4: ("NonIncreasingSequence", None), 5: ("NonIncreasingSequence", None), 6: ("VerifiedAncestor", 3), 7: ("VerifiedTerminal", 4)}
    short = {r.id: r.status for r in history.enumerated(df, max_depth=3).collect()}
    assert short[7] == "ParentDepthExceeded" and short[6] == "VerifiedTerminal"
    with pytest.raises(ValueError, match="duplicate"):
        history.chains(df.unionByName(df))


def test_retention_closure_and_repair(spark):
    # The published dependencies; 9 can't be read, 10 and 11 are a cycle.
    deps = {1: [2], 2: [3], 3: [], 4: [2, 5], 5: [6], 6: [], 7: [8], 8: [3], 9: None, 10: [11], 11: [10]}
    objects = spark.createDataFrame([(k, v is not None) for k, v in deps.items()], "id long, known boolean")
    edges = spark.createDataFrame([(k, x) for k, v in deps.items() for x in v or []], "src long, dst long")
    ids = lambda *x: spark.createDataFrame([(k,) for k in x], "id long")
    kept = lambda policy, *roots: {r.id for r in graph.retention(objects, edges, ids(*roots), policy).filter("status = 'retained'").collect()}
    assert kept("abort", 4, 7) == {2, 3, 4, 5, 6, 7, 8} and kept("retain_all", 7, 10) == {3, 7, 8, 9, 10, 11}
    with pytest.raises(ValueError):
        graph.retention(objects, edges, ids(9), "abort")
    with pytest.raises(KeyError):
        graph.kept_objects(objects, edges, ids(1, 77))
    with pytest.raises(ValueError):
        graph.closure(edges, ids(1), max_depth=1)
    reached = graph.closure(edges, ids(1))
    assert {r.id: r.depth for r in reached.collect()} == {1: 0, 2: 1, 3: 2}
    assert tuple(graph.totals(edges, reached).first()) == (3, 2, 2)
    locators = spark.createDataFrame([(1, 0, 10), (2, 5, 10), (3, 40, 5)], "object_id long, record_offset long, record_len long")
    assert [r.overlaps for r in graph.repair_plan(locators, ids(1, 2, 3)).orderBy("record_offset").collect()] == [False, True, False]
    with pytest.raises(KeyError):
        graph.repair_plan(locators, ids(1, 9))
    with pytest.raises(ValueError):
        graph.repair_plan(locators, ids(1, 2), max_bytes=15)
    for bad, error in ((ids(), ValueError), (ids(1, 1), ValueError), (ids(1, 99), KeyError)):
        with pytest.raises(error):
            graph.projected(objects, bad, "id")


def test_reissue(spark):
    log = spark.createDataFrame([(0, 1, "put", "a"), (0, 2, "put", "b"), (1, 2, "delete", None), (2, 2, "put", "b"), (3, 1, "put", "c")], "seq long, object_id long, op string, digest string")
    got = {(r.reissue, r.object_id, r.op, r.digest) for r in history.reissued(log, [0, 2, 3]).collect()}
    assert got == {(0, 1, "put", "a"), (0, 2, "put", "b"), (1, 1, "put", "a"), (2, 1, "put", "c")}
    with pytest.raises(ValueError):
        history.reissued(log, [2, 1])


def test_stream_to_a_store(spark, tmp_path):
    from keyloom.sources.store import Store
    from keyloom.streaming.sink import write_stream

    kind = "object_id long, op string, kind int, payload binary"
    for k, rows in enumerate([[(1, "put", 1, b"a"), (2, "put", 1, b"b")], [(2, "delete", None, None), (3, "put", 1, b"c")]]):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        held = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        store = Store(spark, str(tmp_path / "store"))
        write_stream(held, store, str(tmp_path / "cp")).start().awaitTermination(120)
        assert store.sequences() == list(range(k + 1))
    assert {r.object_id for r in store.state().collect()} == {1, 3} and {r.object_id for r in store.state(0).collect()} == {1, 2}


def test_checked_ranges(spark):
    from pyspark.sql import functions as F

    from keyloom.functions.codec import checked_end, identity

    end = lambda a, b, n: spark.range(1).select(checked_end(F.lit(a).cast("long"), F.lit(b).cast("long"), F.lit(n).cast("long")).alias("e")).first().e
    assert end(3, 4, 7) == 7
    for bad in ((3, 5, 7), (-1, 1, 7), (2**63 - 1, 1, 2**63 - 1)):
        with pytest.raises(Exception, match="out of bounds"):
            end(*bad)
    assert len({r.i for r in spark.createDataFrame([("a",), ("b",)], "s string").select(identity(F.col("s")).alias("i")).collect()}) == 2


def test_minimizer_query_beyond_a_million(spark, tmp_path):
    """Keys whose packed scores run over into the next residue, and boundaries with the same last digits."""
    import duckdb

    from keyloom.plans import registry

    spark.range(3_000).unionByName(spark.range(998_000, 1_004_000)).unionByName(spark.range(9_000_000, 9_002_000)).selectExpr("id AS o_orderkey").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    got = registry.queries()["minimizer_partition"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(registry.oracle_sql()["minimizer_partition"]).fetchall())
