"""Copy-on-write updates and plans against a plain tree in Python, and the published catalog of deletions."""

import random

import pytest

from keyloom.operators import cow, planning

SMALL = cow.Geometry(leaf=6, leaf_least=3, fanout=4, fanout_least=2)

# Leaves, children of the pages above, the id deleted; root levels, pages, touched, reused, written.
CATALOG = {
    "root-leaf": ([10], [], 5, (0, 0, 1, 1, 1, 0, 1)),
    "depth1-no-underflow": ([185, 122, 93], [[3]], 200, (1, 1, 4, 4, 2, 2, 2)),
    "depth1-borrow-left": ([94, 93], [[2]], 100, (1, 1, 3, 3, 3, 0, 3)),
    "depth1-borrow-right": ([93, 94], [[2]], 5, (1, 1, 3, 3, 3, 0, 3)),
    "depth1-merge-root-collapse": ([93, 93], [[2]], 100, (1, 0, 3, 1, 3, 0, 1)),
    "depth1-merge-keep-root": ([93, 93, 93], [[3]], 100, (1, 1, 4, 3, 3, 1, 2)),
    "depth2-recursive-internal-borrow": ([93, 93] + [185] * 255, [[128, 129], [2]], 5, (2, 2, 260, 259, 5, 255, 4)),
}


@pytest.mark.parametrize("name", CATALOG)
def test_published_deletions(spark, name):
    leaves, parents, object_id, want = CATALOG[name]
    new, report, path = cow.delete(cow.of_sizes(spark, leaves, parents), object_id)
    r = report.first()
    assert (r.source_root_level, r.result_root_level, r.source_pages, r.result_pages, r.touched_original, r.pages_reused, r.pages_written) == want
    assert new.entries.count() == sum(leaves) - 1 and new.pages.count() == r.result_pages
    assert cow.structure_violations(new).isEmpty() and cow.occupancy_violations(new).isEmpty()
    assert [x["level"] for x in path] == list(range(len(path)))


def pages_of(tree):
    """Leaves of ids and, level by level, the numbers of children, read from the tables."""
    leaf = {}
    for r in tree.entries.collect():
        leaf.setdefault(r.leaf, []).append(r.object_id)
    rows = tree.pages.collect()
    by = lambda lv: sorted((r for r in rows if r.level == lv), key=lambda r: r.min_id)
    return [sorted(leaf[r.page]) for r in by(0)], [[r.entry_count for r in by(lv)] for lv in range(1, max(r.level for r in rows) + 1)]


def plain_put(leaves, parents, ids, g):
    """The same by lists: a nested tree, updates routed by the first maximum that isn't less, overflow regrouped."""
    tree = [(leaf, leaf[-1]) for leaf in leaves]
    for sizes in parents:
        up, at = [], 0
        for n in sizes:
            up.append((tree[at : at + n], tree[at + n - 1][1]))
            at += n
        tree = up
    written = touched = 0

    def cut(items, most, least):
        out, at = [], 0
        for n in planning.group_sizes(len(items), most, least):
            out.append(items[at : at + n])
            at += n
        return out

    def rewrite(node, level, keys):
        nonlocal written, touched
        if not keys:
            return [node]
        touched += 1
        body = node[0]
        if level == 0:
            made = [(x, x[-1]) for x in cut(sorted(set(body) | set(keys)), g.leaf, g.leaf_least)]
        else:
            rest, children = list(keys), []
            for k, child in enumerate(body):
                mine = rest if k == len(body) - 1 else [x for x in rest if x <= child[1]]
                rest = [x for x in rest if x not in set(mine)]
                children += rewrite(child, level - 1, mine)
            made = [(x, x[-1][1]) for x in cut(children, g.fanout, g.fanout_least)]
        written += len(made)
        return made

    roots, level = rewrite(tree[0], len(parents), sorted(ids)), len(parents)
    while len(roots) > 1:
        roots = [(x, x[-1][1]) for x in cut(roots, g.fanout, g.fanout_least)]
        written += len(roots)
        level += 1
    flat, now = [], roots
    for _ in range(level):
        flat.insert(0, [len(x[0]) for x in now])
        now = [c for x in now for c in x[0]]
    return [x[0] for x in now], flat, touched, written


@pytest.mark.parametrize("seed", [1, 2])
def test_puts_against_a_plain_tree(spark, seed):
    rng = random.Random(seed)
    state = sorted(rng.sample(range(1, 400), 60))
    tree = cow.built(spark.createDataFrame([(k, f"d{k}") for k in state], "object_id long, digest string"), SMALL)
    for n in (1, 12, 40):
        ids = rng.sample(range(1, 600), n)
        leaves, parents = pages_of(tree)
        want = plain_put(leaves, parents, ids, SMALL)
        new, report = cow.put(tree, spark.createDataFrame([(k, f"n{n}") for k in ids], "object_id long, digest string"), SMALL)
        r = report.first()
        assert pages_of(new) == want[:2] and (r.touched_original, r.pages_written) == want[2:]
        assert r.pages_reused == tree.pages.count() - want[2]
        assert cow.structure_violations(new).isEmpty()
        held = {x.object_id: x.digest for x in new.entries.collect()}
        assert all(held[k] == f"n{n}" for k in ids)
        tree = new
    gone = sorted(held)[7]
    after, _, _ = cow.delete(tree, gone, SMALL, fuller=True)
    assert cow.structure_violations(after).isEmpty() and after.entries.count() == len(held) - 1


def test_updates_refuse(spark):
    tree = cow.of_sizes(spark, [3, 3], [[2]])
    with pytest.raises(KeyError):
        cow.delete(tree, 99, SMALL)
    with pytest.raises(ValueError):
        cow.put(tree, spark.createDataFrame([(1, "a"), (1, "b")], "object_id long, digest string"), SMALL)
    with pytest.raises(ValueError):
        cow.delete(cow.of_sizes(spark, [1], []), 1, SMALL)
    with pytest.raises(KeyError):
        cow.mixed(tree, spark.createDataFrame([(99, "delete", None)], "object_id long, op string, digest string"), SMALL)


def test_mixed_reuses_equal_pages_only(spark):
    tree = cow.built(spark.createDataFrame([(k, f"d{k}") for k in range(1, 61)], "object_id long, digest string"), SMALL)
    _, report = cow.mixed(tree, spark.createDataFrame([(60, "delete", None), (55, "put", "new")], "object_id long, op string, digest string"), SMALL)
    r = report.first()
    assert r.pages_written + r.pages_reused == r.result_pages and r.pages_reused >= 9


def test_leaf_plans():
    rows = [[1, 2, 3, 4, 6, 8], [10, 11, 12], [20, 21, 22]]
    plan = planning.leaf_plan(rows, [(5, "put"), (10, "delete"), (3, "put")], 6, 3)
    assert [a for a, *_ in plan["actions"]] == ["apply", "apply", "split", "merge_left"] and plan["touched"] == [0, 1]
    assert plan["leaves"] == [[1, 2, 3, 4], [5, 6, 8, 11, 12], [20, 21, 22]]
    assert planning.leaf_plan([[1, 2, 3, 4], [5, 6, 7]], [(5, "delete")], 6, 3)["leaves"] == [[1, 2, 3], [4, 6, 7]]
    assert planning.leaf_plan([[1, 2, 3], [4, 5, 6]], [(5, "delete")], 6, 3)["actions"][-1][0] == "merge_left"
    assert planning.leaf_plan([[1, 2, 3], [4, 5, 6]], [(1, "delete")], 6, 3)["leaves"] == [[2, 3, 4, 5, 6]]
    for ops in ([], [(1, "put"), (1, "put")], [(9, "delete")], [(k, "delete") for k in range(1, 7)]):
        with pytest.raises(planning.CannotPlan):
            planning.leaf_plan([[1, 2, 3], [4, 5, 6]], ops, 6, 3)
    # Short by two with a lending neighbour: one entry is borrowed, and the plan fails.
    with pytest.raises(planning.CannotPlan):
        planning.leaf_plan([[1, 2, 3, 4, 5], [6, 7, 8]], [(6, "delete"), (7, "delete")], 6, 3)


def test_tree_plans():
    leaves = [list(range(10 * k + 1, 10 * k + 4)) for k in range(4)]
    same = planning.tree_plan(leaves, [(1, "put")], 6, 3, 4, 2)
    assert (same["transition"], same["before"], same["touched_internal"], same["reused"]) == ("Stable", [4, 1], [[0]], [3, 0])
    more = planning.tree_plan(leaves, [(k, "put") for k in (4, 5, 6, 7)], 6, 3, 4, 2)
    assert (more["transition"], more["after"], more["reused"]) == ("Grew", [5, 2, 1], [3, 0, 0])
    less = planning.tree_plan([[1, 2, 3], [4, 5, 6]], [(1, "delete")], 6, 3, 4, 2)
    assert (less["transition"], less["after"]) == ("Collapsed", [1])
    assert planning.shape_of(9, 4, 2) == [[4, 3, 2], [3]]


def test_lookups_and_digests(spark):
    tree = cow.of_sizes(spark, [3] * 8, [[4, 4], [2]])
    shifted = cow.Tree(tree.entries.selectExpr("object_id * 10 AS object_id", "digest", "leaf"), tree.pages.selectExpr("level", "page", "min_id * 10 AS min_id", "max_id * 10 AS max_id", "entry_count", "parent"))
    got = {r.object_id: (r.found, r.pages_read) for r in cow.lookup(shifted, spark.createDataFrame([(k,) for k in (10, 15, 35, 125, 5, 999)], "object_id long")).collect()}
    assert got == {10: (True, 3), 15: (False, 3), 35: (False, 2), 125: (False, 1), 5: (False, 1), 999: (False, 1)}
    stored = cow.digests(tree).select("level", "page", "page_digest")
    assert cow.digest_violations(tree, stored).isEmpty()
    wrong = stored.selectExpr("level", "page", "CASE WHEN level = 0 AND page = 2 THEN 'x' ELSE page_digest END AS page_digest")
    assert [(r.level, r.page) for r in cow.digest_violations(tree, wrong).collect()] == [(0, 2)]


def test_dispatch(spark):
    tree = cow.of_sizes(spark, [4, 4, 4], [[3]])
    ops = lambda *rows: spark.createDataFrame(list(rows), "object_id long, op string, digest string")
    modes = {cow.update(tree, ops(*rows), SMALL)[1].first().mode for rows in ([(3, "delete", None)],)}
    assert modes == {"delete"}
    assert cow.update(tree, ops((3, "put", "x")), SMALL)[1].first().mode == "replacements"
    assert cow.update(tree, ops((99, "put", "x")), SMALL)[1].first().mode == "single_insert"
    assert cow.update(tree, ops((99, "put", "x"), (3, "delete", None)), SMALL)[1].first().mode == "canonical_mixed"
    with pytest.raises(ValueError):
        cow.update(tree, ops((1, "put", "x")).limit(0), SMALL)


def test_lookup_query_counts_root_and_leaf(spark, tmp_path):
    """With more leaves than the root has room for, as in the SQL: the pages between don't count."""
    import duckdb

    from keyloom.plans import registry

    spark.range(60_000).selectExpr("id AS o_orderkey").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(0, 8_000, 7).selectExpr("id AS p_partkey").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    for t in ("orders", "part"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = registry.queries()["authenticated_lookup"](spark, str(tmp_path)).collect()
    want = con.sql(registry.oracle_sql()["authenticated_lookup"]).fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and {r.pages_read for r in got} == {1, 2}
    tree = cow.of_sizes(spark, [3] * 8, [[4, 4], [2]])
    whole = {r.object_id: (r.pages_read, r.in_leaf) for r in cow.lookup(tree, spark.createDataFrame([(1,), (24,), (99,)], "object_id long")).collect()}
    assert whole == {1: (3, True), 24: (3, True), 99: (1, False)}


def test_routing_in_one_pass(spark):
    """Routed by the first maximum that isn't less, most ids beyond all of them; no frame that is gone through again for each row."""
    import bisect
    import io
    from contextlib import redirect_stdout

    rng = random.Random(5)
    tops = sorted(rng.sample(range(10_000), 300))
    leaves = spark.createDataFrame([(k, top) for k, top in enumerate(tops)], "page long, max_id long")
    ids = [*tops, 0, *(rng.randrange(40_000) for _ in range(3_000))]
    got = cow.routed(spark.createDataFrame([(k,) for k in ids], "object_id long"), leaves)
    assert sorted((r.object_id, r.leaf) for r in got.collect()) == sorted((k, min(bisect.bisect_left(tops, k), 299)) for k in ids)
    shown = io.StringIO()
    with redirect_stdout(shown):
        got.explain()
    assert "unboundedfollowing" not in shown.getvalue().lower()
    assert {r.leaf for r in cow.routed(got.select("object_id"), leaves.limit(0)).collect()} == {None}
