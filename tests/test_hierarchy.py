"""Hierarchies against a sequential walk, on random forests with circles."""

import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossierflow.operators import hierarchy as H
from dossierflow.operators.graph import search_with_ancestors
from dossierflow.plans.problems import problems
from tests.conftest import DATA, needs_data


def brute(rows):
    """(group, node) -> (root, depth, size, path, role) by walking up."""
    parent = {}
    for g, n, p, _ in sorted(rows, key=lambda r: r[3]):
        if n is not None and n.strip():
            parent[(g, n.strip())] = (p or "").strip()
    up = {k: ((k[0], p) if (k[0], p) in parent else None) for k, p in parent.items()}
    out, below = {}, {k: 0 for k in up}
    for k in up:
        seen, x = [], k
        while x is not None and x not in seen:
            seen.append(x)
            x = up[x]
        if x is not None:
            out[k] = ("", -1, -1, "", "on" if x == k else "below")
            continue
        for a in seen[1:]:
            below[a] += 1
        out[k] = (seen[-1][1], len(seen), None, "/".join(n for _, n in reversed(seen)), "none")
    return {k: (r, d, below[k] if role == "none" else s, p, role) for k, (r, d, s, p, role) in out.items()}


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "g string, n string, p string, t int")
    got = H.hierarchy(df, "g", "n", "p", [F.col("t")], **kw).collect()
    assert len({(r.grp, r.node) for r in got}) == len(got)
    return {(r.grp, r.node): (r.root_node, r.depth, r["size"], r.path, r.role) for r in got}


def forest(seed, n, groups=3):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        g = f"g{rnd.randrange(groups)}"
        p = rnd.choice([None, "", "  ", f"n{rnd.randrange(n)}", f" n{rnd.randrange(max(1, i))} ", "lost"])
        rows.append((g, f"n{i}", p, i))
    return rows


@pytest.mark.parametrize("seed,bound,partitions", [(1, 10**6, 4), (2, 3, 4), (3, 1, 7), (4, 10**6, 1)])
def test_random_forests(spark, seed, bound, partitions):
    rows = forest(seed, 120)
    assert run(spark, rows, bound=bound, partitions=partitions) == brute(rows)


def test_chain_and_star_and_circle(spark):
    chain = [("c", f"n{i}", f"n{i - 1}" if i else None, 0) for i in range(300)]
    star = [("s", "hub", None, 0)] + [("s", f"x{i}", "hub", 0) for i in range(200)]
    ring = [("r", f"k{i}", f"k{(i + 1) % 50}", 0) for i in range(50)] + [("r", "tail", "k3", 0), ("r", "self", "self", 0)]
    rows = chain + star + ring
    assert run(spark, rows, bound=5, partitions=6) == brute(rows)


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [("g", "a", None, 1), ("g", "a", "b", 2), ("g", "b", None, 1), ("g", " ", "a", 1), ("g", None, "a", 1), (None, "a", None, 1), (None, "b", "a", 1), ("g", "c", "a", 1)]
    got = run(spark, rows)
    assert got[("g", "a")] == ("b", 2, 1, "b/a", "none")  # the later delivery counts
    assert got[("g", "c")] == ("b", 3, 0, "b/a/c", "none")
    assert got[(None, "b")] == ("a", 2, 0, "a/b", "none")
    assert len(got) == 5
    df = spark.createDataFrame([(1, "g", "x", None, "z", "q")], "id int, grp string, node string, parent string, root string, path string")
    one = H.hierarchy(df, "grp", "node", "parent", [F.col("id")]).collect()
    assert [(r.grp, r.node, r.depth) for r in one] == [("g", "x", 1)]


def test_empty(spark):
    assert run(spark, []) == {}


def test_peeling_leaves_only_circles():
    ids = np.arange(6)
    pids = np.array([-1, 0, 1, 4, 3, 3])
    assert H._peel_locally(ids, pids, np.zeros(6, bool)).tolist() == [False, False, False, True, True, False]


def test_last_delivery_by_time(spark):
    df = spark.createDataFrame([("d", "a", "b", datetime(2024, 1, 2), 1), ("d", "a", "", datetime(2024, 1, 3), 2), ("d", "b", "", datetime(2024, 1, 1), 3)], "g string, n string, p string, t timestamp, id int")
    got = {r.node: r.depth for r in H.hierarchy(df, "g", "n", "p", [F.col("t"), F.col("id")]).collect()}
    assert got == {"a": 1, "b": 1}


def test_intervals_and_descendants(spark):
    rows = forest(9, 80)
    df = spark.createDataFrame(rows, "g string, n string, p string, t int")
    h = H.hierarchy(df, "g", "n", "p", [F.col("t")], partitions=5)
    nodes = [r for r in h.collect() if r.role == "none"]
    below = {(a.grp, a.node, b.node): b.depth - a.depth for a in nodes for b in nodes if a.grp == b.grp and b.path.startswith(a.path + "/")}
    by_interval = {(a.grp, a.node, b.node) for a in nodes for b in nodes if a.tour == b.tour and a.entry < b.entry <= a.entry + a["size"]}
    assert by_interval == set(below) and below
    got = {(r.grp, r.ancestor, r.node): r.distance for r in H.descendants(h, h.select("grp", "node")).collect()}
    assert got == below


def test_ids_that_hold_the_joiner(spark):
    links = {"a/b": None, "a": "a/b", "c/d/e": "a", "f": "c/d/e", "g": "a", "h": None}
    rows = [(g, n, p, 0) for g in ("x/y", None) for n, p in links.items()]
    h = H.hierarchy(spark.createDataFrame(rows, "g string, n string, p string, t int"), "g", "n", "p", [F.col("t")], partitions=3)
    below = {("a/b", "a", 1), ("a/b", "c/d/e", 2), ("a/b", "g", 2), ("a/b", "f", 3), ("a", "c/d/e", 1), ("a", "g", 1), ("a", "f", 2), ("c/d/e", "f", 1)}
    got = [tuple(r) for r in H.descendants(h, h.select("grp", "node")).select("grp", "ancestor", "node", "distance").collect()]
    assert len(got) == len(set(got)) and set(got) == {(g, *x) for g in ("x/y", None) for x in below}
    found = search_with_ancestors(h.where("role = 'none'"), h.where("node = 'f'"))
    assert sorted((str(r.grp), r.node) for r in found.collect()) == sorted((g, n) for g in ("x/y", "None") for n in ("a/b", "a", "c/d/e", "f"))


def test_intervals_as_blocks(spark):
    cases = [(a, b) for a in range(-20, 20) for b in range(a, 25)] + [(2**40 - 3, 2**40 + 5)]
    got = {c: [] for c in cases}
    for r in H.interval_blocks(spark.createDataFrame(cases, "a long, b long"), F.col("a"), F.col("b")).collect():
        got[r.a, r.b] += range(r.block << r.level, r.block + 1 << r.level)
    assert all(sorted(x) == list(range(a, b)) for (a, b), x in got.items())


@needs_data
def test_intervals_of_every_node(spark):
    q = problems.plans
    nodes = q["p2_intervals"](spark, str(DATA)).collect()
    found = {(r.doc_uuid, r.node_id): r for r in q["p2_found"](spark, str(DATA)).collect()}
    assert len(nodes) == len(found)
    tours = {}
    for r in nodes:
        assert (r.n_descendants, r.depth, r.cycle_role) == (found[r.doc_uuid, r.node_id].n_descendants, found[r.doc_uuid, r.node_id].depth, found[r.doc_uuid, r.node_id].cycle_role)
        if r.cycle_role == "none":
            tours.setdefault(r.tour, []).append(r)
    for rows in tours.values():
        for a in rows:
            below = {b.node_id for b in rows if a.entry < b.entry <= a.entry + a.n_descendants}
            path = found[a.doc_uuid, a.node_id].node_path + "/"
            assert below == {b.node_id for b in rows if found[b.doc_uuid, b.node_id].node_path.startswith(path)}
