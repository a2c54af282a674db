"""Walks against a plain depth-first walk, and copies of graphs."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.graph import EDGES, NODES, Graph
from graphloom.operators import traverse


def make(spark, rows, links):
    nodes = spark.createDataFrame([(g, i, [lab], None, "Value", None, None, v, [], ent, None, g, None, {}) for g, i, lab, v, ent in rows], NODES)
    return Graph(nodes, spark.createDataFrame([(g, a, b, lab, o, {}) for g, a, b, lab, o in links], EDGES))


def plain(rows, links, root, follow, stop_edge, stop_node):
    """(node, path) in order of a depth-first walk that comes to a node once."""
    facts, out, seen = {i: (lab, v, ent) for _, i, lab, v, ent in rows}, [], set()

    def visit(n, path):
        if n in seen:
            return True
        seen.add(n)
        out.append((n, path + [n]))
        if stop_node(facts[n]):
            return False
        for _, _, b, lab, _ in sorted((x for x in links if x[1] == n), key=lambda x: (x[4], x[2])):
            if stop_edge(lab, facts[b]):
                return False
            if follow(lab, facts[b]) and not visit(b, path + [n]):
                return False
        return True

    visit(root, [])
    return out


@pytest.mark.parametrize("seed", range(1))
def test_walks_equal_a_plain_one(spark, seed):
    rng = random.Random(seed)
    graphs, rows, links = {}, [], []
    for g in ("g", "h"):
        names = [f"{g}{k:02}" for k in range(12)]
        own = [(g, n, rng.choice("ABC"), rng.choice(["1", "2", None]), rng.choice([None, None, None, "E"])) for n in names]
        tree = [(g, names[rng.randrange(k)], names[k], rng.choice("xyz"), k) for k in range(1, 12)]
        more = [(g, *rng.sample(names, 2), rng.choice("xyz"), 100 + k) for k in range(5)]  # cross edges and cycles
        graphs[g] = (own, tree + more)
        rows += own
        links += tree + more
    graph = make(spark, rows, links)
    root = F.col("node_id").isin("g00", "h00")
    no = lambda *_: False
    cases = [
        ({}, lambda lab, f: True, no, no),
        ({"follow": F.col("label") != "z"}, lambda lab, f: lab != "z", no, no),
        ({"follow": F.col("to.labels")[0] != "A", "stop_node": F.col("to.value") == "2"}, lambda lab, f: f[0] != "A", no, lambda f: f[1] == "2"),
        ({"stop_edge": (F.col("label") == "y") & (F.col("to.labels")[0] == "B")}, lambda lab, f: True, lambda lab, f: lab == "y" and f[0] == "B", no),
        ({"in_entity": True}, lambda lab, f: f[2] is None, no, no),
    ]
    for given, follow, stop_edge, stop_node in cases:
        got = {"g": [], "h": []}
        for r in traverse.walk(graph, root, **given).orderBy("graph_id", "root_id", "place").collect():
            assert r.root_id == f"{r.graph_id}00" and r.level == len(r.path) - 1
            got[r.graph_id].append((r.node_id, r.path))
        assert got == {g: plain(*graphs[g], f"{g}00", follow, stop_edge, stop_node) for g in graphs}, given


def test_walks_up_and_without_roots(spark):
    graph = make(spark, [("g", n, "A", None, None) for n in "abcd"], [("g", "a", "b", "x", 0), ("g", "b", "c", "x", 0), ("g", "d", "c", "x", 1)])
    assert [r.node_id for r in traverse.walk(graph, F.col("node_id") == "c", up=True).orderBy("place").collect()] == ["c", "b", "a", "d"]
    assert traverse.walk(graph, F.lit(False)).collect() == []


def test_copies_have_selectors_changes_and_ids(spark):
    graph = make(spark, [("g", n, "A", n, None) for n in "abc"], [("g", "a", "b", "x", 0), ("g", "b", "c", "y", 0), ("g", "a", "c", "x", 1)])
    copy, ids = traverse.copied(graph, F.col("node_id") != "b", F.col("label") == "x", {"value": F.upper("value")}, {"label": F.lit("z")}, F.concat(F.lit("n"), "node_id"))
    assert sorted((r.node_id, r.value) for r in copy.nodes.collect()) == [("na", "A"), ("nc", "C")]
    assert [(r.src, r.dst, r.label) for r in copy.edges.collect()] == [("na", "nc", "z")]
    assert sorted((r.old_id, r.new_id) for r in ids.collect()) == [("a", "na"), ("c", "nc")]
    whole, _ = traverse.copied(graph)
    assert whole.nodes.count() == 3 and whole.edges.count() == 3
    with pytest.raises(ValueError, match="get the id"):
        traverse.copied(graph, new_id=F.lit("one"))
