"""Updating clauses of openCypher."""

import pytest

from graphloom.graph import EDGES, NODES, Graph
from graphloom.plans import cypher
from graphloom.plans.updates import update, updates


@pytest.fixture(scope="module")
def graph(spark):
    rows = [("g", "a", ["X"], "1", {"p": ["u"]}), ("g", "b", ["X"], "2", {}), ("h", "c", ["Y"], "3", {})]
    nodes = spark.createDataFrame([(g, i, labels, None, "Value", None, None, v, [], None, None, None, None, p) for g, i, labels, v, p in rows], NODES)
    return Graph(nodes, spark.createDataFrame([("g", "a", "b", "k", 0, {"n": [n]}) for n in "12"], EDGES))


def nodes(g):
    return sorted((r.graph_id, r.node_id if r.node_id[0] != "_" else "new", tuple(r.labels), r.value, tuple(sorted((k, v[0]) for k, v in r.props.items()))) for r in g.nodes.collect())


def edges(g):
    return sorted((r.src if r.src[0] != "_" else "new", r.dst if r.dst[0] != "_" else "new", r.label, tuple(sorted((k, v[0]) for k, v in r.props.items()))) for r in g.edges.collect())


A, B, C = ("g", "a", ("X",), "1", (("p", "u"),)), ("g", "b", ("X",), "2", ()), ("h", "c", ("Y",), "3", ())
E = [("a", "b", "k", (("n", "1"),)), ("a", "b", "k", (("n", "2"),))]


def test_properties_and_labels(graph):
    out = update(graph, "MATCH (n:X) WHERE n.value = 1 SET n.value = n.value + 1, n.q = 'v', n:Z REMOVE n.p")
    assert nodes(out) == [("g", "a", ("X", "Z"), "2.0", (("q", "v"),)), B, C] and edges(out) == E
    out = update(graph, "MATCH (n:X) REMOVE n:X SET n.p = null")
    assert nodes(out) == [("g", "a", (), "1", ()), ("g", "b", (), "2", ()), C]
    out = update(graph, "MATCH (a)-[r {n: '2'}]->(b) SET r.n = '9', r.w = b.value")
    assert edges(out) == [E[0], ("a", "b", "k", (("n", "9"), ("w", "2")))]
    with pytest.raises(Exception, match="more than one value for p"):
        update(graph, "MATCH (a)-[r]->(b) SET a.p = r.n")


def test_created_and_merged(graph):
    out = update(graph, "MATCH (n:X) CREATE (n)-[:has {t: 'x'}]->(m:New {value: n.value, z: 'y'})")
    assert [x for x in nodes(out) if x[1] == "new"] == [("g", "new", ("New",), v, (("z", "y"),)) for v in "12"]
    assert [x for x in edges(out) if x[2] == "has"] == [("a", "new", "has", (("t", "x"),)), ("b", "new", "has", (("t", "x"),))]
    out = update(graph, "CREATE (m:One)")
    assert [x[0] for x in nodes(out) if x[1] == "new"] == ["g", "h"]  # in every graph
    again = "MATCH (a:X), (b:X) WHERE a.value = '1' AND b.value = '2' MERGE (a)-[:k {n: '2'}]->(b)"
    assert edges(update(graph, again)) == E
    assert edges(update(graph, again.replace("'2'}", "'3'}"))) == [*E, ("a", "b", "k", (("n", "3"),))]
    out = update(graph, "MATCH (n:X) MERGE (s:Sum {of: 'all'}) MERGE (s)-[:has]->(n)")
    assert [x for x in nodes(out) if x[1] == "new"] == [("g", "new", ("Sum",), None, (("of", "all"),))]
    assert [x for x in edges(out) if x[0] == "new"] == [("new", "a", "has", ()), ("new", "b", "has", ())]
    assert nodes(update(out, "MATCH (n:X) MERGE (s:Sum {of: 'all'})")) == nodes(out)


def test_deleted(graph):
    assert edges(update(graph, "MATCH (a)-[r {n: '1'}]->(b) DELETE r")) == [E[1]]
    with pytest.raises(cypher.QueryError, match="has edges"):
        update(graph, "MATCH (n:X) DELETE n")
    out = update(graph, "MATCH (n:X) WHERE n.value = '1' DETACH DELETE n")
    assert nodes(out) == [B, C] and edges(out) == []
    assert nodes(update(graph, "MATCH (a)-[r]->(b) DELETE r, b")) == [A, C]


def test_texts():
    assert updates("MATCH (n) SET n.a = 1") and not updates("MATCH (n) WHERE n.a = 'SET x' RETURN n")
    for bad in ("MATCH (n)", "MATCH (n) SET n.a", "MATCH (n) CREATE (n)-[:a|b]->(m) RETURN n"):
        with pytest.raises(cypher.QueryError):
            update(None, bad)
