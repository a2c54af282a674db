"""What steps write, sort and ask for, so that they grow no faster than their input."""

import pytest
from pyspark.sql import functions as F

from graphloom import queries, storage
from graphloom.fixtures import compiled
from graphloom.operators import links, measures, reshape, valueset
from graphloom.plans import cypher, pipeline, updates
from graphloom.sinks import exports
from graphloom.sources import documents, tables

TINY = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


@pytest.fixture
def merged(spark):
    """Sort-merge joins only, as in large tables."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_numbering_edges_sorts_nothing(spark):
    out = cypher.run(queries.customers(spark, TINY), "match (a {schemaNodeId:'Customer/key'})<-[]-()-[]->(n {schemaNodeId:'Customer/segment'}) return a.value as k, n.value as s")
    assert "Window" not in plan(out)
    assert out.count() == 150


def test_a_table_of_roots_is_sorted_once_after_its_join(merged):
    text = plan(exports.to_table(queries.customers(merged, TINY), ["c_name"])).split("== Physical Plan ==")[1]
    assert text.count("Sort [") == 3


def test_value_sets_write_a_graph_once(spark, monkeypatch):
    rows, real = [], valueset.written
    monkeypatch.setattr(valueset, "written", lambda df: (out := real(df), rows.append((len(out.columns), out.count())))[0])
    g = queries.orders(spark, TINY)
    whole = len(g.nodes.columns), g.nodes.count()
    out = valueset.process(g, valueset.entries_table(spark, valueset.load(queries.PRIORITIES)))
    assert out.instances("Order/code").count() == 1500
    assert [r for r in rows if r[1] >= whole[1]] == [whole]


def test_keys_of_one_part_meet_nowhere(spark, monkeypatch):
    monkeypatch.setattr(links, "foreign_keys", lambda *a: pytest.fail("values of one key attribute are gathered"))
    g = queries.both(spark, TINY, "Order")
    assert links.matched(g, links.link_specs(g.layer)[0]).count() == 1500


def test_updates_write_nodes_once_for_a_clause(spark, monkeypatch):
    n, real = [], updates.written
    monkeypatch.setattr(updates, "written", lambda df: (n.append("node_id" in df.columns and "_row" not in df.columns), real(df))[1])
    g = updates.update(queries.customers(spark, TINY), "MATCH (c:Customer) SET c.a = '1', c.b = '2', c:Seen")
    assert sum(n) == 2  # the graph's, and those after the clause
    n.clear()
    g = updates.update(g, "MATCH (c:Seen) SET c.d = '3'", held=True)
    assert sum(n) == 1
    props = g.instances("Customer").select(F.map_from_entries(F.array_sort(F.map_entries("props"))).alias("p")).first()["p"]
    assert props == {"a": ["1"], "b": ["2"], "d": ["3"]}


def test_units_are_sorted_once_after_their_join(merged):
    g = queries.sizes(merged, TINY, "PartUnit")
    text = plan(measures.find_measures(g, queries.compiled("PartUnit").find("PartUnit/measure"))).split("== Physical Plan ==")[1]
    assert "REPARTITION_BY_COL" in text and "partial_max" not in text.split("REPARTITION_BY_COL")[1].split("Exchange")[0]


def written_rows(monkeypatch) -> list:
    n, real = [], storage.written
    monkeypatch.setattr(storage, "written", lambda df: (n.append(df.columns), real(df))[1])
    return n


def same(a, b) -> bool:
    return sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_an_ingestion_is_run_once_for_nodes_and_edges(spark, monkeypatch):
    n = written_rows(monkeypatch)
    lazy = queries.conversations(spark, TINY)
    for g in (lazy, lazy.global_scope()):
        n.clear()
        held = g.held()
        assert len(n) == 1
        assert same(held.nodes, g.nodes) and same(held.edges, g.edges)
    n.clear()
    g = lazy.with_(nodes=lazy.nodes.where("type = 'Value'"))
    assert same(g.held().nodes, g.nodes) and len(n) == 2


def test_joined_csv_is_ingested_once_for_nodes_and_edges(spark, monkeypatch):
    n = written_rows(monkeypatch)
    rows = spark.createDataFrame([(0, 1, 7, 1, 5), (1, 1, 7, 2, 6), (2, 2, 8, 1, 5)], "_row long, o_orderkey long, o_custkey long, l_linenumber long, l_partkey long")
    parts = [tables.JoinedEntity(compiled("Order"), ("o_orderkey", "o_custkey"), ("o_orderkey",)), tables.JoinedEntity(compiled("Line"), ("l_linenumber", "o_orderkey", "l_partkey"), ("o_orderkey", "l_linenumber"))]
    g = tables.ingest_joined(rows, parts, link_all=False)
    held = g.held()
    assert len(n) == 1
    assert same(held.nodes, g.nodes) and same(held.edges, g.edges)
    assert held.nodes.where("entity_schema IS NOT NULL").groupBy("schema_node_id").count().orderBy("schema_node_id").collect() == [("Line", 3), ("Order", 2)]


def test_ends_of_a_subgraph_are_not_broadcast(spark):
    g = queries.customers(spark, TINY).subgraph("schema_node_id <> 'Customer/name'")
    assert "Broadcast" not in plan(g.edges)
    assert g.edges.count() == 300


def test_found_value_nodes_are_not_broadcast(spark):
    out = queries.QUERIES["MS2_measure_values_by_query"](spark, TINY)
    assert "Broadcast" not in plan(out)


def test_reshaping_with_instances_broadcasts_nothing(spark, monkeypatch):
    plans, real = [], storage.written
    for module in (reshape, exports):
        monkeypatch.setattr(module, "written", lambda df: (plans.append(plan(df)), real(df))[1])
    out = queries.QUERIES["TX1_repeated_objects"](spark, TINY)
    assert len(plans) > 2 and not [p for p in plans if "Broadcast" in p]
    assert out.count() == spark.read.parquet(f"{TINY}/conversations.parquet").select("conv_id").distinct().count()


def test_cutting_by_quotes_is_cutting_by_marks(monkeypatch):
    texts = ['{"a":"}\\\\\\""}[1]', '{"a', '":[', ' ]}', '"x" 1', "}", "[", '{"b":"é\\\\"}', "", '\\"{"', " "]
    lines = [[texts[(k // 11**i) % 11] for i in range(1 + k % 4)] for k in range(0, 11**4, 7)]
    for size in (0, 1 << 20):
        monkeypatch.setattr(documents, "CHUNK", size)
        got = [(documents._change(iter(x)), [list(documents._cut(iter(x), d)) for d in (0, 2)]) for x in lines]
        with monkeypatch.context() as m:
            m.setattr(documents, "_brackets", lambda text: None)
            assert got == [(documents._change(iter(x)), [list(documents._cut(iter(x), d)) for d in (0, 2)]) for x in lines]


def test_graphs_of_files_are_parsed_once(spark, monkeypatch, tmp_path):
    n, real = [], pipeline.written
    monkeypatch.setattr(pipeline, "written", lambda df: (n.append(plan(df).split("== Physical Plan ==")[1]), real(df))[1])
    texts = exports.to_graph_json(queries.customers(spark, TINY)).select(F.col("json").alias("t"))
    path = queries.streamed(spark, texts, 25)
    g = pipeline.run([{"operation": "readGraph", "params": {"path": path}}], pipeline.Context(spark)).graph
    assert "parseJson" in n[0] and "parseJson" not in plan(g.nodes) + plan(g.edges)
    assert (g.nodes.count(), g.edges.count()) == (600, 450)


def test_lines_and_files_of_documents_grow_in_number_not_in_length(spark, monkeypatch):
    monkeypatch.setattr(queries, "FILE_BYTES", 100_000, raising=False)
    texts = spark.range(20_000).select(F.to_json(F.struct("id")).alias("t"))
    path = queries.streamed(spark, texts, 5)
    read = spark.read.text(path)
    assert read.agg(F.max(F.length("value"))).first()[0] < 1400 * 12
    assert len(read.inputFiles()) == 1 + texts.agg(F.sum(F.length("t"))).first()[0] // 100_000
    assert documents.json_documents(spark, path).select("document").distinct().count() == 20_000
