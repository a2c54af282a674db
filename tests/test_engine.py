"""Operators on small fixtures: edge cases that the tables do not hold."""

import json
from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.fixtures import flat_schema
from graphloom.functions import types, validators
from graphloom.graph import Graph, edge_columns, node_columns
from graphloom.operators import entities, links, measures, reshape, valueset
from graphloom.operators.ingest import errors, ingest_json, ingest_rows, json_items
from graphloom.plans import cypher, pipeline
from graphloom.schema import Attribute, Layer, SchemaError, compile_schema, compose, layer_from_json
from graphloom.schema.bundle import Bundle, find_variant
from graphloom.schema.jsonschema import import_json_schema
from graphloom.sinks import exports
from graphloom.sources import graphs, tables, xml


def layer(name, attributes, load=lambda ref: None, **root):
    return compile_schema(layer_from_json(flat_schema(name, attributes, **root)), load)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_ragged_csv_open_and_closed(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('f1, f2 ,f3\n d1 ,d2,\n"x, ""y""",d4\n,,\n')
    df = tables.read_csv(spark, str(path))
    own = layer("T", {"a": "f1", "b": "f2"})
    closed = tables.ingest_csv(df, own, only_schema=True)
    values = {(r.node_id, r.value) for r in closed.nodes.where("type = 'Value'").collect()}
    assert values == {("row_1.f1", "d1"), ("row_1.f2", "d2"), ("row_2.f1", 'x, "y"'), ("row_2.f2", "d4")}
    more = layer("T", {"a": "f1"})
    opened = tables.ingest_csv(df, more)
    assert {(r.attribute_name, r.value) for r in opened.nodes.where("schema_node_id IS NULL").collect()} == {("f2", "d2"), ("f2", "d4")}
    assert all(r.source.endswith("#" + r.node_id.split("_")[1][0]) for r in closed.nodes.collect())


def test_csv_write_round_trip(spark, tmp_path):
    data = [("1", "a"), ("2", "e"), ("3", "i")]
    g = ingest_rows(spark.createDataFrame(data, "v string, w string"), layer("W", {"v": "v", "w": "w"}), F.col("v"))
    exports.write_csv(exports.to_table(g, ["v", "w"]).coalesce(1), str(tmp_path / "out"))
    assert rows(spark.read.option("header", True).csv(str(tmp_path / "out"))) == data


VISITS = [("ada", "2001", "knee", "x-ray"), ("ada", "2001", "knee", "rest"), ("ada", "2001", "", ""), ("ada", "2002", "eye", "drops"), ("bob", "2002", "eye", "drops"), ("ada", "2003", "ear", "none")]


def _joined(spark, data=None, **more):
    names = ["who", "year", "part", "care"]
    df = tables.with_row_index(spark.createDataFrame(VISITS if data is None else data, ", ".join(f"{n} string" for n in names)).coalesce(1))
    entity = lambda n, cols, ids, *some: tables.JoinedEntity(layer(n, {c: c for c in cols}), tuple(cols), tuple(ids), some)
    return tables.ingest_joined(df, [entity("Patient", ["who"], ["who"]), entity("Visit", ["year", "part"], ["who", "year", "part"], "part"), entity("Care", ["care"], names, "care")], **more)


def test_joined_csv_is_cut_at_changes_of_the_first_entity(spark):
    roots = _joined(spark).nodes.where("entity_schema IS NOT NULL").groupBy("graph_id", "schema_node_id").count()
    assert rows(roots) == [("0/row_0", "Care", 3), ("0/row_0", "Patient", 1), ("0/row_0", "Visit", 2), ("0/row_4", "Care", 1), ("0/row_4", "Patient", 1), ("0/row_4", "Visit", 1), ("0/row_5", "Care", 1), ("0/row_5", "Patient", 1), ("0/row_5", "Visit", 1)]
    named = _joined(spark, id_template="{{.columns.who}}-{{.dataIndex}}", start_row=0).nodes.select("graph_id").distinct()
    assert rows(named) == [("0/ada-0",), ("0/ada-5",), ("0/bob-4",)]
    assert _joined(spark, []).nodes.count() == 0


def test_runs_reach_over_blocks(spark, monkeypatch):
    import itertools
    import random

    monkeypatch.setattr(tables, "BLOCK_ROWS", 4)
    rng = random.Random(2)
    keys = [k for k in "abcabacbca" for _ in range(rng.choice((1, 2, 3, 9, 14)))]
    df = spark.createDataFrame([(i * 2, k, f) for f in ("x", "y") for i, k in enumerate(keys)], "_row long, k string, _part string").repartition(3)
    got = {(r._part, r._row): r._first for r in tables._runs(df, F.col("k"), "_row").collect()}
    want, at = {}, 0
    for _, group in itertools.groupby(keys):
        n = len(list(group))
        want |= {(f, 2 * (at + j)): 2 * at for f in ("x", "y") for j in range(n)}
        at += n
    assert got == want


def test_joined_csv_step_takes_all_parameters(spark, tmp_path):
    text = "a title\nwho;year;n\nskipped;0;0\nada;2001;1\nada;2002;2\nbob;2003;3\nlast;2004;4\n"
    (tmp_path / "v.csv").write_text(text)
    entities_ = [{"layer": layer("Patient", {"who": "who"}), "cols": [0], "idCols": [0]}, {"layer": layer("Visit", {"year": "year", "n": "n"}), "cols": [1, 2], "idCols": [0, 1], "any": [2]}]
    params = {"path": str(tmp_path / "v.csv"), "headerRow": 1, "startRow": 3, "endRow": 5, "delimiter": ";", "id": "g{{.rowIndex}}", "entities": entities_}
    g = pipeline.run([{"operation": "ingest/csv/join", "params": params}], pipeline.Context(spark)).graph
    got = g.nodes.where("value IS NOT NULL").select(F.element_at(F.split("graph_id", "/"), -1).alias("g"), "value")
    assert rows(got) == [("g3", "1"), ("g3", "2"), ("g3", "2001"), ("g3", "2002"), ("g3", "ada"), ("g5", "2003"), ("g5", "3"), ("g5", "bob")]


CONTACT = flat_schema("Contact", {"type": "type", "value": "value"})
PERSON = {"@id": "Person/s", "@type": "Schema", "valueType": "Person", "layer": {"@id": "Person", "@type": "Object", "attributeList": [
    {"@id": "Person/first", "@type": "Value", "attributeName": "firstName"},
    {"@id": "Person/contact", "@type": "Array", "attributeName": "contact", "arrayElements": {"@id": "Person/contact/items", "@type": "Reference", "ref": "Contact"}}]}}
DOC = {"firstName": "John", "extra": "true", "contact": [{"type": "cell", "value": "1"}, {"type": "work", "value": "2"}]}


def person():
    return compile_schema(layer_from_json(PERSON), lambda r: layer_from_json(CONTACT))


def test_json_round_trip_and_open_content(spark):
    df = spark.createDataFrame([("d", json.dumps(DOC))], "g string, j string")
    out = exports.to_json(ingest_json(df, person(), "j", F.col("g")), "Person").first().json
    assert json.loads(out) == DOC
    closed = exports.to_json(ingest_json(df, person(), "j", F.col("g"), only_schema=True), "Person").first().json
    assert json.loads(closed) == {k: v for k, v in DOC.items() if k != "extra"}


def test_json_odd_documents(spark):
    df = spark.createDataFrame([("a", None), ("b", ""), ("c", "[1]"), ("d", '{"firstName":{"x":1},"contact":5}'), ("e", '{"firstName":null}'), ("f", "{}")], "g string, j string")
    g = ingest_json(df, person(), "j", F.col("g"))
    assert {r.graph_id for r in g.nodes.collect()} == {"d", "e", "f"}
    found = {(r.graph_id, r.node_id) for r in errors(json_items(df, person(), "j", F.col("g"))).collect()}
    assert found == {("b", "b"), ("c", "c"), ("d", "d.firstName"), ("d", "d.contact")}
    assert ingest_json(df.limit(0), person(), "j", F.col("g")).nodes.count() == 0


def test_polymorphic_needs_one_option(spark):
    option = lambda n, v: {"@id": f"P/{n}", "@type": "Object", "attributeList": [{"@id": f"P/{n}/t", "@type": "Value", "attributeName": "t", "enumeration": v}]}
    own = compile_schema(layer_from_json({"@id": "P/s", "@type": "Schema", "valueType": "P", "layer": {"@id": "P", "@type": "Object", "attributeList": [{"@id": "P/f", "@type": "Polymorphic", "attributeName": "f", "oneOf": [option("1", ["a", "both"]), option("2", ["b", "both"])]}]}}))
    df = spark.createDataFrame([(t, json.dumps({"f": {"t": t}})) for t in ("a", "b", "both", "none")], "g string, j string")
    g = ingest_json(df, own, "j", F.col("g"))
    assert rows(g.nodes.where("attribute_name = 't'").select("graph_id", "schema_node_id")) == [("a", "P/1/t"), ("b", "P/2/t")]
    assert {r.graph_id for r in errors(json_items(df, own, "j", F.col("g"))).collect()} == {"both", "none"}


def test_xml_shapes(spark):
    own = compile_schema(layer_from_json({"@id": "X/s", "@type": "Schema", "valueType": "X", "layer": {"@id": "X", "@type": "Object", "attributeList": [
        {"@id": "X/f", "@type": "Value", "attributeName": "f", "xmlvalueAttr": "value"}, {"@id": "X/n", "@type": "Array", "attributeName": "n", "arrayElements": {"@id": "X/n/e", "@type": "Value", "attributeName": "e"}},
        {"@id": "X/q", "@type": "Value", "attributeName": "q", "xmlns": "urn:q"}]}}))
    text = '<r xmlns:z="urn:q"><f value="v1"/><n>\n <e> a </e>\n<e>b</e></n><z:q>in</z:q><q>out</q><k whiteSpace="preserve"> s </k></r>'
    df = spark.createDataFrame([("g", text), ("bad", "<r>"), ("null", None)], "g string, x string")
    g = xml.ingest_xml(df, own, "x", F.col("g"))
    got = {(r.schema_node_id, r.attribute_name, r.value) for r in g.nodes.where("type = 'Value'").collect()}
    assert got == {("X/f", "f", "v1"), ("X/n/e", "e", "a"), ("X/n/e", "e", "b"), ("X/q", "q", "in"), (None, "q", "out"), (None, None, " s ")}
    assert {r.graph_id for r in xml.xml_errors(df, own, "x", F.col("g")).collect()} == {"bad", "null"}


def test_graph_json_nested_and_top_edges(spark):
    text = json.dumps({"nodes": [{"n": 0, "labels": ["ns/A"], "properties": {"ns/value": "v", "ns/tags": ["x", "y"]}, "edges": [{"to": 1, "label": "ns/has"}]}, {"n": 1, "labels": ["B"]}], "edges": [{"from": 1, "to": 0, "label": "back"}]})
    g = graphs.read_graphs(spark.createDataFrame([("g", text), ("h", "nope")], "g string, j string"), "j", F.col("g"), "ns/")
    first = g.nodes.where("node_id = '0'").first()
    assert (first.labels, first.value, first.props) == (["A"], "v", {"tags": ["x", "y"]})
    assert rows(g.edges.select("src", "dst", "label")) == [("0", "1", "has"), ("1", "0", "back")]


def test_links_by_reference_and_composite_keys(spark):
    a = layer("A", {"x": "x", "y": "y"}, entityIdFields=["A/x", "A/y"])
    b = layer("B", {"id": "id", "p": "p", "q": "q", "ref": {"@type": "Reference", "ref": "A", "fk": ["B/p", "B/q"], "dir": "to", "label": "is", "ingestAs": "edge"}}, load=lambda r: a, entityIdFields=["B/id"])
    ga = ingest_rows(spark.createDataFrame([("1", "2"), ("12", "")], "x string, y string"), a, F.concat(F.lit("a"), "x"))
    gb = ingest_rows(spark.createDataFrame([("7", "1", "2"), ("8", "1", "3"), ("9", None, None)], "id string, p string, q string"), b, F.concat(F.lit("b"), "id"))
    g = links.link(ga.global_scope().union(gb.global_scope()).with_(layer=b))
    assert rows(g.edges.where("label = 'is'").select("src", "dst")) == [("b7|b7", "a1|a1")]


def test_link_to_one_is_enforced(spark):
    a = layer("A", {"x": "x"}, entityIdFields=["A/x"])
    b = layer("B", {"p": {"attributeName": "p", "referenceFKFor": "A", "dir": "to", "referenceLabel": "is", "multi": "false"}})
    ga = ingest_rows(spark.createDataFrame([("1", "k"), ("1", "l")], "x string, n string"), a, F.col("n"))
    gb = ingest_rows(spark.createDataFrame([("1",)], "p string"), b, F.lit("b"))
    with pytest.raises(Exception, match="more than one target"):
        links.link(ga.global_scope().union(gb.global_scope()).with_(layer=b)).edges.collect()


def test_duplicate_entities_collapse(spark):
    own = layer("Lab", {"id": "id", "v": "v"}, entityIdFields=["Lab/id"])
    g = ingest_rows(spark.createDataFrame([("123", "a"), ("123", "b"), ("124", "c"), (None, "d")], "id string, v string"), own, F.col("v")).global_scope()
    kept = entities.consolidate(g, "Lab")
    assert rows(kept.instances("Lab").select("node_id")) == [("a|a",), ("c|c",), ("d|d",)]
    assert kept.edges.count() == 5 and kept.instances("Lab/v").count() == 3


def test_consolidation_loses_nothing(spark):
    """Values that only a loser has, nested entities below losers, parallel edges and their properties."""
    one = lambda **x: node_columns(graph_id="g", **x)
    root = lambda i, e: spark.range(1).select(*one(node_id=i, labels=F.array(F.lit("P")), type="Object", schema_node_id="P", entity_schema="P/s", entity_id=F.array(F.lit(e)), entity_root_id=i))
    value = lambda i, r, n, v: spark.range(1).select(*one(node_id=i, type="Value", schema_node_id=n, attribute_name=n, value=v, entity_root_id=r))
    parts = [root("p2", "A"), root("p10", "A"), root("p11", "A"), root("q", "B"), value("p2.n", "p2", "n", "kept"), value("p10.n", "p10", "n", "other"), value("p10.x", "p10", "x", "first"), value("p11.x", "p11", "x", "second")]
    parts += [spark.range(1).select(*one(node_id="p11.e", type="Object", schema_node_id="E", entity_schema="E/s", entity_root_id="p11.e")), value("p11.e.v", "p11.e", "v", "deep")]
    nodes = reduce(DataFrame.unionByName, parts)
    ends = [("p2", "p2.n", "has", ""), ("p10", "p10.n", "has", ""), ("p10", "p10.x", "has", ""), ("p11", "p11.x", "has", ""), ("p11", "p11.e", "has", ""), ("p11.e", "p11.e.v", "has", ""), ("q", "p10", "knows", "1"), ("q", "p10", "knows", "2"), ("q", "p2", "knows", "3"), ("p11", "q", "owes", "4")]
    edges = spark.createDataFrame(ends, "src string, dst string, label string, w string").select(*edge_columns(graph_id="g", src=F.col("src"), dst=F.col("dst"), label=F.col("label"), props=F.create_map(F.lit("w"), F.array("w"))))
    out = entities.consolidate(Graph(nodes, edges), "P")
    assert rows(out.nodes.select("node_id", "entity_root_id")) == [("p10.x", "p2"), ("p11.e", "p11.e"), ("p11.e.v", "p11.e"), ("p2", "p2"), ("p2.n", "p2"), ("q", "q")]
    got = rows(out.edges.select("src", "dst", "label", F.col("props")["w"][0].alias("w")))
    assert got == [("p11.e", "p11.e.v", "has", ""), ("p2", "p10.x", "has", ""), ("p2", "p11.e", "has", ""), ("p2", "p2.n", "has", ""), ("p2", "q", "owes", "4"), ("q", "p2", "knows", "1"), ("q", "p2", "knows", "2"), ("q", "p2", "knows", "3")]


def _chain(spark, n, back=False):
    ids = [f"n{k:02d}" for k in range(n)]
    nodes = reduce(DataFrame.unionByName, [spark.createDataFrame([(i,) for i in ids], "i string").select(*node_columns(graph_id="g", node_id=F.col("i"), type="Object"))])
    ends = list(zip(ids, ids[1:])) + ([(ids[-1], ids[0])] if back else [])
    return Graph(nodes, spark.createDataFrame(ends, "s string, d string").select(*edge_columns(graph_id="g", src=F.col("s"), dst=F.col("d"), label="to")))


def test_long_paths_are_followed_to_their_end(spark):
    g = _chain(spark, 13)
    count = lambda g, steps: cypher.run(g, f"match (a {{nodeId:'n00'}})-[:to*{steps}]->(b) return count(b) as n").first().n
    assert [count(g, s) for s in ("", "8..", "0..", "2..3", "20..", "12..12")] == [12, 5, 13, 2, 0, 1]
    assert count(_chain(spark, 5, back=True), "") == 5  # once around: no edge stands twice in a way
    below = entities.descendants(g, F.col("node_id") == "n00")
    assert below.agg(F.max("level"), F.count("*")).first()[:] == (12, 13)
    assert entities.descendants(_chain(spark, 4, back=True), F.col("node_id") == "n00").count() == 4
    assert entities.ancestors(g, F.col("node_id") == "n12", 3).count() == 4


def test_patterns_apart_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(cypher, "MOST_APART", 5)
    text = "match (a {nodeId:'n00'}), (b) return count(b) as n"
    assert cypher.run(_chain(spark, 5), text).first().n == 5
    with pytest.raises(Exception, match="more than 5 nodes"):
        cypher.run(_chain(spark, 6), text).collect()


def test_deep_documents(spark):
    def nested(k):
        return {"@id": f"D/{k}", "@type": "Object", "attributeName": "d", "attributeList": [nested(k + 1)]} if k < 12 else {"@id": f"D/{k}", "@type": "Value", "attributeName": "d"}

    deep = compile_schema(layer_from_json({"@id": "D/s", "@type": "Schema", "valueType": "D", "layer": nested(0)}))
    text = "x"
    for _ in range(12):
        text = {"d": text}
    g = ingest_json(spark.createDataFrame([("g", json.dumps(text))], "g string, j string"), deep, "j", F.col("g"))
    assert rows(g.nodes.where("value IS NOT NULL").select("schema_node_id", "value")) == [("D/12", "x")] and g.nodes.count() == 13
    spec = {"@id": "R/s", "@type": "Schema", "valueType": "R", "layer": {"@id": "R", "@type": "Object", "attributeList": [{"@id": "R/v", "@type": "Value", "attributeName": "v"}, {"@id": "R/kid", "@type": "Reference", "attributeName": "kid", "ref": "R"}]}}
    own = compile_schema(layer_from_json(spec), lambda ref: layer_from_json(spec))
    kids = lambda n: {"v": str(n), **({"kid": kids(n - 1)} if n else {})}
    run = lambda n: ingest_json(spark.createDataFrame([("g", json.dumps(kids(n)))], "g string, j string"), own, "j", F.col("g")).nodes.where("value IS NOT NULL").count()
    assert run(5) == 6
    with pytest.raises(Exception, match="deeper than the 8 levels"):
        run(30)


def test_set_value_chains(spark):
    chain = ["match (this)<-[]-(r)-[]->(n {schemaNodeId:'C/name'}) return n as found, n.value as word", "match (found) where found.value = word return toUpper(found.value) as v"]
    own = layer("C", {"key": "key", "name": "name", "loud": {"attributeName": "loud", "setValue": chain}}, entityIdFields=["C/key", "C/loud"])
    df = spark.createDataFrame([("1", "ann"), ("2", "bob"), ("3", None)], "key string, name string")
    g = entities.apply_set_values(ingest_rows(df, own, F.col("key")))
    assert rows(g.instances("C/loud").where("value IS NOT NULL").select("graph_id", "value")) == [("1", "ANN"), ("2", "BOB")]
    assert rows(g.instances("C").select("graph_id", F.array_join(F.coalesce("entity_id", F.array()), "|").alias("i"))) == [("1", "1|ANN"), ("2", "2|BOB"), ("3", "")]


def test_hash_completes_an_id_of_several_fields(spark):
    import hashlib

    own = layer("H2", {"a": "a", "b": "b", "h": {"attributeName": "h", "hash.sha512": ["H2/b"]}}, entityIdFields=["H2/a", "H2/h"])
    g = entities.compute_hashes(ingest_rows(spark.createDataFrame([("1", "x"), ("2", None)], "a string, b string"), own, F.col("a")))
    assert {r.graph_id: r.entity_id for r in g.instances("H2").collect()} == {"1": ["1", hashlib.sha512(b"x").hexdigest()], "2": None}


def test_uuids_agree_between_uses(spark):
    own = layer("U", {"a": "a", "u": {"attributeName": "u", "uuid": "true"}})
    g = entities.set_uuids(ingest_rows(spark.createDataFrame([("1", "x"), ("2", "y")], "a string, u string"), own, F.col("a")))
    own_ids = g.instances("U/u").select("graph_id", "value")
    assert own_ids.join(own_ids.withColumnRenamed("value", "again"), "graph_id").where("value = again").count() == 2


def test_hash_takes_properties_and_repeats(spark):
    import hashlib

    own = layer("H", {"a": "a", "b": {"attributeName": "b", "ingestAs": "property"}, "h": {"attributeName": "h", "hash": ["H/a", "H/b"]}}, entityIdFields=["H/h"])
    g = entities.compute_hashes(ingest_rows(spark.createDataFrame([("1", "x"), ("2", None)], "a string, b string"), own, F.col("a")))
    want = {"1": hashlib.sha256(b"1x").hexdigest(), "2": hashlib.sha256(b"2").hexdigest()}
    assert {r.graph_id: r.value for r in g.instances("H/h").collect()} == want
    assert {r.graph_id: r.entity_id for r in g.instances("H").collect()} == {k: [v] for k, v in want.items()}


def test_ambiguous_lookups_fail(spark):
    asked = spark.createDataFrame([({"": "x"},)], "request map<string,string>")
    twice = valueset.load([{"id": "a", "values": [{"value": "x", "result": "1"}, {"value": "X", "result": "2"}]}])
    with pytest.raises(Exception, match="ambiguous entries"):
        valueset.lookup(asked, valueset.entries_table(spark, twice)).collect()
    both = valueset.load([{"id": "a", "values": [{"value": "x", "result": "1"}]}, {"id": "b", "values": [{"result": "2"}]}])
    with pytest.raises(Exception, match="several value sets"):
        valueset.lookup(asked, valueset.entries_table(spark, both)).collect()
    with pytest.raises(SchemaError):
        valueset.entries_table(spark, valueset.load([{"id": "a", "values": [{"result": "1"}, {"result": "2"}]}]))


def test_lookup_matching_rules(spark):
    sets = valueset.load([{"id": "s", "values": [{"values": ["F", "Fe  male"], "result": "1"}, {"value": "Ex", "result": "2", "caseSensitive": True}, {"keyValues": {"k": "v"}, "result": "3"}, {"keyValues": {"k": "v1", "l": "w"}, "result": "4"}]}])
    asks = [({"": " fe male"}, "1"), ({"": "ex"}, None), ({"": " Ex "}, "2"), ({"": "V"}, "3"), ({"k": "v"}, "3"), ({"z": "v"}, None), ({"k": "v1"}, "4"), ({"": "v1"}, None), ({"k": "v1", "l": "W"}, "4"), ({"k": "v1", "m": "w"}, None), ({}, None), (None, None)]
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(asks)], "i int, request map<string,string>")
    got = {r.i: (r.result or {}).get("") for r in valueset.lookup(df, valueset.entries_table(spark, sets)).collect()}
    assert got == {i: w for i, (_, w) in enumerate(asks)}


def test_value_set_keys_and_removal(spark):
    own = layer("V", {"a": "a", "sys": "sys", "x": {"attributeName": "x", "vsRequestKeys": ["code", "system"], "vsRequestValues": ["V/a", "V/sys"], "vsResultKeys": ["code", "gone"], "vsResultValues": ["V/x", "V/old"]}, "old": "old"})
    sets = valueset.load([{"id": "s", "values": [{"keyValues": {"code": "h", "system": "l"}, "results": {"code": "K17"}}]}])
    g = ingest_rows(spark.createDataFrame([("H", "L", "was"), ("n", "L", "stays")], "a string, sys string, old string"), own, F.col("a"))
    out = valueset.process(g, valueset.entries_table(spark, sets))
    assert rows(out.nodes.where("schema_node_id IN ('V/x', 'V/old')").select("graph_id", "schema_node_id", "value")) == [("H", "V/x", "K17"), ("n", "V/old", "stays")]


def test_measures_beside_and_embedded(spark):
    own = layer("M", {"m1": "m1", "u": "u", "m": {"@type": ["Value", "Measure"], "attributeName": "m", "measureValueNode": "M/m1", "measureUnitNode": "M/u"}})
    df = spark.createDataFrame([("a", "123", "kg"), ("b", "4.5 lb", None), ("c", "nothing", None)], "k string, m1 string, u string")
    g = measures.build_measures(ingest_rows(df, own, F.col("k")))
    assert {r.graph_id: (r.props["measure/value"][0], r.props["measure/unit"][0]) for r in g.instances("M/m").collect()} == {"a": ("123", "kg"), "b": ("4.5", "lb")}


CONVERSIONS = [
    ("xsd:date", "2006-01-02", "xsd:dateTime", "2006-01-02T00:00:00Z"), ("xsd:date", "2006-01-2", "json:date", "2006-01-02"), ("xsd:date", "2006-01-2", "xsd:gDay", "2"), ("xsd:date", "2006-01-2", "xsd:gMonth", "01"),
    ("xsd:date", "2006-01-2", "xsd:gYear", "2006"), ("xsd:date", "2006-01-2", "xsd:gMonthDay", "01-02"), ("xsd:date", "2006-01-2", "xsd:gYearMonth", "2006-01"), ("json:date-time", "2006-01-02T15:04:05Z", "xsd:date", "2006-01-02"),
    ("xsd:dateTime", "2006-01-02T15:04:05Z", "unix:time", "1136214245"), ("xsd:dateTime", "2006-01-02T15:04:05Z", "unix:timeNano", "1136214245000000000"), ("xsd:date", "2006-01-02", "unix:time", "1136160000"),
    ("xsd:time", "15:04:05Z", "unix:time", "54245"), ("xsd:dateTime", "2006-01-02T15:04:05Z", "xsd:time", "15:04:05Z"), ("unix:timeNano", "1136214245000000000", "unix:time", "1136214245"), ("xsd:byte", "10", "xsd:int", "10"),
    ("xsd:byte", "-10", "xsd:long", "-10"), ("", "-1000", "xsd:byte", None), ("xsd:boolean", "1", "json:boolean", "true"), ("xsd:boolean", "0", "json:boolean", "false"), ("", "False", "json:boolean", "false"), ("xsd:time", "15:04:05", "xsd:date", None),
    ("xsd:gMonthDay", "03-04", "xsd:gDay", "4"), ("xsd:gYearMonth", "2001-07", "xsd:gYear", "2001"), ("", "2015-02-03", "xsd:date", "2015-02-03"), ("unix:time", "0", "json:date-time", "1970-01-01T00:00:00Z"),
]


def test_conversions(spark):
    one = spark.range(1)
    got = [one.select(types.convert(s, t, F.lit(v))).first()[0] for s, v, t, _ in CONVERSIONS]
    assert got == [w for *_, w in CONVERSIONS]
    pick = lambda c: one.select(c).first()[0]
    assert pick(types.convert("ls:date", "xsd:date", F.lit("20150203"), moment=["YYYYMMDD"])) == "2015-02-03"
    assert pick(types.convert("xsd:dateTime", "ls:dateTime", F.lit("2006-01-02T15:04:05Z"), target_moment=["MM-DD-YYYY HH:mm:ss"])) == "01-02-2006 15:04:05"
    assert pick(types.convert("ls:date", "xsd:date", F.lit("Jan 3 2015"), go=["Jan 2 2006"])) == "2015-01-03"
    assert pick(types.merge_part("xsd:gDay", F.lit("9"), "xsd:date", F.lit("2006-01-02"))) == "2006-01-09"
    with pytest.raises(Exception, match="cannot become"):
        pick(types.convert("xsd:time", "xsd:date", F.lit("15:04:05"), strict=True))


def test_integer_bounds(spark):
    one = spark.range(1)
    ok = lambda t, v: one.select(types.parse(t, F.lit(v))).first()[0] is not None
    assert [ok("xsd:nonNegativeInteger", v) for v in ("-1", "0", "x")] == [False, True, False]
    assert [ok("xsd:nonPositiveInteger", v) for v in ("0", "1")] == [True, False]
    assert [ok("xsd:unsignedLong", v) for v in ("18446744073709551615", "18446744073709551616")] == [True, False]
    assert [ok("xsd:byte", v) for v in ("127", "128", "-129")] == [True, False, False]


def test_schema_errors():
    with pytest.raises(SchemaError):
        compose(layer_from_json(flat_schema("A", {"x": "x"})), layer_from_json(flat_schema("A", {"x": "x"})))
    with pytest.raises(SchemaError):
        compile_schema(layer_from_json({"@id": "s", "@type": "Schema", "layer": {"@id": "r", "@type": "Object", "attributeList": [{"@id": "a", "@type": "Value"}, {"@id": "a", "@type": "Value"}]}}))
    with pytest.raises(SchemaError):
        layer_from_json({"@id": "s", "@type": "Nothing"})
    with pytest.raises(SchemaError):
        Layer("x", props={"characterEncoding": "nope"}).encoding
    with pytest.raises(SchemaError):
        import_json_schema({"A": "d#/a"}, {"d": {"a": {"properties": {"b": {"$ref": "#/b"}}}, "b": {"properties": {"b": {"$ref": "#/b"}}}}})


def test_recursive_schema_has_a_depth(spark):
    node = {"@id": "N/s", "@type": "Schema", "valueType": "N", "layer": {"@id": "N", "@type": "Object", "attributeList": [{"@id": "N/v", "@type": "Value", "attributeName": "v"}, {"@id": "N/next", "@type": "Reference", "attributeName": "next", "ref": "N"}]}}
    own = compile_schema(layer_from_json(node), lambda r: layer_from_json(node))
    doc = {"v": 1, "next": {"v": 2, "next": {"v": 3}}}
    g = ingest_json(spark.createDataFrame([("d", json.dumps(doc))], "g string, j string"), own, "j", F.col("g"))
    assert sorted(r.value for r in g.instances("N/v").collect()) == ["1", "2", "3"]


def test_overlay_paths_and_namespaces():
    base = layer_from_json(flat_schema("A", {"x": "x"}))
    over = {"@id": "o", "@type": "Overlay", "valueType": "A", "nsMap": ["A -> http://a"], "attributeOverlays": [{"@id": "http://a/x", "@type": "Value", "note": "n"}]}
    out = compose(base, layer_from_json(over))
    assert [a.id for a in out.attributes()] == ["http://a", "http://a/x"] and out.find("http://a/x").one("note") == "n"
    assert [a.id for a in base.attributes()] == ["A", "A/x"]


def test_bundle_chain_and_ambiguity():
    files = {"b": {"layers": [flat_schema("A", {"x": "x"})], "variants": {"A": {"schema": "A/schema"}}}, "c": {"base": "b", "layers": [], "variants": {"B": {"schema": "A/schema"}}}, "bad": {"base": "b", "variants": {"A": {"schema": "A/schema"}}}, "loop": {"base": "loop"}}
    c = Bundle.load("c", files.__getitem__)
    assert c.compiled("A").root.id == c.compiled("B").root.id == "A"
    for name in ("bad", "loop"):
        with pytest.raises(SchemaError):
            Bundle.load(name, files.__getitem__)
    with pytest.raises(SchemaError):
        find_variant([c, Bundle.load("b", files.__getitem__)], "A")


def test_queries_that_cannot_be_read(spark):
    g = ingest_rows(spark.createDataFrame([("1",)], "x string"), layer("A", {"x": "x"}), F.col("x"))
    for text in ("match (n) return m", "match (n return n", "match (n)<-[]->(m) return n", "match (n) where return n", "match (n) return nofunction(n)"):
        with pytest.raises(cypher.QueryError):
            cypher.run(g, text)
    assert cypher.run(g, "match (n) where n.value is not null return n.value as v").first().v == "1"


def test_reshape_prunes_and_binds(spark):
    source = ingest_rows(spark.createDataFrame([("1", "a"), ("2", None)], "k string, v string"), layer("S", {"k": "k", "v": "v"}), F.col("k"))
    target = compile_schema(layer_from_json({"@id": "T/s", "@type": "Schema", "valueType": "T", "layer": {"@id": "T", "@type": "Object", "attributeList": [{"@id": "T/o", "@type": "Object", "attributeName": "o", "attributeList": [{"@id": "T/o/v", "@type": "Value", "attributeName": "v", "transformValueExpr.first": ["match (n {attributeName:'nothing'}) return n", "match (n {schemaNodeId:'S/v'}) return n"]}]}]}}))
    g = reshape.Reshaper(target).reshape(source)
    assert rows(g.nodes.select("graph_id", "node_id", "value").fillna("")) == [("1", "1", ""), ("1", "1.o", ""), ("1", "1.o.v", "a")]
    with pytest.raises(SchemaError):
        reshape.Reshaper(target, reshape.TransformScript.load({"T/none": {"source": "x"}}))


def test_apply_layer_reinterprets(spark):
    own = layer("D", {"d": {"attributeName": "d", "valueType": "xsd:date"}})
    g = ingest_rows(spark.createDataFrame([("2006-1-2",)], "d string"), own, F.lit("g"))
    over = layer_from_json({"@id": "o", "@type": "Overlay", "valueType": "D", "attributeOverlays": [{"@id": "D/d", "@type": "Value", "valueType": "unix:time"}]})
    out = reshape.apply_layer(g, compose(own, over), reinterpret=True).instances("D/d").first()
    assert (out.value, out.value_type) == ("1136160000", ["unix:time"])


def test_pipeline_names_the_failing_step(spark):
    with pytest.raises(pipeline.PipelineError, match="ingest/csv"):
        pipeline.run([{"operation": "ingest/csv", "params": {"input": "missing", "layer": layer("A", {"x": "x"}), "graphId": "1"}}], pipeline.Context(spark))


def test_validators(spark):
    a = Attribute("x", "Value", {"validation/pattern": "^a", "validation/enumeration": ["ab", "ac"], "validation/const": "ab"})
    df = spark.createDataFrame([("ab",), ("ac",), ("b",), (None,)], "v string").select("v", validators.failures(a, F.col("v")).alias("f"))
    assert {r.v: r.f for r in df.collect()} == {"ab": [], "ac": ["const"], "b": ["pattern", "enumeration", "const"], None: []}


def test_streams(spark, tmp_path):
    from graphloom.streaming import streams

    src = tmp_path / "in"
    spark.createDataFrame([("1", "x", "2024-01-01 00:00:00"), ("1", "x", "2024-01-01 00:01:00"), ("2", "y", "2024-01-01 00:02:00")], "k string, v string, t string").select("k", "v", F.col("t").cast("timestamp").alias("t")).write.parquet(str(src))
    stream = lambda: spark.readStream.schema("k string, v string, t timestamp").parquet(str(src))

    def run(df, name):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name)

    items = run(streams.ingest_stream(stream(), layer("A", {"k": "k", "v": "v"}), F.concat_ws("-", "k", F.date_format("t", "mm")), "t").select("graph_id", "item.value"), "items")
    assert items.where("value IS NOT NULL").count() == 6
    entries = valueset.entries_table(spark, valueset.load([{"id": "a", "values": [{"value": "X", "result": "ex"}, {"result": "other"}]}]))
    found = run(streams.lookup_stream(stream(), entries, "v").select("k", "result"), "found")
    assert sorted(set(rows(found))) == [("1", "ex"), ("2", "other")]
    assert run(streams.unique_stream(stream(), ["k"], "t"), "unique_rows").count() == 2


def test_set_value_makes_missing_nodes(spark):
    own = layer("Q", {"a": "a", "b": {"attributeName": "b", "setValue": ["match (this)<-[]-()-[]->(n {schemaNodeId:'Q/a'}) return n"]}, "c": {"attributeName": "c", "setValue": ["return 'fixed'"]}})
    g = entities.apply_set_values(ingest_rows(spark.createDataFrame([("1", None), ("2", "old")], "a string, b string"), own, F.col("a")))
    assert rows(g.nodes.where("schema_node_id IN ('Q/b', 'Q/c')").select("graph_id", "schema_node_id", "value")) == [("1", "Q/b", "1"), ("1", "Q/c", "fixed"), ("2", "Q/b", "2"), ("2", "Q/c", "fixed")]


def test_value_set_requests_by_query(spark):
    own = layer("V", {"a": "a", "x": {"attributeName": "x", "vsValuesets": ["s"], "vsRequest": ["match (this)<-[]-()-[]->(n {schemaNodeId:'V/a'}) return this as code, n as kind"], "vsResultKeys": ["r"], "vsResultValues": ["V/out"]}, "out": "out"})
    sets = valueset.load([{"id": "s", "values": [{"keyValues": {"code": "c1", "kind": "k1"}, "results": {"r": "yes"}}]}])
    g = ingest_rows(spark.createDataFrame([("k1", "C1"), ("k2", "c1")], "a string, x string"), own, F.col("a"))
    out = valueset.process(g, valueset.entries_table(spark, sets))
    assert rows(out.instances("V/out").select("graph_id", "value")) == [("k1", "yes")]


def test_measure_units_by_query(spark):
    own = layer("M", {"m1": "m1", "u1": "u1", "m": {"@type": ["Value", "Measure"], "attributeName": "m", "measureValueNode": "M/m1", "measureUnitExpr": "match (valueNode)<-[]-()-[]->(v {attributeName:'u1'}) return v"}})
    g = measures.build_measures(ingest_rows(spark.createDataFrame([("5", "kg")], "m1 string, u1 string"), own, F.lit("g")))
    assert [r.value for r in g.instances("M/m").collect()] == ["5 kg"]


def test_excel_sheets(tmp_path):
    import zipfile

    from graphloom.sources.excel import read_excel, stream_sheet

    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    path = tmp_path / "a.xlsx"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>h1</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>h3</t></is></c></row><row r="3"><c r="A3"><v>7</v></c><c r="C3" t="s"><v>1</v></c></row></sheetData></worksheet>')
    assert read_excel(str(path)) == {"S": [["h1", "", "h3"], [], ["7", "", "ab"]]}
    assert list(stream_sheet(str(path), "S"))[1] == {"h1": "7", "": "", "h3": "ab"}


def test_answers_of_a_service(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from urllib.parse import parse_qs, urlparse

    class Service(BaseHTTPRequestHandler):
        def do_GET(self):
            q = parse_qs(urlparse(self.path).query)
            if q.get("value") == ["gone"]:
                return self.send_error(404)
            body = json.dumps({"": q["value"][0].upper() + "/" + q["valueset"][0]} if q["value"] != ["none"] else None).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        own = layer("S", {"a": {"attributeName": "a", "vsValuesets": ["set1"], "vsRequestValues": ["S/a"], "vsResultValues": ["S/b"]}, "b": "b"})
        g = ingest_rows(spark.createDataFrame([("x",), ("none",), ("gone",)], "a string"), own, F.col("a"))
        out = valueset.process(g, valueset.http_answers(f"http://127.0.0.1:{server.server_port}/"))
        assert rows(out.instances("S/b").select("graph_id", "value")) == [("x", "X/set1")]
    finally:
        server.shutdown()


def test_text_templates():
    from graphloom.schema.template import TemplateError, render

    context = {"rows": [{"n": "a", "t": ""}, {"n": 'b"', "t": "x"}], "name": "N", "list": [1, 2]}
    assert render("{{.name}}:{{range .rows}}{{$i}}{{json .n}}{{if .t}}!{{else}}?{{end}}{{$.name}};{{end}}{{index .list 1}}{{.none}}{{range .no}}x{{else}}-{{end}}", context) == 'N:0"a"?N;1"b\\""!N;2-'
    for bad in ("{{if .a}}", "{{end}}", "{{else}}", "{{foo}}"):
        with pytest.raises(TemplateError):
            render(bad, {})


def test_stream_lookup_matches_as_the_batch_does(spark):
    from graphloom.streaming import streams

    table = lambda *v: valueset.entries_table(spark, valueset.load([{"id": "s", "values": list(v)}]))
    df = spark.createDataFrame([("a",), ("A",), ("Ex",), ("ex",), ("z",)], "v string")
    got = rows(streams.lookup_stream(df, table({"value": "a", "result": "1"}, {"value": "Ex", "result": "2", "caseSensitive": True}, {"result": "0"}), "v").select("v", "result"))
    assert got == [("A", "1"), ("Ex", "2"), ("a", "1"), ("ex", "0"), ("z", "0")]
    for wrong in ([{"value": "a", "result": "1"}, {"value": "A", "result": "2"}], [{"keyValues": {"k": "a", "l": "b"}, "result": "1"}]):
        with pytest.raises(ValueError):
            streams.lookup_stream(df, table(*wrong), "v")


def test_checked_pipelines_name_the_step_that_fails_on_rows(spark):
    steps = [{"operation": "ingest/csv", "params": {"layer": layer("S", {"a": "a", "b": {"attributeName": "b", "vsValuesets": ["s"], "vsRequestValues": ["S/a"], "vsResultValues": ["S/b"]}}), "input": "d", "graphId": "a"}}, {"operation": "link"}]
    data = {"d": spark.createDataFrame([("1",)], "a string").select(F.raise_error(F.lit("torn")).cast("string").alias("a"))}
    with pytest.raises(pipeline.PipelineError) as e:
        pipeline.run(steps, pipeline.Context(spark, data=data), checked=True)
    assert e.value.step == "ingest/csv"


def test_custom_checks_of_nodes_and_native_values(spark):
    from graphloom.schema.terms import MEANINGS, define

    define("t/many", check_nodes=lambda g, a: g.instances(a.id).where("value = '2'"), read=lambda a, v: v.cast("int"), write=lambda a, v: (v + 1).cast("string"))
    try:
        own = layer("M", {"a": {"attributeName": "a", "t/many": "x"}})
        g = ingest_rows(spark.createDataFrame([("1",), ("2",)], "a string"), own, F.col("a"))
        assert rows(entities.validate(g).select("graph_id", "validator")) == [("2", "t/many")]
        more = entities.set_native(g, "t/many", entities.native(g, "t/many"))
        assert rows(more.instances("M/a").select("graph_id", "value")) == [("1", "2"), ("2", "3")]
    finally:
        MEANINGS.pop("t/many")


def test_clauses_after_the_first_match(spark):
    g = _chain(spark, 4)
    run = lambda text: rows(cypher.run(g, text))
    got = cypher.run(g, "match (a) optional match (a)-[:to]->(b) where b.nodeId <> 'n02' return a.nodeId as a, b.nodeId as b").collect()
    assert sorted((r.a, r.b or "") for r in got) == [("n00", "n01"), ("n01", ""), ("n02", "n03"), ("n03", "")]
    assert run("match (a)-[:to]->(b) with b, count(a) as n where n > 0 match (b)-[:to]->(c) return c.nodeId as c, n") == [("n02", 1), ("n03", 1)]
    assert run("match (a) with distinct a.type as t unwind ['x', 'y'] as u return t, u") == [("Object", "x"), ("Object", "y")]
    assert run("unwind [1, 2] as x return x") == [(1,), (2,)]
    with pytest.raises(cypher.QueryError):
        cypher.run(g, "match (a) with a.type as t return a")
