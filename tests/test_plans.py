"""What the physical plans must and must not hold, and schema-side functions."""

import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from graphloom import queries as engine
from graphloom.functions.jsonschema import Validator, validate_json
from graphloom.schema import jsonld

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_ingestion_needs_no_shuffle_and_reads_declared_columns(spark):
    text = plan(engine.customers(spark, SF).nodes)
    assert "Exchange" not in text
    assert "ReadSchema: struct<c_custkey:bigint,c_name:string,c_mktsegment:string>" in text


def test_filters_reach_the_scan(spark):
    df = engine.read(spark, SF, "orders").where("o_orderkey < 10")
    from graphloom.fixtures import compiled
    from graphloom.operators.ingest import ingest_rows

    text = plan(ingest_rows(df, compiled("Order"), F.col("o_orderkey")).nodes)
    assert "LessThan(o_orderkey,10)" in text


def test_json_ingestion_is_one_scan_without_python(spark):
    text = plan(engine.conversations(spark, SF).edges)
    assert text.count("Scan parquet") == 2 and "Python" not in text  # the node list and its details


def test_dictionaries_are_broadcast_while_small(spark):
    assert "BroadcastHashJoin" in plan(engine.QUERIES["VS4_default_entry"](spark, SF))


def test_graph_steps_read_what_they_hold(spark):
    """Operators that use their graph several times neither ingest it again nor shuffle it for each use."""
    for name, scans, exchanges in (("JN7_value_set_lookup", 2, 3), ("VS7_result_nodes", 1, 0), ("TX1_reshape", 2, 4), ("SNK3_nested_json_export", 5, 4)):
        text = plan(engine.QUERIES[name](spark, SF)).split("\n\n")[0]
        assert text.count("Scan parquet") <= scans, name
        assert text.count("Exchange (") - text.count("BroadcastExchange (") <= exchanges, name
        assert "orders.parquet" not in plan(engine.QUERIES[name](spark, SF)), name


def test_no_plan_has_a_cross_join(spark):
    for name in ("JN1_foreign_key_links", "JN7_value_set_lookup", "OC_sibling", "TX1_reshape", "SNK3_nested_json_export", "REL_unique_entities"):
        text = plan(engine.QUERIES[name](spark, SF))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


CASES = [
    ({"type": "integer"}, 1.0, []), ({"type": "integer"}, True, ["type"]), ({"enum": [1, "a"]}, "b", ["enum"]), ({"const": {"a": [1]}}, {"a": [1.0]}, []), ({"minimum": 1, "exclusiveMaximum": 3}, 3, ["exclusiveMaximum"]),
    ({"multipleOf": 0.1}, 0.3, []), ({"pattern": "^a", "minLength": 2}, "b", ["minLength", "pattern"]), ({"format": "ipv4"}, "1.2.3.256", ["format"]), ({"items": {"type": "string"}}, ["a", 1], ["type"]),
    ({"prefixItems": [{"type": "string"}], "items": False}, ["a", 1], ["false"]), ({"contains": {"const": 2}, "maxContains": 1}, [2, 2], ["contains"]), ({"uniqueItems": True}, [1, True, 1.0], ["uniqueItems"]),
    ({"required": ["a"], "additionalProperties": False, "properties": {"a": {}}}, {"b": 1}, ["required", "false"]), ({"patternProperties": {"^x": {"type": "null"}}}, {"x1": 1}, ["type"]),
    ({"dependentRequired": {"a": ["b"]}}, {"a": 1}, ["dependentRequired"]), ({"oneOf": [{"type": "number"}, {"type": "integer"}]}, 1, ["oneOf"]), ({"not": {"type": "null"}}, None, ["not"]),
    ({"if": {"type": "number"}, "then": {"minimum": 5}, "else": {"type": "string"}}, 4, ["minimum"]), ({"$ref": "#/$defs/a", "$defs": {"a": {"items": {"$ref": "#/$defs/a"}, "type": "array"}}}, [[], [1]], ["type"]),
    ({"propertyNames": {"maxLength": 1}}, {"ab": 1}, ["maxLength"]), (False, 1, ["false"]), (True, 1, []),
]


@pytest.mark.parametrize("schema,value,want", CASES)
def test_json_schema_keywords(schema, value, want):
    assert [k for _, k in Validator(schema).errors(value)] == want


def test_json_schema_over_rows(spark):
    df = spark.createDataFrame([("a", '{"k":1}'), ("b", "{"), ("c", None), ("d", '{"k":"x"}')], "i string, j string")
    got = validate_json(df, {"properties": {"k": {"type": "integer"}}}, "j", F.col("i")).collect()
    assert sorted(tuple(r) for r in got) == [("b", "", "json"), ("d", "/k", "type")]


def test_json_ld():
    context = {"x": "http://x/", "name": "x:name", "kids": {"@id": "x:kids", "@container": "@id"}}
    doc = {"@context": context, "@id": "http://a", "@type": "x:T", "name": ["n", "m"], "kids": {"http://b": {"name": "k"}}}
    full = [{"@id": "http://a", "@type": ["http://x/T"], "http://x/name": [{"@value": "n"}, {"@value": "m"}], "http://x/kids": [{"@id": "http://b", "http://x/name": [{"@value": "k"}]}]}]
    assert jsonld.expand(doc) == full
    assert jsonld.compact({"@graph": full}, context)["name"] == ["n", "m"]
    assert [n["@id"] for n in jsonld.flatten(doc)] == ["http://a", "http://b"]
    assert jsonld.flatten({"http://x/p": {"http://x/q": "v"}})[0] == {"@id": "_:b0", "http://x/p": [{"@id": "_:b1"}]}


def test_stored_graphs_join_without_shuffle(spark):
    was = spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        g = engine.customers(spark, SF).stored("plans_test", 4)
        joined = g.children("Customer/name").groupBy("graph_id", "parent_id").agg(F.max("value"))
        assert "Exchange" not in plan(joined) and joined.count() == 150
    finally:
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", was)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        for part in ("nodes", "edges"):
            spark.sql(f"DROP TABLE IF EXISTS plans_test_{part}")


def test_command_line(tmp_path, capsys):
    import json

    from graphloom.__main__ import main
    from graphloom.fixtures import flat_schema

    base, over, data = tmp_path / "s.json", tmp_path / "o.json", tmp_path / "d.csv"
    base.write_text(json.dumps(flat_schema("A", {"x": "x"})))
    over.write_text(json.dumps({"@id": "o", "@type": "Overlay", "valueType": "A", "attributeOverlays": [{"@id": "A/x", "@type": "Value", "note": "n"}]}))
    data.write_text("a, b\n1,2\n")
    main(["compose", str(base), str(over)])
    assert json.loads(capsys.readouterr().out)["layer"]["attributeList"][0]["note"] == "n"
    main(["compile", str(base)])
    assert json.loads(capsys.readouterr().out)["layer"]["entitySchema"] == "A/schema"
    main(["header", str(data)])
    assert [a["attributeName"] for a in json.loads(capsys.readouterr().out)["layer"]["attributeList"]] == ["a", "b"]
    main(["slice", str(base), "--term", "attributeName"])
    assert json.loads(capsys.readouterr().out)["@type"] == "Overlay"
