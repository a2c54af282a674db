"""Documents one after another in files, and rows in error."""

import json
import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import measures
from graphloom.plans import pipeline
from graphloom.schema import compile_schema, layer_from_json
from graphloom.sources.documents import json_documents


def layer(**kinds):
    return compile_schema(layer_from_json({"@id": "A/s", "@type": "Schema", "valueType": "A", "layer": {"@id": "A", "@type": "Object", "attributeList": [{"@id": f"A/{k}", "@type": "Value", "attributeName": k, **({"valueType": v} if v else {})} for k, v in kinds.items()]}}))


def test_documents_of_files_are_cut_in_several_tasks(spark, tmp_path):
    rng = random.Random(4)
    files = {}
    for name in "ab":
        docs = [{"k": n, "t": "".join(rng.choices('{}[]"\\ x\n', k=rng.randrange(60))), "l": [[n], {"m": {}}]} for n in range(500)]
        text = "".join(json.dumps(x, indent=rng.choice([None, 1])) + rng.choice(["", " ", "\n", "\n\n"]) for x in docs)
        (tmp_path / f"{name}.json").write_text(text)
        files[name] = docs
    (tmp_path / "empty.json").write_text("")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        df = json_documents(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        got = {}
        for r in df.collect():
            got.setdefault(r.file.split("/")[-1][0], {})[r.number] = json.loads(r.document)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert {f: [own[k] for k in sorted(own)] for f, own in got.items()} == files
    assert all(sorted(own) == list(range(500)) for own in got.values())


def test_unmatched_brackets_and_plain_values(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"a":1}} 7 "x y" true\n[1,\n2] {"b": [')
    got = sorted((r.number, r.document) for r in json_documents(spark, str(tmp_path / "x.json")).collect())
    assert got == [(0, '{"a":1}'), (1, "}"), (2, "7"), (3, '"x y"'), (4, "true"), (5, "[1,\n2]"), (6, '{"b": [')]


def cases(spark, tmp_path):
    three = layer(x="json:integer", y="")
    json_docs = spark.createDataFrame([("1", '{"x": 1, "y": "a"}'), ("2", '{"x": '), ("3", '{"x": "no"}'), ("4", '{"y": {"z": 1}}'), ("5", None)], "g string, value string")
    xml_docs = spark.createDataFrame([("1", "<A><x>1</x></A>"), ("2", "<A><x>"), ("3", "<A/>")], "g string, value string")
    graphs = spark.createDataFrame([("1", '{"nodes": [{"n": 0, "labels": ["L"], "properties": {}}]}'), ("2", "{"), ("3", "[1]")], "g string, value string")
    rows = spark.createDataFrame([("1", "1", "a"), ("2", "no", "b"), ("3", "3", None)], "g string, x string, y string")
    path = tmp_path / "rows.csv"
    path.write_text("x,y\n1,a\nno,b\n3,c\n")
    one = {"input": "d", "graphId": "g"}
    return [
        ("ingest/json", {**one, "layer": three}, json_docs, {"2": "not JSON", "3": "A/x: not a json:integer: no", "4": "A/y: not a Value"}, {"1"}),
        ("ingest/xml", {**one, "layer": three}, xml_docs, {"2": None}, {"1", "3"}),
        ("readGraph", one, graphs, {"2": "not a graph", "3": "not a graph"}, {"1"}),
        ("ingest/csv", {**one, "layer": layer(x="json:integer", y=""), "graphId": "g"}, rows, {"2": "A/x: not a json:integer: no"}, {"1", "3"}),
    ], path


def test_rows_in_error_stop_or_go_into_quarantine(spark, tmp_path):
    found, path = cases(spark, tmp_path)
    for name, params, docs, wrong, good in found:
        context = pipeline.Context(spark, data={"d": docs})
        with pytest.raises(pipeline.PipelineError) as e:
            pipeline.run([{"operation": name, "params": {**params, "onError": "stop"}}], context)
        assert e.value.step == name and isinstance(e.value.cause, pipeline.DataError) and e.value.cause.count >= len(wrong)
        out = pipeline.run([{"operation": name, "params": {**params, "onError": "quarantine"}}], context)
        listed = {r.graph_id: r.error for r in out.results["errors"].collect()}
        assert set(listed) == set(wrong) and all(w is None or listed[g] == w for g, w in wrong.items()), name
        assert out.results["errorCount"] == len(wrong)
        assert {r.graph_id for r in out.graph.nodes.select("graph_id").distinct().collect()} == good, name
    steps = [{"operation": "ingest/csv", "params": {"path": str(path), "layer": layer(x="json:integer", y=""), "id": "r{{.rowIndex}}", "onError": "quarantine"}}]
    out = pipeline.run(steps, pipeline.Context(spark))
    assert [r.error for r in out.results["errors"].collect()] == ["A/x: not a json:integer: no"]
    assert sorted(r.value for r in out.graph.instances("A/y").collect()) == ["a", "c"]


def test_errors_of_several_steps_add_up_and_modes_are_checked(spark, tmp_path):
    found, _ = cases(spark, tmp_path)
    steps = [{"operation": n, "params": {**p, "input": n, "onError": "quarantine"}} for n, p, *_ in found[:2]]
    out = pipeline.run(steps, pipeline.Context(spark, data={n: d for n, _, d, *_ in found}))
    assert out.results["errorCount"] == 4 == out.results["errors"].count()
    with pytest.raises(pipeline.PipelineError, match="onError"):
        pipeline.run([{"operation": "readGraph", "params": {"input": "d", "graphId": "g", "onError": "ignore"}}], pipeline.Context(spark, data={"d": found[2][2]}))
    with pytest.raises(pipeline.PipelineError, match="not JSON"):  # broken documents stop a step that says nothing
        pipeline.run([{"operation": "ingest/json", "params": {"input": "d", "graphId": "g", "layer": layer(x="")}}], pipeline.Context(spark, data={"d": found[0][2]}))


def test_factors_go_by_domain(spark):
    m = spark.createDataFrame([("2", "oz", "g"), ("3", "g", "g"), ("4", "lb", "g")], "value string, unit string, use_unit string")
    f = spark.createDataFrame([("mass", "oz", "g", 28.35, None), ("gold", "oz", "g", 31.1, None), (None, "lb", "g", 453.6, None)], "domain string, from_unit string, to_unit string, factor double, shift double")
    got = lambda d: {r.unit: r.converted for r in measures.convert(m, f, domain=d).collect()}
    assert got("mass") == {"oz": 56.7, "g": 3.0, "lb": 4 * 453.6} and got("gold")["oz"] == 62.2 and got("")["oz"] is None
    with pytest.raises(Exception, match="no factor from oz to g in domain 'other'"):
        measures.convert(m, f, domain="other", missing="error").collect()
    with pytest.raises(Exception, match="more than one factor"):
        measures.convert(m, f.unionByName(f), domain="mass").collect()
