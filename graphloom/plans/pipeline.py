"""Declarative pipelines: a list of {operation, params}, each step a plan transformer.

Steps are lazy but for those that ingest: what they read is written once, with its errors counted
on the way. A document or row in error stops the pipeline with the step's name (onError: "stop",
the default), or is left out whole and listed in results["errors"] (onError: "quarantine").
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph
from ..operators import entities, links, measures, reshape, valueset
from ..schema.bundle import Bundle, read_json_or_yaml
from ..storage import written
from . import cypher, updates


class PipelineError(RuntimeError):
    def __init__(self, step: str, cause: Exception):
        super().__init__(f"{step}: {cause}")
        self.step, self.cause = step, cause


class DataError(ValueError):
    """Rows in error: how many, and the first of them (graph_id, node_id, schema_node_id, error)."""

    def __init__(self, count: int, first):
        super().__init__(f"{count} in error, the first of graph {first['graph_id']}, node {first['node_id']}: {first['error']}")
        self.count, self.first = count, first


@dataclass(frozen=True)
class Context:
    """What flows from step to step; steps give a new one."""

    spark: SparkSession
    graph: Graph | None = None
    bundle: Bundle | None = None
    data: dict[str, DataFrame] = field(default_factory=dict)
    results: dict = field(default_factory=dict)

    def with_(self, **changes) -> Context:
        return replace(self, **changes)


STEPS: dict[str, Callable[[Context, dict], Context]] = {}


def step(name: str):
    def add(f):
        STEPS[name] = f
        return f

    return add


def _layer(c: Context, p: dict):
    return c.bundle.compiled(p["type"]) if isinstance(p.get("type"), str) else p["layer"]


def _table(c: Context, p: dict) -> DataFrame:
    return c.data[p["input"]] if "input" in p else c.spark.read.option("header", True).csv(p["path"])


_ERRORS = "graph_id", "node_id", "schema_node_id", "error"


def _sound(c: Context, p: dict, items: DataFrame, bad: Column, listed: Callable[[DataFrame], DataFrame]) -> tuple[Context, DataFrame]:
    """Items without those of documents in error, written once, and the context with the errors as p says.

    bad: which items are in error; listed: the columns of _ERRORS of such items. Streams are passed on unchecked.
    """
    mode = p.get("onError", "stop")
    if mode not in ("stop", "quarantine"):
        raise ValueError(f"onError is stop or quarantine, not {mode}")
    if items.isStreaming:
        return c, items.where(~bad)
    seen = Observation()
    items = written(items.observe(seen, F.sum(bad.cast("long")).alias("errors"), F.count(F.lit(1)).alias("items")))
    count = seen.get["errors"] or 0
    found = listed(items.where(bad)).select(*_ERRORS)
    if count and mode == "stop":
        raise DataError(count, found.orderBy(*_ERRORS).first())
    if mode == "quarantine":
        earlier = c.results.get("errors")
        c = c.with_(results={**c.results, "errors": found if earlier is None else earlier.unionByName(found), "errorCount": c.results.get("errorCount", 0) + count})
    if count:
        # the documents' ids are written first, so that a join of two plain shuffles can be split
        gone = written(found.select(F.col("graph_id").alias("_gone")).distinct())
        items = items.join(gone, F.col("graph_id").eqNullSafe(F.col("_gone")), "left_anti")
    return c, items


def _ingested(c: Context, p: dict, items: DataFrame, layer) -> Context:
    from ..operators.ingest import errors, graph_of

    bad = F.coalesce(F.col("item.present") & F.col("item.error").isNotNull(), F.lit(False))
    c, items = _sound(c, p, items, bad, errors)
    return c.with_(graph=links.link(graph_of(items, layer)))


@step("ingest/csv")
def _ingest_csv(c: Context, p: dict) -> Context:
    from ..operators.ingest import flat_items
    from ..sources.tables import csv_items, read_csv

    layer, typed = _layer(c, p), p.get("checkTypes", "onError" in p)
    if "input" in p:
        return _ingested(c, p, flat_items(c.data[p["input"]], layer, F.expr(p["graphId"]), only_schema=p.get("onlySchemaAttributes", True), typed=typed), layer)
    rows = read_csv(c.spark, p["path"], p.get("headerRow", 0), p.get("startRow"), p.get("endRow"), p.get("delimiter", ","), layer.encoding)
    return _ingested(c, p, csv_items(rows, layer, p.get("id", "row_{{.rowIndex}}"), p.get("ingestByRows", True), p.get("ingestNullValues", False), p.get("onlySchemaAttributes", False), typed=typed), layer)


@step("ingest/csv/join")
def _ingest_joined(c: Context, p: dict) -> Context:
    from ..sources.tables import JoinedEntity, ingest_joined, read_csv

    row, start = p.get("row", "_row"), p.get("startRow", 0)
    if "input" in p:
        rows = c.data[p["input"]].where(F.col(row) >= start)
        rows = rows if p.get("endRow", -1) < 0 else rows.where(F.col(row) <= p["endRow"])
    else:
        end = p.get("endRow", -1)
        rows = read_csv(c.spark, p["path"], p.get("headerRow", 0), start, None if end < 0 else end, p.get("delimiter", ","), p.get("encoding", "UTF-8"))
    cells = [x for x in rows.columns if x not in (row, "_row", "_file", "_data")]
    names = lambda given: tuple(cells[x] if isinstance(x, int) else x for x in given)
    own = [JoinedEntity(_layer(c, e), names(e["cols"]), names(e["idCols"]), names(e.get("any", ()))) for e in p["entities"]]
    return c.with_(graph=ingest_joined(rows, own, row, id_template=p.get("id") or "row_{{.rowIndex}}", start_row=start))


def _documents(c: Context, p: dict) -> tuple[DataFrame, Column, str]:
    """A step's documents, their graph ids and the column of their text: a table, or the JSON documents of files, any number in each."""
    if "input" in p:
        return c.data[p["input"]], F.expr(p["graphId"]), p.get("column", "value")
    from ..sources.documents import json_documents

    name = F.sha1(F.col("file").cast("binary"))
    return json_documents(c.spark, p["path"]), F.when(F.col("number") == 0, name).otherwise(F.concat_ws("_", name, "number")), "document"


@step("ingest/json")
def _ingest_json(c: Context, p: dict) -> Context:
    from ..operators.ingest import json_items

    (docs, graph_id, column), layer = _documents(c, p), _layer(c, p)
    return _ingested(c, p, json_items(docs, layer, column, graph_id, only_schema=p.get("onlySchemaAttributes", False), typed=p.get("checkTypes", "onError" in p)), layer)


@step("ingest/xml")
def _ingest_xml(c: Context, p: dict) -> Context:
    from ..sources.xml import xml_graph, xml_items

    if "input" in p:
        docs, graph_id = c.data[p["input"]], F.expr(p["graphId"])
    else:
        docs, graph_id = c.spark.read.option("wholetext", True).text(p["path"]).withColumn("_file", F.input_file_name()), F.sha1(F.col("_file").cast("binary"))
    layer = _layer(c, p)
    items = xml_items(docs, layer, p.get("column", "value"), graph_id, p.get("onlySchemaAttributes", False))
    c, items = _sound(c, p, items, F.col("error").isNotNull(), lambda bad: bad)
    return c.with_(graph=links.link(xml_graph(items, layer)))


@step("readGraph")
def _read_graph(c: Context, p: dict) -> Context:
    from ..sources.graphs import graph_items, graph_of_items

    docs, graph_id, column = _documents(c, p)
    none = F.lit(None).cast("string")
    items = graph_items(docs, F.col(column), graph_id, p.get("namespace", "")).withColumns({"node_id": none, "schema_node_id": none})
    c, items = _sound(c, p, items, F.col("error").isNotNull(), lambda bad: bad)
    return c.with_(graph=graph_of_items(items))


@step("writeGraph")
def _write_graph(c: Context, p: dict) -> Context:
    from ..sinks.exports import to_dot, to_graph_json

    kind = p.get("format", "json")
    if kind == "dot":
        return c.with_(results={**c.results, "dot": to_dot(c.graph)})
    if kind == "web":
        import html

        return c.with_(results={**c.results, "web": f"<!DOCTYPE html><title>graph</title><pre class=\"dot\">{html.escape(to_dot(c.graph))}</pre>"})
    if kind == "parquet":
        c.graph.nodes.write.mode("overwrite").parquet(f"{p['path']}/nodes")
        c.graph.edges.write.mode("overwrite").parquet(f"{p['path']}/edges")
        return c
    out = to_graph_json(c.graph, p.get("includeSchema", True))
    if "path" in p:
        out.select("json").write.mode("overwrite").text(p["path"])
    return c.with_(results={**c.results, "graph": out})


@step("export/csv")
def _export_csv(c: Context, p: dict) -> Context:
    from ..sinks.exports import to_table, write_csv

    roots = None
    if "rowQuery" in p:
        ids = cypher.find_nodes(c.graph, p["rowQuery"]).withColumn("_root", F.lit(True))
        nodes = c.graph.nodes.join(ids, ["graph_id", "node_id"], "left_semi").select("graph_id", "node_id").withColumn("_r", F.lit(True))
        graph = c.graph.with_(nodes=c.graph.nodes.join(nodes, ["graph_id", "node_id"], "left").withColumn("labels", F.when(F.col("_r"), F.array_union("labels", F.array(F.lit("$row")))).otherwise(F.col("labels"))).drop("_r").select(*c.graph.nodes.columns))
        table = to_table(graph, p["columns"], F.array_contains("labels", "$row"))
    else:
        table = to_table(c.graph, p["columns"], roots)
    if "path" in p:
        write_csv(table, p["path"], True, p.get("header", True))
    return c.with_(results={**c.results, "csv": table})


@step("export/json")
def _export_json(c: Context, p: dict) -> Context:
    from ..sinks.exports import to_json

    out = to_json(c.graph, p.get("root") or c.graph.layer.root.id, type_key=p.get("typeKey", ""))
    if "path" in p:
        out.select("json").write.mode("overwrite").text(p["path"])
    return c.with_(results={**c.results, "json": out})


@step("valueset")
def _valueset(c: Context, p: dict) -> Context:
    if "provider" in p:
        entries = valueset.PROVIDERS[p["provider"]["kind"]](c.spark, p["provider"])
    elif "service" in p:
        entries = valueset.http_answers(p["service"])
    else:
        sets = valueset.load(p["valuesets"]) if "valuesets" in p else valueset.load_files(p["valuesetFiles"])
        entries = valueset.entries_table(c.spark, sets)
    if "store" in p:
        ask = entries if callable(entries) else lambda asked, tables: valueset.lookup(asked, entries, tables)
        entries = valueset.Answers(c.spark, p["store"], str(p.get("version", "1")), p.get("most", 1_000_000)).wrap(ask)
    return c.with_(graph=valueset.process(c.graph, entries, p.get("tables")))


@step("measures")
def _measures(c: Context, p: dict) -> Context:
    return c.with_(graph=measures.build_measures(c.graph, c.data.get(p["factors"]) if "factors" in p else None, p.get("missing", "error")))


@step("oc")
def _oc(c: Context, p: dict) -> Context:
    """Queries in order; those with updating clauses change the graph for the ones after them and give no result."""
    texts, out, held = p["expr"] if isinstance(p["expr"], list) else [p["expr"]], [], False
    for t in texts:
        if updates.updates(t):
            c, held = c.with_(graph=updates.update(c.graph, t, held)), True
        else:
            out.append(cypher.run(c.graph, t))
    return c.with_(results={**c.results, "ocResult": out[-1], "ocResults": out}) if out else c


@step("reshape")
def _reshape(c: Context, p: dict) -> Context:
    script = p.get("script")
    if isinstance(script, str):
        script = read_json_or_yaml(script)
    own = reshape.TransformScript.load(script) if isinstance(script, dict) else script
    return c.with_(graph=reshape.Reshaper(_layer(c, p), own).reshape(c.graph))


@step("applyLayer")
def _apply_layer(c: Context, p: dict) -> Context:
    return c.with_(graph=reshape.apply_layer(c.graph, _layer(c, p), p.get("reinterpretValues", False)))


@step("unique")
def _unique(c: Context, p: dict) -> Context:
    return c.with_(graph=entities.consolidate(c.graph, p["label"]))


@step("store")
def _store(c: Context, p: dict) -> Context:
    return c.with_(graph=c.graph.stored(p["name"], p["buckets"]))


@step("fork")
def _fork(c: Context, p: dict) -> Context:
    """Named pipelines over the same graph. Plans are immutable, so they cannot disturb each other."""
    return c.with_(results={**c.results, **{name: run(steps, c).results for name, steps in p["pipelines"].items()}})


for _name, _work in (("link", links.link), ("defaults", entities.add_defaults), ("hash", entities.compute_hashes), ("setValue", entities.apply_set_values), ("uuid", entities.set_uuids), ("prune", entities.prune_childless), ("reuse", entities.reuse_entities)):
    STEPS[_name] = lambda c, p, work=_work: c.with_(graph=work(c.graph))


@step("validate")
def _validate(c: Context, p: dict) -> Context:
    return c.with_(results={**c.results, "errors": entities.validate(c.graph)})


def run(steps: list[dict] | str, context: Context, checked: bool = False) -> Context:
    """The steps in order. A step that fails raises PipelineError with its name.

    Rows are read when a result is used, so what fails on rows fails there; checked: the graph is
    written after each step that changes it, and what fails on rows has its step's name.
    """
    for s in read_json_or_yaml(steps) if isinstance(steps, str) else steps:
        name = s["operation"]
        if name not in STEPS:
            raise PipelineError(name, KeyError("no such step"))
        try:
            was, context = context.graph, STEPS[name](context, s.get("params", {}))
            if checked and context.graph is not None and context.graph is not was:
                context = context.with_(graph=context.graph.held())
        except PipelineError:
            raise
        except Exception as e:
            raise PipelineError(name, e) from e
    return context
