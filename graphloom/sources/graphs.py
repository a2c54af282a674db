"""Graph JSON: {"nodes": [{"n", "labels", "properties", "edges": [{"to", "label", "properties"}]}], "edges": [{"from", "to", "label"}]}."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph, edge_columns, node_columns

_PROPS = "map<string,variant>"
_JSON = f"struct<nodes:array<struct<n:long,labels:array<string>,properties:{_PROPS},edges:array<struct<to:long,label:string,properties:{_PROPS}>>>>,edges:array<struct<`from`:long,`to`:long,label:string,properties:{_PROPS}>>>"
#: Properties that have columns of their own.
_OWN = {"schemaNodeId": "schema_node_id", "value": "value", "attributeName": "attribute_name", "attributeIndex": "attribute_index", "entitySchema": "entity_schema", "entityId": "entity_id", "valueType": "value_type", "provenance/source": "source"}


def _strings(props: Column, strip: str) -> Column:
    """A property map with lists of strings as values, and terms without the namespace."""
    texts = lambda v: F.coalesce(F.try_variant_get(v, "$", "array<string>"), F.array(F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v))))
    plain = F.transform_values(F.coalesce(props, F.create_map().cast(_PROPS)), lambda k, v: texts(v))
    return F.transform_keys(plain, lambda k, v: F.regexp_replace(k, strip, "")) if strip else plain


def graph_items(df: DataFrame, text: Column, graph_id: Column, namespace: str = "") -> DataFrame:
    """(graph_id, nodes, edges, error): each text read once, with properties as lists of strings; a text that is not a graph has an error only, a null has nothing."""
    strip = _strip(namespace)
    name = lambda c: F.regexp_replace(c, strip, "") if strip else c
    edge = lambda e, *ends: F.struct(*ends, name(e["label"]).alias("label"), _strings(e["properties"], strip).alias("p"))
    to = lambda e: e["to"].cast("string").alias("to")
    node = lambda n: F.struct(n["n"].cast("string").alias("n"), F.transform(n["labels"], name).alias("labels"), _strings(n["properties"], strip).alias("p"), F.transform(n["edges"], lambda e: edge(e, to(e))).alias("edges"))
    own = df.select(graph_id.cast("string").alias("graph_id"), text.isNotNull().alias("given"), F.try_variant_get(F.try_parse_json(text), "$", _JSON).alias("d"))
    none = F.col("d")["nodes"].isNull()
    edges = F.transform(F.col("d")["edges"], lambda e: edge(e, e["from"].cast("string").alias("from"), to(e)))
    return own.select("graph_id", F.transform(F.col("d")["nodes"], node).alias("nodes"), F.when(~none, edges).alias("edges"), F.when(F.col("given") & none, F.lit("not a graph")).alias("error"))


def _strip(namespace: str) -> str:
    return "^" + "".join("\\" + c if not c.isalnum() else c for c in namespace) if namespace else ""


def graph_of_items(items: DataFrame) -> Graph:
    """The nodes and edges of graph_items."""
    flat = items.select("graph_id", F.explode("nodes").alias("n")).select("graph_id", F.col("n.n").alias("node_id"), "n.labels", "n.p", F.col("n.edges").alias("out"))
    one = lambda k: F.get(F.col("p")[k], F.lit(0))
    kind = F.get(F.filter(F.array(*map(F.lit, ("Value", "Object", "Array"))), lambda k: F.array_contains("labels", k)), F.lit(0))
    columns = {c: (F.col("p")[k] if c in ("entity_id", "value_type") else one(k)) for k, c in _OWN.items()}
    rest = F.map_filter("p", lambda k, v: ~k.isin(list(_OWN)))
    table = flat.select(*node_columns(graph_id=F.col("graph_id"), node_id=F.col("node_id"), labels=F.col("labels"), type=kind, props=rest, **columns))
    nested = flat.select("graph_id", "node_id", F.posexplode("out").alias("i", "e"))
    inner = nested.select(*edge_columns(graph_id=F.col("graph_id"), src=F.col("node_id"), dst=F.col("e.to"), label=F.col("e.label"), ord=F.col("i"), props=F.col("e.p")))
    top = items.select("graph_id", F.posexplode("edges").alias("i", "e"))
    outer = top.select(*edge_columns(graph_id=F.col("graph_id"), src=F.col("e.from"), dst=F.col("e.to"), label=F.col("e.label"), ord=F.col("i"), props=F.col("e.p")))
    return Graph(table, inner.unionByName(outer))


def read_graphs(df: DataFrame, json_col: str, graph_id: Column, namespace: str = "") -> Graph:
    """One graph per JSON text. namespace: a prefix of terms and labels that is stripped. A text that is no graph gives nothing."""
    return graph_of_items(graph_items(df, F.col(json_col), graph_id, namespace))
