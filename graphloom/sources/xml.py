"""XML documents by a layer: elements, attributes, arrays, polymorphic choices, white-space facets.

Mixed content and namespaces do not fit Spark's XML reader, so documents are walked in Python,
in Arrow batches; each document is bounded by itself and the work has no shuffle.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ElementTree
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import HAS, Graph, edge_columns, node_columns
from ..operators.ingest import edge_label, ingest_as
from ..schema.layer import Attribute, Layer

_ITEMS = "graph_id string, node_id string, parent_id string, labels array<string>, schema_node_id string, type string, attribute_name string, attribute_index int, value string, value_type array<string>, entity_schema string, entity_root_id string, edge_label string, error string"


def _split(tag: str) -> tuple[str, str]:
    return tuple(tag[1:].split("}", 1)) if tag.startswith("{") else ("", tag)


def named(a: Attribute, tag: str) -> bool:
    """Namespace and local name agree, or the local name alone where the layer has no namespace."""
    space, local = _split(tag)
    return a.name == local and (not a.one("xml/ns") or a.one("xml/ns") == space)


def facet(text: str, how: str) -> str:
    if how == "preserve":
        return text
    text = re.sub(r"[\t\n\r]", " ", text)
    return text if how == "replace" else re.sub(" +", " ", text).strip(" ")


class _Walker:
    def __init__(self, layer: Layer, only_schema: bool):
        self.layer, self.only_schema = layer, only_schema

    def document(self, graph_id: str, base: str, text: str | None) -> Iterator[tuple]:
        self.graph_id = graph_id
        try:
            root = ElementTree.fromstring(text or "")
        except ElementTree.ParseError as e:
            yield self.row(base, None, None, "Document", None, 0, None, None, error=f"not XML: {e}")
            return
        yield from self.element(self.layer.root, root, base, None, None, 0, "collapse", top=True)

    def row(self, node_id, parent_id, a, kind, name, index, value, root_id, error=None):
        labels = ["DocumentNode", kind, *(a.labels if a else [])]
        types = a.many("valueType") if a else []
        label = None if parent_id is None else edge_label(a) if a else HAS
        return (self.graph_id, node_id, parent_id, labels, a.id if a else None, kind, name, index, value, types, a.one("entitySchema") or None if a else None, root_id, label, error)

    def text_of(self, e, how: str) -> str:
        return facet((e.text or "") + "".join(c.tail or "" for c in e), how)

    def fits(self, a: Attribute, e) -> bool:
        """Whether an element can be an attribute: values have no children, and enumerations hold."""
        if a.kind == "Value":
            how = "collapse"
            value = e.get(a.one("xml/valueAttr")) if a.one("xml/valueAttr") else self.text_of(e, how)
            allowed = a.many("validation/enumeration")
            return not len(e) and value is not None and (not allowed or value in allowed) and (not a.one("validation/pattern") or bool(re.search(a.one("validation/pattern"), value)))
        if a.kind == "Object":
            names = {c.name for c in a.children if not c.one("xml/attribute")}
            attributes = {c.name for c in a.children if c.one("xml/attribute")}
            return all(_split(c.tag)[1] in names for c in e) and all(_split(k)[1] in attributes for k in e.keys())
        return True

    def element(self, a: Attribute | None, e, node_id: str, parent_id, root_id, index: int, how: str, top: bool = False) -> Iterator[tuple]:
        how = e.get("whiteSpace") or e.get("{http://www.w3.org/2001/XMLSchema}whiteSpace") or how
        name = _split(e.tag)[1]
        if a is not None and a.kind == "Polymorphic":
            fit = [o for o in a.children if self.fits(o, e)]
            if len(fit) > 1:
                yield self.row(node_id, parent_id, None, "Value", name, index, None, root_id, error=f"{a.id}: {len(fit)} options fit")
                return
            a = fit[0] if fit else None
            if a is not None and not a.name:
                a = Attribute(a.id, a.kind, {**a.props, "attributeName": name}, a.labels, a.children)
        if a is None:
            if self.only_schema:
                return
            if not len(e) and not e.keys():
                yield self.row(node_id, parent_id, None, "Value", name, index, self.text_of(e, how), root_id)
                return
            yield self.row(node_id, parent_id, None, "Object", name, index, None, root_id)
            yield from self.inside(None, e, node_id, root_id, how)
            return
        mode = ingest_as(a)
        own_root = node_id if a.one("entitySchema") or root_id is None else root_id
        if a.kind == "Value":
            value = e.get(a.one("xml/valueAttr")) if a.one("xml/valueAttr") else self.text_of(e, how)
            if value is not None and mode != "none":
                yield self.row(node_id, parent_id, a, "Value", name, index, value, own_root)
            return
        if mode != "none":
            yield self.row(node_id, parent_id, a, a.kind, name, index, None, own_root)
        yield from self.inside(a, e, node_id if mode != "none" else parent_id, own_root, how)

    def inside(self, a: Attribute | None, e, node_id: str, root_id, how: str) -> Iterator[tuple]:
        index = 0
        children = a.children if a is not None else []
        if a is not None and a.kind == "Array":
            for k, c in enumerate(e):
                yield from self.element(children[0] if children else None, c, f"{node_id}.{k}", node_id, root_id, k, how)
            return
        for key, value in e.items():
            own = next((c for c in children if c.one("xml/attribute") and named(c, key)), None)
            if own is not None or not self.only_schema:
                local = _split(key)[1]
                if local != "whiteSpace":
                    yield self.row(f"{node_id}.{local}", node_id, own, "Value", local, index, facet(value, how), root_id)
                    index += 1
        count: dict[str, int] = {}
        for c in e:
            local = _split(c.tag)[1]
            n = count[local] = count.get(local, -1) + 1
            own = next((x for x in children if not x.one("xml/attribute") and named(x, c.tag)), None)
            yield from self.element(own, c, f"{node_id}.{local}" + (f".{n}" if n else ""), node_id, root_id, index, how)
            index += 1
        text = self.text_of(e, how)
        if text and not self.only_schema:
            yield self.row(f"{node_id}.#text", node_id, None, "Value", None, index, text, root_id)


def ingest_xml(df: DataFrame, layer: Layer, xml_col: str, graph_id: Column, only_schema: bool = False) -> Graph:
    """One graph per XML document; documents that are not XML, and ambiguous choices, are left out (xml_errors lists them)."""
    return xml_graph(xml_items(df, layer, xml_col, graph_id, only_schema), layer)


def xml_graph(items: DataFrame, layer: Layer) -> Graph:
    items = items.where("error IS NULL")
    names = [c.split()[0] for c in _ITEMS.split(", ")]
    keep = [n for n in names if n not in ("graph_id", "parent_id", "edge_label", "error")]
    nodes = items.select(*node_columns(graph_id=F.col("graph_id"), **{n: F.col(n) for n in keep}))
    edges = items.where("parent_id IS NOT NULL").select(*edge_columns(graph_id=F.col("graph_id"), src=F.col("parent_id"), dst=F.col("node_id"), label=F.col("edge_label"), ord=F.col("attribute_index")))
    return Graph(nodes, edges, layer)


def xml_items(df: DataFrame, layer: Layer, xml_col: str, graph_id: Column, only_schema: bool = False) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = df.sparkSession.createDataFrame([], _ITEMS).schema
    arrow = to_arrow_schema(schema)

    def run(batches):
        walker = _Walker(layer, only_schema)
        for batch in batches:
            rows = [r for g, x in zip(*(c.to_pylist() for c in batch.columns), strict=True) for r in walker.document(g, g, x)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return df.select(graph_id.cast("string").alias("g"), F.col(xml_col).alias("x")).mapInArrow(run, schema)


def xml_errors(df: DataFrame, layer: Layer, xml_col: str, graph_id: Column) -> DataFrame:
    return xml_items(df, layer, xml_col, graph_id).where("error IS NOT NULL").select("graph_id", "node_id", "error")
