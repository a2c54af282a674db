"""Ingestion: a compiled layer turns rows or JSON documents into nodes and edges.

The layer is walked on the driver into one array expression of node structs per document; the
data goes through a single select and explode. Where a subtree repeats (arrays), the expression
is a transform() of its elements, so nesting costs no join and no shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.types import check
from ..functions.validators import valid
from ..graph import HAS, Graph, edge_columns, node_columns
from ..schema.layer import Attribute, Layer, SchemaError

_ITEM = (
    ("node_id", "string"), ("parent_id", "string"), ("labels", "array<string>"), ("schema_node_id", "string"), ("type", "string"), ("attribute_name", "string"),
    ("attribute_index", "int"), ("value", "string"), ("value_type", "array<string>"), ("entity_schema", "string"), ("entity_id", "array<string>"),
    ("entity_root_id", "string"), ("props", "map<string,array<string>>"), ("edge_label", "string"), ("present", "boolean"), ("error", "string"),
)
#: How deep a recursive schema is followed; data that goes deeper is an error. Other schemas are followed to their end.
MAX_DEPTH = 8


def ingest_as(a: Attribute) -> str:
    return a.one("ingestAs", "node") or "node"


def property_name(a: Attribute) -> str:
    return a.one("propertyName") or a.name or a.id


def edge_label(a: Attribute) -> str:
    """Label of the edge to an attribute's node."""
    if ingest_as(a) == "edge":
        label = a.one("edgeLabel") or a.name or a.one("Reference/label")
        if not label:
            raise SchemaError(f"{a.id}: no label for its edge")
        return label
    return a.one("outputEdgeLabel") or HAS


def _item(**given) -> Column:
    out = []
    for name, kind in _ITEM:
        value = given.get(name)
        if value is None:
            value = F.create_map() if name == "props" else F.lit(None)
        elif not isinstance(value, Column):
            value = F.array(*map(F.lit, value)) if isinstance(value, list) else F.lit(value)
        out.append(value.cast(kind).alias(name))
    return F.struct(*out)


def recursive(a: Attribute) -> bool:
    """Whether an attribute stands below itself."""
    seen, todo = set(), list(a.children)
    while todo:
        x = todo.pop()
        if x is a:
            return True
        if id(x) not in seen:
            seen.add(id(x))
            todo += x.children
    return False


class _Flat:
    """Values are columns of a row."""

    def __init__(self, columns: dict[str, str], index: dict[int, str], nulls: bool):
        self.columns, self.index, self.nulls = columns, index, nulls

    def column(self, a: Attribute) -> str | None:
        if a.name:
            return self.columns.get(a.name)
        at = a.one("attributeIndex")
        return self.index.get(int(at)) if at else None

    def child(self, a: Attribute, of: Column | None) -> Column:
        name = self.column(a)
        return F.lit(None).cast("string") if name is None else F.trim(F.col(f"`{name}`").cast("string"))

    def text(self, v: Column) -> Column:
        return v

    def present(self, v: Column) -> Column:
        return F.lit(True) if self.nulls else F.coalesce(v != "", F.lit(False))

    def is_kind(self, v: Column, kind: str) -> Column:
        return F.lit(kind == "Value")


class _Variant:
    """Values are variants; fields and elements are taken as they are needed."""

    def __init__(self, nulls: bool):
        self.nulls = nulls

    def child(self, a: Attribute, of: Column) -> Column:
        return F.try_variant_get(of, "$['" + a.name.replace("'", "\\'") + "']", "variant")

    def text(self, v: Column) -> Column:
        return F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v))

    def present(self, v: Column) -> Column:
        return v.isNotNull() if self.nulls else v.isNotNull() & ~F.is_variant_null(v)

    def is_kind(self, v: Column, kind: str) -> Column:
        of = F.substring_index(F.schema_of_variant(v), "<", 1)  # a schema is long where its value is, so it is made once
        if kind in ("Object", "Array"):
            return F.coalesce(of == kind.upper(), F.lit(False))
        return F.coalesce(~of.isin("OBJECT", "ARRAY"), F.lit(False))


class _Walk:
    """typed: values that are none of their attribute's type are in error."""

    def __init__(self, source, only_schema: bool, typed: bool = False):
        self.source, self.only_schema, self.typed = source, only_schema, typed

    def mistyped(self, a: Attribute, value, kinds: bool) -> Column | None:
        """What is wrong with a value, as text; null if nothing is."""
        wrong = [F.when(~self.source.is_kind(value, a.kind), F.lit(f"{a.id}: not a {a.kind}"))] if kinds else []
        if self.typed and a.kind == "Value" and a.one("valueType"):
            text = self.source.text(value)
            fits = F.coalesce(text == "", F.lit(False)) | check(a.one("valueType"), text)
            wrong.append(F.when(~fits, F.concat(F.lit(f"{a.id}: not a {a.one('valueType')}: "), text)))
        return F.coalesce(*wrong) if wrong else None

    def entity_id(self, a: Attribute, value) -> Column | None:
        """Values of the entity's id fields that stand in its own scope; null unless all are there."""
        fields = a.many("entityIdFields")
        if not fields:
            return None
        found = []
        for f in fields:
            at = next((x for x in a.walk() if x.id == f), None)
            if at is None:
                raise SchemaError(f"{a.id}: id field {f} is not below it")
            if at is a:
                found.append(self.source.text(value))
                continue
            steps, v = [], value
            while at is not a:
                steps.append(at)
                at = at.parent
            if any(s.kind == "Array" for s in steps):
                raise SchemaError(f"{a.id}: id field {f} repeats")
            for s in reversed(steps):
                v = self.source.child(s, v)
            found.append(self.source.text(v))
        whole = reduce(lambda x, y: x & y, [self.source.present(v) if isinstance(self.source, _Flat) else v.isNotNull() for v in found])
        return F.when(whole, F.array(*found))

    def properties(self, a: Attribute, value) -> Column | None:
        """Properties that attributes below leave on a's node, in a's own scope."""
        out = []

        def below(x: Attribute, v, nearest: Attribute, above: tuple = ()):
            for c in x.children if not any(x is y for y in above) else ():
                own = self.source.child(c, v)
                if c.kind == "Value" and ingest_as(c) == "property":
                    if (c.one("asPropertyOf") or nearest.id) == a.id:
                        out.append(F.struct(F.lit(property_name(c)).alias("key"), F.array(self.source.text(own)).alias("value"), self.source.present(own).alias("present")))
                elif c.kind == "Object":
                    below(c, own, nearest if ingest_as(c) == "none" else c, (*above, x))

        below(a, value, a)
        if not out:
            return None
        kept = F.filter(F.array(*out), lambda e: e["present"])
        return F.map_from_entries(F.transform(kept, lambda e: F.struct(e["key"], e["value"])))

    def items(self, a: Attribute, value, node_id: Column, parent_id, root_id, index, depth: int, here: Column) -> list[Column]:
        """Arrays of item structs for a's node and all below; `here`: whether a's value stands in the data."""
        if depth > MAX_DEPTH and recursive(a):
            deeper = F.raise_error(F.concat(node_id, F.lit(f": deeper than the {MAX_DEPTH} levels to which {a.id} is followed")))
            return [F.array(_item(node_id=node_id, schema_node_id=a.id, present=F.when(here, deeper.cast("boolean")).otherwise(F.lit(False))))]
        if a.kind == "Polymorphic":
            return self.choice(a, value, node_id, parent_id, root_id, index, depth, here)
        mode = ingest_as(a)
        if mode == "property" and a.kind == "Value":
            return []
        is_entity = bool(a.props.get("entitySchema"))
        own_root = node_id if is_entity or root_id is None else root_id
        container = a.kind in ("Object", "Array")
        types = a.many("valueType")
        out: list[Column] = []
        if mode != "none":
            if mode == "edge" and parent_id is None:
                raise SchemaError(f"{a.id}: a root cannot be an edge")
            wrong = self.mistyped(a, value, not isinstance(self.source, _Flat)) if value is not None else None
            out.append(
                F.array(
                    _item(
                        node_id=node_id, parent_id=parent_id, labels=["DocumentNode", a.kind, *a.labels, *types], schema_node_id=a.id, type=a.kind, attribute_name=a.name or None,
                        attribute_index=index, value=None if container else self.source.text(value), value_type=types, entity_schema=a.one("entitySchema") or None,
                        entity_id=self.entity_id(a, value) if is_entity else None, entity_root_id=own_root, props=self.properties(a, value) if container else None,
                        edge_label=edge_label(a) if parent_id is not None else None, present=here, error=wrong,
                    )
                )
            )
        under = node_id if mode != "none" else parent_id
        if a.kind == "Object":
            for k, c in enumerate(a.children):
                v = self.source.child(c, value)
                inside = c.kind == "Object" and isinstance(self.source, _Flat)  # a flat row holds the fields of nested objects too
                below = F.concat(node_id, F.lit("." + (c.name or str(k))))
                if isinstance(self.source, _Variant):
                    out += self.once(v, below, here, lambda x, own, c=c, k=k: self.items(c, x, own, under, own_root, F.lit(k), depth + 1, F.lit(True)))
                else:
                    out += self.items(c, v if not inside else value, below, under, own_root, F.lit(k), depth + 1, here & (F.lit(True) if inside else self.source.present(v)))
            if not self.only_schema and isinstance(self.source, _Variant):
                known = [c.name for c in a.children]
                fields = F.map_entries(F.map_filter(F.try_variant_get(value, "$", "map<string,variant>"), lambda k, v: ~k.isin(known) & ~F.is_variant_null(v)))
                count = len(known)
                extra = F.transform(
                    fields,
                    lambda e, i: _item(node_id=F.concat(node_id, F.lit("."), e["key"]), parent_id=under, labels=["DocumentNode", "Value"], type="Value", attribute_name=e["key"], attribute_index=i + count, value=self.source.text(e["value"]), entity_root_id=own_root, edge_label=HAS, present=here),
                )
                out.append(F.coalesce(extra, F.array().cast(extra_type())))
        elif a.kind == "Array" and isinstance(self.source, _Variant) and a.children:
            element = a.children[0]
            values = F.try_variant_get(value, "$", "array<variant>")

            def each(x, i):
                inner = self.once(x, F.concat(node_id, F.lit("."), i.cast("string")), here, lambda v, own: self.items(element, v, own, under, own_root, i, depth + 1, F.lit(True)))
                return inner[0] if inner else F.array().cast(extra_type())

            out.append(F.coalesce(F.flatten(F.transform(values, each)), F.array().cast(extra_type())))
        return out

    def once(self, value: Column, node_id: Column, here: Column, make) -> list[Column]:
        """What make(value, node_id) gives, as one array; an empty one where the value is not there.

        The value is an element of an array of one: it is taken from its document once, however
        often its items use it, and nothing below it is looked for where it is not there.
        """
        made = None

        def each(x):
            nonlocal made
            made = make(x["value"], x["id"])
            return F.flatten(F.array(*made)) if made else F.array().cast(extra_type())

        there = F.filter(F.array(F.struct(value.alias("value"), node_id.alias("id"))), lambda x: here & self.source.present(x["value"]))
        out = F.flatten(F.transform(there, each))
        return [out] if made else []

    def choice(self, a, value, node_id, parent_id, root_id, index, depth, here) -> list[Column]:
        """Exactly one option must be valid."""
        fits = [self.valid_option(o, value) for o in a.children]
        count = reduce(lambda x, y: x + y, [f.cast("int") for f in fits])
        out = [F.array(_item(node_id=node_id, parent_id=parent_id, schema_node_id=a.id, type="Polymorphic", present=here & (count != 1), error=F.format_string(f"{a.id}: %d options fit", count)))]
        for o, fit in zip(a.children, fits, strict=True):
            named = Attribute(o.id, o.kind, {"attributeName": a.name, **o.props}, o.labels, o.children)
            out += self.items(named, value, node_id, parent_id, root_id, index, depth + 1, here & fit & (count == 1))
        return out

    def valid_option(self, o: Attribute, value) -> Column:
        out = self.source.is_kind(value, o.kind)
        if o.kind == "Object":
            for c in o.children:
                v = self.source.child(c, value)
                out = out & (~self.source.present(v) | (self.source.is_kind(v, c.kind) & (valid(c, self.source.text(v)) if c.kind == "Value" else F.lit(True))))
            for name in o.many("validation/required"):
                out = out & self.source.present(self.source.child(Attribute("", "Value", {"attributeName": name}), value))
        elif o.kind == "Value":
            out = out & valid(o, self.source.text(value))
        return F.coalesce(out, F.lit(False))


def extra_type() -> str:
    return "array<struct<" + ",".join(f"{n}:{k}" for n, k in _ITEM) + ">>"


def graph_of(items: DataFrame, layer: Layer) -> Graph:
    """Exploded items (graph_id, source, item) as a graph; items in error are left out (see errors())."""
    flat = items.select("graph_id", "source", "item.*").where("present")
    good = flat.where("error IS NULL")
    names = [n for n, _ in _ITEM if n not in ("parent_id", "edge_label", "present", "error")]
    nodes = good.select(*node_columns(graph_id=F.col("graph_id"), source=F.col("source"), **{n: F.col(n) for n in names}))
    edges = good.where("parent_id IS NOT NULL").select(*edge_columns(graph_id=F.col("graph_id"), src=F.col("parent_id"), dst=F.col("node_id"), label=F.col("edge_label"), ord=F.col("attribute_index")))
    return Graph(nodes, edges, layer, items, lambda written: graph_of(written, layer))


def _exploded(df: DataFrame, layer: Layer, graph_id: Column, source: Column, arrays: list[Column]) -> DataFrame:
    whole = F.flatten(F.array(*arrays))
    return df.select(graph_id.cast("string").alias("graph_id"), source.cast("string").alias("source"), F.explode(whole).alias("item"))


def flat_items(df: DataFrame, layer: Layer, graph_id: Column, source: Column | None = None, ingest_nulls: bool = False, only_schema: bool = True, base_id: Column | None = None, helpers: tuple[str, ...] = (), typed: bool = False) -> DataFrame:
    cells = [c for c in df.columns if c not in helpers]
    by_name: dict[str, str] = {c: c for c in cells}
    index = dict(enumerate(cells))
    names = [a.name for a in layer.attributes() if a.kind == "Value" and a.name]
    for n in set(names):
        if names.count(n) > 1 and n in by_name:
            raise SchemaError(f"more than one attribute is named {n}")
    walk = _Walk(_Flat(by_name, index, ingest_nulls), only_schema, typed)
    base = graph_id.cast("string") if base_id is None else base_id.cast("string")
    some = [walk.source.present(walk.source.child(a, None)) for a in layer.attributes() if a.kind == "Value" and walk.source.column(a) is not None]
    extras = [] if only_schema else [c for c in cells if c not in set(names)]
    some += [walk.source.present(F.trim(F.col(f"`{c}`").cast("string"))) for c in extras]
    here = reduce(lambda x, y: x | y, some) if some else F.lit(False)
    arrays = walk.items(layer.root, None, base, None, None, F.lit(0), 0, here)
    if extras:
        offset = len(layer.root.children)
        arrays.append(F.array(*(_item(node_id=F.concat(base, F.lit(f".{c}")), parent_id=base, labels=["DocumentNode", "Value"], type="Value", attribute_name=c, attribute_index=offset + k, value=F.trim(F.col(f"`{c}`").cast("string")), entity_root_id=base, edge_label=HAS, present=walk.source.present(F.trim(F.col(f"`{c}`").cast("string")))) for k, c in enumerate(extras))))
    return _exploded(df, layer, graph_id, F.lit(None) if source is None else source, arrays)


def ingest_rows(df: DataFrame, layer: Layer, graph_id: Column, source: Column | None = None, ingest_nulls: bool = False, only_schema: bool = True, base_id: Column | None = None, helpers: tuple[str, ...] = ()) -> Graph:
    """One graph per row (by graph_id): an entity root and a node for each non-empty cell.

    Cells are trimmed and matched by attribute name, or by attributeIndex where an attribute has
    no name. Cells of columns without attribute become untyped nodes unless only_schema. A row
    without any cell gives nothing. base_id: the root's node id, if it is not the graph's. helpers:
    columns that are no cells.
    """
    return graph_of(flat_items(df, layer, graph_id, source, ingest_nulls, only_schema, base_id, helpers), layer)


def json_items(df: DataFrame, layer: Layer, json_col: str, graph_id: Column, source: Column | None = None, ingest_nulls: bool = False, only_schema: bool = False, base_id: Column | None = None, typed: bool = False) -> DataFrame:
    parsed = df.withColumn("_doc", F.try_parse_json(json_col))
    walk = _Walk(_Variant(ingest_nulls), only_schema, typed)
    base = graph_id.cast("string") if base_id is None else base_id.cast("string")
    arrays = walk.once(F.col("_doc"), base, F.lit(True), lambda doc, own: walk.items(layer.root, doc, own, None, None, F.lit(0), 0, F.lit(True)))
    broken = F.array(_item(node_id=base, type="Document", present=F.col("_doc").isNull() & F.col(json_col).isNotNull(), error=F.lit("not JSON")))
    return _exploded(parsed, layer, graph_id, F.lit(None) if source is None else source, [broken, *arrays])


def ingest_json(df: DataFrame, layer: Layer, json_col: str, graph_id: Column, source: Column | None = None, ingest_nulls: bool = False, only_schema: bool = False, base_id: Column | None = None) -> Graph:
    """One graph per JSON document, by the layer: objects, arrays, polymorphic choices.

    Fields without attribute become untyped nodes unless only_schema; nulls are skipped unless
    ingest_nulls; of a Polymorphic exactly one option must be valid. Values whose JSON type
    disagrees with the layer are left out of the graph and listed by json_errors().
    """
    return graph_of(json_items(df, layer, json_col, graph_id, source, ingest_nulls, only_schema, base_id), layer)


def errors(items: DataFrame) -> DataFrame:
    """(graph_id, node_id, schema_node_id, error) of items in error."""
    return items.select("graph_id", "item.*").where("present AND error IS NOT NULL").select("graph_id", "node_id", "schema_node_id", "error")


def raise_errors(items: DataFrame) -> DataFrame:
    """Strict mode: the first item in error stops the job."""
    return items.withColumn("item", F.when(F.col("item.present") & F.col("item.error").isNotNull(), F.raise_error("item.error").cast(items.schema["item"].dataType)).otherwise(F.col("item")))
