"""Foreign-key links between entities, as equi-joins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import HAS, Graph, edge_columns, node_columns
from ..schema.layer import Attribute, Layer, SchemaError
from ..storage import written


@dataclass(frozen=True)
class LinkSpec:
    attribute: Attribute
    parent_id: str
    target: str
    fk: tuple[str, ...]
    label: str
    forward: bool
    multi: bool
    as_edge: bool
    value_node: bool
    link_node: str


def link_specs(layer: Layer) -> list[LinkSpec]:
    """Links that the layer declares: attributes with a direction and a target (ref or fkFor)."""
    out = []
    for a in layer.attributes():
        target, direction = a.one("Reference/ref") or a.one("Reference/fkFor") or a.one("Reference/target"), a.one("Reference/dir")
        if not target or not direction:
            continue
        if direction not in ("to", "toTarget", "from", "fromTarget"):
            raise SchemaError(f"{a.id}: direction {direction}")
        mode = a.one("ingestAs", "node") or "node"
        if a.kind == "Reference" and mode not in ("node", "edge"):
            raise SchemaError(f"{a.id}: a link is a node or an edge")
        label = a.one("Reference/label") or a.name
        if not label:
            raise SchemaError(f"{a.id}: a link needs a label")
        fk = tuple(a.many("Reference/fk")) or ((a.id,) if a.kind == "Value" else ())
        parent = a.parent.id if a.parent is not None else ""
        out.append(LinkSpec(a, parent, target, fk, label, direction.startswith("to"), a.one("Reference/multi") != "false", mode == "edge", a.kind == "Value", a.one("Reference/linkNode")))
    return out


def entity_index(graph: Graph) -> DataFrame:
    """(graph_id, entity, entity_id, target_id): entities by their schema and by each of their labels."""
    names = F.array_distinct(F.array_compact(F.concat(F.array("entity_schema", "schema_node_id"), F.filter("labels", lambda x: ~x.isin("DocumentNode", "Object", "Array", "Value")))))
    roots = graph.nodes.where("entity_schema IS NOT NULL")
    return roots.select("graph_id", F.explode(names).alias("entity"), "entity_id", F.col("node_id").alias("target_id"))


def foreign_keys(graph: Graph, spec: LinkSpec) -> DataFrame:
    """(graph_id, entity_root_id, n, fk): key vectors of each entity, its n-th values zipped.

    A key attribute may repeat within an entity; all must repeat equally often.
    """
    own = graph.nodes.where(F.col("schema_node_id").isin(list(spec.fk)) & F.col("value").isNotNull())
    by_attribute = own.groupBy("graph_id", "entity_root_id", "schema_node_id").agg(F.sort_array(F.collect_list(F.struct("attribute_index", "node_id", "value"))).alias("v"))
    vectors = by_attribute.groupBy("graph_id", "entity_root_id").agg(F.map_from_entries(F.collect_list(F.struct("schema_node_id", "v.value"))).alias("m"))
    parts = [F.col("m")[f] for f in spec.fk]
    count = F.greatest(*[F.coalesce(F.size(p), F.lit(0)) for p in parts], F.lit(0))
    same = F.least(*[F.coalesce(F.size(p), F.lit(0)) for p in parts], count) == count
    checked = F.when(same, count).otherwise(F.raise_error(F.lit(f"{spec.attribute.id}: foreign key parts differ in number")).cast("int"))
    key = F.explode(F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.struct(i.alias("n"), F.array(*[p[i] for p in parts]).alias("fk"))))
    found = vectors.withColumn("_n", checked).where("_n > 0").select("graph_id", "entity_root_id", key.alias("k"))
    return found.select("graph_id", "entity_root_id", "k.n", "k.fk")


def unique_edges(edges: DataFrame) -> DataFrame:
    """Edges of equal ends and label become one; of a property that several have, the last by value holds."""
    some = edges.groupBy("graph_id", "src", "dst", "label").agg(F.min("ord").alias("ord"), F.array_sort(F.flatten(F.collect_list(F.map_entries("props")))).alias("_p"))
    last = F.aggregate("_p", F.create_map().cast("map<string,array<string>>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, v: k != e["key"]), F.map_from_entries(F.array(e))))
    return some.select(*edge_columns(graph_id=F.col("graph_id"), src=F.col("src"), dst=F.col("dst"), label=F.col("label"), ord=F.col("ord"), props=last))


def matched(graph: Graph, spec: LinkSpec) -> DataFrame:
    """(graph_id, entity_root_id, parent_id, doc_id, doc_props, target_id) of a spec's links.

    doc_id is the node of the link's own attribute below the parent, where the data had one.
    """
    parents = graph.nodes.where(F.col("schema_node_id") == spec.parent_id).select("graph_id", F.col("node_id").alias("parent_id"), "entity_root_id")
    if len(spec.fk) == 1:  # each value is a key, so none have to meet
        keys = graph.nodes.where((F.col("schema_node_id") == spec.fk[0]) & F.col("value").isNotNull()).select("graph_id", "entity_root_id", F.array("value").alias("fk"))
    else:
        keys = foreign_keys(graph, spec)
    targets = entity_index(graph).where(F.col("entity") == spec.target).select("graph_id", F.col("entity_id").alias("fk"), "target_id")
    out = parents.join(keys, ["graph_id", "entity_root_id"]).join(targets, ["graph_id", "fk"])
    if spec.value_node:  # its link starts at the entity, not at a node of the reference
        out = out.withColumns({"doc_id": F.lit(None).cast("string"), "doc_props": F.lit(None).cast("map<string,array<string>>")})
    else:
        docs = graph.children(spec.attribute.id).select("graph_id", "parent_id", F.col("node_id").alias("doc_id"), F.col("props").alias("doc_props"))
        out = out.join(docs, ["graph_id", "parent_id"], "left")
    if not spec.multi:
        many = out.groupBy("graph_id", "parent_id", "fk").agg(F.count_distinct("target_id").alias("_c"))
        out = out.join(many, ["graph_id", "parent_id", "fk"]).withColumn("target_id", F.when(F.col("_c") == 1, F.col("target_id")).otherwise(F.raise_error(F.lit(f"{spec.attribute.id}: more than one target"))))
    return out.select("graph_id", "entity_root_id", "parent_id", "doc_id", "doc_props", "target_id")


def link(graph: Graph, specs: list[LinkSpec] | None = None) -> Graph:
    """The graph with the edges of all specs (default: the layer's).

    A value attribute links its entity root (or linkNode); a reference links its parent directly
    (ingestAs edge: the reference's own node goes, its properties move to the edge) or through a
    node of its own, which is made where it is missing. Edges are unique.

    Nodes are written once, and edges too where a spec looks at them; after that only what is new is
    written, so steps that follow read tables and no link is worked out twice. Streams are left lazy.
    """
    specs = link_specs(graph.layer) if specs is None else specs
    if not specs:
        return graph
    keep = written if not (graph.nodes.isStreaming or graph.edges.isStreaming) else lambda df: df
    graph = graph.with_(nodes=keep(graph.nodes))  # each spec reads them several times
    if not all(spec.value_node for spec in specs):
        graph = graph.with_(edges=keep(graph.edges))
    for spec in specs:
        found = matched(graph, spec)
        empty = F.create_map().cast("map<string,array<string>>")
        nodes, edges = graph.nodes, graph.edges
        if spec.value_node:
            near = F.col("entity_root_id")
            if spec.link_node:
                own = graph.nodes.where(F.col("schema_node_id") == spec.link_node).groupBy("graph_id", "entity_root_id").agg(F.min("node_id").alias("_near"))
                found = found.join(own, ["graph_id", "entity_root_id"], "left")
                near = F.coalesce("_near", "entity_root_id")
            props = empty
        elif spec.as_edge:
            near, props = F.col("parent_id"), F.coalesce("doc_props", empty)
            gone = graph.instances(spec.attribute.id).select("graph_id", "node_id")
            nodes = nodes.where(F.coalesce(F.col("schema_node_id") != spec.attribute.id, F.lit(True)))
            edges = edges.join(gone.withColumnRenamed("node_id", "dst"), ["graph_id", "dst"], "left_anti").select(*edges.columns)
        else:
            made = F.concat("parent_id", F.lit("." + (spec.attribute.name or spec.label)))
            near, props = F.coalesce("doc_id", made), empty
            new = keep(found.where("doc_id IS NULL").select("graph_id", "entity_root_id", "parent_id", made.alias("node_id")).distinct())
            nodes = nodes.unionByName(new.select(*node_columns(graph_id=F.col("graph_id"), node_id=F.col("node_id"), labels=F.array(F.lit("DocumentNode"), F.lit("Reference")), schema_node_id=spec.attribute.id, type="Reference", attribute_name=spec.attribute.name or None, entity_root_id=F.col("entity_root_id"))))
            edges = edges.unionByName(new.select(*edge_columns(graph_id=F.col("graph_id"), src=F.col("parent_id"), dst=F.col("node_id"), label=HAS)))
        ends = (near, F.col("target_id")) if spec.forward else (F.col("target_id"), near)
        links = found.select(*edge_columns(graph_id=F.col("graph_id"), src=ends[0], dst=ends[1], label=spec.label, props=props))
        graph = graph.with_(nodes=nodes, edges=edges.unionByName(keep(unique_edges(links))))
    return graph
