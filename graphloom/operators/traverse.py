"""Walks through graphs by predicates, and copies with selectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import natural
from ..graph import Graph
from ..storage import written

_TO = ("node_id", "labels", "schema_node_id", "type", "attribute_name", "attribute_index", "value", "entity_schema", "entity_id", "props")


def _steps(graph: Graph, follow: Column | None, stop_edge: Column | None, stop_node: Column | None, in_entity: bool, up: bool) -> DataFrame:
    """(graph_id, node_id, next, ord, stop, last): the edges that a walk may take, in order, and where it ends.

    stop: the walk ends before the edge is taken; last: it ends at the node the edge leads to.
    """
    here, there = ("dst", "src") if up else ("src", "dst")
    to = graph.nodes.select("graph_id", F.col("node_id").alias(there), F.struct(*_TO).alias("to"))
    edges = graph.edges.join(to, ["graph_id", there])
    no = F.lit(False)
    goes = F.lit(True) if follow is None else F.coalesce(follow, no)
    if in_entity:
        bounds = [a.id for a in graph.layer.attributes() if a.props.get("entitySchema")] if graph.layer is not None else []
        goes = goes & F.col("to.entity_schema").isNull() & ~F.coalesce(F.col("to.schema_node_id").isin(bounds), no)
    stop = no if stop_edge is None else F.coalesce(stop_edge, no)
    last = no if stop_node is None else F.coalesce(stop_node, no)
    order = F.struct(F.coalesce("ord", "to.attribute_index", F.lit(1 << 30)).alias("k"), natural(F.col(there)).alias("name"))
    out = edges.select("graph_id", F.col(here).alias("node_id"), F.col(there).alias("next"), order.alias("ord"), stop.alias("stop"), last.alias("last"), goes.alias("goes"))
    return out.where("goes OR stop").drop("goes")


def walk(
    graph: Graph, roots: Column, follow: Column | None = None, stop_edge: Column | None = None, stop_node: Column | None = None, in_entity: bool = False, up: bool = False, most: int = 100_000
) -> DataFrame:
    """(graph_id, root_id, node_id, level, path): the nodes that a walk from each root visits, each once, with the ids on its way.

    A walk goes depth first, edges in the order of their ordinals, and comes to a node once, on the first such
    way. follow: which edges it takes; stop_edge: an edge at which the whole walk ends; both see the
    edge's columns and the node it leads to as `to`. stop_node: a node that is visited last, by the
    columns of `to`. in_entity: edges to roots of other entities are not taken. up: against the edges.
    The order of visits is that of `place`: (graph_id, root_id, place) sorts them.

    All walks of all graphs grow together, an edge each round, and each round is written. What comes
    after a place at which a walk has ended is given up in the next round. Cycles end, as no way holds
    a node twice. More than `most` rounds are an error.
    """
    key = ["graph_id", "root_id", "node_id"]
    steps = written(_steps(graph, follow, stop_edge, stop_node, in_entity, up))
    no = F.lit(False)
    ends = no if stop_node is None else F.coalesce(stop_node, no)
    start = graph.nodes.where(roots).withColumn("to", F.struct(*_TO)).select("graph_id", F.col("node_id").alias("root_id"), "node_id", ends.alias("last"))
    place = F.array().cast("array<struct<k:int,name:string>>")
    level = written(start.distinct().select(*key, place.alias("place"), F.array("node_id").alias("path"), "last"))
    best, over = level, written(level.where("last").groupBy("graph_id", "root_id").agg(F.min("place").alias("end")))
    for _ in range(most):
        way = F.array_append("place", F.col("ord"))
        new = level.where("NOT last").withColumnRenamed("last", "_l").join(steps, ["graph_id", "node_id"]).where(~F.array_contains("path", F.col("next")))
        new = written(new.select("graph_id", "root_id", F.col("next").alias("node_id"), way.alias("place"), F.array_append("path", F.col("next")).alias("path"), "last", "stop"))
        # of several ways to a node the first in order counts
        first = new.where("NOT stop").groupBy(*key).agg(F.min_by(F.struct("place", "path", "last"), "place").alias("x")).select(*key, "x.*")
        ended = new.where("stop OR last").groupBy("graph_id", "root_id").agg(F.min("place").alias("end"))
        over = written(over.unionByName(ended).groupBy("graph_id", "root_id").agg(F.min("end").alias("end")))
        was = best.select(*key, F.col("place").alias("_was"))
        better = first.join(was, key, "left").where("_was IS NULL OR place < _was").drop("_was")
        level = written(_before(better, over).select(*best.columns))
        if level.isEmpty():
            return _before(best, over).select(*key, (F.size("path") - 1).alias("level"), "path", "place")
        best = written(_before(best.join(level, key, "left_anti"), over).select(*best.columns).unionByName(level))
    raise RuntimeError(f"more than {most} rounds of a walk")


def _before(visits: DataFrame, over: DataFrame) -> DataFrame:
    """The visits up to the place at which their walk ends; an edge that stops it leads nowhere."""
    return visits.join(over, ["graph_id", "root_id"], "left").where("end IS NULL OR place <= end").drop("end")


def copied(
    graph: Graph, nodes: Column | None = None, edges: Column | None = None, node_changes: dict[str, Column] | None = None, edge_changes: dict[str, Column] | None = None, new_id: Column | None = None
) -> tuple[Graph, DataFrame]:
    """(copy, ids): the nodes and edges that two conditions keep, changed column by column, and (graph_id, old_id, new_id).

    node_changes and edge_changes: expressions of the old columns by name of the new one. new_id: the
    copies' ids; two nodes of one graph that get the same id are an error. Edges stay where both their nodes do.
    """
    keep = graph.nodes if nodes is None else graph.nodes.where(nodes)
    own = keep.withColumn("_new", F.col("node_id") if new_id is None else new_id.cast("string"))
    ids = own.select("graph_id", F.col("node_id").alias("old_id"), F.col("_new").alias("new_id"))
    if new_id is not None:
        ids = written(ids)
        twice = ids.groupBy("graph_id", "new_id").agg(F.count("*").alias("n")).where("n > 1").first()
        if twice is not None:
            raise ValueError(f"{twice['n']} nodes of graph {twice['graph_id']} get the id {twice['new_id']}")
    made = own.withColumns(node_changes or {}).withColumn("node_id", F.col("_new"))
    if new_id is not None:
        roots = ids.select("graph_id", F.col("old_id").alias("entity_root_id"), F.col("new_id").alias("_root"))
        made = made.join(roots, ["graph_id", "entity_root_id"], "left").withColumn("entity_root_id", F.coalesce("_root", "entity_root_id"))
    links = graph.edges if edges is None else graph.edges.where(edges)
    links = links.withColumns(edge_changes or {})
    for end in ("src", "dst"):
        links = links.join(ids.withColumnRenamed("old_id", end), ["graph_id", end]).withColumn(end, F.col("new_id")).drop("new_id")
    return graph.with_(nodes=made.select(*graph.nodes.columns), edges=links.select(*graph.edges.columns)), ids


def nodes_of_entity(graph: Graph, roots: Column) -> DataFrame:
    """(graph_id, root_id, node_id, level, path, place) of the nodes of the roots' own entities."""
    return walk(graph, roots, in_entity=True)

