"""A labeled property graph as two DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema.layer import SCHEMA_NODES, Layer

NODES = (
    "graph_id string, node_id string, labels array<string>, schema_node_id string, type string, attribute_name string, attribute_index int, "
    "value string, value_type array<string>, entity_schema string, entity_id array<string>, entity_root_id string, source string, props map<string,array<string>>"
)
EDGES = "graph_id string, src string, dst string, label string, ord int, props map<string,array<string>>"
HAS = "has"


@dataclass(frozen=True)
class Graph:
    """nodes and edges with the columns of NODES and EDGES; many small graphs share them by graph_id.

    Operators look within one graph_id unless they say otherwise. items: the one table that both
    are read off, where there is one (an ingestion as it is), and read: how they are.
    """

    nodes: DataFrame
    edges: DataFrame
    layer: Layer | None = None
    items: DataFrame | None = None
    read: Callable[[DataFrame], Graph] | None = None

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    def with_(self, **changes) -> Graph:
        if {"nodes", "edges"} & set(changes):  # they are no longer those of the items
            changes = {"items": None, "read": None} | changes
        return replace(self, **changes)

    def instances(self, attribute_id: str) -> DataFrame:
        return self.nodes.where(F.col("schema_node_id") == attribute_id)

    def union(self, other: Graph) -> Graph:
        return self.with_(nodes=self.nodes.unionByName(other.nodes), edges=self.edges.unionByName(other.edges))

    def subgraph(self, keep) -> Graph:
        """The nodes that a condition keeps and the edges between them."""
        nodes = self.nodes.where(keep)
        ids = nodes.select("graph_id", F.col("node_id").alias("_id"))
        edges = self.edges
        for end in ("src", "dst"):
            own = sized(ids.withColumnRenamed("_id", end))
            edges = edges.join(own, ["graph_id", end], "left_semi")
        return self.with_(nodes=nodes, edges=edges.select(*self.edges.columns))

    def children(self, attribute_id: str | None = None) -> DataFrame:
        """Child nodes with their parents' ids (parent_id), over all edges."""
        nodes = self.nodes if attribute_id is None else self.instances(attribute_id)
        ends = self.edges.select("graph_id", F.col("src").alias("parent_id"), F.col("dst").alias("node_id"), F.col("label").alias("edge_label"), "ord")
        return nodes.join(sized(ends), ["graph_id", "node_id"])

    def stored(self, name: str, buckets: int) -> Graph:
        """The graph written as tables <name>_nodes and <name>_edges, bucketed and sorted by graph_id.

        Steps after it read it instead of planning the ingestion again for each use, and joins
        and aggregates within graphs then need no shuffle, as all their keys start with
        graph_id (the session is told that these keys need not all be hashed).
        """
        self.spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        out = []
        for part, df in (("nodes", self.nodes), ("edges", self.edges)):
            df.write.mode("overwrite").bucketBy(buckets, "graph_id").sortBy("graph_id").saveAsTable(f"{name}_{part}")
            out.append(self.spark.table(f"{name}_{part}"))
        return self.with_(nodes=out[0], edges=out[1])

    def held(self) -> Graph:
        """The graph written once to the shared folder and read back.

        A lazy graph is planned again from its source at each use, so operators that use their
        graph several times hold it first. An ingestion is run once for both tables. Streams are left as they are.
        """
        from .storage import written

        if self.nodes.isStreaming or self.edges.isStreaming:
            return self
        if self.items is not None:
            found = self.read(written(self.items.where("item.present")))
            return self.with_(nodes=found.nodes, edges=found.edges)
        return self.with_(nodes=written(self.nodes), edges=written(self.edges))

    def global_scope(self) -> Graph:
        """All graphs as one: node ids get their graph's id in front."""
        name = lambda c: F.concat_ws("|", "graph_id", c)
        one = F.lit("")
        nodes = self.nodes.withColumns({"node_id": name("node_id"), "entity_root_id": F.when(F.col("entity_root_id").isNotNull(), name("entity_root_id"))}).withColumn("graph_id", one)
        edges = self.edges.withColumns({"src": name("src"), "dst": name("dst")}).withColumn("graph_id", one)
        read = self.read
        return self.with_(nodes=nodes, edges=edges, items=self.items, read=None if read is None else lambda items: read(items).global_scope())


def sized(df: DataFrame) -> DataFrame:
    """df as a side of a join that grows with the graph, and so is merged and not broadcast.

    What a graph is exploded from is a compressed file many times smaller than its nodes, by which Spark takes
    millions of them for a table that each task and the driver can hold.
    """
    return df.hint("merge")


def empty_props():
    return F.create_map().cast("map<string,array<string>>")


def node_columns(**given):
    """Columns of NODES; those not given are null (props empty)."""
    out = []
    for spec in NODES.split(", "):
        name, kind = spec.split(" ", 1)
        value = given.get(name)
        if value is None:
            value = empty_props() if name == "props" else F.lit(None)
        out.append((value if hasattr(value, "cast") else F.lit(value)).cast(kind).alias(name))
    return out


def edge_columns(**given):
    out = []
    for spec in EDGES.split(", "):
        name, kind = spec.split(" ", 1)
        value = given.get(name)
        if value is None:
            value = empty_props() if name == "props" else F.lit(None)
        out.append((value if hasattr(value, "cast") else F.lit(value)).cast(kind).alias(name))
    return out


def schema_nodes(spark: SparkSession, layer: Layer) -> DataFrame:
    """The layer as a small table, for broadcast joins at read time."""
    return spark.createDataFrame(layer.rows(), SCHEMA_NODES)


def embed_schema(graph: Graph) -> Graph:
    """Nodes with their schema attribute's properties added; a node's own win. The layer is driver-sized, so it is broadcast."""
    props = schema_nodes(graph.spark, graph.layer).select(F.col("node_id").alias("schema_node_id"), F.col("props").alias("_props"))
    nodes = graph.nodes.join(F.broadcast(props), "schema_node_id", "left")
    extra = F.map_filter("_props", lambda k, v: ~F.array_contains(F.map_keys("props"), k))
    return graph.with_(nodes=nodes.withColumn("props", F.when(F.col("_props").isNull(), F.col("props")).otherwise(F.map_concat("props", extra))).select(*graph.nodes.columns))
