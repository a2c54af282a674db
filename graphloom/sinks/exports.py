"""Exports: flat tables, nested JSON, graph JSON, DOT, property lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import HAS, Graph, sized
from ..schema.layer import Attribute, Layer
from ..storage import written


def to_table(graph: Graph, columns: Sequence[str | tuple[str, str]], roots: Column | None = None, keep_ids: bool = False) -> DataFrame:
    """A row for each root (default: nodes that no edge leads to), a column for each attribute name or (name, query).

    A cell is the value of the root's child with that name, or its property. Several such
    children are an error; none give an empty cell. A query of one column sees the row's node as
    `root`; its one value is the cell, no row gives an empty cell, several are an error.
    """
    queries = {c[0]: c[1] for c in columns if not isinstance(c, str)}
    if queries:
        from ..plans import cypher

        names = [c if isinstance(c, str) else c[0] for c in columns]
        graph = graph.held()
        out = to_table(graph, [n for n in names if n not in queries], roots, True)
        bound = out.select("graph_id", F.col("root").alias("node_id"))
        for n, text in queries.items():
            found = cypher.values(graph, text, "root", bound)
            one = F.when(F.count("*") > 1, F.raise_error(F.lit(f"more than one value of {n}")).cast("string")).otherwise(F.max("value"))
            cells = found.groupBy("graph_id", F.col("_root").alias("root")).agg(one.alias("_cell"))
            out = out.join(cells, ["graph_id", "root"], "left").withColumn(n, F.coalesce("_cell", F.lit(""))).drop("_cell")
        return out.select(*(["graph_id", "root"] if keep_ids else []), *(F.col(f"`{n}`") for n in names))
    ends = graph.edges.select("graph_id", F.col("dst").alias("node_id"), F.col("src").alias("_parent"))
    is_root = F.col("_parent").isNull() if roots is None else F.coalesce(roots, F.lit(False))
    nodes = graph.nodes.join(ends, ["graph_id", "node_id"], "left")
    none = F.lit(None).cast("string")
    cells = F.array(*(F.get(F.col("props")[c], F.lit(0)) for c in columns))
    # a node is a row if it is a root, and a cell of its parent; both meet by the root's id
    as_root = F.when(is_root, F.struct(F.col("node_id").alias("root"), F.lit(True).alias("is_root"), cells.alias("props"), none.alias("name"), none.alias("value")))
    as_cell = F.when(F.col("_parent").isNotNull() & F.col("attribute_name").isin(list(columns)), F.struct(F.col("_parent").alias("root"), F.lit(False).alias("is_root"), F.lit(None).cast("array<string>").alias("props"), F.col("attribute_name").alias("name"), F.col("value").alias("value")))
    parts = nodes.select("graph_id", F.explode(F.filter(F.array(as_root, as_cell), lambda x: x.isNotNull())).alias("_p")).select("graph_id", "_p.*")
    agg = [F.max("is_root").alias("_root"), F.max("props").alias("props")]
    for k, c in enumerate(columns):
        count = F.count(F.when(F.col("name") == c, 1))
        agg.append(F.when(F.max("is_root") & (count > 1), F.raise_error(F.lit(f"more than one value of {c}")).cast("string")).otherwise(F.max(F.when(F.col("name") == c, F.col("value")))).alias(f"_{k}"))
    # dealt out first: a root has a row for each column at most, so aggregating where they are made would only sort them once more
    if not parts.isStreaming:
        parts = parts.repartition("graph_id", "root")
    wide = parts.groupBy("graph_id", "root").agg(*agg).where("_root")
    values = [F.coalesce(F.col(f"_{k}"), F.get("props", F.lit(k)), F.lit("")).alias(c) for k, c in enumerate(columns)]
    return wide.select(*(["graph_id", "root"] if keep_ids else []), *values)


def write_csv(table: DataFrame, path: str, append: bool = True, header: bool = True) -> None:
    table.write.mode("append" if append else "overwrite").option("header", header).csv(path)


def _levels(layer: Layer) -> dict[str, int] | None:
    """Depth of each attribute; None where one stands at several depths, as in recursive layers."""
    out: dict[str, int] = {}
    todo: list[tuple[Attribute, int]] = [(layer.root, 1)]
    while todo:
        a, level = todo.pop()
        if out.setdefault(a.id, level) != level:
            return None
        todo += [(c, level + 1) for c in a.children]
    return out


def to_json(graph: Graph, root: str, depth: int | None = None, labels: Sequence[str] = (HAS,), type_key: str = "") -> DataFrame:
    """(graph_id, node_id, json) of the instances of a root attribute, built bottom-up, an aggregate for each level.

    Objects take their children by attribute name, arrays by index; numbers and booleans are
    written as such where the attribute's type says so. Only edges with the given labels are
    followed. depth: levels followed (default: all, however deep).

    Where the layer gives every node a level, a level's nodes are worked on once, the deepest
    first. Where attributes stand at several depths, as in recursive layers, containers are
    peeled off the edges by height: each round builds those whose children are all built, and is
    written. An edge that leads back (see _uncycled) gives null. With a depth, or on streams, all containers are built anew for
    each level, with what their children then are.
    """
    levels = depth if depth is not None else max(len(a.path()) for a in graph.layer.attributes())
    literal = {"json:number", "json:integer", "json:boolean", "xsd:boolean", "xsd:decimal", "xsd:int", "xsd:long", "xsd:short", "xsd:byte", "integer", "number", "boolean"}
    typed = F.exists(F.coalesce("value_type", F.array().cast("array<string>")), lambda t: t.isin(sorted(literal)))
    text = F.when(F.col("value").isNull(), F.lit("null")).when(typed & F.col("value").rlike(r"^(?:-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false)$"), F.col("value")).otherwise(F.regexp_replace(F.to_json(F.array("value")), r"^\[|\]$", ""))
    quote = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    props = F.transform(F.map_entries("props"), lambda e: F.struct(F.lit(-1).alias("i"), e["key"].alias("k"), F.when(F.size(e["value"]) == 1, quote(e["value"][0])).otherwise(F.to_json(e["value"])).alias("v")))
    known = _levels(graph.layer) if depth is None else None
    level = F.lit(None).cast("int") if not known else F.element_at(F.create_map(*(F.lit(x) for pair in known.items() for x in pair)), F.col("schema_node_id"))
    links = graph.edges.where(F.col("label").isin(list(labels))).select("graph_id", F.col("src").alias("parent_id"), F.col("dst").alias("node_id"), "ord")
    own = graph.nodes.select(
        "graph_id", "node_id", "type", "attribute_name", "attribute_index", "schema_node_id", level.alias("level"), F.when(F.col("type") == "Value", text).alias("json"),
        F.when(F.col("type") != "Value", props).alias("_props"), F.element_at(F.coalesce("labels", F.array().cast("array<string>")), -1).alias("_label"),
    )
    tree = own.join(sized(links), ["graph_id", "node_id"], "left").withColumn("i", F.coalesce("ord", "attribute_index"))
    if not tree.isStreaming:
        tree = written(tree)

    empty = F.array().cast("array<struct<i:int,k:string,v:string>>")
    finished = F.struct(F.col("i"), F.col("attribute_name").alias("k"), F.col("json").alias("v"))
    itself = F.struct("type", "attribute_name", "schema_node_id", "_props", "_label")
    upward = F.struct("parent_id", "i")

    def built(children: DataFrame, containers: DataFrame) -> DataFrame:
        """Containers with their json; children and containers meet by the container's id."""
        parts = children.select("graph_id", F.col("parent_id").alias("node_id"), finished.alias("c"), F.lit(None).alias("s"), F.lit(None).alias("u"))
        parts = parts.unionByName(containers.select("graph_id", "node_id", F.lit(None).alias("c"), itself.alias("s"), upward.alias("u")))
        # a container may stand below several parents, each time as the same text
        got = parts.groupBy("graph_id", "node_id").agg(F.sort_array(F.collect_list("c")).alias("c"), F.first("s", ignorenulls=True).alias("s"), F.collect_set("u").alias("u")).where("s IS NOT NULL")
        kind = F.array(F.struct(F.lit(-2).alias("i"), F.lit(type_key).alias("k"), quote(F.col("s._label")).alias("v"))) if type_key else empty
        fields = F.transform(F.filter(F.concat(kind, F.coalesce("s._props", empty), "c"), lambda e: e["k"].isNotNull()), lambda e: F.concat(quote(e["k"]), F.lit(":"), e["v"]))
        obj = F.concat(F.lit("{"), F.array_join(fields, ","), F.lit("}"))
        arr = F.concat(F.lit("["), F.array_join(F.transform("c", lambda e: e["v"]), ","), F.lit("]"))
        got = got.select("graph_id", "node_id", F.col("s.attribute_name").alias("attribute_name"), F.col("s.schema_node_id").alias("schema_node_id"), F.when(F.col("s.type") == "Array", arr).otherwise(obj).alias("json"), F.explode("u").alias("u"))
        return got.select("graph_id", "node_id", "attribute_name", "schema_node_id", "json", "u.parent_id", "u.i")

    columns = ("graph_id", "node_id", "attribute_name", "schema_node_id", "json", "parent_id", "i")
    values, containers = tree.where("type = 'Value'"), tree.where("type <> 'Value'")
    if known and not tree.isStreaming and tree.where("level IS NULL").isEmpty():
        target = known.get(root, 1)
        done = None
        for k in range(max(known.values()), target - 1, -1):
            here = values.where(F.col("level") == k).select(*columns)
            above = containers.where(F.col("level") == k)
            if done is not None or any(a.kind != "Value" and known[a.id] == k for a in graph.layer.attributes()):
                below = values.limit(0).select(*columns) if done is None else done.where("parent_id IS NOT NULL")
                here = here.unionByName(built(below, above)) if any(a.kind == "Value" and known[a.id] == k for a in graph.layer.attributes()) else built(below, above)
            done = here
    elif depth is None and not tree.isStreaming:
        return _peeled(tree, root, values.select(*columns), containers, columns, built)
    else:
        done = values.select(*columns)
        for _ in range(levels):
            done = values.select(*columns).unionByName(built(done.where("parent_id IS NOT NULL"), containers))
    return done.where(F.col("schema_node_id") == root).select("graph_id", "node_id", "json").distinct()


def _peeled(tree: DataFrame, root: str, values: DataFrame, containers: DataFrame, columns: Sequence[str], built) -> DataFrame:
    """to_json of trees of any depth, leaves first: a container is built in the round after its last child."""
    key = ["graph_id", "node_id"]
    ids = containers.select(*key).distinct()
    up = tree.where("parent_id IS NOT NULL").select("graph_id", "node_id", "parent_id")
    # edges between containers that are still to be built; other parents than containers take no children
    waiting = written(up.join(ids, key, "left_semi").join(ids.select("graph_id", F.col("node_id").alias("parent_id")), ["graph_id", "parent_id"], "left_semi").distinct())
    opened, left, out = values, written(ids), []
    while True:
        ready = written(left.join(waiting.select("graph_id", F.col("parent_id").alias("node_id")), key, "left_anti"))
        if ready.isEmpty():
            if left.isEmpty():
                break
            cut = _uncycled(left, waiting, tree.where(F.col("schema_node_id") == root).select(*key).distinct())
            if cut.isEmpty():  # what is left stands in cycles that no root leads to
                break
            names = tree.select(*key, "parent_id", "attribute_name", "schema_node_id", "i").join(cut, [*key, "parent_id"])
            opened = written(opened.unionByName(names.select("graph_id", "node_id", "attribute_name", F.lit(None).cast("string").alias("schema_node_id"), F.lit("null").alias("json"), "parent_id", "i").select(*columns)))
            # a cut edge is no edge to the containers either, or its text would come twice
            containers = written(containers.join(cut.withColumn("_cut", F.lit(True)), [*key, "parent_id"], "left").withColumn("parent_id", F.when(F.col("_cut"), None).otherwise(F.col("parent_id"))).drop("_cut"))
            waiting = written(waiting.join(cut, [*key, "parent_id"], "left_anti"))
            continue
        parent = ready.select("graph_id", F.col("node_id").alias("parent_id"))
        below = opened.where("parent_id IS NOT NULL").join(parent, ["graph_id", "parent_id"], "left_semi")
        new = written(built(below.select(*columns), containers.join(ready, key, "left_semi")).select(*columns))
        out.append(new.where(F.col("schema_node_id") == root).select(*key, "json"))
        opened = written(opened.where("parent_id IS NOT NULL").join(parent, ["graph_id", "parent_id"], "left_anti").select(*columns).unionByName(new))
        waiting = written(waiting.join(ready, key, "left_anti"))
        left = written(left.join(ready, key, "left_anti"))
    if not out:
        return values.where(F.col("schema_node_id") == root).select(*key, "json").distinct()
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found.distinct()


def _uncycled(left: DataFrame, waiting: DataFrame, roots: DataFrame) -> DataFrame:
    """(graph_id, node_id, parent_id): edges among the containers left that do not lead away from the roots.

    Levels are counted from the roots that no edge leads to, or, in a graph without such a one, from the root with the
    smallest id. An edge to a node of the same or a smaller level may close a cycle and is cut; all cycles have such an edge.
    """
    key = ["graph_id", "node_id"]
    own = roots.join(left, key, "left_semi")
    top = own.join(waiting.select(*key), key, "left_anti")
    lone = own.join(top.select("graph_id").distinct(), "graph_id", "left_anti").groupBy("graph_id").agg(F.min("node_id").alias("node_id"))
    level = seen = written(top.unionByName(lone).distinct().withColumn("level", F.lit(0)))
    while True:
        step = level.select("graph_id", F.col("node_id").alias("parent_id"), (F.col("level") + 1).alias("level")).join(waiting, ["graph_id", "parent_id"]).select(*key, "level").distinct()
        level = written(step.join(seen, key, "left_anti"))
        if level.isEmpty():
            break
        seen = written(seen.unionByName(level))
    ends = waiting.join(seen, key).join(seen.select("graph_id", F.col("node_id").alias("parent_id"), F.col("level").alias("_above")), ["graph_id", "parent_id"])
    return written(ends.where("level <= _above").select(*key, "parent_id"))


def to_graph_json(graph: Graph, include_schema: bool = True) -> DataFrame:
    """(graph_id, json): each graph in graph JSON, nodes numbered by node id.

    A graph_id is meant to be one document; its nodes are collected into one row. Without
    include_schema, attribute nodes that no document node is an instance of are left out.
    """
    nodes = graph.nodes
    if not include_schema:
        nodes = nodes.where(F.array_contains("labels", "DocumentNode") | F.col("labels").isNull())
    one = lambda c, k: F.when(F.col(c).isNotNull(), F.create_map(F.lit(k), F.array(F.col(c).cast("string")))).otherwise(F.create_map().cast("map<string,array<string>>"))
    many = lambda c, k: F.when(F.size(c) > 0, F.create_map(F.lit(k), F.col(c))).otherwise(F.create_map().cast("map<string,array<string>>"))
    props = F.map_concat("props", one("schema_node_id", "schemaNodeId"), one("value", "value"), one("attribute_name", "attributeName"), one("attribute_index", "attributeIndex"), one("entity_schema", "entitySchema"), many("entity_id", "entityId"), many("value_type", "valueType"))
    listed = nodes.select("graph_id", F.struct("node_id", "labels", props.alias("properties")).alias("n")).groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct("n.node_id", "n.labels", F.map_entries("n.properties").alias("p")))).alias("ns"))
    links = graph.edges.groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct("src", "ord", "dst", "label"))).alias("es"))
    joined = listed.join(links, "graph_id", "left")
    number = F.map_from_entries(F.transform("ns", lambda n, i: F.struct(n["node_id"], i)))
    own = joined.withColumn("_n", number)
    at = F.col("_n")
    out_nodes = F.transform("ns", lambda n: F.struct(at[n["node_id"]].alias("n"), n["labels"].alias("labels"), F.map_from_entries(n["p"]).alias("properties")))
    out_edges = F.transform(F.coalesce("es", F.array().cast("array<struct<src:string,ord:int,dst:string,label:string>>")), lambda e: F.struct(at[e["src"]].alias("from"), at[e["dst"]].alias("to"), e["label"].alias("label")))
    return own.select("graph_id", F.to_json(F.struct(out_nodes.alias("nodes"), out_edges.alias("edges"))).alias("json"))


def list_properties(graph: Graph, names: Sequence[str]) -> DataFrame:
    """(graph_id, node_id, properties): named properties of every node, comma-joined."""
    return graph.nodes.select("graph_id", "node_id", F.concat_ws(",", *(F.array_join(F.coalesce(F.col("props")[n], F.array().cast("array<string>")), ",") for n in names)).alias("properties"))


def to_dot(graph: Graph, name: str = "G", most: int = 10_000) -> str:
    """DOT text of a small graph; more than `most` nodes are refused, as a drawing is made on the driver."""
    nodes = graph.nodes.orderBy("graph_id", "node_id").limit(most + 1).collect()
    if len(nodes) > most:
        raise ValueError(f"more than {most} nodes to draw")
    quote = lambda s: str(s).replace("\\", "\\\\").replace('"', '\\"')
    lines = [f'digraph "{quote(name)}" {{', "  node [shape=box];"]
    for n in nodes:
        facts = [n.node_id, ",".join(n.labels or []), *([f"value={n.value}"] if n.value is not None else []), *(f"{k}={','.join(v)}" for k, v in sorted((n.props or {}).items()))]
        text = "\\n".join(quote(f) for f in facts if f)
        lines.append(f'  "{quote(n.graph_id)}/{quote(n.node_id)}" [label="{text}"];')
    edges = graph.edges.orderBy("graph_id", "src", "ord", "dst").limit(4 * most + 1).collect()
    if len(edges) > 4 * most:
        raise ValueError(f"more than {4 * most} edges to draw")
    for e in edges:
        lines.append(f'  "{quote(e.graph_id)}/{quote(e.src)}" -> "{quote(e.graph_id)}/{quote(e.dst)}" [label="{quote(e.label)}"];')
    return "\n".join([*lines, "}"])


def ancestors_of(a: Attribute) -> list[str]:
    return [x.id for x in a.path()[:-1]]
