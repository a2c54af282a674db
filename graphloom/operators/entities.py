"""Operators on entities and their values: deduplication, defaults, hashes, conditions, paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..graph import HAS, Graph, edge_columns, node_columns
from ..schema.layer import SchemaError
from ..schema.terms import MEANINGS
from ..storage import written


def _first(column: str) -> Column:
    """Order of node ids: shorter ones first, so that numbers in them count up."""
    return F.struct(F.length(column).alias("n"), F.col(column).alias("id"))


def _survivors(roots: DataFrame) -> DataFrame:
    """(graph_id, node_id, winner) of the roots of each kind and id of which there are several, the winner among them.

    Minima are written before they are joined, so the join's other side can be split where a
    large share of the rows bears one id.
    """
    key = ["graph_id", "_kind", "entity_id"]
    first = written(roots.groupBy(*key).agg(F.min(_first("node_id")).alias("_w"), F.count("*").alias("_c")).where("_c > 1").select(*key, F.col("_w.id").alias("winner")))
    return written(roots.select(*key, "node_id").join(first, key).select("graph_id", "node_id", "winner"))


def _replace(graph: Graph, roots: DataFrame) -> Graph:
    """One root for all of a group: what leads to the others leads to the winner, and what lies below them lies below it.

    Of a value that several have below them the winner's stays, or else the first other's;
    containers and nested entities all stay. Edges keep their properties, parallel ones included.
    """
    graph = graph.held()
    losers = roots.where("node_id <> winner")
    kept = (*graph.nodes.columns,), (*graph.edges.columns,)
    below = graph.edges.join(roots.withColumnRenamed("node_id", "src"), ["graph_id", "src"]).select("graph_id", "src", "dst", "winner", "label")
    values = graph.nodes.where("type = 'Value'").select("graph_id", F.col("node_id").alias("dst"), F.coalesce("schema_node_id", "attribute_name").alias("_name"))
    values = written(below.join(values, ["graph_id", "dst"]).withColumn("_rank", F.struct((F.col("src") != F.col("winner")).alias("late"), _first("src").alias("root"))))
    best = written(values.groupBy("graph_id", "winner", "label", "_name").agg(F.min("_rank").alias("_best")))
    gone = values.join(best, ["graph_id", "winner", "label", "_name"]).where("_rank <> _best").select("graph_id", F.col("dst").alias("node_id"))
    gone = written(gone.unionByName(losers.select("graph_id", "node_id")).distinct())
    to = losers.select("graph_id", F.col("node_id").alias("_from"), F.col("winner").alias("_to"))

    def moved(df: DataFrame, column: str) -> DataFrame:
        own = to.withColumnRenamed("_from", column)
        return df.join(own, ["graph_id", column], "left").withColumn(column, F.coalesce("_to", column)).drop("_to")

    dropped = gone.join(losers, ["graph_id", "node_id"], "left_anti").withColumnRenamed("node_id", "dst")
    nodes = moved(graph.nodes.join(gone, ["graph_id", "node_id"], "left_anti"), "entity_root_id").select(*kept[0])
    edges = moved(moved(graph.edges.join(dropped, ["graph_id", "dst"], "left_anti"), "src"), "dst").select(*kept[1])
    return graph.with_(nodes=nodes, edges=edges)


def consolidate(graph: Graph, label: str) -> Graph:
    """Of the entities with a label and the same id, the first by node id stays for all; entities without id are left alone."""
    graph = graph.held()
    roots = graph.nodes.where(F.array_contains("labels", label) & F.col("entity_id").isNotNull()).withColumn("_kind", F.lit(label))
    return _replace(graph, _survivors(roots))


def reuse_entities(graph: Graph) -> Graph:
    """Within a graph, one node for each entity schema and id: later ones become edges to the first, which takes over what only they have."""
    graph = graph.held()
    roots = graph.nodes.where("entity_schema IS NOT NULL AND entity_id IS NOT NULL").withColumn("_kind", F.col("entity_schema"))
    return _replace(graph, _survivors(roots))


def add_defaults(graph: Graph) -> Graph:
    """For each instance of an attribute's parent without a child or property of it, its defaultValue."""
    nodes, edges = graph.nodes, graph.edges
    for a in graph.layer.attributes():
        if "defaultValue" not in a.props or a.parent is None:
            continue
        parents = nodes.where(F.col("schema_node_id") == a.parent.id)
        mode = a.one("ingestAs", "node")
        if mode == "property":
            name = a.one("propertyName") or a.name or a.id
            lacks = (F.col("schema_node_id") == a.parent.id) & ~F.array_contains(F.map_keys("props"), name)
            with_ = F.map_concat("props", F.create_map(F.lit(name), F.array(F.lit(a.one("defaultValue")))))
            nodes = nodes.withColumn("props", F.when(lacks, with_).otherwise(F.col("props")))
            continue
        present = Graph(nodes, edges).children(a.id).select("graph_id", F.col("parent_id").alias("node_id"))
        missing = parents.join(present, ["graph_id", "node_id"], "left_anti")
        made = F.concat("node_id", F.lit("." + (a.name or a.id)))
        order = a.parent.children.index(a) if a in a.parent.children else 0
        types = F.array(*map(F.lit, a.many("valueType"))).cast("array<string>")
        new = missing.select("graph_id", F.col("node_id").alias("_p"), made.alias("_id"), "entity_root_id", "source")
        labels = F.array(*map(F.lit, ["DocumentNode", a.kind, *a.labels]))
        nodes = nodes.unionByName(new.select(*node_columns(graph_id=F.col("graph_id"), node_id=F.col("_id"), labels=labels, schema_node_id=a.id, type=a.kind, attribute_name=a.name or None, attribute_index=order, value=a.one("defaultValue"), value_type=types, entity_root_id=F.col("entity_root_id"), source=F.col("source"))))
        label = HAS if mode != "edge" else a.one("edgeLabel") or a.name
        edges = edges.unionByName(new.select(*edge_columns(graph_id=F.col("graph_id"), src=F.col("_p"), dst=F.col("_id"), label=label, ord=order)))
    return graph.with_(nodes=nodes, edges=edges)


def prune_childless(graph: Graph) -> Graph:
    """Containers whose attribute says `conditional: mustHaveChildren` go if nothing is below them, bottom-up."""
    order = [a for a in graph.layer.attributes() if a.one("conditional") == "mustHaveChildren"]
    for a in sorted(order, key=lambda a: -len(a.path())):
        parents = graph.edges.select("graph_id", F.col("src").alias("node_id")).distinct()
        gone = graph.instances(a.id).join(parents, ["graph_id", "node_id"], "left_anti").select("graph_id", "node_id")
        nodes = graph.nodes.join(gone, ["graph_id", "node_id"], "left_anti").select(*graph.nodes.columns)
        edges = graph.edges.join(gone.withColumnRenamed("node_id", "dst"), ["graph_id", "dst"], "left_anti").select(*graph.edges.columns)
        graph = graph.with_(nodes=nodes, edges=edges)
    return graph


_HASHES = {"hash": lambda c: F.sha2(c, 256), "hash.sha256": lambda c: F.sha2(c, 256), "hash.sha512": lambda c: F.sha2(c, 512), "hash.sha1": F.sha1}


def compute_hashes(graph: Graph) -> Graph:
    """Values of hash attributes: digest of the listed attributes' raw values within the entity, in order.

    Several instances of a listed attribute follow each other; nothing stands between values. A
    missing node is made below the entity root. If the attribute is an id field, entity ids are
    set anew from the values of all id fields.
    """
    for a in graph.layer.attributes():
        term = next((t for t in _HASHES if t in a.props), None)
        if term is None:
            continue
        listed = a.many(term)
        place = F.array_position(F.array(*map(F.lit, listed)), F.col("schema_node_id"))
        nodes = graph.nodes.where(F.col("schema_node_id").isin(listed) & F.col("value").isNotNull()).select("graph_id", "entity_root_id", place.alias("p"), "node_id", "value")
        props = [(k, p) for k, i in enumerate(listed, 1) if (p := graph.layer.find(i)) is not None and p.one("ingestAs") == "property"]
        for k, p in props:
            name = p.one("propertyName") or p.name or p.id
            held = graph.nodes.where(F.array_contains(F.map_keys("props"), name)).select("graph_id", "entity_root_id", F.lit(k).cast("long").alias("p"), "node_id", F.explode(F.col("props")[name]).alias("value"))
            nodes = nodes.unionByName(held)
        joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", "node_id", "value"))), lambda s: s["value"]), "")
        values = nodes.groupBy("graph_id", "entity_root_id").agg(_HASHES[term](joined.cast("binary")).alias("_hash"))
        graph = set_values(graph, a.id, values)
        entity = graph.layer.entity_of(a)
        if entity is not None and a.id in entity.many("entityIdFields"):
            graph = _complete_ids(graph, entity)
    return graph


def _complete_ids(graph: Graph, entity) -> Graph:
    """Entity ids of an entity's roots from the values of its id fields, where all of them are there."""
    fields = entity.many("entityIdFields")
    cells = graph.nodes.where(F.col("schema_node_id").isin(fields) & F.col("value").isNotNull())
    found = cells.groupBy("graph_id", F.col("entity_root_id").alias("node_id")).agg(*(F.min(F.when(F.col("schema_node_id") == f, F.col("value"))).alias(f"_{k}") for k, f in enumerate(fields)))
    parts = [F.col(f"_{k}") for k in range(len(fields))]
    found = found.select("graph_id", "node_id", F.lit(entity.id).alias("schema_node_id"), F.when(F.size(F.array_compact(F.array(*parts))) == len(fields), F.array(*parts)).alias("_ids"))
    nodes = graph.nodes.join(found, ["graph_id", "node_id", "schema_node_id"], "left")
    return graph.with_(nodes=nodes.withColumn("entity_id", F.coalesce("_ids", "entity_id")).select(*graph.nodes.columns))


def set_values(graph: Graph, attribute_id: str, values: DataFrame) -> Graph:
    """Set the nodes of an attribute from values(graph_id, entity_root_id, _value-like last column), making those that are missing."""
    a = graph.layer.find(attribute_id)
    if a is None:
        raise SchemaError(f"no attribute {attribute_id}")
    new = values.columns[-1]
    own = values.withColumnRenamed(new, "_set")
    mine = F.coalesce(F.col("schema_node_id") == attribute_id, F.lit(False))
    nodes = graph.nodes.where(mine).join(own, ["graph_id", "entity_root_id"], "left").withColumn("value", F.coalesce("_set", "value")).select(*graph.nodes.columns)
    nodes = graph.nodes.where(~mine).unionByName(nodes)
    there = graph.instances(attribute_id).select("graph_id", "entity_root_id")
    parents = graph.nodes.where(F.col("schema_node_id") == a.parent.id).select("graph_id", "entity_root_id", F.col("node_id").alias("_p"), "source")
    lack = own.where("_set IS NOT NULL").join(there, ["graph_id", "entity_root_id"], "left_anti").join(parents, ["graph_id", "entity_root_id"])
    lack = lack.withColumn("_id", F.concat("_p", F.lit("." + (a.name or a.id))))
    labels = F.array(*map(F.lit, ["DocumentNode", "Value", *a.labels]))
    nodes = nodes.unionByName(lack.select(*node_columns(graph_id=F.col("graph_id"), node_id=F.col("_id"), labels=labels, schema_node_id=a.id, type="Value", attribute_name=a.name or None, value=F.col("_set"), entity_root_id=F.col("entity_root_id"), source=F.col("source"))))
    edges = graph.edges.unionByName(lack.select(*edge_columns(graph_id=F.col("graph_id"), src=F.col("_p"), dst=F.col("_id"), label=HAS)))
    return graph.with_(nodes=nodes, edges=edges)


def apply_set_values(graph: Graph) -> Graph:
    """Attributes with `setValue`: missing nodes are made, and the last query's single cell is the value.

    The queries see `this`, the attribute's node, and run in order: what a query gives for a
    node in a single row under a name (`as x`) is bound to that name in the later ones, a node as
    that node, a value as that value. A last query that gives several rows, several columns or
    none leaves the value as it is. A value that is an id field sets its entity's id.
    """
    from ..plans import cypher

    for a in graph.layer.attributes():
        texts = a.many("setValue")
        if not texts or a.parent is None:
            continue
        graph = ensure_path(graph, [a.parent.id, a.id]).held()
        own = graph.instances(a.id).select("graph_id", "node_id")
        found = cypher.chained_values(graph, texts, "this", own)
        one = found.groupBy("graph_id", F.col("_this").alias("node_id")).agg(F.count("*").alias("_c"), F.max("value").alias("_set")).where("_c = 1").drop("_c")
        nodes = graph.nodes.join(one, ["graph_id", "node_id"], "left").withColumn("value", F.coalesce("_set", "value")).select(*graph.nodes.columns)
        graph = graph.with_(nodes=nodes)
        entity = graph.layer.entity_of(a)
        if entity is not None and a.id in entity.many("entityIdFields"):
            graph = _complete_ids(graph, entity)
    return graph


def set_uuids(graph: Graph) -> Graph:
    """Random ids as values of attributes with `uuid`."""
    ids = [a.id for a in graph.layer.attributes() if "uuid" in a.props]
    value = F.when(F.col("schema_node_id").isin(ids), F.expr("uuid()")).otherwise(F.col("value"))
    # written once: a plan that draws ids gives others each time it is used
    return graph.with_(nodes=written(graph.nodes.withColumn("value", value))) if ids else graph


def renumber(graph: Graph) -> Graph:
    """attribute_index of a node: its place among its parent's edges, in order. One sort per parent."""
    order = Window.partitionBy("graph_id", "src").orderBy("ord", "dst")
    edges = graph.edges.withColumn("ord", F.row_number().over(order) - 1)
    place = edges.select("graph_id", F.col("dst").alias("node_id"), F.col("ord").alias("_o")).groupBy("graph_id", "node_id").agg(F.min("_o").alias("_o"))
    nodes = graph.nodes.join(place, ["graph_id", "node_id"], "left").withColumn("attribute_index", F.coalesce("_o", "attribute_index")).select(*graph.nodes.columns)
    return graph.with_(nodes=nodes, edges=edges)


def ensure_path(graph: Graph, attribute_ids: list[str]) -> Graph:
    """Below each instance of the first attribute one instance of each next: found, or made; more than one is an error."""
    for upper, lower in zip(attribute_ids, attribute_ids[1:]):
        a = graph.layer.find(lower)
        count = graph.children(lower).groupBy("graph_id", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("_c"))
        parents = graph.instances(upper).join(count, ["graph_id", "node_id"], "left")
        parents = parents.where(F.when(F.coalesce("_c", F.lit(0)) > 1, F.raise_error(F.lit(f"more than one {lower}")).cast("boolean")).otherwise(F.col("_c").isNull()))
        new = parents.select("graph_id", F.col("node_id").alias("_p"), F.concat("node_id", F.lit("." + (a.name or a.id))).alias("_id"), "entity_root_id")
        nodes = graph.nodes.unionByName(new.select(*node_columns(graph_id=F.col("graph_id"), node_id=F.col("_id"), labels=F.array(F.lit("DocumentNode"), F.lit(a.kind), *map(F.lit, a.labels)), schema_node_id=a.id, type=a.kind, attribute_name=a.name or None, entity_root_id=F.col("entity_root_id"))))
        edges = graph.edges.unionByName(new.select(*edge_columns(graph_id=F.col("graph_id"), src=F.col("_p"), dst=F.col("_id"), label=HAS)))
        graph = graph.with_(nodes=nodes, edges=edges)
    return graph


def validate(graph: Graph) -> DataFrame:
    """(graph_id, node_id, schema_node_id, validator, value) of every failure, missing required children included."""
    from ..functions.validators import failures

    parts = []
    for a in graph.layer.attributes():
        if a.kind == "Value" and any(k.startswith("validation/") or (k in MEANINGS and MEANINGS[k].check) for k in a.props):
            bad = graph.instances(a.id).select("graph_id", "node_id", "schema_node_id", F.explode(failures(a, F.col("value"))).alias("validator"), "value")
            parts.append(bad)
        for term in (t for t in a.props if t in MEANINGS and MEANINGS[t].check_nodes):
            bad = MEANINGS[term].check_nodes(graph, a).select("graph_id", "node_id")
            parts.append(graph.instances(a.id).join(bad, ["graph_id", "node_id"], "left_semi").select("graph_id", "node_id", "schema_node_id", F.lit(term).alias("validator"), "value"))
        if a.kind == "Object":
            wanted = [c for c in a.children if c.name in a.many("validation/required") or c.id in a.many("validation/required") or (c.kind == "Value" and c.one("validation/required").lower() == "true")]
            for c in wanted:
                there = graph.children(c.id).select("graph_id", F.col("parent_id").alias("node_id"))
                lack = graph.instances(a.id).join(there, ["graph_id", "node_id"], "left_anti")
                parts.append(lack.select("graph_id", "node_id", "schema_node_id", F.lit(f"required:{c.id}").alias("validator"), F.lit(None).cast("string").alias("value")))
    if not parts:
        return graph.nodes.select("graph_id", "node_id", "schema_node_id", F.lit("").alias("validator"), "value").limit(0)
    return reduce(DataFrame.unionByName, parts)


def descendants(graph: Graph, roots: Column, depth: int | None = None, labels: list[str] | None = None) -> DataFrame:
    """(graph_id, root_id, node_id, level) of all nodes below the roots that a condition picks, within `depth` edges if given.

    Each level is written and followed until none is new; cycles end as every node counts once for a root.
    """
    edges = graph.edges if labels is None else graph.edges.where(F.col("label").isin(labels))
    steps = written(edges.select("graph_id", F.col("src").alias("node_id"), F.col("dst").alias("_next")).distinct())
    key = ["graph_id", "root_id", "node_id"]
    level = written(graph.nodes.where(roots).select("graph_id", F.col("node_id").alias("root_id"), "node_id", F.lit(0).alias("level")).distinct())
    parts, k = [level], 0
    while k != depth:
        k += 1
        new = level.join(steps, ["graph_id", "node_id"]).select("graph_id", "root_id", F.col("_next").alias("node_id"), F.lit(k).alias("level")).distinct()
        level = written(new.join(reduce(DataFrame.unionByName, parts).select(*key), key, "left_anti"))
        if level.isEmpty():
            break
        parts.append(level)
    return reduce(DataFrame.unionByName, parts)


def ancestors(graph: Graph, nodes: Column, depth: int | None = None) -> DataFrame:
    """(graph_id, start_id, node_id, level) of all nodes above, within `depth` edges if given."""
    turned = graph.with_(edges=graph.edges.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "label", "ord", "props"))
    return descendants(turned, nodes, depth).withColumnRenamed("root_id", "start_id")


def native(graph: Graph, term: str) -> DataFrame:
    """(graph_id, node_id, schema_node_id, native): native values of the attributes that bear a term, as the term reads them."""
    parts = [graph.instances(a.id).select("graph_id", "node_id", "schema_node_id", MEANINGS[term].read(a, F.col("value")).alias("native")) for a in graph.layer.attributes() if term in a.props]
    return reduce(DataFrame.unionByName, parts)


def set_native(graph: Graph, term: str, values: DataFrame) -> Graph:
    """Nodes of the attributes that bear a term with values(graph_id, node_id, native) written as their text."""
    own = values.select("graph_id", "node_id", "native")
    for a in [a for a in graph.layer.attributes() if term in a.props]:
        mine = F.coalesce(F.col("schema_node_id") == a.id, F.lit(False))
        new = graph.nodes.where(mine).join(own, ["graph_id", "node_id"], "left").withColumn("value", F.coalesce(MEANINGS[term].write(a, F.col("native")), F.col("value")))
        graph = graph.with_(nodes=graph.nodes.where(~mine).unionByName(new.select(*graph.nodes.columns)))
    return graph


def post_ingest(graph: Graph) -> Graph:
    """Everything that terms of the layer do after ingestion: hooks of attributes, in the layer's order, then those of the whole graph."""
    bear = lambda terms: any(t in a.props for a in graph.layer.attributes() for t in terms)
    for terms, work in POST_INGEST:
        if bear(terms):
            graph = work(graph)
    for a in graph.layer.attributes():
        for term in a.props:
            if term in MEANINGS and MEANINGS[term].post_node:
                graph = MEANINGS[term].post_node(graph, a)
    for term, m in MEANINGS.items():
        if m.post and bear([term]):
            graph = m.post(graph)
    return graph


#: The terms with a hook of their own, in the order in which the hooks run.
POST_INGEST = ((("defaultValue",), add_defaults), (("setValue",), apply_set_values), (tuple(_HASHES), compute_hashes), (("uuid",), set_uuids))


def drop_annotated(graph: Graph, term: str, values: list[str] | None = None) -> Graph:
    """De-identification: the graph without nodes whose attribute bears a term (with one of the values)."""
    ids = [a.id for a in graph.layer.attributes() if term in a.props and (values is None or set(a.many(term)) & set(values))]
    return graph.subgraph(F.col("schema_node_id").isNull() | ~F.col("schema_node_id").isin(ids)) if ids else graph
