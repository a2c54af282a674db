"""Reshaping: graphs of one schema to another, layer application, and re-ingestion."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import natural
from ..graph import HAS, Graph, edge_columns, node_columns, schema_nodes, sized
from ..plans import cypher
from ..schema.layer import Attribute, Layer, SchemaError
from ..schema.terms import VOCABULARY
from ..storage import written


#: How many edges source nodes are followed upwards to the context they lie below.
MOST_LEVELS = 10_000


@dataclass
class TransformScript:
    """Annotations by the end of a target attribute's path: {"a/b": {"source": ..., "valueExpr": [...]}}."""

    rules: dict[str, dict] = field(default_factory=dict)

    @staticmethod
    def load(spec: dict) -> TransformScript:
        out = TransformScript()
        for path, rule in (spec.get("reshapeNodes") or spec.get("nodes") or spec).items():
            out.rules[path] = {k.removeprefix("transform/"): v for k, v in rule.items()}
        return out

    def of(self, a: Attribute) -> dict | None:
        """The rule of the longest path that ends a's path, by ids or names."""
        best = None
        for path, rule in self.rules.items():
            parts = path.split(" ") if " " in path else [path]
            own = a.path()[-len(parts) :]
            if len(own) == len(parts) and all(p in (x.id, x.name) for p, x in zip(parts, own)):
                if best is None or len(parts) > best[0]:
                    best = (len(parts), rule)
        return best[1] if best else None

    def validate(self, layer: Layer) -> None:
        """Every rule must fit an attribute, and every expression must parse."""
        for path, rule in self.rules.items():
            if not any(self.of(a) is rule for a in layer.attributes()):
                raise SchemaError(f"no attribute for {path}")
            for key in ("valueExpr", "valueExpr.first", "valueExpr.all", "evaluate", "provenance"):
                for text in _list(rule.get(key)):
                    cypher.parse(text)


def _list(v) -> list:
    return [] if v in (None, "") else list(v) if isinstance(v, (list, tuple)) else [v]


def _rule(a: Attribute, script: TransformScript | None) -> dict:
    found = script.of(a) if script else None
    if found is not None:
        return found
    return {k.removeprefix("transform/"): v for k, v in a.props.items() if k.startswith("transform/")}


class Reshaper:
    """Turns source graphs into graphs of a target layer, attribute by attribute.

    An attribute's results are, in this order: those of expressions (valueExpr.first: of the first that
    gives something, valueExpr.all: of all, valueExpr: of the first), of mapProperty (source nodes
    whose property names the attribute), of source(s) (source nodes by schema attribute). Each result is an instance:
    a value, or an object or array with a subtree of its own. Objects without any value below go.

    `evaluate` queries and the named columns of a result are symbols for the attribute and all below
    it: nodes or values, lists where a query gives several rows. mapContext, a query or the ids of schema
    attributes, limits mapProperty and sources: a query's node for all that is below the instance, ids for the attribute
    itself. Without one, sources below an instance that comes from a source node are looked for below that
    node where the source's layer has them there, else in the whole graph. `provenance`
    is a query of at most one node, whose provenance properties an instance gets where it has none.
    Properties stay whose names begin with one of keep_namespaces or whose terms bear one of keep_tags.
    """

    def __init__(self, target: Layer, script: TransformScript | None = None, keep_namespaces: Sequence[str] = ("provenance",), keep_tags: Sequence[str] = ("provenance",)):
        self.target, self.script, self.keep = target, script, tuple(keep_namespaces)
        self.kept_terms = [t.name for t in VOCABULARY.terms.values() if set(t.tags) & set(keep_tags)]
        if script is not None:
            script.validate(target)

    def values(self, source: Graph, a: Attribute) -> DataFrame | None:
        """(graph_id, _o, value, props) for a's nodes from expressions or a mapProperty; None if a takes none of these."""
        rule = _rule(a, self.script)
        bound: dict[str, DataFrame] = {}
        for text in _list(rule.get("evaluate")):
            q = cypher.parse(text)
            found = cypher.run(source, text, with_graph=True)
            for _, name in q.items:
                bound[name] = found.select("graph_id", F.col(f"`{name}`").alias("node_id"))
        for key, mode in (("valueExpr.first", "first"), ("valueExpr.all", "all"), ("valueExpr", "first")):
            texts = _list(rule.get(key))
            if texts:
                parts = [self.expression(source, t, bound, k) for k, t in enumerate(texts)]
                out = parts[0]
                for p in parts[1:]:
                    out = out.unionByName(p)
                if mode == "first":
                    best = out.groupBy("graph_id").agg(F.min("_k").alias("_k"))
                    out = out.join(sized(best), ["graph_id", "_k"])
                return out.select("graph_id", F.concat_ws("/", F.lpad(F.col("_k").cast("string"), 4, "0"), "_o").alias("_o"), "value", "props")
        if p := rule.get("mapProperty") or self.target.root.one("transform/mapProperty"):
            hit = source.nodes.where(F.array_contains(F.col("props")[_list(p)[0]], a.id))
            if rule.get("mapProperty") or not self.sources(a):
                return self.within(source, hit, rule).select("graph_id", F.col("node_id").alias("_o"), "value", "props")
        return None

    def sources(self, a: Attribute) -> list[str]:
        rule = _rule(a, self.script)
        return _list(rule.get("source")) + _list(rule.get("sources"))

    def within(self, source: Graph, hit: DataFrame, rule: dict) -> DataFrame:
        context = _list(rule.get("mapContext"))
        if not context:
            return hit
        from .entities import descendants

        below = descendants(source, F.col("schema_node_id") == context[0]).select("graph_id", "node_id").distinct()
        return hit.join(sized(below), ["graph_id", "node_id"], "left_semi")

    def expression(self, source: Graph, text: str, bound: dict[str, DataFrame], k: int) -> DataFrame:
        q = cypher.parse(text)
        if len(q.items) != 1:
            raise SchemaError(f"one column is needed for a value: {text}")
        e = q.items[0][0]
        if not q.paths:
            ids = source.nodes.select("graph_id").distinct()
            return ids.select("graph_id", F.lit(k).alias("_k"), F.lit("").alias("_o"), F.lit(e[1] if e[0] == "lit" else None).cast("string").alias("value"), F.create_map().cast("map<string,array<string>>").alias("props"))
        found = cypher.run(source, text, {v: b for v, b in bound.items()}, with_graph=True)
        name = found.columns[1]
        if e[0] == "var":
            ids = found.select("graph_id", F.col(f"`{name}`").alias("node_id"))
            own = source.nodes.join(sized(ids), ["graph_id", "node_id"], "left_semi")
            return own.select("graph_id", F.lit(k).alias("_k"), F.col("node_id").alias("_o"), "value", "props")
        return found.select("graph_id", F.lit(k).alias("_k"), F.col(f"`{name}`").cast("string").alias("_o"), F.col(f"`{name}`").cast("string").alias("value"), F.create_map().cast("map<string,array<string>>").alias("props"))

    def all_values(self, source: Graph, attributes: Sequence[Attribute]) -> DataFrame | None:
        """(graph_id, attribute, n, value, props): all attributes' values, numbered within each graph and attribute in the order of source nodes.

        Attributes that take plain source nodes share one pass over them.
        """
        parts, plain = [], {}
        for a in attributes:
            got = self.values(source, a)
            if got is None and self.sources(a):
                if _list(_rule(a, self.script).get("mapContext")):
                    hit = source.nodes.where(F.col("schema_node_id").isin(self.sources(a)))
                    got = self.within(source, hit, _rule(a, self.script)).select("graph_id", F.col("node_id").alias("_o"), "value", "props")
                else:
                    for i in self.sources(a):
                        plain.setdefault(i, []).append(a.id)
            if got is not None:
                parts.append(got.select("graph_id", F.lit(a.id).alias("attribute"), "_o", "value", "props"))
        if plain:
            to = F.element_at(F.create_map(*(x for i, ids in plain.items() for x in (F.lit(i), F.array(*map(F.lit, ids))))), F.col("schema_node_id"))
            parts.append(source.nodes.where(F.col("schema_node_id").isin(list(plain))).select("graph_id", F.explode(to).alias("attribute"), F.col("node_id").alias("_o"), "value", "props"))
        if not parts:
            return None
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        keep = self.kept("props")
        # one graph is one document, so a window holds what one document gives an attribute
        n = F.row_number().over(Window.partitionBy("graph_id", "attribute").orderBy(natural(F.col("_o")))) - 1
        return out.select("graph_id", "attribute", n.alias("n"), "value", keep.alias("props"))

    def kept(self, props: str) -> Column:
        return F.map_filter(props, lambda k, v: _any(k, self.keep) | k.isin(self.kept_terms))

    def nested(self) -> bool:
        """Whether instances of containers, symbols or provenance are asked for, so that instances are made from the root down."""
        for a in self.target.attributes():
            rule = _rule(a, self.script)
            if "evaluate" in rule or "provenance" in rule or (a.kind in ("Object", "Array") and set(rule) - {"mapProperty"}):
                return True
            if any(cypher.is_query(x) for x in _list(rule.get("mapContext"))):
                return True
        return False

    def reshape(self, source: Graph) -> Graph:
        """Source nodes are read once for the attributes that take them as they are; all values are numbered and written once."""
        source = source.held()
        if self.nested():
            return _Instances(self, source).graph()
        every = self.target.attributes()
        leaves = [a for a in every if a.kind not in ("Object", "Array")]
        got = self.all_values(source, leaves)
        if got is None:
            return Graph(source.nodes.limit(0), source.edges.limit(0), self.target)
        got = got if got.isStreaming else written(got)

        described = lambda a: _described(a, a in leaves)

        # each value's node, and the containers above it
        up = F.create_map(*(x for a in leaves for x in (F.lit(a.id), F.array(*map(described, reversed(a.path()))))))
        rows = got.select("graph_id", "n", "value", "props", F.explode(F.element_at(up, F.col("attribute"))).alias("a"))
        at = lambda path: F.when(path == "", F.col("graph_id")).otherwise(F.concat("graph_id", F.lit("."), path))
        leaf = F.col("a.leaf")
        node_id = F.concat(at(F.col("a.path")), F.when(leaf & (F.col("n") > 0), F.concat(F.lit("."), F.col("n").cast("string"))).otherwise(F.lit("")))
        none = F.create_map().cast("map<string,array<string>>")
        types = F.when(leaf, F.col("a.types"))
        nodes = rows.select(
            *node_columns(
                graph_id=F.col("graph_id"), node_id=node_id, labels=F.col("a.labels"), schema_node_id=F.col("a.id"), type=F.col("a.kind"), attribute_name=F.col("a.name"), attribute_index=F.col("a.order"), value=F.when(leaf, F.col("value")),
                value_type=types, entity_schema=F.col("a.entity"), entity_root_id=F.col("graph_id"), props=F.when(leaf, F.coalesce("props", none)).otherwise(none),
            )
        ).dropDuplicates(["graph_id", "node_id"])
        edges = rows.where(~F.col("a.root")).select(*edge_columns(graph_id=F.col("graph_id"), src=at(F.col("a.parent")), dst=node_id, label=F.col("a.label"), ord=F.col("a.order"))).dropDuplicates(["graph_id", "dst"])
        from .links import link, link_specs

        out = Graph(nodes, edges, self.target)
        return link(out) if link_specs(self.target) else out


def _described(a: Attribute, leaf: bool) -> Column:
    """What all nodes of a target attribute have in common."""
    names = [x.name or str(x.parent.children.index(x) if x.parent else "") for x in a.path()[1:]]
    order = a.parent.children.index(a) if a.parent is not None else 0
    given = (a.id, ".".join(names), ".".join(names[:-1]), a.kind, a.name or None, order, a.one("entitySchema") or None, a.one("outputEdgeLabel") or HAS)
    kinds = ("id", "path", "parent", "kind", "name", "order", "entity", "label")
    lists = (("labels", ["DocumentNode", a.kind, *a.labels]), ("types", a.many("valueType")))
    return F.struct(*(F.lit(v).cast("int" if k == "order" else "string").alias(k) for k, v in zip(kinds, given, strict=True)), F.lit(a is a.path()[0]).alias("root"), F.lit(leaf).alias("leaf"), *(F.array(*map(F.lit, v)).cast("array<string>").alias(k) for k, v in lists))


_PROPS = "map<string,array<string>>"
_UP = "array<struct<a:int,id:string,parent:string,n:int,value:string,props:map<string,array<string>>>>"


@dataclass(frozen=True)
class _Env:
    """Instances of a target attribute, as what is below them sees them.

    table: graph_id, inst, up (the nodes made on the way, the instance's last), context (the node that a
    mapContext gave, or null), near (the source node that the instance is made from, or null), and an
    array s_<symbol> for each symbol. origin: the source attributes of near.
    """

    table: DataFrame
    nodes: tuple[str, ...] = ()
    values: tuple[str, ...] = ()
    context: bool = False
    origin: tuple[str, ...] = ()

    def symbols(self) -> list[str]:
        return [f"s_{x}" for x in (*self.nodes, *self.values)]


class _Instances:
    """Reshaping from the root down: each attribute's instances are made from those of its parent."""

    def __init__(self, shaper: Reshaper, source: Graph):
        self.shaper, self.source = shaper, source
        self.every = list(shaper.target.attributes())
        self.leaves: list[DataFrame] = []

    def graph(self) -> Graph:
        ids = self.source.nodes.select("graph_id").distinct()
        none = F.lit(None).cast("string")
        start = ids.select("graph_id", none.alias("inst"), F.array().cast(_UP).alias("up"), none.alias("context"), none.alias("near"))
        self.visit(self.shaper.target.root, _Env(start))
        if not self.leaves:
            return Graph(self.source.nodes.limit(0), self.source.edges.limit(0), self.shaper.target)
        # every value with the containers above it; containers are the same on all ways that lead through them
        found = self.leaves[0]
        for other in self.leaves[1:]:
            found = found.unionByName(other)
        found = written(found).select("graph_id", F.explode("up").alias("x"))
        facts = F.element_at(F.create_map(*(y for k, a in enumerate(self.every) for y in (F.lit(k), _described(a, a.kind not in ("Object", "Array"))))), F.col("x.a"))
        rows = found.withColumn("d", facts)
        leaf, none = F.col("d.leaf"), F.create_map().cast(_PROPS)
        nodes = rows.select(
            *node_columns(
                graph_id=F.col("graph_id"), node_id=F.col("x.id"), labels=F.col("d.labels"), schema_node_id=F.col("d.id"), type=F.col("d.kind"), attribute_name=F.col("d.name"), attribute_index=F.coalesce("x.n", "d.order"),
                value=F.when(leaf, F.col("x.value")), value_type=F.when(leaf, F.col("d.types")), entity_schema=F.col("d.entity"), entity_root_id=F.col("graph_id"), props=F.coalesce("x.props", none),
            )
        ).dropDuplicates(["graph_id", "node_id"])
        edges = rows.where("x.parent IS NOT NULL").select(*edge_columns(graph_id=F.col("graph_id"), src=F.col("x.parent"), dst=F.col("x.id"), label=F.col("d.label"), ord=F.coalesce("x.n", "d.order"))).dropDuplicates(["graph_id", "dst"])
        from .links import link, link_specs

        out = Graph(nodes, edges, self.shaper.target)
        return link(out) if link_specs(self.shaper.target) else out

    def visit(self, a: Attribute, env: _Env) -> None:
        rule = _rule(a, self.shaper.script)
        env = self.evaluated(env, _list(rule.get("evaluate")))
        made = self.results(a, env, rule)
        container = a.kind in ("Object", "Array")
        if made is None and not container:
            return
        env = self.instances(a, env, rule, made)
        if not container:
            self.leaves.append(env.table.select("graph_id", "up"))
            return
        for c in a.children:
            self.visit(c, env)

    def evaluated(self, env: _Env, texts: list[str]) -> _Env:
        """env with the named columns of queries as symbols."""
        for text in texts:
            found, kinds = cypher.run_within(self.source, text, _keyed(env.table), env.nodes, env.values)
            new = [(c, name, node) for c, (name, named, node) in zip((f"c{k}" for k in range(len(kinds))), kinds, strict=True) if named]
            # one instance's rows are those of one document
            lists = [F.transform(F.array_sort(F.collect_list(F.struct("o", F.col(c).alias("c")))), lambda x: x["c"]).alias(f"s_{name}") for c, name, _ in new]
            if not lists:
                continue
            got = written(found.groupBy("graph_id", "inst").agg(*lists))
            names = [name for _, name, _ in new]
            table = _joined(env.table.drop(*(f"s_{x}" for x in names)), got)
            nodes = tuple(x for x in env.nodes if x not in names) + tuple(x for _, x, node in new if node)
            values = tuple(x for x in env.values if x not in names) + tuple(x for _, x, node in new if not node)
            env = replace(env, table=table, nodes=nodes, values=values)
        return env

    def results(self, a: Attribute, env: _Env, rule: dict) -> tuple[DataFrame, list[tuple[str, bool]], tuple[str, ...]] | None:
        """(graph_id, inst, k, o, node, value, s_<symbol>...) of a's results with their own symbols (name, is a node), and the source attributes they come from; None if no rule gives any."""
        parts, symbols, k = [], {}, 0
        for key, first in (("valueExpr.first", True), ("valueExpr.all", False), ("valueExpr", True)):
            group = []
            for text in _list(rule.get(key)):
                found, kinds = cypher.run_within(self.source, text, _keyed(env.table), env.nodes, env.values)
                if a.kind == "Value" and len(kinds) != 1:
                    raise SchemaError(f"one column is needed for a value: {text}")
                one = len(kinds) == 1
                some = F.coalesce(*(F.col(f"c{n}") for n in range(len(kinds)))).isNotNull()
                own = {name: (f"c{n}", node) for n, (name, named, node) in enumerate(kinds) if named}
                symbols |= {name: node for name, (_, node) in own.items()}
                is_node = one and kinds[0][2]
                group.append(found.where(some).select("graph_id", "inst", F.lit(k).alias("k"), "o", (F.col("c0") if is_node else F.lit(None)).cast("string").alias("node"), (F.col("c0") if one and not is_node else F.lit(None)).cast("string").alias("value"), *(F.array(c).alias(f"s_{name}") for name, (c, _) in own.items())))
                k += 1
            if first and len(group) > 1:
                whole = written(_union(_filled(group, sorted(symbols))))
                group = [whole.join(sized(whole.groupBy("graph_id", "inst").agg(F.min("k").alias("k"))), ["graph_id", "inst", "k"], "left_semi")]
            parts += group
        wanted = []
        if p := rule.get("mapProperty") or (self.shaper.target.root.one("transform/mapProperty") if a.kind == "Value" and not self.shaper.sources(a) else ""):
            wanted.append((F.array_contains(F.col("props")[_list(p)[0]], a.id), ()))
        if ids := self.shaper.sources(a):
            wanted.append((F.col("schema_node_id").isin(ids), tuple(ids)))
        for condition, ids in wanted:
            hit = self.source.nodes.where(condition)
            if [x for x in _list(rule.get("mapContext")) if not cypher.is_query(x)]:
                hit = self.shaper.within(self.source, hit, rule)
            hit = hit.select("graph_id", "node_id")
            at = "near" if self.stands_below(env, ids) else "context" if env.context else None
            got = self.below(env, hit, at) if at else _keyed(env.table).select("graph_id", "inst").join(sized(hit), "graph_id")
            parts.append(got.select("graph_id", "inst", F.lit(k).alias("k"), natural(F.col("node_id")).alias("o"), F.col("node_id").alias("node"), F.lit(None).cast("string").alias("value")))
            k += 1
        if not parts:
            return None
        names = sorted(symbols)
        return _union(_filled(parts, names)), [(x, symbols[x]) for x in names], tuple(i for _, ids in wanted for i in ids)

    def stands_below(self, env: _Env, ids: tuple[str, ...]) -> bool:
        """Whether the source's layer has these attributes below those that the instances come from."""
        layer = self.source.layer
        return bool(env.origin and ids) and layer is not None and all(any(x.id in env.origin for b in layer.attributes() if b.id == i for x in b.path()[:-1]) for i in ids)

    def below(self, env: _Env, hit: DataFrame, column: str) -> DataFrame:
        """(graph_id, inst, node_id) of the hits below the instances' nodes in a column, those nodes included.

        Hits climb together, an edge each round, until none has anything above it; each round is written.
        """
        up = self.source.edges.select("graph_id", F.col("dst").alias("at"), F.col("src").alias("_above"))
        tops = written(env.table.where(F.col(column).isNotNull()).select("graph_id", F.col(column).alias("at")).distinct())
        level, met, k = written(hit.select("graph_id", "node_id", F.col("node_id").alias("at"))), [], 0
        while not level.isEmpty():
            met.append(level.join(sized(tops), ["graph_id", "at"], "left_semi"))
            k += 1
            if k > MOST_LEVELS:
                raise SchemaError(f"more than {MOST_LEVELS} levels above a source node: is there a cycle?")
            level = written(level.join(sized(up), ["graph_id", "at"]).select("graph_id", "node_id", F.col("_above").alias("at")).distinct())
        if not met:
            return _keyed(env.table).select("graph_id", "inst", F.lit("").alias("node_id")).limit(0)
        pairs = _union(met).distinct()
        own = _keyed(env.table).select("graph_id", "inst", F.col(column).alias("at"))
        return own.join(sized(pairs), ["graph_id", "at"]).select("graph_id", "inst", "node_id")

    def instances(self, a: Attribute, env: _Env, rule: dict, made) -> _Env:
        """The instances of a: one for each result, or one for each instance of the parent where a container has no rule."""
        index = next(k for k, x in enumerate(self.every) if x is a)
        element = a.parent is not None and a.parent.kind == "Array"
        step = "" if a.parent is None else "." + (a.name or str(a.parent.children.index(a)))
        base, none = F.coalesce("inst", "graph_id"), F.lit(None).cast("string")
        symbols, origin, table = [], env.origin, env.table
        if made is None:
            table = table.withColumns({"_n": F.lit(0), "_value": none, "_props": F.lit(None).cast(_PROPS)})
        else:
            found, symbols, ids = made
            n = F.row_number().over(Window.partitionBy("graph_id", "inst").orderBy("k", "o", "value")) - 1
            own = self.source.nodes.select("graph_id", F.col("node_id").alias("node"), F.col("value").alias("_text"), self.shaper.kept("props").alias("_props"))
            found = found.withColumn("_n", n).join(sized(own), ["graph_id", "node"], "left").withColumn("_value", F.coalesce("value", "_text")).drop("value", "_text", "k", "o")
            if a.kind == "Value":
                found = found.where("node IS NOT NULL OR _value IS NOT NULL")
            new = [f"s_{x}" for x, _ in symbols]
            table = _joined(table.drop(*new), found, "inner")
            if a.kind != "Value" and ids:
                origin, table = ids, table.withColumn("near", F.col("node"))
            table = table.drop("node")
        if prov := _list(rule.get("provenance")):
            table = self.with_provenance(env, table, prov[0], symbols)
        suffix = F.concat(F.lit("."), F.col("_n").cast("string"))
        if a.parent is None:
            if made is not None:
                suffix = F.when(F.col("_n") > 0, suffix).otherwise(F.lit(""))
            node_id = base if made is None else F.concat(base, suffix)
        else:
            node_id = F.concat(base, suffix) if element else F.concat(base, F.lit(step), F.when(F.col("_n") > 0, suffix).otherwise(F.lit("")))
        it = F.struct(F.lit(index).alias("a"), node_id.alias("id"), F.col("inst").alias("parent"), (F.col("_n") if element else F.lit(None)).cast("int").alias("n"), F.col("_value").alias("value"), F.col("_props").alias("props"))
        names = [x for x, _ in symbols]
        nodes = tuple(x for x in env.nodes if x not in names) + tuple(x for x, node in symbols if node)
        values = tuple(x for x in env.values if x not in names) + tuple(x for x, node in symbols if not node)
        out = _Env(table, nodes, values, env.context, origin)
        out = replace(out, table=table.select("graph_id", node_id.alias("inst"), F.array_append("up", it).alias("up"), "context", "near", *out.symbols()))
        if a.kind != "Value" and made is not None:
            out = replace(out, table=written(out.table))
        query = [x for x in _list(rule.get("mapContext")) if cypher.is_query(x)]
        if query and made is not None:
            found, kinds = cypher.run_within(self.source, query[0], _keyed(out.table), out.nodes, out.values)
            if not kinds[0][2]:
                raise SchemaError(f"mapContext gives no node: {query[0]}")
            one = F.when(F.count_distinct("c0") > 1, F.raise_error(F.lit(f"{a.id}: more than one context")).cast("string")).otherwise(F.max("c0"))
            got = found.groupBy("graph_id", "inst").agg(one.alias("context"))
            out = replace(out, table=written(_joined(out.table.withColumnRenamed("context", "_was"), got).withColumn("context", F.coalesce("context", "_was")).drop("_was")), context=True, origin=())
        return out

    def with_provenance(self, env: _Env, table: DataFrame, text: str, symbols: list) -> DataFrame:
        """Instances with the provenance properties of the one node that a query finds; a node's own win."""
        found, kinds = cypher.run_within(self.source, text, _keyed(env.table), env.nodes, env.values)
        if len(kinds) != 1 or not kinds[0][2]:
            raise SchemaError(f"provenance needs one column of nodes: {text}")
        one = F.when(F.count_distinct("c0") > 1, F.raise_error(F.lit("provenance: more than one node")).cast("string")).otherwise(F.max("c0"))
        own = self.source.nodes.select("graph_id", F.col("node_id").alias("_node"), F.map_filter("props", lambda k, v: k.startswith("provenance/")).alias("_given"))
        got = found.groupBy("graph_id", "inst").agg(one.alias("_node")).join(sized(own), ["graph_id", "_node"]).drop("_node")
        props = F.coalesce("_props", F.create_map().cast(_PROPS))
        given = F.map_filter(F.coalesce("_given", F.create_map().cast(_PROPS)), lambda k, v: ~F.array_contains(F.map_keys(props), k))
        return _joined(table, got).withColumn("_props", F.map_concat(props, given)).drop("_given")


def _keyed(table: DataFrame) -> DataFrame:
    """An environment's rows with an instance name that is never null."""
    return table.withColumn("inst", F.coalesce("inst", F.lit("")))


def _joined(table: DataFrame, found: DataFrame, how: str = "left") -> DataFrame:
    """table with what was found for its instances."""
    found = found.withColumnRenamed("inst", "_inst").withColumnRenamed("graph_id", "_graph")
    same = (table["graph_id"] == found["_graph"]) & (F.coalesce(table["inst"], F.lit("")) == found["_inst"])
    return table.join(sized(found), same, how).drop("_graph", "_inst")


def _filled(parts: list[DataFrame], symbols: list[str]) -> list[DataFrame]:
    """The parts with all symbols' columns."""
    return [p.select(*p.columns, *(F.lit(None).cast("array<string>").alias(f"s_{x}") for x in symbols if f"s_{x}" not in p.columns)) for p in parts]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _any(k: Column, prefixes: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | k.startswith(p)
    return out


def apply_layer(graph: Graph, layer: Layer, reinterpret: bool = False) -> Graph:
    """Annotations of a layer added to the nodes that are instances of its attributes.

    Terms that compose as sets are united, others are replaced. reinterpret: values move from
    their node's type to the layer's, where that says another.
    """
    from ..functions.types import convert, type_name
    from ..schema.layer import rule_of

    rows = schema_nodes(graph.spark, layer).select(F.col("node_id").alias("schema_node_id"), F.col("props").alias("_p"), F.col("labels").alias("_l"))
    nodes = graph.nodes.join(F.broadcast(rows), "schema_node_id", "left")  # a layer is driver-sized
    terms = sorted({t for a in layer.attributes() for t in a.props})
    united = [t for t in terms if rule_of(t) == "set"]
    merged = F.map_zip_with("props", "_p", lambda k, a, b: F.when(k.isin(united), F.array_union(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>")))).otherwise(F.coalesce(b, a)))
    nodes = nodes.withColumn("props", F.when(F.col("_p").isNull(), F.col("props")).otherwise(merged)).withColumn("labels", F.when(F.col("_l").isNull(), F.col("labels")).otherwise(F.array_union("labels", "_l")))
    if reinterpret:
        value, types = F.col("value"), F.col("value_type")
        for a in layer.attributes():
            new = a.one("valueType")
            old = graph.layer.find(a.id).one("valueType") if graph.layer is not None and graph.layer.find(a.id) else ""
            if a.kind == "Value" and new and type_name(new) != type_name(old):
                mine = F.col("schema_node_id") == a.id
                value = F.when(mine, convert(old, new, F.col("value"), target_go=a.many("goTimeFormat"), target_moment=a.many("momentTimeFormat"))).otherwise(value)
                types = F.when(mine, F.array(F.lit(new))).otherwise(types)
        nodes = nodes.withColumns({"value": value, "value_type": types})
    return graph.with_(nodes=nodes.select(*graph.nodes.columns))


def reingest(graph: Graph, variant: Layer, root: str | None = None) -> Graph:
    """The graph rebuilt under another variant: exported to JSON by attribute names and ingested again."""
    from ..sinks.exports import to_json
    from .ingest import ingest_json

    docs = to_json(graph, root or graph.layer.root.id)
    return ingest_json(docs.withColumn("_g", F.col("graph_id")), variant, "json", F.col("_g"))
