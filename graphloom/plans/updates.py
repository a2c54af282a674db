"""Updating clauses of openCypher: CREATE, MERGE, SET, REMOVE and [DETACH] DELETE as deltas of the nodes and edges tables.

What a query matches is written once; each clause then makes a small table of changes, which meets
nodes and edges by key. Patterns stay within one graph_id, and a query that matches nothing before its
first clause is done once in every graph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import HAS, Graph, edge_columns, node_columns
from ..storage import written
from .cypher import _COLUMNS, QueryError, _Node, _Parser, _Plan, numbered

_WORDS = ("CREATE", "MERGE", "SET", "REMOVE", "DELETE", "DETACH")
_PROPS = "map<string,array<string>>"


class _UpdateParser(_Parser):
    """Matches and conditions as in a reading query, then updating clauses to the end."""

    def props(self) -> dict:
        out = {}
        if self.take("{"):
            while not self.take("}"):
                key = self.literal() if self.peek()[0] == "str" else self.name()
                self.need(":")
                out[key] = self.expr() if self.updating else self.literal()
                self.take(",")
        return out

    def update(self) -> tuple[list, tuple | None, list]:
        self.updating = False
        paths, where, clauses = [], None, []
        while self.take("MATCH"):
            paths += self.paths()
            own = self.condition()
            where = own if where is None else where if own is None else ("and", where, own)
        self.updating = True
        while self.peek()[0] != "end":
            word = self.word()
            if word not in _WORDS:
                raise QueryError(f"one of {', '.join(_WORDS)} expected, not {self.peek()[1]!r}")
            self.at += 1
            if word in ("CREATE", "MERGE"):
                clauses.append((word, self.paths() if word == "CREATE" else [self.path()]))
            elif word in ("SET", "REMOVE"):
                clauses.append((word, self.targets(word == "SET")))
            else:
                if word == "DETACH":
                    self.need("DELETE")
                names = [self.name()]
                while self.take(","):
                    names.append(self.name())
                clauses.append((word, names))
        if not clauses:
            raise QueryError("nothing is updated")
        return paths, where, clauses

    def targets(self, values: bool) -> list[tuple]:
        """(variable, property or None, label or None, expression or None)"""
        out = []
        while True:
            var = self.name()
            if self.take(":"):
                out.append((var, None, self.name(), None))
            else:
                self.need(".")
                key = self.name()
                if values:
                    self.need("=")
                out.append((var, key, None, self.expr() if values else None))
            if not self.take(","):
                return out


class _Update:
    def __init__(self, graph: Graph, paths: list, where, held: bool):
        # edges are numbered once, so that a match and a change mean the same one of parallel edges
        self.graph = graph if held else graph.with_(nodes=written(graph.nodes))
        self.edges = numbered(graph.edges)
        self.plan = _Plan(self.graph.with_(edges=self.edges), {})
        self.plan.numbered = True
        df = self.plan.pattern(None, paths) if paths else self.graph.nodes.select("graph_id").distinct()
        if where is not None:
            df = df.where(self.plan.column(where))
        self.rows = written(df.withColumn("_row", F.monotonically_increasing_id()))

    def value(self, e) -> Column:
        return self.plan.column(e).cast("string")

    def bound(self, n: _Node) -> bool:
        return n.var in self.plan.nodes

    # --- changes of what is there

    def set_(self, targets: list[tuple], remove: bool) -> None:
        """Changes of all targets, each table written once for them."""
        was, edges = self.graph.nodes, self.edges
        for var, key, label, e in targets:
            change = F.lit(label) if label else F.lit(None).cast("string") if e is None else self.value(e)
            if var in self.plan.nodes:
                self.change("nodes", ["graph_id", "node_id"], self.rows.select("graph_id", F.col(f"{var}.node_id").alias("node_id"), change.alias("_new")), key, label, remove)
            elif var in self.plan.edges:
                ends = ["src", "dst", "label", "number"]
                self.change("edges", ["graph_id", *ends], self.rows.select("graph_id", *(F.col(f"{var}.{c}").alias(c) for c in ends), change.alias("_new")), key, label, remove)
            else:
                raise QueryError(f"unknown variable {var}")
        if self.graph.nodes is not was:
            self.put("nodes", written(self.graph.nodes))
        if self.edges is not edges:
            self.put("edges", written(self.edges))

    def change(self, table: str, keys: list[str], found: DataFrame, key: str | None, label: str | None, remove: bool) -> None:
        several = F.when(F.count_distinct(F.coalesce("_new", F.lit("\0"))) > 1, F.raise_error(F.lit(f"more than one value for {key or label}")).cast("string")).otherwise(F.max("_new"))
        one = found.where(F.col(keys[-1]).isNotNull()).groupBy(*keys).agg(several.alias("_new"), F.lit(True).alias("_hit"))
        old = self.graph.nodes if table == "nodes" else self.edges
        both = old.join(one, keys, "left")
        hit = F.coalesce("_hit", F.lit(False))
        if label is not None:
            if table == "edges":
                raise QueryError("an edge keeps its label")
            column, new = "labels", F.array_remove("labels", label) if remove else F.array_union(F.coalesce("labels", F.array().cast("array<string>")), F.array(F.lit(label)))
        elif table == "nodes" and key in _COLUMNS:
            if key == "nodeId":
                raise QueryError("a node keeps its id")
            column = _COLUMNS[key]
            new = F.col("_new").cast(old.schema[column].dataType)
        else:
            column, rest = "props", F.map_filter("props", lambda k, v: k != key)
            new = F.when(F.col("_new").isNull(), rest).otherwise(F.map_concat(rest, F.create_map(F.lit(key), F.array("_new"))))
        self.put(table, both.withColumn(column, F.when(hit, new).otherwise(F.col(column))).select(*old.columns))

    def put(self, table: str, df: DataFrame) -> None:
        if table == "nodes":
            self.graph = self.graph.with_(nodes=df)
        else:
            self.edges = df

    def delete(self, names: list[str], detach: bool) -> None:
        for var in names:
            if var in self.plan.edges:
                ends = ["graph_id", "src", "dst", "label", "number"]
                gone = self.rows.select("graph_id", *(F.col(f"{var}.{c}").alias(c) for c in ends[1:])).distinct()
                self.edges = written(self.edges.join(gone, ends, "left_anti"))
            elif var in self.plan.nodes:
                gone = written(self.rows.select("graph_id", F.col(f"{var}.node_id").alias("node_id")).distinct())
                for end in ("src", "dst"):
                    own = gone.withColumnRenamed("node_id", end)
                    if not detach:
                        held = self.edges.join(own, ["graph_id", end], "left_semi").first()
                        if held is not None:
                            raise QueryError(f"{var}: node {held[end]} of graph {held['graph_id']} has edges; DETACH DELETE takes them too")
                    self.edges = written(self.edges.join(own, ["graph_id", end], "left_anti").select(*self.edges.columns))
                self.put("nodes", written(self.graph.nodes.join(gone, ["graph_id", "node_id"], "left_anti").select(*self.graph.nodes.columns)))
            else:
                raise QueryError(f"unknown variable {var}")

    # --- what is new

    def create(self, paths: list[list], merge: bool) -> None:
        for path in paths:
            for n in path[::2]:
                if not self.bound(n):
                    self.node(n, merge)
            for a, r, b in zip(path[::2], path[1::2], path[2::2], strict=False):
                self.edge(a, r, b, merge)

    def node(self, n: _Node, merge: bool) -> None:
        """A node for each row, or (merge) the nodes that fit, and one for the rows of a graph with equal properties where none fits."""
        values = {k: self.value(e) for k, e in n.props.items()}
        rows = self.rows.withColumns({f"_v{i}": v for i, v in enumerate(values.values())})
        keys = [f"_v{i}" for i in range(len(values))]
        if merge:
            asked = rows.select("graph_id", *keys).distinct()
            fits = self.graph.nodes
            for label in n.labels:
                fits = fits.where(F.array_contains("labels", label))
            fits = fits.select("graph_id", F.col("node_id").alias("_old"), *(self.plan.value(k, "").alias(f"_v{i}") for i, k in enumerate(values)))
            wanted = asked.join(fits, ["graph_id", *keys], "left")
            wanted = written(wanted.withColumn("_id", F.coalesce("_old", F.concat(F.lit(f"_{n.var}."), F.sha1(F.to_json(F.array(F.lit(",".join(n.labels)), *keys)).cast("binary"))))))
            made, rows = wanted.where("_old IS NULL"), rows.join(wanted.drop("_old"), ["graph_id", *keys])
        else:
            rows = written(rows.withColumn("_id", F.concat(F.lit(f"_{n.var}."), F.expr("uuid()"))))
            made = rows
        own = {_COLUMNS[k]: F.col(f"_v{i}") for i, k in enumerate(values) if k in _COLUMNS and k != "nodeId"}
        rest = [x for i, k in enumerate(values) if k not in _COLUMNS for x in (F.lit(k), F.array(f"_v{i}"))]
        props = F.map_filter(F.create_map(*rest), lambda k, v: v[0].isNotNull()) if rest else F.create_map().cast(_PROPS)
        new = made.select(*node_columns(graph_id=F.col("graph_id"), node_id=F.col("_id"), labels=F.array(*map(F.lit, n.labels)).cast("array<string>"), props=props, **own))
        self.put("nodes", written(self.graph.nodes.unionByName(new)))
        struct = self.graph.nodes.select("graph_id", F.col("node_id").alias("_id"), F.struct(*(c for c in self.graph.nodes.columns if c != "graph_id")).alias(n.var))
        self.rows = written(rows.drop(*keys).join(struct, ["graph_id", "_id"]).drop("_id"))
        self.plan.nodes.add(n.var)

    def edge(self, a: _Node, r, b: _Node, merge: bool) -> None:
        if r.variable or len(r.labels) > 1 or r.direction == "both":
            raise QueryError("a new edge has one direction and at most one label")
        src, dst = (a, b) if r.direction == "out" else (b, a)
        label = r.labels[0] if r.labels else HAS
        items = [x for k, e in r.props.items() for x in (F.lit(k), F.array(self.value(e)))]
        props = F.create_map(*items) if items else F.create_map().cast(_PROPS)
        new = self.rows.select(*edge_columns(graph_id=F.col("graph_id"), src=F.col(f"{src.var}.node_id"), dst=F.col(f"{dst.var}.node_id"), label=label, props=props.cast(_PROPS)))
        ends = ["graph_id", "src", "dst", "label"]
        if merge:
            said = F.to_json(F.array_sort(F.map_entries("props")))
            new = new.withColumn("_said", said).dropDuplicates([*ends, "_said"])
            there = self.edges.select(*ends, F.col("props").alias("_there"))
            # an edge fits if it has the properties that the pattern names
            fits = new.join(there, ends).where(F.forall(F.map_entries("props"), lambda p: F.col("_there")[p["key"]] == p["value"])).select(*ends, "_said")
            new = new.join(fits.distinct(), [*ends, "_said"], "left_anti").drop("_said")
        # matched edges have numbers from 1, so a new one is none of them
        self.edges = written(self.edges.unionByName(new.withColumn("number", F.lit(0).cast("long")).select(*self.edges.columns)))


def update(graph: Graph, text: str, held: bool = False) -> Graph:
    """The graph after a query of MATCH clauses and updating clauses.

    SET and REMOVE change properties and labels of matched nodes and properties of edges; two different
    values for one property are an error. CREATE makes its nodes and edges for each matched row; MERGE only where
    nothing fits: of a node its labels and properties, of an edge its ends, label and properties. DELETE
    of a node that has edges is an error unless DETACH. Clauses work in order; matches are those of the beginning.
    held: the graph's nodes are a table that is written, as those that an update gives are.
    """
    parser = _UpdateParser(text)
    paths, where, clauses = parser.update()
    work = _Update(graph, paths, where, held)
    for word, given in clauses:
        if word in ("CREATE", "MERGE"):
            work.create(given, word == "MERGE")
        elif word in ("SET", "REMOVE"):
            work.set_(given, word == "REMOVE")
        else:
            work.delete(given, word == "DETACH")
    return work.graph.with_(edges=work.edges.drop("number").select(*graph.edges.columns))


def updates(text: str) -> bool:
    """Whether a query changes the graph, by its words outside of strings and patterns."""
    return any(kind == "name" and word.upper() in _WORDS for kind, word in _Parser(text).tokens)
