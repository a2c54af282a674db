"""A subset of openCypher over the nodes and edges tables, lowered to joins.

MATCH and OPTIONAL MATCH of linear patterns (labels, property maps, directions, *min..max), WHERE,
UNWIND of lists, WITH and RETURN (projection, *, aliases, DISTINCT, aggregates, ORDER BY, SKIP, LIMIT; WITH
also WHERE). Patterns stay within one graph_id; what is
aggregated, made distinct, ordered or cut is so over all graphs, in WITH as in RETURN (within each graph where the
caller asks for graph ids). After a WITH that carries no node no further pattern can be matched. A
variable-length step is the union of its lengths; without an upper bound it is followed to its end.
Patterns without a common variable combine within a graph, up to MOST_APART nodes of the later one.
The single steps of one MATCH are different edges; parallel edges are told apart by their numbers.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import natural
from ..graph import Graph
from ..storage import written

#: Nodes of one graph that a pattern may have which shares no variable with those before it.
MOST_APART = 10_000
_TOKEN = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<num>\d+\.\d+|\d+)|(?P<name>`[^`]+`|[A-Za-z_][A-Za-z_0-9]*)|(?P<op><>|<=|>=|=~|->|<-|\.\.|[()\[\]{}:,.|=<>+\-*/%]))")
_COLUMNS = {"value": "value", "schemaNodeId": "schema_node_id", "attributeName": "attribute_name", "attributeIndex": "attribute_index", "entitySchema": "entity_schema", "nodeId": "node_id", "type": "type", "source": "source"}
_AGGREGATES = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "collect": F.collect_list}


class QueryError(ValueError):
    pass


@dataclass
class _Node:
    var: str
    labels: list[str] = field(default_factory=list)
    props: dict = field(default_factory=dict)


@dataclass
class _Rel:
    var: str
    labels: list[str]
    props: dict
    direction: str  # out, in, both
    low: int = 1
    high: int | None = 1
    variable: bool = False


@dataclass
class _Query:
    paths: list[list] = field(default_factory=list)
    where: tuple | None = None
    items: list[tuple] = field(default_factory=list)
    distinct: bool = False
    order: list[tuple] = field(default_factory=list)
    skip: int | None = None
    limit: int | None = None
    named: set[str] = field(default_factory=set)
    rest: list[tuple] = field(default_factory=list)  # clauses after the first matches


class _Parser:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        while at < len(text.rstrip()):
            m = _TOKEN.match(text, at)
            if not m:
                raise QueryError(f"cannot read {text[at : at + 20]!r}")
            kind = m.lastgroup
            self.tokens.append((kind, m[kind]))
            at = m.end()
        self.at, self.made = 0, 0

    def peek(self, k: int = 0):
        return self.tokens[self.at + k] if self.at + k < len(self.tokens) else ("end", "")

    def word(self) -> str:
        kind, text = self.peek()
        return text.upper() if kind == "name" else ""

    def take(self, *texts: str) -> bool:
        kind, text = self.peek()
        if kind != "str" and (text in texts or (kind == "name" and text.upper() in texts)):
            self.at += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.take(text):
            raise QueryError(f"{text} expected, not {self.peek()[1]!r}")

    def name(self) -> str:
        kind, text = self.peek()
        if kind != "name":
            raise QueryError(f"a name expected, not {text!r}")
        self.at += 1
        return text.strip("`")

    def fresh(self) -> str:
        self.made += 1
        return f"_{self.made}"

    def query(self) -> _Query:
        q = _Query()
        while not self.take("RETURN"):
            if self.take("OPTIONAL"):
                self.need("MATCH")
                q.rest.append(("optional", self.paths(), self.condition()))
            elif self.take("MATCH"):
                paths, own = self.paths(), self.condition()
                if q.rest:
                    q.rest.append(("match", paths, own))
                    continue
                q.paths += paths
                if own is not None:
                    q.where = own if q.where is None else ("and", q.where, own)
            elif self.take("UNWIND"):
                e = self.expr()
                self.need("AS")
                q.rest.append(("unwind", e, self.name()))
            elif self.take("WITH"):
                distinct = self.take("DISTINCT")
                q.rest.append(("with", self.items(set()), distinct, self.cut(), self.condition()))
            else:
                self.need("RETURN")
        q.distinct = self.take("DISTINCT")
        q.items = self.items(q.named)
        q.order, q.skip, q.limit = self.cut()
        if self.peek()[0] != "end":
            raise QueryError(f"unexpected {self.peek()[1]!r}")
        return q

    def cut(self) -> tuple[list, int | None, int | None]:
        """ORDER BY, SKIP and LIMIT, as far as they stand here."""
        order: list[tuple] = []
        if self.take("ORDER"):
            self.need("BY")
            while True:
                e = self.expr()
                order.append((e, self.take("DESC", "DESCENDING") or (self.take("ASC", "ASCENDING") and False)))
                if not self.take(","):
                    break
        skip = int(self.literal()) if self.take("SKIP") else None
        return order, skip, int(self.literal()) if self.take("LIMIT") else None

    def paths(self) -> list[list]:
        out = [self.path()]
        while self.take(","):
            out.append(self.path())
        return out

    def condition(self) -> tuple | None:
        return self.expr() if self.take("WHERE") else None

    def items(self, named: set[str]) -> list[tuple]:
        out = []
        if self.take("*"):
            out.append((("all",), "*"))
            if not self.take(","):
                return out
        while True:
            start = self.at
            e = self.expr()
            text = "".join(t.strip("`") for _, t in self.tokens[start : self.at])
            if self.take("AS"):
                text = self.name()
                named.add(text)
            out.append((e, text))
            if not self.take(","):
                return out

    def literal(self):
        kind, text = self.peek()
        self.at += 1
        if kind == "str":
            return re.sub(r"\\(.)", r"\1", text[1:-1])
        if kind == "num":
            return float(text) if "." in text else int(text)
        if kind == "name" and text.upper() in ("TRUE", "FALSE"):
            return text.upper() == "TRUE"
        raise QueryError(f"a value expected, not {text!r}")

    def props(self) -> dict:
        out = {}
        if self.take("{"):
            while not self.take("}"):
                key = self.literal() if self.peek()[0] == "str" else self.name()
                self.need(":")
                out[key] = self.literal()
                self.take(",")
        return out

    def path(self) -> list:
        out: list = [self.node()]
        while self.peek()[1] in ("-", "<-") and self.peek()[0] == "op":
            out += [self.rel(), self.node()]
        return out

    def node(self) -> _Node:
        self.need("(")
        var = self.name() if self.peek()[0] == "name" else self.fresh()
        labels = []
        while self.take(":"):
            labels.append(self.name())
        out = _Node(var, labels, self.props())
        self.need(")")
        return out

    def rel(self) -> _Rel:
        inward = self.take("<-") or (self.need("-"), False)[1]
        out = _Rel(self.fresh(), [], {}, "both")
        if self.take("["):
            if self.peek()[0] == "name":
                out.var = self.name()
            if self.take(":"):
                out.labels.append(self.name())
                while self.take("|"):
                    self.take(":")
                    out.labels.append(self.name())
            if self.take("*"):
                out.variable, out.high = True, None
                if self.peek()[0] == "num":
                    out.low = out.high = int(self.literal())
                if self.take(".."):
                    out.high = int(self.literal()) if self.peek()[0] == "num" else None
            out.props = self.props()
            self.need("]")
        outward = self.take("->") or (self.need("-"), False)[1]
        if inward and outward:
            raise QueryError("a step has one direction")
        out.direction = "in" if inward else "out" if outward else "both"
        return out

    # expressions, by falling precedence
    def expr(self):
        left = self.conjunction()
        while self.take("OR"):
            left = ("or", left, self.conjunction())
        return left

    def conjunction(self):
        left = self.negation()
        while self.take("AND"):
            left = ("and", left, self.negation())
        return left

    def negation(self):
        return ("not", self.negation()) if self.take("NOT") else self.comparison()

    def comparison(self):
        left = self.sum()
        for op in ("<>", "<=", ">=", "=~", "=", "<", ">"):
            if self.take(op):
                return (op, left, self.sum())
        if self.take("IN"):
            return ("in", left, self.sum())
        if self.take("CONTAINS"):
            return ("contains", left, self.sum())
        if self.word() in ("STARTS", "ENDS"):
            op = self.word().lower()
            self.at += 1
            self.need("WITH")
            return (op, left, self.sum())
        if self.take("IS"):
            no = self.take("NOT")
            self.need("NULL")
            return ("notnull" if no else "null", left)
        return left

    def sum(self):
        left = self.product()
        while self.peek() in (("op", "+"), ("op", "-")):
            op = self.peek()[1]
            self.at += 1
            left = (op, left, self.product())
        return left

    def product(self):
        left = self.atom()
        while self.peek() in (("op", "*"), ("op", "/"), ("op", "%")):
            op = self.peek()[1]
            self.at += 1
            left = (op, left, self.atom())
        return left

    def atom(self):
        if self.take("("):
            e = self.expr()
            self.need(")")
            return e
        if self.take("["):
            out = []
            while not self.take("]"):
                out.append(self.expr())
                self.take(",")
            return ("list", out)
        if self.take("-"):
            return ("-", ("lit", 0), self.atom())
        kind, text = self.peek()
        if kind in ("str", "num") or (kind == "name" and text.upper() in ("TRUE", "FALSE")):
            return ("lit", self.literal())
        if kind == "name" and text.upper() == "NULL":
            self.at += 1
            return ("lit", None)
        name = self.name()
        if self.take("("):
            distinct, args = self.take("DISTINCT"), []
            if self.take("*"):
                self.need(")")
                return ("call", name.lower(), False, ["*"])
            while not self.take(")"):
                args.append(self.expr())
                self.take(",")
            return ("call", name.lower(), distinct, args)
        if self.take("."):
            return ("prop", name, self.name())
        return ("var", name)


def parse(text: str) -> _Query:
    return _Parser(text).query()


def is_query(text: str) -> bool:
    """Whether a text is a query, not an id."""
    return re.match(r"\s*(optional\s+match|match|unwind|with|return)\b", text, re.I) is not None


def numbered(edges: DataFrame) -> DataFrame:
    """Edges with a number above 0 that tells each from all others."""
    return written(edges.withColumn("number", F.monotonically_increasing_id() + 1))


class _Plan:
    def __init__(self, graph: Graph, bindings: dict[str, DataFrame]):
        self.graph, self.bindings = graph, bindings
        self.params: set[str] = set()
        self.lists: set[str] = set()  # params that hold lists of values from outside
        self.arrays: set[str] = set()  # params that a clause made as lists
        self.nodes: set[str] = set()
        self.edges: set[str] = set()
        self.steps_here: list[str] = []  # edge variables of the clause at work
        self.keys: tuple[str, ...] = ()  # columns that aggregates keep apart
        self.numbered = False

    def pattern(self, df: DataFrame | None, paths: list[list]) -> DataFrame:
        """df joined with the paths of one MATCH, each begun where a variable is known already."""
        if df is not None and "graph_id" not in df.columns:
            raise QueryError("a pattern after WITH needs a node that WITH carries")
        self.steps_here = []
        self.numbered = self.numbered or sum(not r.variable for path in paths for r in path[1::2]) > 1
        for path in paths:
            for part in self.begun(path):
                df = self.path(df, part)
        return df

    def begun(self, path: list) -> list[list]:
        """The path, or its two ends from the first known node outwards."""
        known = next((k for k in range(0, len(path), 2) if path[k].var in self.nodes), 0)
        if known == 0:
            return [path]
        turn = {"out": "in", "in": "out", "both": "both"}
        back = [x if isinstance(x, _Node) else replace(x, direction=turn[x.direction]) for x in reversed(path[: known + 1])]
        return [back] + ([path[known:]] if known + 1 < len(path) else [])

    def scan(self, n: _Node) -> DataFrame:
        df = self.graph.nodes
        for label in n.labels:
            df = df.where(F.array_contains("labels", label))
        for k, v in n.props.items():
            df = df.where(self.value(k, "") == F.lit(str(v)))
        out = df.select("graph_id", F.struct(*(c for c in df.columns if c != "graph_id")).alias(n.var))
        if n.var in self.bindings:
            bound = self.bindings[n.var].select("graph_id", F.col("node_id").alias("_b"))
            out = out.join(bound, (out["graph_id"] == bound["graph_id"]) & (out[f"{n.var}.node_id"] == bound["_b"]), "left_semi")
        return out

    def value(self, prop: str, prefix: str) -> Column:
        own = _COLUMNS.get(prop)
        return F.col(f"{prefix}{own}").cast("string") if own else F.get(F.col(f"{prefix}props")[prop], F.lit(0))

    def steps(self, r: _Rel) -> DataFrame:
        """(graph_id, _from, _to, the edge as r.var) of one step."""
        e = self.counted() if self.numbered else self.graph.edges.withColumn("number", F.lit(0).cast("long"))
        if r.labels:
            e = e.where(F.col("label").isin(r.labels))
        for k, v in r.props.items():
            e = e.where((F.col("label") if k == "label" else F.get(F.col("props")[k], F.lit(0))) == F.lit(str(v)))
        edge = F.struct("src", "dst", "label", "props", "number").alias(r.var)
        out = e.select("graph_id", F.col("src").alias("_from"), F.col("dst").alias("_to"), edge)
        back = e.select("graph_id", F.col("dst").alias("_from"), F.col("src").alias("_to"), edge)
        return {"out": out, "in": back, "both": out.unionByName(back)}[r.direction]

    def counted(self) -> DataFrame:
        """Edges with numbers, written once before any filter, so that a number means the same edge in every step and no step sorts for it."""
        if "number" not in self.graph.edges.columns:
            self.graph = self.graph.with_(edges=numbered(self.graph.edges))
        return self.graph.edges

    def reach(self, r: _Rel) -> DataFrame:
        """(graph_id, _from, _to) by low to high steps; each way counts once, and no edge stands twice in a way.

        Without an upper bound ways grow by a step at a time, each length written, until none is left:
        as no edge repeats, they end even where the graph has cycles.
        """
        one = self.steps(r).select("graph_id", "_from", "_to", F.to_json(F.col(r.var)).alias("_edge"))
        parts = []
        if r.low == 0:
            parts.append(self.graph.nodes.select("graph_id", F.col("node_id").alias("_from"), F.col("node_id").alias("_to")))
        if r.high is None:
            one = written(one)
        level = one.select("graph_id", "_from", "_to", F.array("_edge").alias("_way"))
        k = 1
        while r.high is None or k <= r.high:
            if r.high is None:
                level = written(level)
                if level.isEmpty():
                    break
            if k >= r.low:
                parts.append(level.select("graph_id", "_from", "_to"))
            step = one.select("graph_id", F.col("_from").alias("_mid"), F.col("_to").alias("_next"), "_edge")
            level = level.withColumnRenamed("_to", "_mid").join(step, ["graph_id", "_mid"]).where(~F.array_contains("_way", F.col("_edge")))
            level = level.select("graph_id", "_from", F.col("_next").alias("_to"), F.array_append("_way", F.col("_edge")).alias("_way"))
            k += 1
        if not parts:
            return one.select("graph_id", "_from", "_to").limit(0)
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def path(self, df: DataFrame | None, path: list) -> DataFrame:
        first = path[0]
        if first.var in self.nodes:
            out = self.narrow(df, first)
        else:
            own = self.scan(first)
            if df is not None and first.var not in self.bindings:
                many = own.groupBy("graph_id").agg(F.count("*").alias("_c"))
                few = F.when(F.col("_c") <= MOST_APART, True).otherwise(F.raise_error(F.lit(f"more than {MOST_APART} nodes of a graph in a pattern that shares no variable")).cast("boolean"))
                own = own.join(many.where(few).drop("_c"), "graph_id")
            out = own if df is None else df.join(own, "graph_id")
            self.nodes.add(first.var)
        at = first.var
        for r, n in zip(path[1::2], path[2::2]):
            step = self.reach(r) if r.variable else self.steps(r)
            out = out.withColumn("_from", F.col(f"{at}.node_id")).join(step, ["graph_id", "_from"]).drop("_from")
            if not r.variable:
                self.edges.add(r.var)
                for other in self.steps_here:
                    out = out.where(F.struct(*(f"{r.var}.{c}" for c in ("src", "dst", "label", "number"))) != F.struct(*(f"{other}.{c}" for c in ("src", "dst", "label", "number"))))
                self.steps_here.append(r.var)
            if n.var in self.nodes:
                out = self.narrow(out.where(F.col(f"{n.var}.node_id") == F.col("_to")).drop("_to"), n)
            else:
                own = self.scan(n).withColumn("_to", F.col(f"{n.var}.node_id"))
                out = out.join(own, ["graph_id", "_to"]).drop("_to")
                self.nodes.add(n.var)
            at = n.var
        return out

    def clause(self, df: DataFrame, kind: str, *given) -> DataFrame:
        """df after a clause that follows the first matches."""
        if kind == "match":
            df = self.pattern(df, given[0])
            return df if given[1] is None else df.where(self.column(given[1]))
        if kind == "optional":
            # rows are numbered and written, so that both uses of them have the same numbers
            df = written(df.withColumn("_row", F.monotonically_increasing_id()))
            was = df.columns
            hit = self.pattern(df, given[0])
            if given[1] is not None:
                hit = hit.where(self.column(given[1]))
            hit = hit.select("_row", *(c for c in hit.columns if c not in was))
            return df.join(hit, "_row", "left").drop("_row")
        if kind == "unwind":
            self.params.add(given[1])
            return df.withColumn(f"_param_{given[1]}", F.explode(self.listed(given[0])))
        items, distinct, (order, skip, limit), where = given
        items = self.spread(items)
        nodes = {n: e[1] for e, n in items if e[0] == "var" and e[1] in self.nodes}
        edges = {n: e[1] for e, n in items if e[0] == "var" and e[1] in self.edges}
        plain = {n: e for e, n in items if n not in nodes and n not in edges}
        carried = [c for c in ("graph_id", *self.keys) if c in df.columns and (c in self.keys or nodes or edges)]
        lists = {n for n, e in plain.items() if e[0] == "var" and e[1] in self.lists}
        sort = [(self.column(e), d) for e, d in order if not self.aggregates(e) and not (e[0] == "var" and e[1] in plain)]
        if any(self.aggregates(e) for e in plain.values()):
            keys = [F.col(f"{v}.node_id").alias(f"_key_{n}") for n, v in nodes.items()] + [F.struct(f"{v}.src", f"{v}.dst", f"{v}.label", f"{v}.number").alias(f"_key_{n}") for n, v in edges.items()]
            keys += [self.column(e).alias(f"_param_{n}") for n, e in plain.items() if not self.aggregates(e)]
            made = [F.first(v).alias(n) for n, v in (nodes | edges).items()] + [self.column(e).alias(f"_param_{n}") for n, e in plain.items() if self.aggregates(e)]
            df = df.groupBy(*carried, *keys).agg(*made).drop(*(f"_key_{n}" for n in nodes | edges))
            sort = []
        else:
            extra = [c.alias(f"_o{k}") for k, (c, _) in enumerate(sort)] if not distinct else []
            df = df.select(*carried, *(F.col(v).alias(n) for n, v in (nodes | edges).items()), *(self.column(e).alias(f"_param_{n}") for n, e in plain.items()), *extra)
            sort = [(F.col(f"_o{k}"), d) for k, (_, d) in enumerate(sort)] if not distinct else []
            if distinct:
                # nodes and edges hold maps, which cannot be compared: one of each is taken
                keys = [F.col(f"{n}.node_id").alias(f"_key_{n}") for n in nodes] + [F.struct(f"{n}.src", f"{n}.dst", f"{n}.label", f"{n}.number").alias(f"_key_{n}") for n in edges]
                df = df.groupBy(*carried, *keys, *(f"_param_{n}" for n in plain)).agg(*(F.first(n).alias(n) for n in nodes | edges), F.count("*").alias("_c")).drop("_c", *(f"_key_{n}" for n in nodes | edges))
        self.arrays = {n for n, e in plain.items() if self.is_list(e) or (e[0] == "var" and e[1] in self.arrays)} - lists
        self.nodes, self.edges, self.params, self.lists = set(nodes), set(edges), set(plain), lists
        if order:
            own = iter(sort)
            terms = []
            for e, d in order:
                c, d = (self.column(e), d) if (e[0] == "var" and e[1] in plain) or not sort else next(own)
                terms.append(c.desc() if d else c.asc())
            df = df.orderBy(*terms)
        if (order or skip or limit is not None) and self.keys:
            raise QueryError("ORDER BY, SKIP and LIMIT after WITH cut over all graphs, and graphs were asked for apart")
        df = df.offset(skip) if skip else df
        df = df if limit is None else df.limit(limit)
        df = df.drop(*(c for c in df.columns if c.startswith("_o") and c[2:].isdigit()))
        return df if where is None else df.where(self.column(where))

    def spread(self, items: list[tuple]) -> list[tuple]:
        """Items with * as all variables that the query names."""
        own = sorted(v for v in self.nodes | self.edges | self.params if not re.fullmatch(r"_\d+", v))
        return [x for e, n in items for x in ([(("var", v), v) for v in own] if e == ("all",) else [(e, n)])]

    def narrow(self, df: DataFrame, n: _Node) -> DataFrame:
        for label in n.labels:
            df = df.where(F.array_contains(f"{n.var}.labels", label))
        for k, v in n.props.items():
            df = df.where(self.value(k, f"{n.var}.") == F.lit(str(v)))
        return df

    def column(self, e) -> Column:
        op = e[0]
        if op == "lit":
            return F.lit(e[1])
        if op == "list":
            return F.array(*map(self.column, e[1]))
        if op == "var":
            if e[1] in self.lists:  # as a single value
                return F.when(F.size(f"_param_{e[1]}") == 1, F.get(f"_param_{e[1]}", F.lit(0)))
            if e[1] in self.params:
                return F.col(f"_param_{e[1]}")
            if e[1] not in self.nodes | self.edges:
                raise QueryError(f"unknown variable {e[1]}")
            return F.col(f"{e[1]}.node_id") if e[1] in self.nodes else F.col(f"{e[1]}.label")
        if op == "prop":
            return self.value(e[2], f"{e[1]}.") if e[1] in self.nodes else F.get(F.col(f"{e[1]}.props")[e[2]], F.lit(0))
        if op == "call":
            return self.call(*e[1:])
        if op in ("and", "or"):
            a, b = self.column(e[1]), self.column(e[2])
            return a & b if op == "and" else a | b
        if op == "not":
            return ~self.column(e[1])
        if op in ("null", "notnull"):
            c = self.column(e[1])
            return c.isNull() if op == "null" else c.isNotNull()
        if op == "in":
            return F.array_contains(self.listed(e[2]), self.column(e[1]))
        a, b = self.column(e[1]), self.column(e[2])
        if op in ("+", "-", "*", "/", "%"):
            if op == "+" and any(x[0] == "lit" and isinstance(x[1], str) for x in (e[1], e[2])):
                return F.concat(a.cast("string"), b.cast("string"))
            a, b = a.try_cast("double"), b.try_cast("double")
            return {"+": a + b, "-": a - b, "*": a * b, "/": a / b, "%": a % b}[op]
        if op in ("contains", "starts", "ends", "=~"):
            return {"contains": a.contains(b), "starts": a.startswith(b), "ends": a.endswith(b), "=~": F.regexp_like(a, F.concat(F.lit("^(?:"), b, F.lit(")$")))}[op]
        for x, y, c in ((e[1], e[2], "a"), (e[2], e[1], "b")):  # properties are strings: compare with numbers as numbers
            if y[0] == "lit" and isinstance(y[1], (int, float)) and not isinstance(y[1], bool) and (x[0] == "prop" or (x[0] == "var" and x[1] in self.lists)):
                if c == "a":
                    a = a.try_cast("double")
                else:
                    b = b.try_cast("double")
        return {"=": a == b, "<>": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]

    def listed(self, e) -> Column:
        return F.col(f"_param_{e[1]}") if e[0] == "var" and e[1] in self.lists else self.column(e)

    def is_list(self, e) -> bool:
        return e[0] == "list" or (e[0] == "var" and e[1] in self.lists) or (e[0] == "call" and e[1] in ("labels", "collect", "split", "tail", "reverse", "range", "keys"))

    def call(self, name: str, distinct: bool, args: list) -> Column:
        if name in _AGGREGATES:
            if args == ["*"]:
                return F.count("*")
            c = self.column(args[0])
            if name in ("sum", "avg", "min", "max") and args[0][0] == "prop":
                c = c.try_cast("double") if name in ("sum", "avg") else c
            if distinct:
                return {"count": F.count_distinct, "collect": F.collect_set, "sum": F.sum_distinct}[name](c)
            return _AGGREGATES[name](c)
        if name == "labels":
            return F.col(f"{args[0][1]}.labels")
        if name == "type":
            return F.col(f"{args[0][1]}.label")
        if name == "id":
            return self.column(args[0])
        if name == "keys":
            return F.map_keys(F.col(f"{args[0][1]}.props"))
        c = [self.listed(a) for a in args]
        if name == "size":
            known = args[0]
            return F.size(c[0]) if self.is_list(known) or (known[0] == "var" and known[1] in self.arrays) else F.length(c[0])
        plain = {"tolower": F.lower, "toupper": F.upper, "trim": F.trim, "head": lambda x: F.get(x, F.lit(0)), "last": lambda x: F.try_element_at(x, F.lit(-1)), "tail": lambda x: F.slice(x, 2, F.size(x)), "reverse": F.reverse, "split": lambda x, y: F.split(x, F.concat(F.lit("\\Q"), y, F.lit("\\E"))), "range": F.sequence, "tointeger": lambda x: x.try_cast("bigint"), "tofloat": lambda x: x.try_cast("double"), "tostring": lambda x: x.cast("string"), "coalesce": F.coalesce, "abs": F.abs, "exists": lambda x: x.isNotNull()}
        if name not in plain:
            raise QueryError(f"unknown function {name}")
        return plain[name](*c)

    def aggregates(self, e) -> bool:
        return isinstance(e, tuple) and ((e[0] == "call" and e[1] in _AGGREGATES) or any(self.aggregates(x) if isinstance(x, tuple) else isinstance(x, list) and any(map(self.aggregates, x)) for x in e[1:]))


def run(graph: Graph, text: str, bindings: dict[str, DataFrame] | None = None, with_graph: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """The query's result as a DataFrame; a node in RETURN gives its id, an edge its label.

    bindings: variables fixed beforehand, each a table (graph_id, node_id). with_graph adds
    graph_id (grouping by it where there are aggregates). keep: bound variables whose node ids
    stand in the result as _<name>; one that no pattern names is matched alone.
    """
    return _run(graph, parse(text), bindings or {}, with_graph, keep)


def _started(plan: _Plan, rest: list, apart: bool) -> tuple[DataFrame, list]:
    """What a query without a first MATCH starts from, and its clauses still to do.

    A single row, unless a pattern follows: then a row for each graph. A leading OPTIONAL MATCH gives
    its matches, or a single row of nulls where there are none in any graph (apart: a row of nulls for each graph without).
    """
    graph = plan.graph
    if not any(c[0] in ("match", "optional") for c in rest):
        one = graph.spark.range(1).select(F.lit("").alias("graph_id"))
        return (graph.nodes.select("graph_id").distinct() if apart else one), rest
    ids = graph.nodes.select("graph_id").distinct()
    if rest[0][0] != "optional" or apart:
        return ids, rest
    hit = plan.pattern(None, rest[0][1])
    if rest[0][2] is not None:
        hit = hit.where(plan.column(rest[0][2]))
    hit = written(hit)
    nothing = graph.spark.range(1 if hit.isEmpty() else 0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in hit.schema))
    return hit.unionByName(nothing), rest[1:]


def run_within(graph: Graph, text: str, env: DataFrame, nodes: Sequence[str], values: Sequence[str]) -> tuple[DataFrame, list[tuple[str, bool, bool]]]:
    """A query run once for each row of env(graph_id, inst, s_<symbol>), where symbols are arrays of node ids or of values.

    Gives (graph_id, inst, o, c0, c1, ...), o being an order of rows by the nodes they come from, and of each
    column its name, whether it was named, and whether it gives node ids. A symbol of nodes stands
    for each of them in turn; one of values is a value where it has one, and a list for IN, UNWIND and RETURN.
    """
    q = parse(text)
    plan = _Plan(graph, {})
    plan.keys = ("graph_id", "inst")
    used = {n.var for p in q.paths for n in p[::2]} | _variables(q.where) | _variables([e for e, _ in q.items]) | _variables([e for e, _ in q.order]) | _variables([list(c[1:]) for c in q.rest])
    used |= {n.var for c in q.rest if c[0] in ("match", "optional") for p in c[1] for n in p[::2]}
    df = env.select("graph_id", "inst", *(f"s_{x}" for x in (*nodes, *values) if x in used))
    for x in [x for x in nodes if x in used]:
        own = graph.nodes.select("graph_id", F.struct(*(c for c in graph.nodes.columns if c != "graph_id")).alias(x))
        df = df.withColumn("_id", F.explode(f"s_{x}")).drop(f"s_{x}")
        df = df.join(own.withColumn("_id", F.col(f"{x}.node_id")), ["graph_id", "_id"]).drop("_id")
        plan.nodes.add(x)
    for x in [x for x in values if x in used]:
        df = df.withColumnRenamed(f"s_{x}", f"_param_{x}")
        plan.params.add(x)
        plan.lists.add(x)
    if q.paths:
        df = plan.pattern(df, q.paths)
    if q.where is not None:
        df = df.where(plan.column(q.where))
    for clause in q.rest:
        df = plan.clause(df, *clause)
    items = plan.spread(q.items)
    places = [natural(F.col(f"{v}.node_id")) for v in sorted(plan.nodes) if v in df.columns]
    columns = [f"c{k}" for k in range(len(items))]
    if any(plan.aggregates(e) for e, _ in items):
        keys = [plan.column(e).alias(c) for c, (e, _) in zip(columns, items, strict=True) if not plan.aggregates(e)]
        made = [plan.column(e).alias(c) for c, (e, _) in zip(columns, items, strict=True) if plan.aggregates(e)]
        out = df.groupBy("graph_id", "inst", *keys).agg(*made).withColumn("o", F.lit(""))
    else:
        out = df.select("graph_id", "inst", F.concat_ws("/", *places).alias("o"), *(plan.listed(e).alias(c) for c, (e, _) in zip(columns, items, strict=True)), *(plan.column(e).alias(f"_o{k}") for k, (e, _) in enumerate(q.order)))
        if q.distinct:
            out = out.groupBy("graph_id", "inst", *columns).agg(F.min("o").alias("o"))
        elif q.order or q.skip or q.limit is not None:
            by = [F.col(f"_o{k}").desc() if d else F.col(f"_o{k}").asc() for k, (_, d) in enumerate(q.order)]
            n = F.row_number().over(Window.partitionBy("graph_id", "inst").orderBy(*by, "o"))
            out = out.withColumn("_n", n).where(F.col("_n") > (q.skip or 0))
            out = (out if q.limit is None else out.where(F.col("_n") <= (q.skip or 0) + q.limit)).withColumn("o", F.lpad(F.col("_n").cast("string"), 10, "0"))
    for c, (e, _) in zip(columns, items, strict=True):
        if dict(out.dtypes)[c].startswith("array"):
            out = out.withColumn(c, F.explode(c))
    kinds = [(n, n in q.named or e[0] == "var", e[0] == "var" and e[1] in plan.nodes) for e, n in items]
    return out.select("graph_id", "inst", "o", *(F.col(c).cast("string").alias(c) for c in columns)), kinds


def _variables(e) -> set[str]:
    if not isinstance(e, (tuple, list)):
        return set()
    if isinstance(e, tuple) and e and e[0] in ("var", "prop"):
        return {e[1]}
    return set().union(*map(_variables, e)) if e else set()


def _run(graph: Graph, q: _Query, bindings: dict[str, DataFrame], with_graph: bool, keep: tuple[str, ...], fixed: dict[str, DataFrame] | None = None, params: dict[str, DataFrame] | None = None) -> DataFrame:
    """run() of a parsed query. fixed, params: nodes and values (graph_id, _<keep>, _<name>) that earlier queries gave each node of the first kept variable."""
    plan = _Plan(graph, bindings)
    df = None
    named = {n.var for path in q.paths for n in path[::2]}
    for var in keep:
        if var not in named:
            q.paths.insert(0, [_Node(var)])
    used = _variables(q.where) | set().union(*(_variables(e) for e, _ in q.items), *(_variables(e) for e, _ in q.order))
    fixed = {n: t for n, t in (fixed or {}).items() if n in named | used}
    for n in fixed:
        plan.bindings[n] = fixed[n].select("graph_id", F.col(f"_{n}").alias("node_id"))
        if n not in named:
            q.paths.append([_Node(n)])
    plan.keys = ("graph_id",) if with_graph else ()
    if q.paths:
        df = plan.pattern(df, q.paths)
    rest = list(q.rest)
    if df is None:
        df, rest = _started(plan, rest, with_graph)
    for n, table in fixed.items():
        own = table.select(F.col("graph_id").alias("_g"), F.col(f"_{keep[0]}").alias("_k"), F.col(f"_{n}").alias("_v"))
        df = df.join(own, (df["graph_id"] == own["_g"]) & (F.col(f"{keep[0]}.node_id") == own["_k"]) & (F.col(f"{n}.node_id") == own["_v"]), "left_semi")
    for n, table in (params or {}).items():
        if n in used - named:
            plan.params.add(n)
            own = table.select(F.col("graph_id").alias("_g"), F.col(f"_{keep[0]}").alias("_k"), F.col(f"_{n}").alias(f"_param_{n}"))
            df = df.join(own, (df["graph_id"] == own["_g"]) & (F.col(f"{keep[0]}.node_id") == own["_k"]), "left").drop("_g", "_k")
    if q.where is not None:
        df = df.where(plan.column(q.where))
    for clause in rest:
        df = plan.clause(df, *clause)
    q.items = plan.spread(q.items)
    names = [n for _, n in q.items]
    kept = [F.col(f"{v}.node_id").alias(f"_{v}") for v in keep]
    if any(plan.aggregates(e) for e, _ in q.items):
        keys = kept + [plan.column(e).alias(n) for e, n in q.items if not plan.aggregates(e)]
        group = (["graph_id"] if with_graph else []) + keys
        out = df.groupBy(*group).agg(*(plan.column(e).alias(n) for e, n in q.items if plan.aggregates(e)))
        out = out.select(*(["graph_id"] if with_graph else []), *(F.col(f"`{n}`") for n in names), *(f"_{v}" for v in keep))
        order = [(F.col(f"`{dict((str(x), n) for x, n in q.items).get(str(e), e[-1] if isinstance(e[-1], str) else '')}`"), d) for e, d in q.order]
    else:
        order, extra = [], []
        for k, (e, d) in enumerate(q.order):
            known = next((n for x, n in q.items if x == e or e == ("var", n)), None)
            order.append((F.col(f"`{known or f'_o{k}'}`"), d))
            if known is None:
                extra.append(plan.column(e).alias(f"_o{k}"))
        out = df.select(*(["graph_id"] if with_graph else []), *(plan.column(e).alias(n) for e, n in q.items), *kept, *extra)
    if q.distinct:
        out = out.distinct()
    if order:
        out = out.orderBy(*(c.desc() if d else c.asc() for c, d in order))
    if q.skip:
        out = out.offset(q.skip)
    if q.limit is not None:
        out = out.limit(q.limit)
    return out.select(*(["graph_id"] if with_graph else []), *(F.col(f"`{n}`") for n in names), *(f"_{v}" for v in keep))


def values(graph: Graph, text: str, var: str, bound: DataFrame, fixed: dict[str, DataFrame] | None = None, params: dict[str, DataFrame] | None = None) -> DataFrame:
    """(graph_id, _<var>, key, value) of a query with one variable bound: a row for each result column.

    A column that returns a node gives the node's value.
    """
    q = parse(text)
    if not q.paths:
        q.paths.append([_Node(var)])
    out = _run(graph, q, {var: bound}, True, (var,), fixed, params)
    of_nodes = {n for (e, n) in q.items if e[0] == "var"}
    cells = F.explode(F.array(*(F.struct(F.lit(n).alias("key"), F.col(f"`{n}`").cast("string").alias("value"), F.lit(n in of_nodes).alias("node")) for _, n in q.items))).alias("c")
    rows = out.select("graph_id", f"_{var}", cells).select("graph_id", f"_{var}", "c.*")
    own = graph.nodes.select("graph_id", F.col("node_id").alias("value"), F.col("value").alias("_text"))
    plain = rows.where("NOT node").select("graph_id", f"_{var}", "key", "value")
    return plain.unionByName(rows.where("node").join(own, ["graph_id", "value"]).select("graph_id", f"_{var}", "key", F.col("_text").alias("value")))


def chained_values(graph: Graph, texts: list[str], var: str, bound: DataFrame) -> DataFrame:
    """values() of the last of several queries over one bound variable.

    A column `as x` of an earlier query that gives a row of the variable's node a single row is
    bound to x in the later ones, as that node or as that value.
    """
    params: dict[str, DataFrame] = {}
    fixed: dict[str, DataFrame] = {}
    for text in texts[:-1]:
        q = parse(text)
        if not q.paths:
            q.paths.append([_Node(var)])
        out = written(_run(graph, q, {var: bound}, True, (var,), fixed, params))
        one = out.groupBy("graph_id", f"_{var}").agg(F.count("*").alias("_c"), *(F.first(f"`{n}`").alias(n) for _, n in q.items)).where("_c = 1")
        for e, n in q.items:
            if n in q.named:
                got = one.select("graph_id", f"_{var}", F.col(f"`{n}`").cast("string").alias(f"_{n}"))
                (fixed if e[0] == "var" else params)[n] = got
    return values(graph, texts[-1], var, bound, fixed, params)


def find_nodes(graph: Graph, text: str, bindings: dict[str, DataFrame] | None = None) -> DataFrame:
    """(graph_id, node_id) of the nodes that a query of one column returns."""
    out = run(graph, text, bindings, with_graph=True)
    return out.select("graph_id", F.col(f"`{out.columns[1]}`").alias("node_id"))
