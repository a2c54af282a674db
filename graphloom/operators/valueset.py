"""Value sets: dictionary lookups as equi-joins on normalised words."""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import HAS, Graph, edge_columns, node_columns
from ..schema.layer import Attribute, Layer, SchemaError
from ..storage import exists, folders, removed, written

ENTRIES = "table_id string, entry_id long, is_default boolean, case_sensitive boolean, n_keys int, key string, match string, result map<string,string>"
#: Dictionaries of up to so many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 100_000


@dataclass
class Entry:
    """One entry: single values, or key values; neither makes it the default."""

    values: list[str] = field(default_factory=list)
    key_values: dict[str, str] = field(default_factory=dict)
    results: dict[str, str] = field(default_factory=dict)
    result: str | None = None
    case_sensitive: bool = False

    def outcome(self) -> dict[str, str]:
        return dict(self.results) or ({"": self.result} if self.result is not None else dict(self.key_values))

    @property
    def is_default(self) -> bool:
        return not self.values and not self.key_values


@dataclass
class ValueSet:
    id: str
    entries: list[Entry] = field(default_factory=list)


def words(value: Column, case_sensitive: Column | bool = False) -> Column:
    """White space collapsed and, unless case counts, lower case."""
    flat = F.trim(F.regexp_replace(value, r"[\s\u0085 ]+", " "))
    if isinstance(case_sensitive, bool):
        return flat if case_sensitive else F.lower(flat)
    return F.when(case_sensitive, flat).otherwise(F.lower(flat))


def load(specs: Sequence[dict]) -> list[ValueSet]:
    """Value sets from parsed files [{id, values: [{values, value, keyValues, results, result, caseSensitive}]}]; ids must differ."""
    out: dict[str, ValueSet] = {}
    for spec in specs:
        for s in spec.get("valuesets", [spec]) if isinstance(spec, dict) else spec:
            if s["id"] in out:
                raise SchemaError(f"duplicate value set {s['id']}")
            own = []
            for v in s.get("values", ()):
                single = v.get("values", [v["value"]] if "value" in v else [])
                own.append(Entry(list(single), dict(v.get("keyValues", {})), dict(v.get("results", {})), v.get("result"), bool(v.get("caseSensitive", False))))
            out[s["id"]] = ValueSet(s["id"], own)
    return list(out.values())


def load_files(paths: Sequence[str]) -> list[ValueSet]:
    from ..schema.bundle import read_json_or_yaml

    return load([read_json_or_yaml(p) for p in paths])


def split_cell(cell: str, separator: str) -> list[str]:
    return [x.strip() for x in cell.split(separator)] if separator else [cell.strip()]


def cartesian(parts: Sequence[Sequence[str]]) -> list[tuple[str, ...]]:
    return list(itertools.product(*parts))


def from_spreadsheet(id_: str, rows: list[list[str]]) -> ValueSet:
    """A set from rows: option rows (options.separator, options.lookupOrder, options.output), a header, data rows.

    A cell with a separator for its column holds several values; an entry is made for every
    combination of the row's values. lookupOrder names the key columns (default all), output
    the result columns (default all).
    """
    options: dict[str, list[str]] = {}
    at = 0
    while at < len(rows) and rows[at] and rows[at][0].strip().startswith("options."):
        options[rows[at][0].strip()[len("options.") :]] = [c.strip() for c in rows[at][1:]]
        at += 1
    header = [c.strip() for c in rows[at]]
    pairs = options.get("separator", [])
    separators = dict(zip(pairs[::2], pairs[1::2])) if len(pairs) > 1 else {h: pairs[0] for h in header} if pairs else {}
    keys = [h for h in options.get("lookupOrder", []) if h] or header
    outputs = [h for h in options.get("output", []) if h] or header
    entries = []
    for r in rows[at + 1 :]:
        cells = [split_cell(c, separators.get(h, "")) for h, c in zip(header, r)]
        for combination in cartesian(cells):
            row = {h: v for h, v in zip(header, combination) if v}
            if row:
                entries.append(Entry(key_values={k: row[k] for k in keys if k in row}, results={o: row[o] for o in outputs if o in row}))
    return ValueSet(id_, entries)


def entries_table(spark: SparkSession, sets: Sequence[ValueSet]) -> DataFrame:
    """The sets as match rows: one for each single value or key value, one for each default."""
    rows, n = [], 0
    for s in sets:
        if sum(e.is_default for e in s.entries) > 1:
            raise SchemaError(f"value set {s.id} has more than one default")
        for e in s.entries:
            n += 1
            out = e.outcome()
            norm = (lambda v: " ".join(v.split())) if e.case_sensitive else (lambda v: " ".join(v.split()).lower())
            if e.is_default:
                rows.append((s.id, n, True, e.case_sensitive, 0, None, None, out))
            for v in dict.fromkeys(map(norm, e.values)) if not e.key_values else ():
                rows.append((s.id, n, False, e.case_sensitive, 0, None, v, out))
            for k, v in e.key_values.items():
                rows.append((s.id, n, False, e.case_sensitive, len(e.key_values), k, norm(v), out))
    return spark.createDataFrame(rows, ENTRIES)


def measured(entries: DataFrame) -> dict[str, tuple[int, bool]]:
    """Rows of each set, and whether it has a default; one row for each set comes to the driver."""
    return {r.table_id: (r.n, r.d) for r in entries.groupBy("table_id").agg(F.count("*").alias("n"), F.max("is_default").alias("d")).collect()}


def lookup(requests: DataFrame, entries: DataFrame, tables: Sequence[str] | None = None, request_col: str = "request", sizes: dict[str, tuple[int, bool]] | None = None) -> DataFrame:
    """requests with a column `result` (map, null if nothing answers).

    request is a map of key to value; the key is "" for a plain value. Distinct requests are
    looked up once and joined back. A request of one value matches single values, entries of one
    key (any key if the request names none), or the named key of larger entries; a request of
    several must agree in all its keys. Several entries of a set are an error, as are
    several sets that answer; an entry beats its set's default. sizes: what measured(entries)
    gives, where it is known.
    """
    own = entries if not tables else entries.where(F.col("table_id").isin(list(tables)))
    sizes = {t: x for t, x in (measured(entries) if sizes is None else sizes).items() if not tables or t in tables}
    side = F.broadcast if sum(n for n, _ in sizes.values()) <= BROADCAST_ROWS else (lambda d: d)
    key_of = F.to_json(F.array_sort(F.map_entries(request_col)))
    asked = requests.select(key_of.alias("_q"), F.col(request_col).alias("_r")).where(F.size(request_col) > 0).dropDuplicates(["_q"])
    parts = asked.select("_q", F.size("_r").alias("_n"), F.explode("_r").alias("_k", "_v"))
    parts = parts.select("_q", "_n", "_k", F.explode(F.array(*(F.struct(F.lit(cs).alias("cs"), words(F.col("_v"), cs).alias("m")) for cs in (False, True)))).alias("_w"))
    parts = parts.select("_q", "_n", "_k", F.col("_w.cs").alias("case_sensitive"), F.col("_w.m").alias("match"))
    hits = parts.join(side(own.where("NOT is_default")), ["case_sensitive", "match"])
    one = (F.col("_n") == 1) & (F.col("key").isNull() | (F.col("key") == F.col("_k")) | ((F.col("_k") == "") & (F.col("n_keys") == 1)))
    many = (F.col("_n") > 1) & (F.col("key") == F.col("_k"))
    hits = hits.where(one | many).groupBy("_q", "table_id", "entry_id").agg(F.count_distinct("_k").alias("_c"), F.max("_n").alias("_n"), F.first("result").alias("result")).where("_c = _n")
    answers = hits.select("_q", "table_id", "result", F.lit(False).alias("_default"))
    if defaults := [t for t, (_, has) in sizes.items() if has]:
        # every request meets each table's one default: a table of at most as many rows as sets
        met = asked.select("_q", F.explode(F.array(*map(F.lit, defaults))).alias("table_id")).join(F.broadcast(own.where("is_default").select("table_id", "result")), "table_id")
        answers = answers.unionByName(met.select("_q", "table_id", "result", F.lit(True).alias("_default")))
    count = F.count(F.when(~F.col("_default"), 1))
    entry = F.first(F.when(~F.col("_default"), F.col("result")), ignorenulls=True)
    best = F.when(count > 1, F.raise_error(F.concat(F.lit("ambiguous entries for "), F.first("_q"))).cast("map<string,string>")).when(count == 1, entry).otherwise(F.first("result", ignorenulls=True))
    best = answers.groupBy("_q", "table_id").agg(best.alias("result"))
    one_set = F.when(F.count("*") > 1, F.raise_error(F.concat(F.lit("several value sets answer "), F.first("_q"))).cast("map<string,string>")).otherwise(F.first("result"))
    final = best.groupBy("_q").agg(one_set.alias("result"))
    return requests.withColumn("_q", key_of).join(final, "_q", "left").drop("_q")


@dataclass(frozen=True)
class ValueSetInfo:
    """What a schema attribute says about its value-set processing."""

    attribute: Attribute
    context: str
    tables: tuple[str, ...]
    request_keys: tuple[str, ...]
    request_values: tuple[str, ...]
    result_keys: tuple[str, ...]
    result_values: tuple[str, ...]
    result_context: str

    @staticmethod
    def of(layer: Layer, a: Attribute) -> ValueSetInfo | None:
        if not any(k.startswith("vs/") for k in a.props):
            return None
        entity = layer.entity_of(a)
        context = a.one("vs/context") or (entity.id if entity else layer.root.id)
        many = lambda t: tuple(a.many(t))
        out = ValueSetInfo(a, context, many("vs/valuesets"), many("vs/requestKeys"), many("vs/requestValues"), many("vs/resultKeys"), many("vs/resultValues"), a.one("vs/resultContext") or context)
        if out.request_keys and len(out.request_keys) != len(out.request_values):
            raise SchemaError(f"{a.id}: request keys and values differ in number")
        if out.result_keys and len(out.result_keys) != len(out.result_values):
            raise SchemaError(f"{a.id}: result keys and values differ in number")
        return out


def infos(layer: Layer) -> list[ValueSetInfo]:
    return [i for a in layer.attributes() if (i := ValueSetInfo.of(layer, a)) is not None]


def requests(graph: Graph, info: ValueSetInfo) -> DataFrame:
    """(graph_id, context_id, entity_root_id, request): the values that each context node asks with."""
    texts = info.attribute.many("vs/request")
    if texts:
        return _queried(graph, info, texts)
    sources = list(info.request_values) or [info.attribute.id]
    keys = list(info.request_keys) or ([""] if len(sources) == 1 else sources)
    # one pass over the nodes: each entity's values by key, and its context nodes
    wanted, found = F.col("schema_node_id").isin([*sources, info.context]), {}
    for s, k in zip(sources, keys, strict=True):
        found.setdefault(k, []).append(F.when(F.col("schema_node_id") == s, F.col("value")))
        a = graph.layer.find(s)
        if a is not None and a.one("ingestAs") == "property":
            p = a.one("propertyName") or a.name or a.id
            found[k].append(F.get(F.col("props")[p], F.lit(0)))
            wanted = wanted | F.array_contains(F.map_keys("props"), p)
    values = [F.min(F.coalesce(*v)) for v in found.values()]
    held = F.filter(F.array(*(F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in zip(found, values, strict=True))), lambda x: x["v"].isNotNull())
    contexts = F.collect_list(F.when(F.col("schema_node_id") == info.context, F.col("node_id")))
    asked = graph.nodes.where(wanted).groupBy("graph_id", "entity_root_id").agg(held.alias("_held"), contexts.alias("_contexts")).where(F.size("_held") > 0)
    return asked.select("graph_id", F.explode("_contexts").alias("context_id"), "entity_root_id", F.map_from_entries("_held").alias("request"))


def _queried(graph: Graph, info: ValueSetInfo, texts: list[str]) -> DataFrame:
    """Requests from queries with `this` bound to the attribute's nodes: a column's name is its key."""
    from ..plans import cypher

    own = graph.instances(info.attribute.id).select("graph_id", "node_id", "entity_root_id")
    found = reduce(DataFrame.unionByName, [cypher.values(graph, t, "this", own.select("graph_id", "node_id")) for t in texts])
    key = F.when(F.col("key").isin("this", "n", "") | F.col("key").contains("."), F.lit("")).otherwise(F.col("key"))
    asked = found.join(own.withColumnRenamed("node_id", "_this"), ["graph_id", "_this"]).where("value IS NOT NULL")
    asked = asked.groupBy("graph_id", "entity_root_id", key.alias("k")).agg(F.min("value").alias("v")).groupBy("graph_id", "entity_root_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("request"))
    if text := info.attribute.one("vs/contextExpr"):
        contexts = cypher.run(graph, text, {"this": own.select("graph_id", "node_id")}, with_graph=True, keep=("this",))
        contexts = contexts.select("graph_id", F.col(f"`{contexts.columns[1]}`").alias("context_id"), F.col("_this").alias("node_id")).join(own, ["graph_id", "node_id"]).select("graph_id", "context_id", "entity_root_id")
    else:
        contexts = graph.instances(info.context).select("graph_id", F.col("node_id").alias("context_id"), "entity_root_id")
    return contexts.join(asked, ["graph_id", "entity_root_id"])


def apply_results(graph: Graph, info: ValueSetInfo, answered: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> Graph:
    """Result nodes (or properties, edges) below the result context, from answered(graph_id, context_id, entity_root_id, result).

    A result value that exists is updated; a key that the answer lacks removes it. keep: what is done with tables of
    results that later steps read several times, as to write them; nodes and edges without results pass as they are.
    """
    targets = list(info.result_values) or [info.attribute.id]
    keys = list(info.result_keys) or ([""] if len(targets) == 1 else targets)
    where = answered
    if info.result_context != info.context:
        where = answered.drop("context_id").join(graph.instances(info.result_context).select("graph_id", "entity_root_id", F.col("node_id").alias("context_id")), ["graph_id", "entity_root_id"])
    nodes, edges = graph.nodes, graph.edges
    for t, k in zip(targets, keys, strict=True):
        a = graph.layer.find(t)
        if a is None:
            raise SchemaError(f"{info.attribute.id}: no result attribute {t}")
        got = where.where("result IS NOT NULL").select("graph_id", "entity_root_id", "context_id", F.col("result")[k].alias("_new"))
        mode = a.one("ingestAs", "node") or "node"
        if mode == "property":
            name = a.one("propertyName") or a.name or a.id
            own = got.select("graph_id", F.col("context_id").alias("node_id"), "_new")
            less = F.map_filter("props", lambda x, v, name=name: x != name)
            full = F.when(F.col("_new").isNotNull(), F.map_concat(less, F.create_map(F.lit(name), F.array("_new")))).otherwise(F.col("props"))
            nodes = keep(nodes.join(own, ["graph_id", "node_id"], "left").withColumn("props", full).select(*graph.nodes.columns))
            continue
        own = got.select("graph_id", "entity_root_id", F.lit(t).alias("schema_node_id"), "_new", F.lit(True).alias("_hit")).dropDuplicates(["graph_id", "entity_root_id"])
        # only the result attribute's own nodes are joined; all others pass
        mine = F.coalesce(F.col("schema_node_id") == t, F.lit(False))
        old = nodes.where(mine).join(own, ["graph_id", "entity_root_id", "schema_node_id"], "left").where("_hit IS NULL OR _new IS NOT NULL")
        old = nodes.where(~mine).unionByName(keep(old.withColumn("value", F.coalesce("_new", "value")).select(*graph.nodes.columns)))
        there = nodes.where(mine).select("graph_id", "entity_root_id")
        new = keep(got.where("_new IS NOT NULL").join(there, ["graph_id", "entity_root_id"], "left_anti")).withColumn("_id", F.concat("context_id", F.lit("." + (a.name or a.id))))
        order = a.parent.children.index(a) if a.parent is not None and a in a.parent.children else None
        nodes = old.unionByName(new.select(*node_columns(graph_id=F.col("graph_id"), node_id=F.col("_id"), labels=F.array(*map(F.lit, ["DocumentNode", "Value", *a.labels])), schema_node_id=t, type="Value", attribute_name=a.name or None, attribute_index=order, value=F.col("_new"), entity_root_id=F.col("entity_root_id"))))
        label = (a.one("edgeLabel") or a.name) if mode == "edge" else HAS
        edges = edges.unionByName(new.select(*edge_columns(graph_id=F.col("graph_id"), src=F.col("context_id"), dst=F.col("_id"), label=label, ord=order)))
    return graph.with_(nodes=nodes, edges=edges)


def process(graph: Graph, answer: Callable[[DataFrame, Sequence[str]], DataFrame] | DataFrame, only_tables: Sequence[str] | None = None) -> Graph:
    """All value-set attributes of the layer. answer: an entries table, or a function(requests, tables) that adds `result`.

    The nodes are written before the first lookup (edges too where a query looks at them), after it only what is new
    or changed, so neither the ingestion nor a lookup is planned again for each later use and no graph is written twice.
    """
    wanted = [i for i in infos(graph.layer) if only_tables is None or not i.tables or set(i.tables) & set(only_tables)]
    if not wanted:
        return graph
    if not callable(answer):
        entries, sizes = answer, measured(answer)
        answer = lambda asked, tables: lookup(asked, entries, tables, sizes=sizes)
    streams = graph.nodes.isStreaming or graph.edges.isStreaming
    keep = (lambda df: df) if streams else written
    queried = any(i.attribute.many("vs/request") or i.attribute.one("vs/contextExpr") for i in wanted)
    graph = graph.with_(nodes=keep(graph.nodes), edges=keep(graph.edges) if queried else graph.edges)
    for info in wanted:
        answered = written(answer(requests(graph, info), info.tables))
        graph = apply_results(graph, info, answered, keep)
    return graph


class Answers:
    """Answers of a service kept between runs, in a folder that driver and executors share.

    wrap(answer) gives an answer function for process() that sends a service only the requests whose
    answers are not kept; that there is no answer is kept too. Each call that asks anything adds a generation, written whole
    before it counts. version: answers of another version are not seen (a new release of a dictionary, say).
    most: beyond so many answers the generations asked for first are dropped, whole, the newest never.
    """

    def __init__(self, spark: SparkSession, folder: str, version: str = "1", most: int = 1_000_000):
        if not re.fullmatch(r"[\w.-]+", version):
            raise ValueError(f"a version is of letters, digits, dots and dashes: {version}")
        self.spark, self.folder, self.most = spark, f"{folder}/{version}", most

    def _generations(self) -> list[str]:
        """Complete generations, oldest first."""
        return [g for g in folders(self.spark, self.folder) if exists(self.spark, f"{self.folder}/{g}/_SUCCESS")]

    def known(self) -> DataFrame:
        """(_q, result) of all that is kept, a request once."""
        names = self._generations()
        if not names:
            return self.spark.createDataFrame([], _ANSWERS)
        kept = self.spark.read.schema(_ANSWERS).parquet(*(f"{self.folder}/{g}" for g in names))
        return kept.groupBy("_q").agg(F.first("result").alias("result"))

    def wrap(self, answer: Callable[[DataFrame, Sequence[str]], DataFrame]) -> Callable[[DataFrame, Sequence[str]], DataFrame]:
        def remembered(asked: DataFrame, tables: Sequence[str]) -> DataFrame:
            sets = F.lit(json.dumps(sorted(tables)))
            keyed = asked.withColumn("_q", F.concat(sets, F.to_json(F.array_sort(F.map_entries("request")))))
            some = keyed.where(F.size("request") > 0).groupBy("_q").agg(F.first(F.map_entries("request")).alias("_r"))
            new = written(some.join(self.known().select("_q"), "_q", "left_anti").select("_q", F.map_from_entries("_r").alias("request")))
            if not new.isEmpty():
                self._add(answer(new.withColumnRenamed("_q", "_asked"), tables).select(F.col("_asked").alias("_q"), "result"))
            return keyed.join(self.known(), "_q", "left").drop("_q")

        return remembered

    def _add(self, answers: DataFrame) -> None:
        names = self._generations()
        number = int(names[-1]) + 1 if names else 0
        answers.select("_q", F.col("result").cast("map<string,string>").alias("result")).write.parquet(f"{self.folder}/{number:010}")
        sizes = [self.spark.read.schema(_ANSWERS).parquet(f"{self.folder}/{g}").count() for g in self._generations()]
        while len(sizes) > 1 and sum(sizes) > self.most:
            removed(self.spark, f"{self.folder}/{self._generations()[0]}")
            sizes.pop(0)


_ANSWERS = "_q string, result map<string,string>"

#: Named providers of dictionaries: kind -> function(spark, spec) giving an entries table.
PROVIDERS: dict[str, Callable[[SparkSession, dict], DataFrame]] = {}


def register_provider(kind: str, make: Callable[[SparkSession, dict], DataFrame]) -> None:
    PROVIDERS[kind] = make


def _jdbc(spark: SparkSession, spec: dict) -> DataFrame:
    """Key and result columns of a JDBC table as entries of one set."""
    df = spark.read.format("jdbc").options(**spec["options"]).load()
    return entries_from_table(df, spec["id"], spec["keys"], spec["results"])


def entries_from_table(df: DataFrame, table_id: str, keys: Sequence[str], results: Sequence[str]) -> DataFrame:
    """A dictionary table of any size as entries: each row an entry of its key columns."""
    outcome = F.create_map(*(x for r in results for x in (F.lit(r), F.col(r).cast("string"))))
    id_ = F.xxhash64(*keys, *results)
    keyed = F.explode(F.array(*(F.struct(F.lit(k).alias("key"), words(F.col(k).cast("string")).alias("match")) for k in keys))).alias("_e")
    return df.select(F.lit(table_id).alias("table_id"), id_.alias("entry_id"), F.lit(False).alias("is_default"), F.lit(False).alias("case_sensitive"), F.lit(len(keys)).alias("n_keys"), keyed, outcome.alias("result")).select("table_id", "entry_id", "is_default", "case_sensitive", "n_keys", "_e.key", "_e.match", "result")


def _sql(spark: SparkSession, spec: dict) -> DataFrame:
    """Rows of a configured query with named parameters (`:name`) as entries of one set."""
    return entries_from_table(spark.sql(spec["query"], args=spec.get("params", {})), spec["id"], spec["keys"], spec["results"])


def http_answers(url: str, seconds: float = 10.0, tries: int = 3) -> Callable[[DataFrame, Sequence[str]], DataFrame]:
    """Answers of a service for process(): GET url?key=value&... gives a JSON object of results, or null or 404 for none.

    Each distinct request is sent once, by the tasks that hold it; a request that fails `tries`
    times stops the job. A request of one unnamed value is sent as `value`, the sets as `valueset`.
    """

    def answer(asked: DataFrame, tables: Sequence[str]) -> DataFrame:
        def fetch(batches):
            import time
            import urllib.error
            import urllib.parse
            import urllib.request

            import pyarrow as pa

            def one(request: list[tuple[str, str]]) -> list[tuple[str, str]] | None:
                query = urllib.parse.urlencode([*((k or "value", v) for k, v in request), *(("valueset", t) for t in tables)])
                for k in range(tries):
                    try:
                        with urllib.request.urlopen(f"{url}?{query}", timeout=seconds) as got:
                            found = json.loads(got.read().decode("utf-8") or "null")
                        return None if not found else [(str(x), str(y)) for x, y in (found if isinstance(found, dict) else {"": found}).items() if y is not None]
                    except urllib.error.HTTPError as e:
                        if e.code == 404:
                            return None
                        if k + 1 == tries:
                            raise
                    except urllib.error.URLError:
                        if k + 1 == tries:
                            raise
                    time.sleep(0.1 * 2**k)

            for batch in batches:
                results = [one(r.as_py()) for r in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(results, pa.map_(pa.string(), pa.string()))], names=["_q", "result"])

        keyed = asked.withColumn("_q", F.to_json(F.array_sort(F.map_entries("request"))))
        distinct = keyed.where(F.size("request") > 0).select("_q", "request").groupBy("_q").agg(F.first(F.map_entries("request")).alias("_r"))
        found = distinct.select("_q", F.map_from_entries("_r").alias("request")).mapInArrow(fetch, "_q string, result map<string,string>")
        return keyed.join(found, "_q", "left").drop("_q")

    return answer


register_provider("jdbc", _jdbc)
register_provider("sql", _sql)
register_provider("inline", lambda spark, spec: entries_table(spark, load([spec])))


def dumps(sets: Sequence[ValueSet]) -> str:
    return json.dumps([{"id": s.id, "values": [{"values": e.values, "keyValues": e.key_values, "results": e.results, "result": e.result, "caseSensitive": e.case_sensitive} for e in s.entries]} for s in sets])
