"""Measures: value and unit parsed, found next to each other in the graph, and converted by factors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import HAS, Graph, edge_columns, node_columns, sized
from ..schema.layer import Attribute, SchemaError

_MEASURE = r"^\s*([+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?)\s*(\S.*?)\s*$"


def parse_measure(text: Column) -> Column:
    """struct<value,unit> of a number followed by a unit; null if it is not exactly these two parts."""
    value, unit = (F.regexp_extract(text, _MEASURE, k) for k in (1, 2))
    return F.when(text.rlike(_MEASURE), F.struct(value.alias("value"), unit.alias("unit")))


def convert(measures: DataFrame, factors: DataFrame, value: str = "value", unit: str = "unit", target: str = "use_unit", domain: str = "", missing: str = "null") -> DataFrame:
    """measures with converted, from factors(domain, from_unit, to_unit, factor, shift): value * factor + shift.

    Of a pair's factors the one of the domain is taken, else the one without a domain; several of
    them are an error. An equal or absent target keeps the value. missing: a pair without a factor
    gives null, or ("error") fails. factors is a table of units, so it is broadcast only while it
    is small (Spark's threshold decides).
    """
    of = F.coalesce("domain", F.lit("")) if "domain" in factors.columns else F.lit("")
    own = factors.select(F.col("from_unit").alias(unit), F.col("to_unit").alias(target), of.alias("_d"), "factor", "shift").where(F.col("_d").isin("", domain))
    best = F.max_by(F.struct("factor", "shift"), F.struct((F.col("_d") == domain).alias("a")))
    several = F.count(F.when(F.col("_d") == domain, 1)) > 1
    general = (F.count(F.when(F.col("_d") == domain, 1)) == 0) & (F.count("*") > 1)
    text = F.concat(F.lit("more than one factor from "), F.col(unit), F.lit(" to "), F.col(target))
    one = own.groupBy(unit, target).agg(F.when(several | general, F.raise_error(text).cast("struct<factor:double,shift:double>")).otherwise(best.cast("struct<factor:double,shift:double>")).alias("_f"))
    joined = measures.join(one, [unit, target], "left")
    number = F.col(value).try_cast("double")
    same = F.col(target).isNull() | (F.col(target) == F.col(unit))
    found = number * F.col("_f.factor") + F.coalesce("_f.shift", F.lit(0.0))
    if missing == "error":
        lack = F.concat(F.lit("no factor from "), F.col(unit), F.lit(" to "), F.col(target), F.lit(f" in domain '{domain}'"))
        found = F.when(F.col("_f").isNull(), F.raise_error(lack).cast("double")).otherwise(found)
    return joined.withColumn("converted", F.when(same, number).otherwise(found)).drop("_f")


def measure_attributes(graph: Graph) -> list[Attribute]:
    return [a for a in graph.layer.attributes() if "Measure" in a.labels or "Measure" in a.many("valueType")]


def find_measures(graph: Graph, a: Attribute, value_nodes: DataFrame | None = None, unit_nodes: DataFrame | None = None) -> DataFrame:
    """(graph_id, entity_root_id, parent_id, value, unit): a measure's values and units.

    Values: instances of measure/valueNode (or value_nodes(graph_id, node_id), as a query gives
    them), else the measure's own. Units: unit_nodes, else instances of measure/unitNode below
    the value or below its parent (one at most), else embedded in the value.
    """
    source = a.one("measure/valueNode") or a.id
    values = graph.children(source).select("graph_id", "entity_root_id", "parent_id", F.col("node_id").alias("_v"), F.col("value").alias("_text"))
    if value_nodes is not None:
        values = graph.children().join(sized(value_nodes), ["graph_id", "node_id"], "left_semi").select("graph_id", "entity_root_id", "parent_id", F.col("node_id").alias("_v"), F.col("value").alias("_text"))
    unit_id = a.one("measure/unitNode")
    if unit_nodes is None and not unit_id:
        own = values.withColumn("_m", parse_measure(F.col("_text"))).where("_m IS NOT NULL")
        return own.select("graph_id", "entity_root_id", "parent_id", "_m.value", "_m.unit")
    units = graph.children(unit_id) if unit_nodes is None else graph.children().join(sized(unit_nodes), ["graph_id", "node_id"], "left_semi")
    if not units.isStreaming:  # dealt out first: a parent has one unit, so aggregating where they are found would only sort them once more
        units = units.select("graph_id", "parent_id", "value").repartition("graph_id", "parent_id")
    units = units.groupBy("graph_id", "parent_id").agg(F.max("value").alias("_u"), F.count("*").alias("_c"))
    units = units.withColumn("_u", F.when(F.col("_c") == 1, F.col("_u")).otherwise(F.raise_error(F.lit(f"{a.id}: more than one unit"))))
    below = units.select("graph_id", F.col("parent_id").alias("_v"), F.col("_u").alias("_below"))
    beside = units.select("graph_id", "parent_id", F.col("_u").alias("_beside"))
    found = values.join(below, ["graph_id", "_v"], "left").join(beside, ["graph_id", "parent_id"], "left")
    parsed = parse_measure(F.col("_text"))
    unit = F.coalesce("_below", "_beside", parsed["unit"])
    number = F.when(F.coalesce("_below", "_beside").isNotNull(), F.trim("_text")).otherwise(parsed["value"])
    return found.select("graph_id", "entity_root_id", "parent_id", number.alias("value"), unit.alias("unit")).where("value IS NOT NULL AND unit IS NOT NULL")


def _found(graph: Graph, a: Attribute) -> DataFrame:
    """find_measures with the attribute's queries for values and units, where it has them.

    The unit query sees `valueNode`, bound to the measure's values.
    """
    from ..plans import cypher

    text, unit = a.one("measure/valueNodeExpr"), a.one("measure/unitExpr")
    values = cypher.find_nodes(graph, text) if text else None
    if not unit:
        return find_measures(graph, a, values)
    own = graph.instances(a.one("measure/valueNode") or a.id).select("graph_id", "node_id") if values is None else values
    return find_measures(graph, a, values, cypher.find_nodes(graph, unit, {"valueNode": own}).distinct())


def build_measures(graph: Graph, factors: DataFrame | None = None, missing: str = "error") -> Graph:
    """A node for each measure: value and unit in its properties, converted where useUnit says so.

    The node is made below the value's parent, or updated if there is one. Factors are those of the
    attribute's measure/unitDomain; a unit without a factor fails, or (missing: "drop") its measure is left out.
    """
    for a in measure_attributes(graph):
        found = _found(graph, a).withColumn("use_unit", F.lit(a.one("measure/useUnit") or None).cast("string"))
        if a.one("measure/useUnit"):
            if factors is None:
                raise SchemaError(f"{a.id}: a conversion table is needed for useUnit")
            found = convert(found, factors, domain=a.one("measure/unitDomain"), missing=missing).where("converted IS NOT NULL")
            found = found.withColumn("value", F.col("converted").cast("string")).withColumn("unit", F.coalesce("use_unit", "unit"))
        name = a.name or a.id
        props = F.create_map(F.lit("measure/value"), F.array("value"), F.lit("measure/unit"), F.array("unit"))
        made = found.select("graph_id", "entity_root_id", "parent_id", F.concat("parent_id", F.lit("." + name)).alias("_id"), props.alias("_props"), F.concat_ws(" ", "value", "unit").alias("_value"))
        old = graph.children(a.id).select("graph_id", "node_id", "parent_id")
        update = made.join(old, ["graph_id", "parent_id"]).select("graph_id", "node_id", "_props", F.col("_value").alias("_new"))
        nodes = graph.nodes.join(update, ["graph_id", "node_id"], "left")
        nodes = nodes.withColumn("props", F.when(F.col("_props").isNull(), F.col("props")).otherwise(F.map_concat(F.map_filter("props", lambda k, v: ~k.startswith("measure/")), "_props"))).withColumn("value", F.coalesce("_new", "value")).select(*graph.nodes.columns)
        new = made.join(old, ["graph_id", "parent_id"], "left_anti")
        labels = F.array(*map(F.lit, ["DocumentNode", "Value", "Measure"]))
        nodes = nodes.unionByName(new.select(*node_columns(graph_id=F.col("graph_id"), node_id=F.col("_id"), labels=labels, schema_node_id=a.id, type="Value", attribute_name=name, value=F.col("_value"), value_type=F.array(F.lit("Measure")), entity_root_id=F.col("entity_root_id"), props=F.col("_props"))))
        edges = graph.edges.unionByName(new.select(*edge_columns(graph_id=F.col("graph_id"), src=F.col("parent_id"), dst=F.col("_id"), label=HAS)))
        graph = graph.with_(nodes=nodes, edges=edges)
    return graph
