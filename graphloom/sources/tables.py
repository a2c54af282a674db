"""CSV and spreadsheet input: row indexes, id templates, header and row ranges, and joined CSV."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..graph import Graph
from ..operators.ingest import flat_items, graph_of
from ..operators.links import link
from ..schema.layer import Layer
from ..storage import written


def with_row_index(df: DataFrame, name: str = "_row", order: Column | None = None) -> DataFrame:
    """df with a gap-free index from 0 in `order` (default: the order of the input's partitions).

    Offsets of partitions come from one small count per partition, so rows are not gathered in
    one task. With `order` the rows are range-partitioned, and written once: two runs of a range
    partitioning need not agree on its bounds.
    """
    if order is not None:
        df = df.repartitionByRange(order).sortWithinPartitions(order)
    within = df.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id() % (1 << 33))
    if order is not None:
        within = written(within)
    counts = within.groupBy("_p").agg(F.count("*").alias("_n"))
    # one row per partition: a running total over them is bounded by the number of partitions
    offsets = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_o"))
    return within.join(F.broadcast(offsets), "_p").withColumn(name, F.col("_o") + F.col("_i")).drop("_p", "_i", "_o")


def read_csv(spark: SparkSession, path: str, header_row: int | None = 0, start_row: int | None = None, end_row: int | None = None, delimiter: str = ",", encoding: str = "UTF-8", multi_line: bool = False) -> DataFrame:
    """Rows of one CSV file as strings, with _row (0-based, the header counted) and _file.

    Lazy quotes and ragged rows are accepted: missing cells are null, further cells are dropped.
    Only lines up to the header are looked at on the driver. multi_line: cells may hold line
    breaks; the file is then read by one task, as it cannot be split.
    """
    lines = spark.read.option("encoding", encoding).text(path)
    head = lines.limit((header_row or 0) + 1).collect() if header_row is not None else lines.limit(1).collect()
    cells = _cells(head[-1].value, delimiter) if head else []
    names = [c.strip() for c in cells] if header_row is not None else [f"_c{k}" for k in range(len(cells))]
    names = [n or f"_c{k}" for k, n in enumerate(names)]
    schema = ", ".join(f"`{n}` string" for n in names)
    first = 0 if header_row is None else header_row + 1
    first = max(first, start_row or 0)
    one = spark.read.schema(schema).options(sep=delimiter, header=False, mode="PERMISSIVE", multiLine=multi_line, encoding=encoding, escape='"').csv(path)
    out = with_row_index(one.withColumn("_file", F.input_file_name()))
    kept = F.col("_row") >= first
    return out.where(kept if end_row is None else kept & (F.col("_row") <= end_row))


def _cells(line: str, delimiter: str) -> list[str]:
    import csv

    return next(csv.reader([line], delimiter=delimiter), [])


def template(text: str, columns: list[str]) -> Column:
    """An id template as a column: `{{.rowIndex}}`, `{{.dataIndex}}`, `{{.columns.name}}`, `{{index .columns n}}`."""
    parts, at = [], 0
    for m in re.finditer(r"\{\{\s*(?:\.rowIndex|\.dataIndex|\.columns\.(?P<name>[^}\s]+)|index \.columns (?P<n>\d+))\s*\}\}", text):
        parts.append(F.lit(text[at : m.start()]))
        if m["name"]:
            parts.append(F.col(f"`{m['name']}`").cast("string"))
        elif m["n"]:
            parts.append(F.col(f"`{columns[int(m['n'])]}`").cast("string"))
        else:
            parts.append(F.col("_row" if "rowIndex" in m[0] else "_data").cast("string"))
        at = m.end()
    return F.concat(*parts, F.lit(text[at:]))


def ingest_csv(df: DataFrame, layer: Layer, id_template: str = "row_{{.rowIndex}}", by_rows: bool = True, ingest_nulls: bool = False, only_schema: bool = False, file_col: str = "_file") -> Graph:
    """Graphs of rows as read_csv gives them: one for each row, or (by_rows False) one for each file.

    Rows are told apart by file and template id; source is file#row.
    """
    return link(graph_of(csv_items(df, layer, id_template, by_rows, ingest_nulls, only_schema, file_col), layer))


def csv_items(df: DataFrame, layer: Layer, id_template: str = "row_{{.rowIndex}}", by_rows: bool = True, ingest_nulls: bool = False, only_schema: bool = False, file_col: str = "_file", typed: bool = False) -> DataFrame:
    """The items of ingest_csv's graphs. typed: cells that are none of their attribute's type are in error."""
    cells = [c for c in df.columns if c not in ("_row", "_file", "_data")]
    own = df if "_data" in df.columns else df.withColumn("_data", F.col("_row"))
    own = own.withColumn("_id", template(id_template, cells)).withColumn("_src", F.concat_ws("#", F.col(file_col), F.col("_row")))
    graph_id = F.concat_ws("#", F.sha1(F.col(file_col).cast("binary")), "_id") if by_rows else F.sha1(F.col(file_col).cast("binary"))
    base = own.select(*cells, graph_id.alias("__gid"), F.col("_id").alias("__id"), F.col("_src").alias("__src"))
    return flat_items(base, layer, F.col("__gid"), F.col("__src"), ingest_nulls, only_schema, F.col("__id"), ("__gid", "__id", "__src"), typed)


@dataclass(frozen=True)
class JoinedEntity:
    """An entity of a joined CSV: its layer, its columns, its id columns and columns one of which must hold a value."""

    layer: Layer
    columns: tuple[str, ...]
    id_columns: tuple[str, ...]
    any_columns: tuple[str, ...] = ()


#: Rows of an input that are looked through for runs by one task.
BLOCK_ROWS = 1 << 17


def _runs(df: DataFrame, key: Column, row_col: str) -> DataFrame:
    """df with _first: the row at which the run of consecutive rows with one key starts, within each _part.

    Runs are sought within blocks of row numbers; what a block's first rows continue comes from
    a table of one row for each block, so no task sorts an input whole.
    """
    rows = df.withColumn("_key", key).withColumn("_block", F.floor(F.col(row_col) / BLOCK_ROWS).cast("long"))
    order = Window.partitionBy("_part", "_block").orderBy(row_col)
    before = F.lag("_key").over(order)
    rows = rows.withColumn("_new", F.when(before.isNotNull() & (before != F.col("_key")), F.col(row_col)))
    rows = written(rows.withColumn("_start", F.max("_new").over(order)))
    blocks = rows.groupBy("_part", "_block").agg(F.min_by("_key", row_col).alias("_head"), F.max_by("_key", row_col).alias("_tail"), F.min(row_col).alias("_low"), F.max("_new").alias("_last"))
    by_block = Window.partitionBy("_part").orderBy("_block")
    continues = F.coalesce(F.lag("_tail").over(by_block) == F.col("_head"), F.lit(False))
    blocks = blocks.withColumn("_own", F.when(~continues, F.col("_low"))).withColumn("_open", F.coalesce("_last", "_own"))
    carried = F.last("_open", ignorenulls=True).over(by_block.rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("_part", "_block", F.coalesce("_own", carried).alias("_carried"))
    return rows.join(blocks, ["_part", "_block"]).withColumn("_first", F.coalesce("_start", "_carried")).drop("_block", "_new", "_start", "_carried", "_key")


def ingest_joined(df: DataFrame, entities: list[JoinedEntity], row_col: str = "_row", partition: Column | None = None, link_all: bool = True, id_template: str = "row_{{.rowIndex}}", start_row: int = 0) -> Graph:
    """Graphs of a denormalised CSV: consecutive rows with equal ids of the first entity are one graph.

    Each entity is projected from its columns; within a graph the rows of an entity with the same
    ids count once. partition tells inputs apart (default: the file, where df has _file).
    id_template names a graph from its first row; dataIndex counts from start_row. Node ids carry
    the entity's number, as several roots of one graph stand on the same row.
    """
    cells = [c for c in df.columns if c not in (row_col, "_row", "_file", "_data")]
    part = partition if partition is not None else F.col("_file") if "_file" in df.columns else F.lit(0)
    key = F.to_json(F.array(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in entities[0].id_columns)))
    rows = _runs(df.withColumn("_part", part), key, row_col)
    named = rows.where(F.col("_first") == F.col(row_col)).withColumns({"_row": F.col("_first"), "_data": F.col("_first") - start_row})
    if id_template == "row_{{.rowIndex}}":
        rows = rows.withColumn("_graph", F.concat(F.lit("row_"), F.col("_first").cast("string")))
    else:
        rows = rows.join(named.select("_part", "_first", template(id_template, cells).alias("_graph")), ["_part", "_first"])
    found = None
    for n, e in enumerate(entities):
        own = rows
        if e.any_columns:
            some = F.lit(False)
            for c in e.any_columns:
                some = some | (F.trim(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) != "")
            own = own.where(some)
        ids = F.to_json(F.array(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in e.id_columns)))
        own = own.withColumn("_eid", ids)
        once = own.groupBy("_part", "_graph", "_eid").agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in e.columns), F.col(row_col).alias("__row")), row_col).alias("_e"))
        base = once.select("_e.*", F.concat_ws("/", F.col("_part").cast("string"), "_graph").alias("__gid"), "_graph")
        base = base.withColumn("__id", F.concat(F.lit(f"{n}:row_"), F.col("__row").cast("string")))
        cells = base.select(*(F.col(f"`{c}`") for c in e.columns), "__gid", "__id")
        items = flat_items(cells, e.layer, F.col("__gid"), None, False, True, F.col("__id"))
        found = items if found is None else found.unionByName(items)
    out = graph_of(found, entities[0].layer)
    if link_all:
        for e in entities:
            linked = link(out.with_(layer=e.layer))
            out = out.with_(nodes=linked.nodes, edges=linked.edges)
    return out
