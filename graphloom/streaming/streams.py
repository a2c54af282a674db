"""The row-local operators on streams, and the cross-row ones with watermarks.

Ingestion, hashing inputs, validation and dictionary lookup against static entries are plain
projections and broadcast joins, so they run unchanged on a streaming DataFrame. Links become a
stream-stream join within a time bound, and deduplication keeps ids for the watermark's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ingest import flat_items, json_items
from ..operators.valueset import words
from ..schema.layer import Layer


def ingest_stream(rows: DataFrame, layer: Layer, graph_id: Column, time: str, delay: str = "10 minutes", json_col: str | None = None) -> DataFrame:
    """Items (graph_id, item struct, event time) of a stream of rows or JSON documents, watermarked."""
    marked = rows.withWatermark(time, delay)
    source = F.col(time).cast("string")
    items = flat_items(marked, layer, graph_id, source) if json_col is None else json_items(marked, layer, json_col, graph_id, source)
    return items.where("item.present AND item.error IS NULL").withColumn(time, F.col("source").cast("timestamp"))


def lookup_stream(rows: DataFrame, entries: DataFrame, value_col: str, result_key: str = "") -> DataFrame:
    """rows with `result` from a static table of entries of one value or one key, and its default.

    As in the batch lookup, words that differ in case match unless their entry is case-sensitive.
    Entries of several keys, different entries for one word and several defaults are errors.
    """
    one = entries.where("NOT is_default").groupBy("case_sensitive", F.col("match").alias("_m")).agg(F.count_distinct("entry_id").alias("_c"), F.max("n_keys").alias("_n"), F.first(F.col("result")[result_key]).alias("_hit"))
    wrong = one.where("_c > 1 OR _n > 1").limit(1).collect()
    if wrong:
        raise ValueError(f"several entries for {wrong[0]._m}" if wrong[0]._c > 1 else f"an entry of several keys for {wrong[0]._m}")
    defaults = entries.where("is_default").select(F.col("result")[result_key].alias("d")).limit(2).collect()
    if len(defaults) > 1:
        raise ValueError("several defaults")
    fallback = F.lit(defaults[0].d if defaults else None)
    out = rows
    for case in (True, False):
        mine = one.where(F.col("case_sensitive") == case).select(F.col("_m").alias(f"_m{case}"), F.col("_hit").alias(f"_hit{case}"), F.lit(True).alias(f"_is{case}"))
        out = out.withColumn(f"_m{case}", words(F.col(value_col), case)).join(mine, f"_m{case}", "left").drop(f"_m{case}")
    both = F.when(F.col("_isTrue") & F.col("_isFalse"), F.raise_error(F.concat(F.lit("ambiguous entries for "), F.col(value_col))).cast("string"))
    found = both.when(F.col("_isTrue"), F.col("_hitTrue")).when(F.col("_isFalse"), F.col("_hitFalse")).otherwise(fallback)
    return out.withColumn("result", found).drop("_isTrue", "_isFalse", "_hitTrue", "_hitFalse")


def unique_stream(rows: DataFrame, keys: list[str], time: str, delay: str = "10 minutes") -> DataFrame:
    """The first row of each key within the watermark's length; state is dropped after it."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def link_streams(facts: DataFrame, entities: DataFrame, fact_key: str, entity_key: str, fact_time: str, entity_time: str, within: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Foreign-key links of two streams whose event times lie within a bound, so state is bounded."""
    a = facts.withWatermark(fact_time, delay)
    b = entities.withWatermark(entity_time, delay)
    near = F.expr(f"{entity_time} BETWEEN {fact_time} - INTERVAL {within} AND {fact_time} + INTERVAL {within}")
    return a.join(b, (F.col(fact_key) == F.col(entity_key)) & near)


def window_counts(rows: DataFrame, time: str, keys: list[str], width: str = "10 minutes", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Counts by key and time window of late-tolerant rows."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return rows.withWatermark(time, delay).groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *keys, "n")
