"""Entity reuse on streams with state of its own, sessions, and late rows in a table of their own."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from ..storage import exists

#: A state store that keeps state on the executors' disks and not in their heaps.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Groups into which entities are dealt by hash. Each is one row of state and one call a micro-batch, whatever its number of entities.
BUCKETS = 1 << 12


def _reuse(keep: int):
    """A function of applyInPandasWithState that keeps first nodes of a bucket's entities until `keep` milliseconds after they were last met.

    A bucket's entities share a state and a timeout, that of the first of them to be forgotten: a call for each entity costs milliseconds.
    """

    def one(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = {(g, k, e): (node, until) for g, k, e, node, until in json.loads(state.get[0])} if state.exists else {}
        if not state.hasTimedOut:
            own = [x for part in rows for x in zip(*(part[c].tolist() for c in ("graph_id", "kind", "entity_id", "node_id", "time_ms")), strict=True)]
            # node ids: shorter ones first, so that numbers in them count up, as in the batch operator
            first, last = {}, {}
            for g, k, e, node, at in own:
                rank = (node is None, len(node or ""), node or "")
                first[g, k, e] = min(first.get((g, k, e), rank), rank)
                last[g, k, e] = max(last.get((g, k, e), at), at)
            for entity, rank in first.items():
                node, until = known.get(entity, (None if rank[0] else rank[2], 0))
                known[entity] = (node, max(until, last[entity] + keep))
            found = [(g, k, e, node, known[g, k, e][0]) for g, k, e, node, _ in own]
            yield pd.DataFrame(found, columns=["graph_id", "kind", "entity_id", "node_id", "winner"])
        now = state.getCurrentWatermarkMs()
        left = [(*entity, node, until) for entity, (node, until) in known.items() if until >= now]
        if not left:
            state.remove()
            return
        state.update((json.dumps(left),))
        state.setTimeoutTimestamp(max(min(x[4] for x in left), now + 1))

    return one


def reuse_stream(entities: DataFrame, time: str, keep: str = "1 day", delay: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """(graph_id, kind, entity_id, node_id, winner): for each entity node of a stream the node that stands for its entity.

    entities: graph_id, kind (its schema or label), entity_id (text), node_id and an event time. The node that came first
    stays; of those of one micro-batch the first by node id, as in entities.reuse_entities. It is remembered until `keep` after the
    entity was last met, by event time; a timeout drops it then. Rows without an entity id give nothing. With many entities the session
    takes ROCKSDB as its state store, which keeps them on disk. A bucket's state is written whole when an entity of it is met; a
    running stream keeps its number of buckets.
    """
    spark = entities.sparkSession
    length = spark.sql(f"SELECT CAST(unix_millis(TIMESTAMP '1970-01-01 00:00:00Z' + INTERVAL {keep}) AS BIGINT) AS ms").first()["ms"]
    marked = entities.where("entity_id IS NOT NULL").withWatermark(time, delay).withColumn("time_ms", F.unix_millis(F.col(time)))
    bucket = F.pmod(F.xxhash64("graph_id", "kind", "entity_id"), F.lit(buckets)).alias("bucket")
    rows = marked.select(bucket, "graph_id", "kind", "entity_id", "node_id", "time_ms", time)
    return rows.groupBy("bucket").applyInPandasWithState(
        _reuse(length), "graph_id string, kind string, entity_id string, node_id string, winner string", "entities string", "append", "EventTimeTimeout"
    )


def sessions(rows: DataFrame, time: str, keys: list[str], gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """(session_start, session_end, keys, n): runs of a key's rows with no more than `gap` between two of them."""
    marked = rows.withWatermark(time, delay) if rows.isStreaming else rows
    counted = marked.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, "n")


def split_late(rows: DataFrame, time: str, delay: str, on_time: Callable[[DataFrame, int], None], late_path: str, marks_path: str):
    """A writer that hands on_time(batch, number) the rows of each micro-batch and puts late ones into a table.

    Late are rows whose time is more than `delay` before the latest time of all batches before theirs. These
    latest times are kept in marks_path, a row for each batch, so a restarted query goes on with them, and a batch that
    is run again is split as it was: its late rows replace those it wrote before. Start it with a checkpoint location as any writer.
    """
    spark = rows.sparkSession

    def each(batch: DataFrame, number: int) -> None:
        before = None
        if exists(spark, marks_path):
            before = spark.read.schema("number long, latest timestamp").parquet(f"{marks_path}/*").where(F.col("number") < number).agg(F.max("latest")).first()[0]
        batch = batch.persist()
        late = F.lit(False) if before is None else F.coalesce(F.col(time) < F.lit(before) - F.expr(f"INTERVAL {delay}"), F.lit(False))
        batch.where(late).write.mode("overwrite").parquet(f"{late_path}/batch={number}")
        on_time(batch.where(~late), number)
        batch.agg(F.lit(number).cast("long").alias("number"), F.max(time).cast("timestamp").alias("latest")).write.mode("overwrite").parquet(f"{marks_path}/batch_{number}")
        batch.unpersist()

    return rows.writeStream.foreachBatch(each)
