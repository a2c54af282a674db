"""Helpers shared by the corpus operators: Arrow batches, shared-folder tables, hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_M64 = np.uint64(0xFFFFFFFFFFFFFFFF)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; where none is set, a folder of this machine, which only a local session can use."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def saved(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there and a lost executor costs nothing."""
    path = f"{shared_dir(df.sparkSession)}/graphloom/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*frames: DataFrame) -> None:
    """Delete the tables that saved() wrote, once nothing reads them any more."""
    for df in frames:
        for f in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
            jvm, jsc = df.sparkSession._jvm, df.sparkSession._jsc
            p = jvm.org.apache.hadoop.fs.Path(f)
            p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)


def give_back() -> None:
    """Memory that Arrow and the C library keep after a task's work goes back to the system: workers stay, an executor's memory is theirs too."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library of Linux has it
    if trim is not None:
        trim(0)


def mapped(df: DataFrame, columns: Sequence[str], schema: str, make: Callable[[], Callable[[list[list]], dict[str, list]]], rows: int = 512) -> DataFrame:
    """mapInArrow over slices of a bounded number of rows.

    make() is called once for each task and returns the function that turns lists of
    column values into a dict of output columns.
    """
    target = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            part = None
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                out = work([c.to_pylist() for c in part.columns])
                yield pa.RecordBatch.from_arrays([_array(out[f.name], f.type) for f in arrow], schema=arrow)
                del out
            del batch, part
        del work
        give_back()

    return df.select(*columns).mapInArrow(run, target)


def _array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.Array):
        return values
    if isinstance(values, np.ndarray):
        return pa.array(values).cast(kind)
    return pa.array(values, type=kind)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words (xor-shift and multiply)."""
    x = np.asarray(x, dtype=np.uint64)
    with np.errstate(over="ignore"):
        return _mixed(x)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(df: DataFrame, column: str = "text") -> int:
    from pyspark.sql import functions as F

    return int(df.agg(F.sum(F.octet_length(column))).first()[0] or 0)


#: Bits for each key in an array of bits, and the most bits of all (32 MB).
KEY_BITS, MOST_BITS = 24, 1 << 28


class Bits:
    """An array of bits that tells of 64-bit keys whether they may be among given ones: three bits of a hash for each."""

    def __init__(self, words: np.ndarray):
        self.words, self.mask = words, np.uint64(64 * len(words) - 1)

    @staticmethod
    def places(keys: np.ndarray, mask: np.uint64) -> list[np.ndarray]:
        keys = mix64(keys)
        other = mix64(keys ^ np.uint64(0x9E3779B97F4A7C15))
        return [x & mask for x in (keys, other, (keys >> np.uint64(32)) ^ (other >> np.uint64(32)))]

    def hold(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), dtype=bool)
        for at in self.places(keys, self.mask):
            found &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return found


def bit_array(keys: DataFrame, column: str, count: int) -> Bits:
    """The Bits of a column of longs, set over its rows and gathered as words; bounded however many keys there are."""
    from pyspark.sql import functions as F

    bits = 1 << 16
    while bits < min(KEY_BITS * count, MOST_BITS):
        bits *= 2
    mask = np.uint64(bits - 1)

    def place():
        def work(columns):
            at = np.concatenate(Bits.places(np.array(columns[0], dtype=np.int64).view(np.uint64), mask))
            return {"slot": (at >> np.uint64(6)).astype(np.int64), "bit": (np.uint64(1) << (at & np.uint64(63))).view(np.int64)}

        return work

    found = mapped(keys, [column], "slot long, bit long", place, rows=8192).groupBy("slot").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(bits // 64, dtype=np.uint64)
    out[found.column("slot").to_numpy()] = found.column("bit").to_numpy().view(np.uint64)
    return Bits(out)


def may_hold(src: DataFrame, ids: Bits) -> DataFrame:
    """The rows of src whose first column, a long, may be among the ids of the bits; null is not."""
    shared = src.sparkSession.sparkContext.broadcast(ids.words)

    def run(batches):
        bits = Bits(shared.value)
        for batch in batches:
            own = batch.column(0)
            yield batch.filter(pa.array(bits.hold(np.asarray(own.fill_null(0)).astype(np.int64).view(np.uint64)) & np.asarray(own.is_valid())))
            del batch, own
        give_back()

    return src.mapInArrow(run, src.schema)
