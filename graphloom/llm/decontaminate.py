"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are joined on shared seeds (hashes of runs of words):

1. An item's most frequent seeds are left out as long as the words in them are too few for the
   coverage asked for. Whoever covers the item has one of its other seeds, so nothing is lost,
   and seeds that many items share (a template) are seldom joined on.
2. An array of bits of these seeds, of a bounded size, tells in one scan which documents may hold any.
   Such a document's seeds, as rows, meet the items' in an equi-join.
3. For each candidate pair the longest common runs of unmarked words are marked again and again,
   found by running Karp-Rabin hashes of falling window lengths; a tile marks its words on both
   sides, so no word counts twice and passages may stand in another order. A document is
   contaminated by an item of which the tiles cover a sufficient share.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bits, bit_array, give_back, mapped, mix64, saved

MIN_MATCH = 5
COVERAGE = 0.8
#: Up to so many seeds (24 MB) the benchmark's are broadcast; beyond it the join shuffles.
BROADCAST_SEEDS = 1_000_000
#: Up to so many digests of contaminated texts (some 40 MB) are broadcast.
BROADCAST_KEYS = 400_000
#: Parts in which the items that meet a document are tiled.
PARTS = 64
_WORD = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def windows(values: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of `size` of 64-bit values, by doubling."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        out, part, power = None, mix64(values), 1
        done, base = 0, _BASE
        left = size
        while left:
            if left & 1:
                out = part[:n].copy() if out is None else out * base + part[done : done + n]
                done += power
            left >>= 1
            if left:
                part = part[: len(part) - power] * base + part[power:]
                power, base = 2 * power, base * base
        return mix64(out)


def tile(text: np.ndarray, pattern: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles (text start, pattern start, length), longest first, none shorter than `least`.

    Values below 0 match nothing. Of equally long matches the first in the pattern, then in
    the text, is marked first.
    """
    free_t, free_p = text >= 0, pattern >= 0
    tiles: list[tuple[int, int, int]] = []
    size = max(least, min(len(text), len(pattern)))
    while True:
        found = _matches(text, pattern, free_t, free_p, size) if size <= min(len(text), len(pattern)) else []
        longest = max((m[0] for m in found), default=0)
        for length, p, t in sorted((m for m in found if m[0] == longest), key=lambda m: m[1:]):
            if free_t[t : t + length].all() and free_p[p : p + length].all():
                free_t[t : t + length] = free_p[p : p + length] = False
                tiles.append((t, p, length))
        if found:
            continue  # shorter ones, and what is left of those partly marked meanwhile, are looked for again
        if size <= least:
            return tiles
        size = max(least, size // 2)


def _matches(text, pattern, free_t, free_p, size) -> list[tuple[int, int, int]]:
    """Maximal common runs (length, pattern start, text start) of at least `size` unmarked words."""
    clear = lambda free: np.flatnonzero(np.convolve(free, np.ones(size), "valid") > size - 0.5)
    at_t, at_p = clear(free_t), clear(free_p)
    if not len(at_t) or not len(at_p):
        return []
    hash_t, hash_p = windows(text, size)[at_t], windows(pattern, size)[at_p]
    order = np.argsort(hash_t, kind="stable")
    low, high = (np.searchsorted(hash_t[order], hash_p, side) for side in ("left", "right"))
    out = []
    ends: dict[int, int] = {}  # by diagonal: where the last run ended
    for k in np.flatnonzero(high > low):
        p = int(at_p[k])
        for t in at_t[order[low[k] : high[k]]].tolist():
            if ends.get(t - p, -1) >= p + size or not np.array_equal(text[t : t + size], pattern[p : p + size]):
                continue
            n = size
            while p + n < len(pattern) and t + n < len(text) and free_p[p + n] and free_t[t + n] and text[t + n] == pattern[p + n]:
                n += 1
            ends[t - p] = p + n
            out.append((n, p, t))
    return out


class Seeds:
    """Texts to seed hashes; remembers at most `most` word hashes."""

    def __init__(self, least: int = MIN_MATCH, most: int = 300_000):
        self.least, self.most, self.known = least, most, {}

    def values(self, tokens: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > self.most:
            known.clear()
        for t in set(tokens).difference(known):
            known[t] = xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass"))
        return np.fromiter(map(known.__getitem__, tokens), dtype=np.uint64, count=len(tokens))

    def of(self, values: np.ndarray, size: int) -> np.ndarray:
        return windows(values, size) ^ mix64(np.uint64(size))


def rare(seeds: list[tuple[int, int, int]], n_words: int, size: int, coverage: float) -> list[int]:
    """Of an item's seeds (how often among all items, place, hash) those to join on: the most frequent are left out while their words are under `coverage`."""
    inside, left = np.zeros(n_words, dtype=bool), sorted(seeds, reverse=True)
    for k, (_, at, _) in enumerate(left):
        inside[at : at + size] = True
        if inside.sum() >= coverage * n_words:
            return sorted({h for _, _, h in left[k:]})
    return []


def cover(tokens: list[str], item: list[str], least: int, coverage: float) -> tuple[int, int] | None:
    """(words of the item covered, tiles) if they reach `coverage`."""
    size = min(least, len(item))
    known: dict[str, int] = {}
    own = np.array([known.setdefault(w, len(known)) for w in item], dtype=np.int64)
    ids = np.fromiter((known.get(w, -1) for w in tokens), dtype=np.int64, count=len(tokens))
    if not size or len(ids) < size:
        return None
    # only words within seeds can lie in a tile; the rest is cut away
    hit = np.flatnonzero(np.isin(windows(ids, size), windows(own, size)))
    edge = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + size, -1)
    cut = np.flatnonzero((np.cumsum(edge[:-1]) > 0) & (ids >= 0))
    if not len(cut) or len(cut) < coverage * len(item):
        return None
    kept = np.insert(ids[cut], np.flatnonzero(np.diff(cut) > 1) + 1, -1)
    tiles = tile(kept, own, size)
    covered = sum(n for _, _, n in tiles)
    return (covered, len(tiles)) if covered and covered >= coverage * len(item) else None


class Index:
    """The benchmark's items and the seeds to join on, as tables; bits and seed lengths as values."""

    def __init__(self, benchmark: DataFrame, id_col: str, text_col: str, coverage: float, least: int = MIN_MATCH):
        given = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("item_text")).distinct()

        def seeds():
            of = Seeds(least)

            def work(columns):
                out = {"item_id": columns[0], "item_text": columns[1], "n": [], "size": [], "seeds": []}
                for text in columns[1]:
                    tokens = words(text)
                    size = min(least, len(tokens))
                    out["n"].append(len(tokens))
                    out["size"].append(size)
                    out["seeds"].append(of.of(of.values(tokens), size).view(np.int64) if size else [])
                return out

            return work

        items = mapped(given, ["item_id", "item_text"], "item_id long, item_text string, n int, size int, seeds array<long>", seeds)
        self.items = saved(items.where("n > 0").withColumn("item", F.monotonically_increasing_id()))
        one = self.items.select("item", "n", "size", F.posexplode("seeds").alias("at", "seed"))
        often = one.groupBy("seed").agg(F.count("*").alias("often"))
        held = one.join(often, "seed").groupBy("item").agg(F.first("n").alias("n"), F.first("size").alias("size"), F.collect_list(F.struct("often", "at", "seed")).alias("held"))

        def choose():
            def work(columns):
                item, n, size, held = columns
                return {"item": item, "seeds": [rare([(h["often"], h["at"], h["seed"]) for h in x], a, b, coverage) for x, a, b in zip(held, n, size, strict=True)]}

            return work

        chosen = mapped(held, ["item", "n", "size", "held"], "item long, seeds array<long>", choose, rows=32)
        self.seeds = saved(chosen.select("item", F.explode("seeds").alias("seed")))
        self.least, self.coverage = least, coverage
        self.count = self.seeds.count()
        self.sizes = sorted(r[0] for r in self.items.select("size").distinct().collect())
        self.bits = bit_array(self.seeds, "seed", self.count)


_SEEDS, _ROW, _KEY = "__graphloom_seeds", "__graphloom_row", "__graphloom_key"


def _seeds_of(texts: list[str | None], of: Seeds, sizes: list[int], bits: Bits) -> tuple[np.ndarray, np.ndarray]:
    """(text number, seed) of the seeds of each text that may be the benchmark's, each once, by text."""
    tokens = [words(t) for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in tokens])
    values = of.values([w for t in tokens for w in t])
    found = [np.zeros((0, 2), dtype=np.uint64)]
    for size in sizes:
        if len(values) >= size:
            inside = np.flatnonzero(owner[: len(owner) - size + 1] == owner[size - 1 :])
            seeds = of.of(values, size)[inside]
            hit = bits.hold(seeds)
            found.append(np.stack([owner[inside[hit]].astype(np.uint64), seeds[hit]], axis=1))
    pairs = np.unique(np.concatenate(found), axis=0)
    return pairs[:, 0].astype(np.int64), pairs[:, 1]


def _suspects(df: DataFrame, index: Index, text_col: str) -> DataFrame:
    """The rows of df whose texts may hold a seed of the benchmark, with these seeds."""
    from pyspark.sql import types as T

    shared = df.sparkSession.sparkContext.broadcast(index.bits.words)
    sizes, least, column = index.sizes, index.least, df.schema.fieldNames().index(text_col)

    def run(batches):
        bits, of = Bits(shared.value), Seeds(least)
        for batch in (b.slice(k, 256) for b in batches for k in range(0, b.num_rows, 256)):
            text, seeds = _seeds_of(batch.column(column).to_pylist(), of, sizes, bits)
            number = np.bincount(text, minlength=batch.num_rows)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(number[number > 0])), pa.int32()), pa.array(seeds.view(np.int64)))
            yield batch.filter(pa.array(number > 0)).append_column(_SEEDS, lists)
            del batch, lists
        give_back()

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(_SEEDS, T.ArrayType(T.LongType()))]))


def _tiled(suspects: DataFrame, index: Index, columns: list[str], text_col: str) -> DataFrame:
    """columns of suspects (with _ROW) and item_id, n_item_words, n_covered, n_tiles for each item that they cover."""
    seeds = F.broadcast(index.seeds) if index.count <= BROADCAST_SEEDS else index.seeds
    pairs = suspects.select(_ROW, F.explode(_SEEDS).alias("seed")).join(seeds, "seed").select(_ROW, "item").distinct()
    met = pairs.join(index.items.select("item", "item_id", "item_text"), "item")
    met = met.groupBy(_ROW, F.pmod("item", F.lit(PARTS)).alias("part")).agg(F.collect_list(F.struct("item_id", "item_text")).alias("items"))
    least, coverage = index.least, index.coverage
    kinds = ", ".join(f"`{c}` {suspects.schema[c].dataType.simpleString()}" for c in columns)

    def tiles():
        def work(given):
            *kept, texts, items = given
            out: list[tuple] = []
            for k, (text, own) in enumerate(zip(texts, items, strict=True)):
                tokens = words(text)
                for item in own:
                    other = words(item["item_text"])
                    if got := cover(tokens, other, least, coverage):
                        out.append((*(c[k] for c in kept), item["item_id"], len(other), *got))
            names = [*columns, "item_id", "n_item_words", "n_covered", "n_tiles"]
            return {n: [r[i] for r in out] for i, n in enumerate(names)}

        return work

    # rows of a document follow one another in the join's sorted partitions
    rows = met.join(suspects.select(*dict.fromkeys([_ROW, *columns, text_col])), _ROW)
    return mapped(rows, [*columns, text_col, "items"], f"{kinds}, item_id long, n_item_words int, n_covered int, n_tiles int", tiles, rows=64)


def find_leaks(df: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each document row and benchmark item that it covers by `coverage` or more.

    Items of fewer than five words count only as a whole; items without words, and null or empty
    texts, match nothing. Null ids stay null, repeated documents give repeated rows, repeated
    benchmark rows count once. Empty tables give no rows; other columns are not read.
    """
    index = Index(benchmark, item_col, item_text_col, coverage)
    src = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))
    suspects = saved(_suspects(src, index, "_text").withColumn(_ROW, F.monotonically_increasing_id()))
    found = _tiled(suspects, index, ["doc_id"], "_text")
    return found.select("doc_id", "item_id", "n_item_words", "n_covered", "n_tiles", (F.col("n_covered") / F.col("n_item_words")).alias("coverage"), F.lit(True).alias("contaminated"))


def drop_leaks(df: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of df, all columns, that no benchmark item contaminates.

    Contamination is a matter of the text, so contaminated texts are found first and told by their
    digests then: all at once where they are few enough to broadcast, else by a join. Null and
    empty texts hold no item and stay, repeated rows stay or go together, ids are not read; an empty
    table stays empty, and an empty benchmark, or one without words, takes nothing away.
    """
    index = Index(benchmark, item_col, item_text_col, coverage)
    src = df.select(F.col(f"`{text_col}`").alias("_text")).where("_text IS NOT NULL")
    suspects = saved(_suspects(src, index, "_text").withColumns({_ROW: F.monotonically_increasing_id(), _KEY: F.sha2(F.col("_text").cast("binary"), 256)}))
    leaks = saved(_tiled(suspects, index, [_KEY], "_text").select(_KEY).distinct())
    if leaks.count() > BROADCAST_KEYS:
        keyed = df.withColumn(_KEY, F.sha2(F.col(f"`{text_col}`").cast("binary"), 256))
        return keyed.join(leaks, _KEY, "left_anti").select(*(F.col(f"`{c}`") for c in df.columns))
    gone = df.sparkSession.sparkContext.broadcast(frozenset(bytes.fromhex(r[0]) for r in leaks.collect()))
    i = df.schema.fieldNames().index(text_col)

    def run(batches):
        own = gone.value
        for batch in batches:
            yield batch.filter(pa.array([not t.is_valid or hashlib.sha256(t.as_buffer()).digest() not in own for t in batch.column(i)], type=pa.bool_()))
            del batch
        give_back()

    return df.mapInArrow(run, df.schema)
