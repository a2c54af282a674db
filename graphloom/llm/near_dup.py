"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Two permutations make all signature coordinates: the first scatters a document's shingles over
a ring, the second ranks the ring's places, and coordinate k reads the ranks shifted k places.
Documents with equal shingle sets form classes first. Classes that share a band form candidate
clusters; within a cluster links are confirmed on full sets. A row of exact similarities is
worked out for a class only while it may still join two components, so the pairs of a large
group are neither emitted nor all computed.
"""

from __future__ import annotations

import math

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_array, forget, give_back, mapped, may_hold, mix64, saved
from .components import connected_components
from .decontaminate import windows

WIDTH = 5
BAND_ROWS = 6
#: Enough bands are used that a pair just at the threshold misses all of them less often than this.
MISS = 1e-8
RING = 1 << 20
#: Up to so many ids (some 16 MB) of documents that go are broadcast.
BROADCAST_IDS = 1_000_000
#: Shingles of one verification block; larger clusters are verified block against block.
BLOCK_SHINGLES = 1_000_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles; of fewer words, one of them all."""
    words = (text or "").encode("utf-8").lower().split()  # bytes: A-Z only, and ASCII space only
    if not words:
        return np.zeros(0, dtype=np.uint64)
    digest = xxhash.xxh3_64_intdigest
    values = np.fromiter(map(digest, words), dtype=np.uint64, count=len(words))
    size = min(WIDTH, len(words))
    return np.unique(windows(values, size) ^ np.uint64(size))


def bands_for(percent: int, rows: int = BAND_ROWS, miss: float = MISS) -> int:
    share = (percent / 100) ** rows
    return 1 if share >= 1 else math.ceil(math.log(miss) / math.log(1 - share))


class Circulant:
    def __init__(self, bands: int, rows: int = BAND_ROWS, seed: int = 11):
        self.bands, self.rows = bands, rows
        ranks = np.random.default_rng(seed).permutation(RING).astype(np.uint32)
        self.shifted = np.lib.stride_tricks.sliding_window_view(np.concatenate([ranks, ranks[: bands * rows]]), bands * rows)

    def signature(self, values: np.ndarray) -> np.ndarray:
        """All coordinates: for each shift the least rank over the shingles' places."""
        places = np.unique(mix64(values ^ _STEP) & np.uint64(RING - 1)).astype(np.int64)
        best = self.shifted[places[:1024]].min(axis=0)
        for at in range(1024, len(places), 1024):
            np.minimum(best, self.shifted[places[at : at + 1024]].min(axis=0), out=best)
        return best

    def band_keys(self, values: np.ndarray) -> np.ndarray:
        """One 64-bit key for each band, its number included."""
        grid = self.signature(values).reshape(self.bands, self.rows).astype(np.uint64)
        with np.errstate(over="ignore"):
            key = mix64(np.arange(self.bands, dtype=np.uint64) + np.uint64(1))
            for k in range(self.rows):
                key = mix64(key * _STEP + grid[:, k])
        return key.view(np.int64)


def verified(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """(id, smallest id of its component) for the links of at least `percent` within a block.

    Of two sets in different components at least one gets its whole row of similarities, by
    an inverted index; sets in the largest component left need none against each other.
    """
    m = len(ids)
    if m < 2:
        return []
    size = np.array([len(s) for s in sets], dtype=np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m), size)
    _, token = np.unique(flat, return_inverse=True)
    df = np.bincount(token)
    posting = owner[np.argsort(token, kind="stable")]
    start = np.concatenate([[0], np.cumsum(df)])
    first = np.concatenate([[0], np.cumsum(size)])
    central = np.bincount(owner, weights=df[token], minlength=m) / np.maximum(size, 1)
    label, open_ = np.arange(m), np.ones(m, dtype=bool)
    while True:
        left = np.flatnonzero(open_)
        if not len(left):
            break
        names, count = np.unique(label[left], return_counts=True)
        others = left[label[left] != names[np.argmax(count)]]
        if not len(others):
            break
        x = int(others[np.argmax(central[others])])
        open_[x] = False
        own = token[first[x] : first[x + 1]]
        length = df[own]
        at = np.repeat(start[own] - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
        both = np.bincount(posting[at], minlength=m)
        linked = np.flatnonzero((100 * both >= percent * (size[x] + size - both)) & (both > 0))
        joined = np.unique(label[linked])
        if len(joined) > 1:
            label[np.isin(label, joined)] = joined[0]
    out = []
    for name, count in zip(*np.unique(label, return_counts=True), strict=True):
        if count > 1:
            members = ids[label == name]
            low = int(members.min())
            out += [(int(i), low) for i in members if i != low]
    return out


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, bands: int | None = None, band_rows: int = BAND_ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of df.

    Documents are linked if 100 * |intersection| >= percent * |union| of their shingle sets;
    component_id is the smallest id reachable over links. A null, empty or wordless text has no
    shingles and is linked with nothing. A row with a null id is linked with nothing either: its
    component is null and it is kept. Rows with the same id are one document to the links.
    Ties cannot arise, an empty table gives no rows, other columns are not read.
    """
    src = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    bands = bands or bands_for(percent, band_rows)

    def sign():
        ring = Circulant(bands, band_rows)

        def work(columns):
            ids, texts = columns
            sets = [shingles(t) for t in texts]
            return {
                "doc_id": ids,
                "n_shingles": [len(s) for s in sets],
                "set_key": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                "bands": [ring.band_keys(s) if len(s) and i is not None else None for i, s in zip(ids, sets, strict=True)],
            }

        return work

    nodes = saved(mapped(src, ["doc_id", "_text"], "doc_id long, n_shingles long, set_key binary, bands array<long>", sign))
    named = nodes.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
    classes = saved(named.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")))
    band = classes.select("rep", F.explode("bands").alias("band"))
    # written first, so that the join below has two plain shuffles and a hot band can be split
    hubs = saved(band.groupBy("band").agg(F.min("rep").alias("hub"), F.max("rep").alias("_top")).where("hub <> _top").select("band", "hub"))
    near = band.join(hubs, "band").where("rep <> hub").select(F.col("rep").alias("u"), F.col("hub").alias("v"))
    cluster = saved(connected_components(near))
    links = _verified_links(src, classes, cluster, percent)
    final = connected_components(links)
    out = nodes.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key"))
    out = out.join(classes.select("set_key", "rep"), "set_key", "left").join(final.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.coalesce("component", "rep", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _verified_links(src: DataFrame, classes: DataFrame, cluster: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (u, v) within the candidate clusters."""
    member = classes.select("rep", "set_key", "n").join(cluster, F.col("rep") == F.col("node")).select("rep", "set_key", "n", "component")
    weight = cluster.join(classes.select(F.col("rep").alias("node"), "n"), "node").groupBy("component").agg((F.floor(F.sum("n") / BLOCK_SHINGLES) + 1).alias("blocks"), F.sum("n").alias("_n"))
    weight = saved(weight)
    packs = int((weight.agg(F.sum("_n")).first()[0] or 0) // BLOCK_SHINGLES) + 1
    member = saved(member.join(weight.drop("_n"), "component").select("rep", "set_key", "component", "blocks", F.pmod(F.xxhash64("rep"), "blocks").alias("block")))
    # an array of bits, of a bounded size, keeps most texts of other documents out of the shuffle
    text = may_hold(src, bit_array(member, "rep", member.count())).join(member, F.col("doc_id") == F.col("rep"))

    def collect():
        def work(columns):
            rep, key, component, blocks, block, texts = columns
            sets = [shingles(t) for t in texts]
            own = [k for k, s in enumerate(sets) if len(s) and xxhash.xxh3_128_digest(s.tobytes()) == key[k]]
            pick = lambda values: [values[k] for k in own]
            return {"rep": pick(rep), "component": pick(component), "blocks": pick(blocks), "block": pick(block), "set": [sets[k].tobytes() for k in own]}

        return work

    sets = mapped(text, ["rep", "set_key", "component", "blocks", "block", "_text"], "rep long, component long, blocks long, block long, set binary", collect)
    # a class meets every block of its cluster, its own included
    met = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("_other")
    pairs = sets.select("rep", "component", "blocks", "block", "set", met).select("rep", "component", "set", F.least("block", "_other").alias("i"), F.greatest("block", "_other").alias("j"), "blocks")
    pack = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("component"), F.lit(packs))).otherwise(F.xxhash64("component", "i", "j"))

    def confirm(table):
        import pyarrow as pa

        # group the rows of each (component, i, j); repeated rows of a class count once
        groups: dict[tuple, dict] = {}
        for c, i, j, rep, s in zip(*(table.column(n).to_pylist() for n in ("component", "i", "j", "rep")), table.column("set"), strict=True):
            groups.setdefault((c, i, j), {}).setdefault((rep, s.as_py()), None)
        u, v = [], []
        for group in groups.values():
            ids = np.array([rep for rep, _ in group], dtype=np.int64)
            for a, b in verified(ids, [np.frombuffer(s, dtype=np.uint64) for _, s in group], percent):
                u.append(a)
                v.append(b)
        groups.clear()
        give_back()
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    out = pairs.withColumn("pack", pack).groupBy("pack").applyInArrow(confirm, "u long, v long")
    out = saved(out.distinct())
    forget(weight, member)
    return out


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """The rows of df, all columns, with one document of each component: the one with the smallest id.

    Documents are told apart by id and text: of rows that share both one stays, and different texts of one id
    stay or go each for itself. Of such texts the one with the least hash goes by the id; the others, and rows
    without an id, come after all others and go by a hash of 61 bits of id and text. Null, empty
    and wordless texts are linked with nothing and stay. An empty table gives none.

    The ids that go are broadcast up to a counted number; beyond it rows are shuffled, and the
    built side of a partition holds ids only, a small share of the texts that pass by.
    """
    own, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")
    plain = F.coalesce(own < _ODD, F.lit(False))
    mark = F.coalesce(F.xxhash64(text), F.lit(0))
    twice = saved(df.where(plain).groupBy(own.alias(_SID)).agg(F.count("*").alias(_GONE), F.min(mark).alias(_LEAST)).where(F.col(_GONE) > 1).select(_SID, _LEAST))
    shared, odd = twice.count(), not df.where(~plain).isEmpty()
    if not shared and not odd:
        return _without(df, own, _gone(df.select(own.alias("doc_id"), text.alias("text")), percent))
    again = F.broadcast(twice) if shared <= BROADCAST_IDS else twice
    met = own == F.col(_SID)
    first = df.where(plain).join(again, met, "left_anti")
    late = df.where(plain).join(again, met).drop(_SID).unionByName(df.where(~plain).withColumn(_LEAST, F.lit(None).cast("long")))
    sid = F.when(F.col(_LEAST) == mark, own).otherwise(F.xxhash64(own, text).bitwiseAND(F.lit(_ODD - 1)) + _ODD)
    late = late.withColumn(_SID, sid).drop(_LEAST).dropDuplicates([_SID])
    src = first.select(own.alias("doc_id"), text.alias("text")).unionByName(late.select(F.col(_SID).alias("doc_id"), text.alias("text")))
    gone = _gone(src, percent)
    return _without(first, own, gone).unionByName(_without(late, F.col(_SID), gone).drop(_SID))


#: Ids from here on stand for rows without an id of their own.
_ODD = 1 << 61
_SID, _LEAST, _GONE = "__graphloom_sid", "__graphloom_least", "__graphloom_gone"


def _gone(src: DataFrame, percent: int) -> DataFrame:
    others = saved(near_duplicates(src, percent=percent).where(~F.col("kept")).select(F.col("doc_id").alias(_GONE)).distinct())
    return F.broadcast(others) if others.count() <= BROADCAST_IDS else others.hint("shuffle_hash")


def _without(df: DataFrame, own, gone: DataFrame) -> DataFrame:
    return df.join(gone, own == F.col(_GONE), "left_anti")


#: The same rows by comparing all documents that share a shingle.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i+4], ' ') AS sh FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
link AS (
  SELECT u, v FROM (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2)
  JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM w UNION SELECT link.v, reach.r FROM reach JOIN link ON link.u = reach.doc_id)
SELECT w.doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(r) AS component_id, w.doc_id = min(r) AS kept
FROM w JOIN reach USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY w.doc_id
"""
