"""Ranked lexical search with Block-Max WAND over compressed posting blocks.

Documents are indexed in segments of bounded text. A segment's postings stand, term by term, in
blocks of at most 128: ordinals as gaps and frequencies, each in the least number of bytes, with
the block's first and last ordinal and its impacts (the pairs of frequency and document length
that no other pair of the block beats) outside of the compressed part. Once the corpus counts
are known the impacts give each block's maximum score.

A query keeps its ten best documents in a heap for each task. Within a segment it moves shallow
pointers only: the block bounds of its terms cut the ordinals into windows in which every term
stays in one block, and a window's bound is the sum of its blocks' maxima. The pivot is the next
window whose bound reaches the threshold; blocks of windows below it are never decompressed.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, saved

BLOCK = 128
#: Text bytes of a segment, and windows of at most so many ordinals scored at once.
SEGMENT_BYTES, STRIDE = 16 << 20, 1024
#: Query text that is handled, and shared with all tasks, at a time.
QUERY_BYTES = 16 << 20
#: Up to so many distinct terms of the queries only their postings are indexed.
MOST_TERMS = 1_000_000
_SPACES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """The text's maximal runs of letters, digits and other characters beyond ASCII; A-Z lower-cased."""
    return (text or "").encode("utf-8").translate(_SPACES).split()


def _packed(values: np.ndarray) -> tuple[int, bytes]:
    """Values in 1, 2, 4 or 8 bytes each."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or values.max() < 1 << 8 * w)
    return width, values.astype(f"<u{width}").tobytes()


class _Numbers(dict):
    def __missing__(self, term):
        self[term] = found = len(self)
        return found


def segment(ids: list, texts: list, only: frozenset | None = None) -> dict:
    """One segment of an index: documents by ascending id (null last), their lengths, and the posting blocks.

    With `only`, other terms count towards lengths alone.
    """
    order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0))
    numbers, lengths, codes = _Numbers(), [], []
    for k in order:
        own = terms(texts[k])
        lengths.append(len(own))
        hits = own if only is None else [t for t in own if t in only]
        codes.append(np.fromiter(map(numbers.__getitem__, hits), dtype=np.int64, count=len(hits)))
    n, size = np.array(lengths, dtype=np.int64), max(1, len(order))
    owner = np.repeat(np.arange(len(order)), [len(c) for c in codes])
    key, tf = np.unique((np.concatenate(codes) if codes else np.zeros(0, np.int64)) * size + owner, return_counts=True)
    term, doc = key // size, key % size
    df = np.bincount(term, minlength=len(numbers))
    place = np.arange(len(term)) - np.repeat(np.cumsum(df) - df, df)
    start = np.flatnonzero(place % BLOCK == 0)
    block = np.cumsum(place % BLOCK == 0) - 1
    end = np.append(start, len(term))[1:]
    gap = np.diff(doc, prepend=0)
    gap[start] = 0
    data, at, widths = [], [0], []
    for a, b in zip(start.tolist(), end.tolist(), strict=True):
        (gap_width, gaps), (tf_width, times) = _packed(gap[a:b]), _packed(tf[a:b])
        data.append(gaps + times)
        at.append(at[-1] + len(data[-1]))
        widths.append(gap_width * 16 + tf_width)
    # impacts: by falling frequency, the lengths that are shorter than all before; blocks are kept apart by steps
    rank = np.lexsort((n[doc], -tf, block))
    step = (n.max() if len(n) else 0) + 1
    shifted = n[doc[rank]] - block[rank] * step
    before = np.minimum.accumulate(np.concatenate([[step], shifted]))[:-1]
    best = rank[shifted < before] if len(rank) else rank
    return {
        "ids": [ids[k] for k in order],
        "lengths": n.tolist(),
        "terms": list(numbers),
        "df": df.tolist(),
        "first": doc[start].tolist(),
        "last": doc[end - 1].tolist() if len(start) else [],
        "size": (end - start).tolist(),
        "widths": widths,
        "offset": at,
        "data": b"".join(data),
        "impact_block": block[best].tolist(),
        "impact_tf": tf[best].tolist(),
        "impact_length": n[doc[best]].tolist(),
    }


_SEGMENT = (
    "ids array<long>, lengths array<long>, terms array<binary>, df array<long>, first array<int>, last array<int>, size array<int>, "
    "widths array<int>, offset array<long>, data binary, impact_block array<int>, impact_tf array<long>, impact_length array<long>"
)


def index_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", only: frozenset | None = None, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """A row for each segment, of at most segment_bytes of text or one document.

    `only` bounds the terms that get postings. Null and wordless texts have length 0 and no
    postings. Repeated rows are documents of their own. An empty table has no segments.
    """
    spark = df.sparkSession
    target = spark.createDataFrame([], _SEGMENT).schema
    shared = None if only is None else spark.sparkContext.broadcast(only)

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, mine = to_arrow_schema(target), None if shared is None else shared.value

        def row(ids, texts):
            made = segment(ids, texts, mine)
            return pa.RecordBatch.from_arrays([pa.array([made[f.name]], type=f.type) for f in arrow], schema=arrow)

        ids, texts, held = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0), batch.column(1), strict=True):
                t = t.as_py()
                if ids and held + len(t or "") > segment_bytes:
                    yield row(ids, texts)
                    ids, texts, held = [], [], 0
                ids.append(i.as_py())
                texts.append(t)
                held += len(t or "")
        if ids:
            yield row(ids, texts)

    return df.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_t")).mapInArrow(run, target)


class Corpus:
    """Counts of an index: documents with a term (N) and their terms with repeats (L)."""

    def __init__(self, documents: int, total: int):
        self.documents, self.total = documents, total

    def weight(self, df: int) -> int:
        return math.floor(1000 * math.log((2 * self.documents + 2) / (2 * df + 1)))

    def norms(self, lengths: np.ndarray) -> np.ndarray:
        """m of documents of these lengths."""
        if len(lengths) and int(lengths.max()) * 90 * self.documents >= 1 << 62:
            return np.array([10 + 90 * int(n) * self.documents // self.total for n in lengths], dtype=np.int64)
        return 10 + 90 * lengths * self.documents // max(1, self.total)


def _parts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Searcher:
    """Runs queries, each a list of terms with weights, over segments; keeps each one's k best documents."""

    def __init__(self, queries: list[list[tuple[bytes, int]]], corpus: Corpus, k: int):
        self.queries, self.corpus, self.k = queries, corpus, k
        self.heaps: list[list] = [[] for _ in queries]
        self.unpacked = self.blocks = 0

    def add(self, seg: dict) -> None:
        lengths = np.asarray(seg["lengths"], dtype=np.int64)
        self.m = self.corpus.norms(lengths)
        self.ids = seg["ids"]
        df = np.asarray(seg["df"], dtype=np.int64)
        count = -(-df // BLOCK)
        start = np.concatenate([[0], np.cumsum(count)])
        most = np.zeros(int(start[-1]), dtype=np.int64)
        np.maximum.at(most, np.asarray(seg["impact_block"], dtype=np.int64), _parts(np.asarray(seg["impact_tf"], dtype=np.int64), self.corpus.norms(np.asarray(seg["impact_length"], dtype=np.int64))))
        self.first, self.last = np.asarray(seg["first"], dtype=np.int64), np.asarray(seg["last"], dtype=np.int64)
        self.size, self.widths, self.offset, self.data = seg["size"], seg["widths"], seg["offset"], seg["data"]
        number = {t: k for k, t in enumerate(seg["terms"])}
        for query, heap in zip(self.queries, self.heaps, strict=True):
            own = [(number[t], w) for t, w in query if t in number and w > 0]
            if own:
                blocks = np.concatenate([np.arange(start[t], start[t + 1]) for t, _ in own])
                weight = np.repeat([w for _, w in own], [count[t] for t, _ in own])
                self._search(heap, blocks, weight, most[blocks] * weight)

    def _search(self, heap: list, blocks: np.ndarray, weight: np.ndarray, most: np.ndarray) -> None:
        first, last = self.first[blocks], self.last[blocks]
        self.blocks += len(blocks)
        # windows: within one, every term stays in one block
        edges = np.unique(np.concatenate([first, last + 1]))
        change = np.bincount(np.searchsorted(edges, first), weights=most, minlength=len(edges)) - np.bincount(np.searchsorted(edges, last + 1), weights=most, minlength=len(edges))
        bound = np.cumsum(change).astype(np.int64)  # whole numbers below 2**53
        at = 0
        while True:
            least = heap[0][0] if len(heap) == self.k else 1
            reach = np.flatnonzero(bound[at:-1] >= least)
            if not len(reach):
                return
            at += int(reach[0])  # the pivot window
            stop = at + 1
            while stop < len(edges) - 1 and bound[stop] >= least and edges[stop + 1] - edges[at] <= STRIDE:
                stop += 1
            low, high = int(edges[at]), int(edges[stop])
            use = np.flatnonzero((first < high) & (last >= low))
            score = np.zeros(high - low, dtype=np.int64)
            for b, w in zip(blocks[use].tolist(), weight[use].tolist(), strict=True):
                doc, tf = self._unpack(b)
                a, z = np.searchsorted(doc, (low, high))
                score[doc[a:z] - low] += w * _parts(tf[a:z], self.m[doc[a:z]])
            good = np.flatnonzero(score >= least)
            if len(good) > self.k:
                good = good[score[good] >= np.partition(score[good], -self.k)[-self.k]]
            for n in good.tolist():
                self._offer(heap, int(score[n]), self.ids[low + n])
            at = stop

    def _unpack(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        self.unpacked += 1
        n, gap_width, tf_width = self.size[b], self.widths[b] >> 4, self.widths[b] & 15
        at = self.offset[b]
        doc = np.cumsum(np.frombuffer(self.data, dtype=f"<u{gap_width}", count=n, offset=at).astype(np.int64)) + self.first[b]
        return doc, np.frombuffer(self.data, dtype=f"<u{tf_width}", count=n, offset=at + n * gap_width).astype(np.int64)

    def _offer(self, heap: list, score: int, doc: int | None) -> None:
        """Higher scores first, then smaller ids; null ids last."""
        entry = (score, -float("inf") if doc is None else -doc)
        if len(heap) < self.k:
            heapq.heappush(heap, entry)
        elif entry > heap[0]:
            heapq.heapreplace(heap, entry)

    def found(self) -> list[tuple[int, int | None, int]]:
        return [(q, None if low == -float("inf") else -low, score) for q, heap in enumerate(self.heaps) for score, low in heap]


def _counts(index: DataFrame) -> Corpus:
    row = index.agg(F.sum(F.size(F.filter("lengths", lambda n: n > 0))), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, n: a + n))).first()
    return Corpus(row[0] or 0, row[1] or 0)


def search(index: DataFrame, queries: DataFrame, k: int = 10, item_col: str = "item_id", text_col: str = "text", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of the index for each item.

    Rows that share an item id, null included, are one item with the terms of all of them. Items without
    terms, and those none of whose terms stands in the index, have no rows. Equal scores go by ascending
    doc_id, null last. Queries are handled in blocks of query_bytes of text, each against all segments.
    """
    spark = index.sparkSession
    corpus = _counts(index)
    parts = int((queries.agg(F.sum(F.octet_length(text_col))).first()[0] or 0) // query_bytes) + 1
    items = queries.select(F.col(item_col).cast("long").alias("_q"), F.col(text_col).alias("_t")).where("_t IS NOT NULL")
    out = [_search_block(index, items.where(F.pmod(F.xxhash64("_q"), F.lit(parts)) == n), corpus, k) for n in range(parts)]
    best = saved(_union(out))
    salts = max(1, int(best.count() ** 0.5) // k)
    once = _ranked(best.withColumn("salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(salts))), k, "item_id", "salt")
    return _ranked(once.drop("rank"), k, "item_id").select("item_id", "rank", "doc_id", "score")


def _ranked(found: DataFrame, k: int, *by: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for other in frames[1:]:
        out = out.unionByName(other)
    return out


def _search_block(index: DataFrame, items: DataFrame, corpus: Corpus, k: int) -> DataFrame:
    """The k best documents of each task for a block of items of bounded size."""
    own: dict = defaultdict(dict)
    for r in items.collect():
        own[r["_q"]].update(dict.fromkeys(terms(r["_t"])))
    names = list(own)
    spark = index.sparkSession
    wanted = spark.createDataFrame([(bytearray(t),) for t in {t for q in own.values() for t in q}], "term binary")
    pairs = index.select(F.explode(F.arrays_zip("terms", "df")).alias("p")).select(F.col("p.terms").alias("term"), F.col("p.df").alias("df"))
    df = {bytes(r["term"]): r["df"] for r in pairs.join(F.broadcast(wanted), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df")).collect()}
    shared = spark.sparkContext.broadcast((names, [[(t, corpus.weight(df[t])) for t in own[q] if t in df] for q in names]))

    def run(batches):
        import pyarrow as pa

        names, queries = shared.value
        searcher = Searcher(queries, corpus, k)
        for batch in batches:
            for at in range(batch.num_rows):
                searcher.add({name: batch.column(name)[at].as_py() for name in batch.schema.names})
        found = searcher.found()
        yield pa.RecordBatch.from_arrays(
            [pa.array([names[q] for q, _, _ in found], pa.int64()), pa.array([d for _, d, _ in found], pa.int64()), pa.array([s for _, _, s in found], pa.int64())], ["item_id", "doc_id", "score"]
        )

    return index.mapInArrow(run, "item_id long, doc_id long, score long")


def query_terms(queries: DataFrame, text_col: str = "text", most: int = MOST_TERMS) -> frozenset | None:
    """The distinct terms of the queries where they are at most `most`, else None (index all terms)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(sorted({t for x in batch.column(0).to_pylist() for t in terms(x)}), pa.binary())], ["term"])

    found = queries.select(text_col).mapInArrow(run, "term binary").distinct().limit(most + 1).collect()
    return None if len(found) > most else frozenset(bytes(r["term"]) for r in found)


def search_documents(df: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text") -> DataFrame:
    """Index df for the queries' terms, written once, and search it: see index_documents and search."""
    index = saved(index_documents(df, id_col, text_col, query_terms(queries, query_col)))
    out = saved(search(index, queries, k, item_col, query_col))
    forget(index)
    return out


#: The same rows by scoring every document that shares a term.
ORACLE = r"""
WITH low AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
size AS (SELECT count(*) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS total FROM low WHERE len(ts) > 0),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
f AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(ts) AS n, unnest(ts) AS t FROM low) WHERE t IN (SELECT t FROM q) GROUP BY doc_id, n, t),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * any_value(n_docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM f, size GROUP BY t),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // total)))) AS BIGINT) AS score FROM q JOIN f USING (t) JOIN w USING (t), size GROUP BY item_id, doc_id)
SELECT item_id, CAST(r AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM s WHERE score > 0) WHERE r <= 10
"""
