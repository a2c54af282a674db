"""Language-model scores by deleted interpolation.

Maximum-likelihood estimates of n-grams of every order are mixed; the mixture weights depend on
the bucket of the longest context that was seen (its order and the power of two of its
frequency) and are learned by expectation-maximisation on a deleted tenth of the training rows,
against counts of the other ones. Scores then use the counts of all training rows.

Texts are cut into batches of whole documents. A batch asks for the counts of its distinct
n-grams once: keys of 64 bits are dealt to buckets, packed by batch, counted there and answered
in the order in which they came. So a frequent n-gram costs one key for each batch, never a row for each
occurrence, and no table of counts is gathered anywhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, mix64, saved, text_bytes

ORDER = 2
#: Text bytes of a batch and, about, of the keys of a bucket.
BATCH_BYTES, BUCKET_BYTES = 8 << 20, 16 << 20
SCORED, DELETED, KEPT = 0, 1, 2
_END, _START = xxhash.xxh3_64_intdigest(b""), xxhash.xxh3_64_intdigest(b" ")
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LEVEL = 64


class _Numbers(dict):
    def __missing__(self, word):
        self[word] = found = len(self)
        return found


class Batch:
    """Token numbers of some documents: each document is its words and an end."""

    def __init__(self, ids: list, roles: list, tokens: np.ndarray, size: np.ndarray, words: np.ndarray):
        self.ids, self.roles, self.tokens, self.size, self.words = ids, roles, tokens, size, words

    @classmethod
    def of(cls, ids: list, roles: list, texts: list) -> Batch:
        numbers, parts = _Numbers(), []
        for text in texts:
            own = (text or "").encode("utf-8").lower().split()  # bytes: A-Z only, and ASCII space only
            own.append(b"")
            parts.append(np.fromiter(map(numbers.__getitem__, own), dtype=np.int32, count=len(own)))
        words = np.fromiter(map(xxhash.xxh3_64_intdigest, numbers), dtype=np.uint64, count=len(numbers))
        return cls(ids, roles, np.concatenate(parts), np.array([len(p) for p in parts], dtype=np.int64), words)

    def pack(self) -> bytes:
        return zstandard.ZstdCompressor(level=1).compress(
            np.array([len(self.size), len(self.words)], dtype=np.int64).tobytes() + self.size.tobytes() + self.words.tobytes() + self.tokens.astype(np.int32).tobytes()
        )

    @classmethod
    def unpack(cls, ids: list, roles: list, data: bytes) -> Batch:
        raw = zstandard.ZstdDecompressor().decompress(data)
        docs, words = np.frombuffer(raw, dtype=np.int64, count=2).tolist()
        size = np.frombuffer(raw, dtype=np.int64, count=docs, offset=16)
        own = np.frombuffer(raw, dtype=np.uint64, count=words, offset=16 + 8 * docs)
        return cls(ids, roles, np.frombuffer(raw, dtype=np.int32, offset=16 + 8 * (docs + words)), size, own)

    def grams(self, order: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each order from 1: distinct 64-bit keys, the number of the key at each token, and counts.

        A document's first tokens have starts before them, of which the one-token key is last.
        """
        first = np.cumsum(self.size) - self.size
        place = np.arange(len(self.tokens)) - np.repeat(first, self.size)
        count = np.bincount(self.tokens, minlength=len(self.words))
        out = [(np.append(self.words, np.uint64(_START)), self.tokens.astype(np.int64), np.append(count, len(self.size)))]
        own, before = self.tokens.astype(np.int64), len(self.words)
        with np.errstate(over="ignore"):
            for n in range(2, order + 1):
                # a key of n tokens: the n-1 tokens before it are the key of one place earlier
                shorter = np.roll(own, 1)
                shorter[place == 0] = before  # no key of that order ends there: n-1 starts
                pair, index = np.unique(shorter * len(self.words) + self.tokens, return_inverse=True)
                parent, word = pair // len(self.words), pair % len(self.words)
                starts = mix64(np.array([_START + n], dtype=np.uint64)) if n > 2 else np.array([_START], dtype=np.uint64)
                keys = np.concatenate([out[-1][0][: before], starts])
                made = mix64(keys[parent] * _STEP + self.words[word] + np.uint64(n))
                # the context of n-1 starts is counted by documents, as the one start is
                out.append((np.append(made, mix64(np.array([_START + n + 1], dtype=np.uint64))), index.astype(np.int64), np.append(np.bincount(index, minlength=len(pair)), len(self.size))))
                own, before = index.astype(np.int64), len(pair)
        return out


def roles(id_col: str):
    """0 for rows that are only scored, 1 for the deleted tenth of training rows, 2 for the others.

    Rows whose crc32 of the id as text is 0 modulo 10, and rows without an id, are not learned from.
    """
    rest = F.crc32(F.col(id_col).cast("string").cast("binary")) % 10
    return F.when(rest == 1, DELETED).when(rest.isNull() | (rest == 0), SCORED).otherwise(KEPT)


def _batches(columns, limit: int):
    """Batches of whole documents from Arrow batches of (id, role, text): about `limit` bytes of text, one role each."""
    held: dict[int, tuple] = {}
    for batch in columns:
        for i, role, text in zip(*batch.columns, strict=True):
            role, text = role.as_py(), text.as_py()
            ids, texts, size = held.get(role, ([], [], 0))
            ids.append(i.as_py())
            texts.append(text)
            held[role] = (ids, texts, size + len(text or ""))
            if held[role][2] >= limit:
                yield Batch.of(ids, [role] * len(ids), texts)
                del held[role]
    for role, (ids, texts, _) in sorted(held.items()):
        yield Batch.of(ids, [role] * len(ids), texts)


def _name(batch: Batch) -> bytes:
    """The same for equal batches, in whatever task they are made."""
    state = xxhash.xxh3_128()
    for part in (batch.words, batch.tokens, batch.size, np.array(batch.roles[:1])):
        state.update(part.tobytes())
    state.update(repr(batch.ids).encode())
    return state.digest()


def _dealt(batch: Batch, order: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all orders and their counts, sorted by bucket, with the buckets and the order of sorting."""
    grams = batch.grams(order)
    keys, counts = np.concatenate([g[0] for g in grams]), np.concatenate([g[2] for g in grams])
    bucket = (mix64(keys ^ _STEP) % np.uint64(buckets)).astype(np.int64)
    rank = np.argsort(bucket, kind="stable")  # one-token keys stay in front within a bucket
    return keys[rank], counts[rank], bucket[rank], rank


def _thin(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.astype(np.uint64).tobytes() if len(values) and values.max() >= 1 << 32 else values.astype(np.uint32).tobytes())


def _thick(data: bytes, count: int) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data) if count else b""
    return np.frombuffer(raw, dtype=np.uint64 if len(raw) == 8 * count else np.uint32).astype(np.int64)


def _requests(src: DataFrame, order: int, buckets: int, limit: int) -> DataFrame:
    def run(columns):
        for batch in _batches(columns, limit):
            keys, counts, bucket, rank = _dealt(batch, order, buckets)
            used, at = np.unique(bucket, return_index=True)
            end = np.append(at[1:], len(keys))
            single = np.add.reduceat((rank <= len(batch.words)).astype(np.int64), at)  # words and the start stand in front
            role, name = batch.roles[0], _name(batch)
            yield pa.RecordBatch.from_pydict(
                {
                    "bucket": pa.array(used, pa.int64()),
                    "batch": pa.array([name] * len(used), pa.binary()),
                    "role": pa.array([role] * len(used), pa.int32()),
                    "single": pa.array(single, pa.int64()),
                    "keys": pa.array([keys[a:z].tobytes() for a, z in zip(at, end, strict=True)], pa.binary()),
                    "counts": pa.array([_thin(counts[a:z]) if role != SCORED else b"" for a, z in zip(at, end, strict=True)], pa.binary()),
                }
            )

    return src.mapInArrow(run, "bucket long, batch binary, role int, single long, keys binary, counts binary")


_ANSWER = "batch binary, role int, bucket long, kept binary, whole binary, n_kept long, n_whole long, v_kept long, v_whole long"


def _answer(table: pa.Table) -> pa.Table:
    """One bucket: counts of its keys over kept and over all training rows, for each asking batch, and its totals of words."""
    role, single = np.array(table.column("role")), np.array(table.column("single"))
    keys = [np.frombuffer(k.as_py(), dtype=np.uint64) for k in table.column("keys")]
    counts = [np.zeros(len(k), np.int64) if r == SCORED else _thick(c.as_py(), len(k)) for k, c, r in zip(keys, table.column("counts"), role, strict=True)]
    size = np.array([len(k) for k in keys])
    distinct, index = np.unique(np.concatenate(keys), return_inverse=True)
    counts = np.concatenate(counts)
    of = np.repeat(role, size)
    total = np.zeros((2, len(distinct)), dtype=np.int64)
    np.add.at(total[0], index[of == KEPT], counts[of == KEPT])
    np.add.at(total[1], index, counts)
    word = np.zeros(len(distinct), dtype=bool)
    start = np.cumsum(size) - size
    word[index[np.arange(len(index)) - np.repeat(start, size) < np.repeat(single, size)]] = True
    word[distinct == np.uint64(_START)] = False
    n, v = total[:, word].sum(axis=1), (total[:, word] > 0).sum(axis=1)
    rows = {name: [] for name in ("batch", "role", "bucket", "kept", "whole", "n_kept", "n_whole", "v_kept", "v_whole")}
    bucket = table.column("bucket")[0].as_py()
    for k, (name, r) in enumerate(zip(table.column("batch").to_pylist(), role.tolist(), strict=True)):
        own = index[start[k] : start[k] + size[k]]
        first = k == 0
        for column, value in zip(rows, (name, r, bucket, _thin(total[0][own]) if r == DELETED else None, _thin(total[1][own]), *((n[0], n[1], v[0], v[1]) if first else (0, 0, 0, 0))), strict=True):
            rows[column].append(value)
    kinds = [pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    return pa.table({c: pa.array([int(x) for x in v] if t == pa.int64() else v, t) for (c, v), t in zip(rows.items(), kinds, strict=True)})


def _packed_batches(src: DataFrame, limit: int) -> DataFrame:
    def run(columns):
        for batch in _batches(columns, limit):
            yield pa.RecordBatch.from_pydict(
                {
                    "batch": pa.array([_name(batch)], pa.binary()),
                    "ids": pa.array([batch.ids], pa.list_(pa.int64())),
                    "role": pa.array(batch.roles[:1], pa.int32()),
                    "data": pa.array([batch.pack()], pa.binary()),
                }
            )

    return src.mapInArrow(run, "batch binary, ids array<long>, role int, data binary")


def _answered(batch: Batch, order: int, buckets: int, answers: pa.Table, column: str) -> list[np.ndarray]:
    """The counts at each token of its keys of order 1 and up, and of their contexts: [words, pairs, ...], one row each."""
    keys, _, bucket, rank = _dealt(batch, order, buckets)
    found = dict(zip(answers.column("bucket").to_pylist(), answers.column(column), strict=True))
    used, size = np.unique(bucket, return_counts=True)
    missing = [b for b in used.tolist() if b not in found]
    if missing:
        raise RuntimeError("a batch has no counts: the rows of the input changed between two scans; write the input as a table first")
    flat = np.zeros(len(keys), dtype=np.int64)
    flat[rank] = np.concatenate([_thick(found[b].as_py(), n) for b, n in zip(used.tolist(), size.tolist(), strict=True)])
    out, at = [], 0
    for keys, index, _ in batch.grams(order):
        own = flat[at : at + len(keys)]
        out.append((own[index], own[-1]))
        at += len(keys)
    return out


def _levels(batch: Batch, counts: list, n: int, v: int) -> tuple[np.ndarray, np.ndarray]:
    """The context bucket of each token, and the estimates of each order from 0 (uniform) up."""
    first = np.cumsum(batch.size) - batch.size
    start = np.zeros(len(batch.tokens), dtype=bool)
    start[first] = True
    estimate = [np.full(len(batch.tokens), 1.0 / (v + 1)), counts[0][0] / max(n, 1)]
    bucket = np.zeros(len(batch.tokens), dtype=np.int64)
    for k in range(1, len(counts)):
        context = np.roll(counts[k - 1][0], 1)
        context[start] = counts[k - 1][1]
        estimate.append(np.where(context > 0, counts[k][0] / np.maximum(context, 1), 0.0))
        bucket = np.where(context > 0, _LEVEL * k + np.floor(np.log2(np.maximum(context, 1))).astype(np.int64), bucket)
    return bucket, np.array(estimate)


def _events(batches: DataFrame, answers: DataFrame, order: int, buckets: int, n: int, v: int) -> DataFrame:
    """(bucket, p0, p1, ..., n): how often deleted rows have these estimates, from kept counts."""
    names = [f"p{k}" for k in range(order + 1)]

    def run(_, left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for k in range(left.num_rows):
            batch = Batch.unpack(left.column("ids")[k].as_py(), [DELETED], left.column("data")[k].as_py())
            bucket, estimate = _levels(batch, _answered(batch, order, buckets, right, "kept"), n, v)
            rows.append(np.vstack([bucket[None, :].astype(np.float64), estimate]))
        every, count = np.unique(np.concatenate(rows, axis=1), axis=1, return_counts=True) if rows else (np.zeros((order + 2, 0)), np.zeros(0, np.int64))
        return pa.table({"bucket": every[0].astype(np.int32), **dict(zip(names, every[1:], strict=True)), "n": count.astype(np.int64)})

    schema = "bucket int, " + ", ".join(f"{x} double" for x in names) + ", n long"
    some = answers.where(F.col("role") == DELETED).select("batch", "bucket", "kept").groupBy("batch")
    return batches.groupBy("batch").cogroup(some).applyInArrow(run, schema)


class Mixture:
    """weights[bucket]: for orders 0 and up; buckets without deleted rows take their level's pooled weights."""

    def __init__(self, order: int, weights: dict[int, list[float]], pooled: dict[int, list[float]]):
        self.order, self.weights, self.pooled = order, weights, pooled

    def table(self) -> np.ndarray:
        out = np.zeros((_LEVEL * self.order, self.order + 1))
        for b in range(len(out)):
            level = b // _LEVEL
            out[b] = self.weights.get(b) or self.pooled.get(level) or _even(level, self.order)
        return out


def _even(level: int, order: int) -> list[float]:
    """The same weight for every order that a context of this level can give."""
    return [1 / (level + 2) if k <= level + 1 else 0.0 for k in range(order + 1)]


def learn(events: DataFrame, order: int, rounds: int = 20, tolerance: float = 1e-5) -> Mixture:
    """Expectation-maximisation over the events: a bucket's new weights are the mean shares of the orders in its events.

    One event spread evenly is added to each bucket, so that no order's weight is zero. Rounds end when
    the log-likelihood of the events gains less than `tolerance` of itself.
    """
    spark = events.sparkSession
    seen = [r["bucket"] for r in events.select("bucket").distinct().collect()]  # at most 64 for each order
    weights = {b: _even(b // _LEVEL, order) for b in seen}
    before, sums = None, {}
    for _ in range(rounds if seen else 0):
        given = spark.createDataFrame([(b, *w) for b, w in weights.items()], "bucket int, " + ", ".join(f"w{k} double" for k in range(order + 1)))
        share = [F.col(f"w{k}") * F.col(f"p{k}") for k in range(order + 1)]
        p = sum(share[1:], share[0])
        found = events.join(F.broadcast(given), "bucket").groupBy("bucket").agg(F.sum("n"), F.sum(F.col("n") * F.log(p)), *[F.sum(F.col("n") * s / p) for s in share]).collect()
        sums = {r[0]: (r[1], list(r[3:])) for r in found}
        weights = {b: [(x + e) / (n + 1) for x, e in zip(part, _even(b // _LEVEL, order), strict=True)] for b, (n, part) in sums.items()}
        now = sum(r[2] for r in found)
        if before is not None and now - before <= tolerance * abs(before):
            break
        before = now
    pooled = {}
    for level in {b // _LEVEL for b in sums}:
        own = [x for b, x in sums.items() if b // _LEVEL == level]
        n = sum(x[0] for x in own)
        pooled[level] = [(sum(x[1][k] for x in own) + e) / (n + 1) for k, e in enumerate(_even(level, order))]
    return Mixture(order, weights, pooled)


def score_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, rounds: int = 20, batch_bytes: int = BATCH_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of df.

    Learned from all rows with an id whose crc32 is not 0 modulo 10; those with 0 are held out. A null
    or empty text is one end token. Repeated rows count as often as they stand. Without training rows
    every estimate is the uniform one. A row without an id is scored, not learned from, and not held out.
    Other columns are not read; an empty table gives no rows. Words whose 64-bit hashes are equal count
    as one word. df is scanned three times and must give the same rows in the same parts each time, as a table of
    files does; otherwise the run ends with an error.
    """
    spark = df.sparkSession
    src = df.select(F.col(id_col).cast("long").alias("doc_id"), roles(id_col).alias("role"), F.col(text_col).alias("text"))
    buckets = max(1, text_bytes(df, text_col) // bucket_bytes)
    answers = saved(_requests(src, order, buckets, batch_bytes).groupBy("bucket").applyInArrow(_answer, _ANSWER))
    n_kept, n_whole, v_kept, v_whole = (x or 0 for x in answers.agg(*[F.sum(c) for c in ("n_kept", "n_whole", "v_kept", "v_whole")]).first())
    batches = _packed_batches(src, batch_bytes)
    events = saved(_events(batches.where(F.col("role") == DELETED), answers, order, buckets, n_kept, v_kept))
    shared = spark.sparkContext.broadcast(learn(events, order, rounds).table())
    forget(events)

    def run(_, left: pa.Table, right: pa.Table) -> pa.Table:
        out = {c: [] for c in ("doc_id", "held", "n_tokens", "n_known", "base_score", "score")}
        for k in range(left.num_rows):
            batch = Batch.unpack(left.column("ids")[k].as_py(), [], left.column("data")[k].as_py())
            counts = _answered(batch, order, buckets, right, "whole")
            bucket, estimate = _levels(batch, counts, n_whole, v_whole)
            known = counts[0][0]
            base = np.log10((known + 0.1) / (n_whole + 0.1 * (v_whole + 1)))
            score = np.log10((shared.value[bucket] * estimate.T).sum(axis=1))
            first = np.cumsum(batch.size) - batch.size
            out["doc_id"] += batch.ids
            out["held"] += [left.column("role")[k].as_py() == SCORED] * len(batch.ids)
            out["n_tokens"] += batch.size.tolist()
            out["n_known"] += np.add.reduceat((known > 0).astype(np.int64), first).tolist()
            out["base_score"] += np.add.reduceat(base, first).tolist()
            out["score"] += np.add.reduceat(score, first).tolist()
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.table({c: pa.array(v, t) for (c, v), t in zip(out.items(), kinds, strict=True)})

    some = answers.select("batch", "bucket", "whole").groupBy("batch")
    scored = batches.groupBy("batch").cogroup(some).applyInArrow(run, "doc_id long, held boolean, n_tokens long, n_known long, base_score double, score double")
    held = F.col("held") & F.col("doc_id").isNotNull()
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(n_whole).cast("long").alias("train_tokens"), "base_score", "score")
