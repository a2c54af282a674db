"""Vector code compression: integer product codes, nearest entries found in vantage-point trees.

Vectors are scaled to integers and cut into equal parts; each part position has a codebook of
at most 256 entries. Every round builds one vantage-point tree for each part position on the
driver (a codebook is small), and tasks search the trees for whole batches of parts: a child is
visited unless the triangle inequality, with radii rounded away from the ball, shows that
nothing in it is as near as the best entry so far. Bounds that are equal are visited, since an
equally near entry with a lower index wins, and all comparisons are of integers. A round sends
sums and counts of each task, not vectors.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, saved

#: Integer components beyond this could overflow sums of squares or of many rows.
MOST = 1 << 24
LEAF = 16
_FAR = np.iinfo(np.int64).max


def _down(x):
    return np.nextafter(x, -np.inf)


def _up(x):
    return np.nextafter(x, np.inf)


class VantageTree:
    """Exact nearest entries (squared Euclidean distance, ties to the lower index) of integer points."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.leaf = np.asarray(points, dtype=np.int64), leaf
        self.doubles = self.points.astype(np.float64)
        self.norms = (self.doubles * self.doubles).sum(axis=1)
        self.seen, self.exact = 0, False
        self.root = self._build(np.arange(len(self.points)))

    def _build(self, own: np.ndarray):
        if len(own) <= self.leaf:
            return own
        spread = ((self.points[own] - self.points[own].mean(axis=0)) ** 2).sum(axis=1)
        at = int(np.argmax(spread))
        vantage, rest = own[at], np.delete(own, at)
        square = ((self.points[rest] - self.points[vantage]) ** 2).sum(axis=1)
        order = np.argsort(square, kind="stable")
        half = (len(rest) + 1) // 2
        sides = []
        for pick in (order[:half], order[half:]):
            radius = np.sqrt(square[pick].astype(np.float64))
            sides.append((max(0.0, float(_down(radius.min()))), float(_up(radius.max())), self._build(np.sort(rest[pick]))))
        return vantage, sides

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of each row of queries."""
        self.index, self.best = np.zeros(len(queries), dtype=np.int64), np.full(len(queries), _FAR)
        if len(queries):
            most = max(int(np.abs(queries).max(initial=0)), int(np.abs(self.points).max(initial=0)))
            self.exact = 4 * most * most * max(1, queries.shape[1]) < 1 << 53
            self._visit(self.root, queries, np.arange(len(queries)))
        return self.index, self.best

    def _squares(self, queries: np.ndarray, entries: np.ndarray) -> np.ndarray:
        """Squared distances, whole numbers; products of doubles while all sums stay below 2**53."""
        points = self.points[entries]
        if self.exact:
            own = queries.astype(np.float64)
            return ((own * own).sum(axis=1)[:, None] - 2 * (own @ self.doubles[entries].T) + self.norms[entries][None, :]).astype(np.int64)
        gap = queries[:, None, :] - points[None, :, :]
        return (gap * gap).sum(axis=2)

    def _offer(self, rows: np.ndarray, index, square: np.ndarray) -> None:
        better = (square < self.best[rows]) | ((square == self.best[rows]) & (index < self.index[rows]))
        self.best[rows] = np.where(better, square, self.best[rows])
        self.index[rows] = np.where(better, index, self.index[rows])

    def _visit(self, node, queries: np.ndarray, rows: np.ndarray) -> None:
        if isinstance(node, np.ndarray):
            self.seen += len(rows) * len(node)
            square = self._squares(queries[rows], node)
            pick = square.argmin(axis=1)  # the first of equal ones, and node is ascending
            self._offer(rows, node[pick], square[np.arange(len(rows)), pick])
            return
        vantage, sides = node
        self.seen += len(rows)
        square = self._squares(queries[rows], np.array([vantage]))[:, 0]
        self._offer(rows, vantage, square)
        away = np.sqrt(square.astype(np.float64))
        low, high = _down(away), _up(away)
        bounds = [_down(np.maximum(inner - high, low - outer)) for inner, outer, _ in sides]
        first = bounds[0] <= bounds[1]
        for later in (False, True):
            for side in (0, 1):
                turn = (first if side == 0 else ~first) ^ later
                turn &= bounds[side] <= _up(np.sqrt(self.best[rows].astype(np.float64)))
                if turn.any():
                    self._visit(sides[side][2], queries, rows[turn])


class Codebooks:
    """entries[part]: integer points, at most 256 for each part position."""

    def __init__(self, entries: list[np.ndarray]):
        self.entries = entries

    def sha256(self) -> str:
        """Of the entries' decimal components by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(x) for part in self.entries for x in part.ravel().tolist()).encode()).hexdigest()


def _kept(df: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    fine = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return df.where(F.col(vector_col).isNotNull() & fine).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("_label"), whole.alias("_v"))


def _checked_size(kept: DataFrame, parts: int) -> int:
    """The vectors' common length; an error where lengths differ, do not split evenly or hold components beyond MOST."""
    span = F.greatest(F.coalesce(F.array_max("_v"), F.lit(0)), -F.coalesce(F.array_min("_v"), F.lit(0)))
    least, most, peak = kept.agg(F.min(F.size("_v")), F.max(F.size("_v")), F.max(span)).first()
    if least != most:
        raise ValueError(f"vectors have from {least} to {most} components")
    if (least or 0) % parts:
        raise ValueError(f"{least} components do not make {parts} equal parts")
    if (peak or 0) > MOST:
        raise ValueError(f"a scaled component is beyond {MOST}")
    return least or 0


def _parts(vectors, parts: int) -> list[np.ndarray]:
    """Lists, or an Arrow column of lists of one length, as one table of integers for each part position."""
    if isinstance(vectors, list):
        flat = np.array(vectors, dtype=np.int64)
    else:
        flat = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)
    return np.split(flat, parts, axis=1)


def _first_entries(kept: DataFrame, entries: int, parts: int) -> Codebooks:
    """The vectors of the smallest ids; each task names its own candidates, as many as there are entries."""

    def run(batches):
        import pyarrow as pa

        least: dict[int, list] = {}
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if i not in least or v < least[i]:
                    least[i] = v
            least = {i: least[i] for i in sorted(least)[:entries]}
        yield pa.RecordBatch.from_arrays([pa.array(list(least), pa.int64()), pa.array(list(least.values()), pa.list_(pa.int64()))], ["vec_id", "_v"])

    mine = kept.where("vec_id IS NOT NULL").select("vec_id", "_v").mapInArrow(run, "vec_id long, _v array<long>")
    rows = mine.groupBy("vec_id").agg(F.min("_v").alias("_v")).orderBy("vec_id").limit(entries).collect()
    return Codebooks(_parts([r["_v"] for r in rows], parts) if rows else [])


def _sums(kept: DataFrame, books: Codebooks, parts: int) -> np.ndarray:
    """Component sums and, last, counts for each part position and entry."""
    shared = kept.sparkSession.sparkContext.broadcast(books.entries)  # at most parts * 256 entries
    size, width = len(books.entries[0]), books.entries[0].shape[1]

    def run(batches):
        import pyarrow as pa

        trees = [VantageTree(e) for e in shared.value]
        total = np.zeros((parts, size, width + 1), dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                for p, own in enumerate(_parts(batch.column(0).slice(at, 8192), parts)):
                    index, _ = trees[p].nearest(own)
                    np.add.at(total[p], index, np.column_stack([own, np.ones(len(own), dtype=np.int64)]))
        flat = total.ravel()
        used = np.flatnonzero(np.repeat(total[:, :, -1].ravel() > 0, width + 1))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(flat[used])], ["slot", "total"])

    found = kept.select("_v").mapInArrow(run, "slot long, total long").groupBy("slot").agg(F.sum("total").alias("total")).toArrow()
    out = np.zeros(parts * size * (width + 1), dtype=np.int64)
    out[found.column("slot").to_numpy()] = found.column("total").to_numpy()
    return out.reshape(parts, size, width + 1)


def fit(kept: DataFrame, parts: int, entries: int, rounds: int) -> Codebooks:
    """Codebooks of a table of (vec_id, _v): the smallest ids' parts, then rounds of floored means."""
    _checked_size(kept, parts)
    books = _first_entries(kept, entries, parts)
    for _ in range(rounds if books.entries else 0):
        total = _sums(kept, books, parts)
        books = Codebooks([np.where(t[:, -1:] > 0, t[:, :-1] // np.maximum(t[:, -1:], 1), e) for t, e in zip(total, books.entries, strict=True)])
    return books


def encode(kept: DataFrame, books: Codebooks, parts: int) -> DataFrame:
    """vec_id, _label, code and error of each row of a table of (vec_id, _label, _v)."""
    shared = kept.sparkSession.sparkContext.broadcast(books.entries)

    def run(batches):
        import pyarrow as pa

        trees = [VantageTree(e) for e in shared.value]
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                some = batch.slice(at, 8192)
                n = some.num_rows
                found = [trees[p].nearest(own) for p, own in enumerate(_parts(some.column(1), parts))] if trees else []
                index = np.column_stack([i for i, _ in found]).astype(np.uint8) if found else None
                codes = pa.array([row.tobytes().hex() for row in index], pa.string()) if found else pa.nulls(n, pa.string())
                error = pa.array(sum(e for _, e in found), pa.int64()) if found else pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays([some.column(0), codes, error, some.column(2)], ["vec_id", "code", "error", "label"])

    rows = kept.select("vec_id", "_v", F.col("_label").cast("string").alias("_label")).mapInArrow(run, "vec_id long, code string, error long, label string")
    return rows.select("vec_id", F.col("label").alias("_label"), "code", "error")


def compress_vectors(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024
) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for each row whose vector is whole and finite.

    Rows with a null vector or with null or non-finite components are dropped. A row with a null
    id is coded but starts no entry; ids that repeat start one, from the least of their vectors,
    and each of their rows counts in the means. With fewer ids than entries the codebooks are
    shorter; without any id code and error are null. Null labels sum together. Empty vectors have
    the code of entry 0 and no error; an empty table gives no rows. Vectors of unequal length, or of one
    that parts do not divide, and components beyond 2**24 after scaling are an error. Other columns are not read.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte for each part")
    kept = saved(_kept(df, id_col, vector_col, label_col, scale))
    books = fit(kept, parts, entries, rounds)
    coded = saved(encode(kept, books, parts))
    forget(kept)
    # written first, so that a label of many rows can be split in the join
    sums = saved(coded.groupBy("_label").agg(F.sum("error").alias("label_error")).withColumnRenamed("_label", "_of"))
    out = coded.join(sums, F.col("_label").eqNullSafe(F.col("_of")), "left")
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def _oracle(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """The same rows by comparing every part with every entry."""
    ctes = [
        "k AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings "
        "WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"p AS MATERIALIZED (SELECT r, part, v[part * (len(v) // {parts}) + 1 : (part + 1) * (len(v) // {parts})] AS v FROM k, range({parts}) t(part))",
        f"first AS (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM (SELECT vec_id, arg_min(r, v) AS r FROM k WHERE vec_id IS NOT NULL GROUP BY vec_id) ORDER BY vec_id LIMIT {entries})",
        "b0 AS MATERIALIZED (SELECT part, e, v AS c FROM p JOIN first USING (r))",
    ]
    for n in range(rounds + 1):
        ctes.append(
            f"a{n} AS MATERIALIZED (SELECT r, part, min({{'d': CAST(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), 'e': e}}) AS m FROM p JOIN b{n} USING (part) GROUP BY r, part)"
        )
        if n < rounds:
            ctes += [
                f"s{n} AS (SELECT part, a{n}.m.e AS e, i, CAST(sum(p.v[i]) AS BIGINT) AS s, count(*) AS n FROM a{n} JOIN p USING (r, part), LATERAL (SELECT unnest(range(1, len(p.v) + 1)) AS i) GROUP BY ALL)",
                f"b{n + 1} AS MATERIALIZED (SELECT b.part, b.e, coalesce(list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) FILTER (i IS NOT NULL), any_value(b.c)) AS c FROM b{n} b LEFT JOIN s{n} s ON s.part = b.part AND s.e = b.e GROUP BY b.part, b.e)",
            ]
    ctes += [
        f"o AS (SELECT r, string_agg(printf('%02x', a.m.e), '' ORDER BY part) AS code, CAST(sum(a.m.d) AS BIGINT) AS error FROM a{rounds} a GROUP BY r)",
        f"h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, e)) AS h FROM b{rounds})",
    ]
    return (
        "WITH " + ",\n".join(ctes) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT h FROM h) AS codebooks_sha256 FROM k JOIN o USING (r)"
    )


ORACLE = _oracle()
