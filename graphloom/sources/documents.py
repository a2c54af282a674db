"""JSON documents that stand one after another in files, whatever their line breaks.

A file is read as lines, in as many tasks as it has splits. A JSON text cannot hold a line break
within a string, so what a line does to the depth of brackets does not depend on the lines
before it. One pass finds for each split how it changes the depth; with the depths at which splits begin a
second pass cuts each split into the documents that begin or go on in it, and pieces of one document meet by its number.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import written

_MARK = re.compile(r'"(?:[^"\\]|\\.)*"?|[\[{]|[\]}]|[^\s\[\]{}"]+')
#: The last document of a split, which may go on in the next.
_OPEN = 1 << 40
#: Splits of all files; their depths are summed on the driver, which also lists the files.
MOST_SPLITS = 1_000_000
#: Characters of lines that are looked at together, and of documents that are passed on together.
CHUNK = 4 << 20


def _brackets(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Where brackets stand outside of strings in a text's UTF-8, and 1 or -1 for each; None if a string is not closed in its line or a backslash stands outside."""
    plain = text.replace("\\\\", "\1\1").replace('\\"', "\1\1") if "\\" in text else text
    b = np.frombuffer(plain.encode(), np.uint8)
    quotes = np.flatnonzero(b == 34)
    inside = lambda at: np.searchsorted(quotes, at) & 1
    if len(quotes) & 1 or inside(np.flatnonzero(b == 10)).any() or not inside(np.flatnonzero((b == 92) | (b == 1))).all():
        return None
    c = b | 32  # [ and { are one then, ] and } too
    at = np.flatnonzero((c == 123) | (c == 125))
    at = at[inside(at) == 0]
    return at, np.where(c[at] == 123, 1, -1)


def _chunks(lines: Iterator[str]) -> Iterator[list[str]]:
    chunk, size = [], 0
    for line in lines:
        chunk.append(line)
        size += len(line) + 1
        if size > CHUNK:
            yield chunk
            chunk, size = [], 0
    if chunk:
        yield chunk


def _change(lines: Iterator[str]) -> tuple[int, int]:
    """Depth d becomes max(d + delta, floor); a closing bracket too many leaves it at 0."""
    delta, floor = 0, 0
    for chunk in _chunks(lines):
        found = _brackets("\n".join(chunk))
        if found is None:
            steps = np.array([1 if m[0][0] in "[{" else -1 for line in chunk for m in _MARK.finditer(line) if m[0][0] in "[]{}"], np.int64)
        else:
            steps = found[1]
        if len(steps):
            depths = np.cumsum(steps)
            total = int(depths[-1])
            delta, floor = delta + total, max(floor + total, total - min(0, int(depths.min())))
    return delta, floor


def _tops(raw: bytes, at: np.ndarray, steps: np.ndarray, depth: int) -> tuple[list[int], list[int], int] | None:
    """Where documents begin and end in a text, and the depth after it; None if a bracket is one too many or something else than documents stands at the top."""
    depths = depth + np.cumsum(steps)
    if len(depths) and depths.min() < 0:
        return None
    starts = [0] * (depth > 0) + at[(depths == 1) & (steps == 1)].tolist()
    ends = (at[depths == 0] + 1).tolist()
    for a, b in zip([0] * (depth == 0) + ends, [*starts[depth > 0 :], len(raw)], strict=False):
        if a < b and raw[a:b].strip():
            return None
    return starts, ends, int(depths[-1]) if len(depths) else depth


def _cut(lines: Iterator[str], depth: int) -> Iterator[tuple[int, str]]:
    """(number, piece): the pieces of documents in a split's lines. -1: goes on from before; _OPEN: is open at the end."""
    number, held = (-1, []) if depth else (0, [])

    def by_marks(line: str) -> Iterator[tuple[int, str]]:
        nonlocal number, held, depth
        at = 0
        for m in _MARK.finditer(line):
            c = m[0][0]
            if c in "[{":
                depth += 1
                if depth == 1:
                    at = m.start()
            elif c in "]}":
                if depth == 0:  # one too many: a document that is none
                    yield number, m[0]
                    number += 1
                    continue
                depth -= 1
                if depth == 0:
                    held.append(line[at : m.end()])
                    yield number, "\n".join(held)
                    number, held, at = max(number, -1) + 1, [], m.end()
            elif depth == 0:
                yield number, m[0]
                number, at = number + 1, m.end()
        if depth:
            held.append(line[at:])

    for chunk in _chunks(lines):
        text = "\n".join(chunk)
        found = _brackets(text)
        raw = text.encode()
        tops = None if found is None else _tops(raw, *found, depth)
        if tops is None:
            for line in chunk:
                yield from by_marks(line)
            continue
        starts, ends, depth = tops
        for a, b in zip(starts, ends, strict=False):
            yield number, "\n".join([*held, raw[a:b].decode()])
            number, held = number + 1, []
        if len(starts) > len(ends):
            held.append(raw[starts[-1] :].decode())
    if depth and held:
        yield (_OPEN if number >= 0 else -1), "\n".join(held)


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, str]]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def json_documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, number, document): each top-level JSON value of the files, numbered from 0 within its file.

    Values may follow each other with or without white space, and may hold line breaks. A document has to
    fit a row, a file has not. Brackets that do not match make a document that no reader accepts: one too
    many is a document of its own, one that is missing takes the rest of the file. Empty files give nothing.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")

    def changes(batches):
        for (file, block), rows in groupby(_splits(batches), lambda r: r[:2]):
            delta, floor = _change(line for _, _, line in rows)
            yield pa.RecordBatch.from_pydict({"file": pa.array([file], pa.string()), **{c: pa.array([v], pa.int64()) for c, v in (("block", block), ("delta", delta), ("floor", floor))}})

    rows = lines.mapInArrow(changes, "file string, block long, delta long, floor long").orderBy("file", "block").limit(MOST_SPLITS + 1).collect()
    if len(rows) > MOST_SPLITS:
        raise ValueError(f"more than {MOST_SPLITS} splits; read fewer files at a time")
    # the depth at which each split begins, and the split in which the document that goes on in it began
    begins: dict[tuple[str, int], tuple[int, int]] = {}
    file, depth, origin = None, 0, 0
    for r in rows:
        if r["file"] != file:
            file, depth, origin = r["file"], 0, r["block"]
        begins[file, r["block"]] = (depth, origin)
        # floor is above 0 or the depth has been at 0 where a split ends lower than it must by its sum alone
        after = max(depth + r["delta"], r["floor"])
        begins_here = depth == 0 or _touches(depth, r)
        if after and begins_here:
            origin = r["block"]
        depth = after
    shared = spark.sparkContext.broadcast(begins)

    def pieces(batches):
        for (file, block), rows in groupby(_splits(batches), lambda r: r[:2]):
            yield from _rows(file, block, (line for _, _, line in rows), *shared.value[file, block])

    found = written(lines.mapInArrow(pieces, "file string, block long, number long, piece long, text string"))
    opened = F.col("number") == _OPEN
    # only a document that its split leaves open has pieces elsewhere
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "text"))), lambda x: x["text"]), "\n")
    whole = found.where(~opened).select("file", "block", "number", F.col("text").alias("document"))
    whole = whole.unionByName(found.where(opened).groupBy("file", "block", "number").agg(joined.alias("document")))
    # documents of earlier splits of the file come first; a split's own are numbered in order, the open one last
    counts = found.groupBy("file", "block").agg((F.count_if(~opened) + F.max(opened.cast("int"))).alias("n"), F.min("number").alias("low")).collect()
    offsets, file, total = [], None, 0
    for r in sorted(counts, key=lambda r: (r["file"], r["block"])):
        if r["file"] != file:
            file, total = r["file"], 0
        offsets.append((file, r["block"], total, r["n"], r["low"]))
        total += r["n"]
    table = spark.createDataFrame(offsets, "file string, block long, before long, n long, low long")
    place = F.when(F.col("number") == _OPEN, F.col("n") - 1).otherwise(F.col("number") - F.col("low"))
    return whole.join(F.broadcast(table), ["file", "block"]).select("file", (F.col("before") + place).alias("number"), "document")


def _touches(depth: int, r) -> bool:
    """Whether a split that begins at a depth comes down to 0 in it: its lowest point is as far below as its floor is above its end."""
    return depth + r["delta"] <= r["floor"]


def _rows(file: str, block: int, lines: Iterator[str], depth: int, origin: int) -> Iterator[pa.RecordBatch]:
    own = ((*((origin, _OPEN) if number == -1 else (block, number)), text) for number, text in _cut(lines, depth))
    while some := list(_some(own)):
        yield pa.RecordBatch.from_pydict({
            "file": pa.array([file] * len(some), pa.string()), "block": pa.array([b for b, _, _ in some], pa.int64()), "number": pa.array([n for _, n, _ in some], pa.int64()),
            "piece": pa.array([block] * len(some), pa.int64()), "text": pa.array([t for _, _, t in some], pa.string()),
        })


def _some(rows: Iterator[tuple[int, int, str]]) -> Iterator[tuple[int, int, str]]:
    """The next rows, up to CHUNK characters."""
    size = 0
    for row in islice(rows, CHUNK):
        yield row
        size += len(row[2])
        if size > CHUNK:
            return
