"""Exact substring removal by maximal repeats of an enhanced suffix array.

A byte is removed if a span of 100 bytes that covers it also starts earlier (smaller id, or
same document and earlier start). Every such span holds at least one anchor, a local minimum
among the hashes of its short windows, so equal spans hold an anchor at the same place, and
only spans at one place about equal anchors have to be compared:

1. The starts of the spans through an anchor go in two runs (RUNS). All spans of a run share a
   core of 62 bytes and lie within a context of 138; a core's hash is the run's key. Runs
   whose contexts agree (both hashes, of two bases) are one class: all but its first are covered.
   This is settled within each batch first, which sends on at most two contexts of a key, and
   then by buckets of keys.
2. Keys with several contexts ask for the bytes. Suffixes that could agree have a key in common,
   so keys are what the suffix array is split by: a key with too many contexts is halved, again
   and again, into keys of longer cores and shorter contexts, after equal contexts have become
   one by an aggregate over their bytes. A run of one span ends there, so this always ends.
3. Over the bytes of each key, a stack scan of the suffix array's common-prefix intervals gives
   the maximal repeats (those whose left neighbours differ) with all occurrences; all but the
   first are covered.
4. Covered spans meet their texts by document.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, saved

SPAN, ANCHOR = 100, 24
REACH = SPAN - ANCHOR
#: First and last start, from the anchor, of each run of spans through it.
RUNS = ((-76, -39), (-38, 0))
#: Text bytes whose keys share a bucket, and bytes of contexts that share a pack.
BUCKET_BYTES, PACK_BYTES = 8 << 20, 4 << 20
#: Contexts of a key beyond which it is halved.
MOST_CONTEXTS = 4096
_BASES = (0xD1342543DE82EF95, 0x9E6C63D0876A9A35)
_LETTER = mix64(np.arange(256, dtype=np.uint64) + np.uint64(77))
_NULL_ID = -(1 << 63)
#: Text bytes whose anchors are sought at once, and whose keys are settled at once.
_CHUNK, _BATCH_BYTES = 1 << 18, 4 << 20
#: Bytes of one suffix array (more if one key has them), occurrences listed at once, bytes of a batch of rows.
_ARRAY_BYTES, _OCCURRENCES, _ROW_BYTES = 1 << 18, 1 << 18, 1 << 20
#: Runs of one row (some 120 KB), so that no row is a large object to the JVM.
_PACKED = 4096


class Powers:
    """base**k and base**-k modulo 2**64, as far as they were asked for."""

    def __init__(self, base: int):
        self.base = base
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            with np.errstate(over="ignore"):
                for name, base in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                    out = np.full(size, base, dtype=np.uint64)
                    out[0] = 1
                    setattr(self, name, np.multiply.accumulate(out))
        return self.up[:n], self.down[:n]


def _spread(x: np.ndarray, pick) -> np.ndarray:
    """pick (np.minimum, np.maximum) over each REACH + 1 neighbours of x."""
    width = 1
    while 2 * width <= REACH + 1:
        x = pick(x[:-width], x[width:])
        width *= 2
    rest = REACH + 1 - width
    return pick(x[: len(x) - rest], x[rest:]) if rest else x


def pieces(texts: Iterator[bytes]) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(text number, first byte, bounds of the bytes whose anchors count, bytes) of texts in pieces of _CHUNK and a margin."""
    for k, t in enumerate(texts):
        for at in range(0, max(1, len(t)), _CHUNK):
            low, high = max(0, at - SPAN), min(len(t), at + _CHUNK + SPAN)
            yield k, low, at - low, min(at + _CHUNK, len(t)) - low, t[low:high]


def runs(parts: list[tuple[int, int, int, int, bytes]], powers: list[Powers]) -> tuple[np.ndarray, ...]:
    """(text number, first start, starts left out before it, number of starts, core hash, context hash) of all anchors' runs.

    Runs follow one another by RUNS, then by text and place. Starts of spans that would leave
    the text are left out, and so are runs without any.
    """
    size = np.array([len(p[4]) for p in parts], dtype=np.int64)
    raw = np.frombuffer(b"".join(p[4] for p in parts), dtype=np.uint8)
    n = len(raw)
    if n < SPAN:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    end = np.cumsum(size)
    letter = _LETTER[raw]
    with np.errstate(over="ignore"):
        part, width, base = letter, 1, _BASES[0]
        held = {1: part}
        while width < 16:
            part = part[:-width] * np.uint64(base) + part[width:]
            width, base = 2 * width, base * base % (1 << 64)
            held[width] = part
        h = held[16][: n - ANCHOR + 1] * np.uint64(pow(_BASES[0], 8, 1 << 64)) + held[8][16 : 16 + n - ANCHOR + 1]
        del held, part
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    # least hash of each span, over the REACH + 1 windows within it; 0 where a span would leave its text
    low = _spread(h, np.minimum)
    inside = np.ones(len(low) + SPAN, dtype=bool)
    for e in end.tolist():
        inside[max(0, e - SPAN + 1) : e] = False
    low = np.where(inside[: len(low)], low, 0)
    # a window is an anchor if it is the least of any span through it
    edge = np.zeros(REACH, dtype=np.uint64)
    at = np.flatnonzero(_spread(np.concatenate([edge, low, edge]), np.maximum) == h)
    part = np.searchsorted(end, at, side="right")
    begin = end - size
    counts = np.array([p[2:4] for p in parts], dtype=np.int64)[part]
    at, part = (x[(at - begin[part] >= counts[:, 0]) & (at - begin[part] < counts[:, 1])] for x in (at, part))
    text, shift = np.array([p[0] for p in parts], dtype=np.int64)[part], np.array([p[1] for p in parts], dtype=np.int64)[part] - begin[part]
    powered = [p.to(n + 1) for p in powers]
    with np.errstate(over="ignore"):
        total = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(letter * up[:n], dtype=np.uint64)]) for up, _ in powered]
        out = []
        for k, (a, b) in enumerate(RUNS):
            first, last = np.maximum(at + a, begin[part]), np.minimum(at + b, end[part] - SPAN)
            some = first <= last
            x, y, place = first[some], last[some], at[some]
            core = mix64((total[0][place + a + SPAN] - total[0][place + b]) * powered[0][1][place + b] + np.uint64(k + 1))
            whole = mix64((total[1][y + SPAN] - total[1][x]) * powered[1][1][x] ^ mix64(((x - place - a) * 256 + y - x).astype(np.uint64)))
            out.append((text[some], x + shift[some], x - place - a, y - x + 1, core, whole))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def merged(group: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of the union of half-open spans within each group (numbers from 0), by group and place."""
    if not len(start):
        return group, start, end
    by = np.lexsort((start, group))
    group, start = group[by], start[by]
    far = int(end.max()) + 1  # groups lie one after another
    reach = np.maximum.accumulate(end[by] + group * far)
    first = np.concatenate([[True], start[1:] + group[1:] * far > reach[:-1]]) | np.concatenate([[True], group[1:] != group[:-1]])
    last = np.concatenate([first[1:], [True]])
    return group[first], start[first], reach[last] - group[last] * far


#: A document's key and a run of it: hash of its core, first start, starts left out before it, number of starts.
_RUN = np.dtype([("doc", "<i8"), ("sub", "<i8"), ("core", "<u8"), ("first", "<i4"), ("left_out", "u1"), ("count", "u1")])
#: A document's key and a covered span of it.
_SPAN = np.dtype([("doc", ">i8"), ("sub", ">i8"), ("start", ">i4"), ("end", ">i4")])
#: Covered spans (kind 0) and asked runs (2) as records, by parts of the documents.
_FOUND = "kind int, part int, data binary"


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _part(doc, sub, parts: int):
    return ((doc ^ sub) % parts).astype(np.int32)


def _by_part(kind: int, records: np.ndarray, parts: int) -> pa.Table:
    """A row for each part with its records as bytes."""
    part = _part(records["doc"].astype(np.int64), records["sub"].astype(np.int64), parts)
    by = np.argsort(part, kind="stable")
    part, records = part[by], records[by]
    at = np.flatnonzero(np.diff(part, prepend=-1))
    return pa.table({"kind": np.full(len(at), kind, dtype=np.int32), "part": part[at], "data": _binary(records.view("u1"), np.append(at, len(part)) * records.itemsize)})


def _documents(doc: np.ndarray, sub: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a row of each document, the number of its document for each row)."""
    by = np.lexsort((sub, doc))
    new = np.concatenate([[True], (doc[by][1:] != doc[by][:-1]) | (sub[by][1:] != sub[by][:-1])]) if len(by) else np.zeros(0, dtype=bool)
    group = np.empty(len(by), dtype=np.int64)
    group[by] = np.cumsum(new) - 1
    return by[new], group


def _spans(doc: np.ndarray, sub: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Merged spans as records, by document and place."""
    one, group = _documents(doc, sub)
    group, start, end = merged(group, start, end)
    out = np.empty(len(start), dtype=_SPAN)
    for name, x in zip(_SPAN.names, (doc[one][group], sub[one][group], start, end), strict=True):
        out[name] = x
    return out


def _records(*columns) -> np.ndarray:
    out = np.empty(len(columns[0]), dtype=_RUN)
    for name, x in zip(_RUN.names, columns, strict=True):
        out[name] = x
    return out


def _gathered(kind: np.dtype):
    """A part's records to a row for each document, its spans merged."""

    def run(table: pa.Table) -> pa.Table:
        records = np.frombuffer(b"".join(x.as_py() for x in table.column("data")), kind)
        if kind == _SPAN:
            records = _spans(*(records[n].astype(np.int64) for n in _SPAN.names))
        doc, sub = records["doc"].astype(np.int64), records["sub"].astype(np.int64)
        by = np.lexsort((sub, doc))
        doc, sub, records = doc[by], sub[by], records[by]
        at = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (sub[1:] != sub[:-1])]))
        return pa.table({"doc": doc[at], "sub": sub[at], "data": _binary(records.view("u1"), np.append(at, len(doc)) * kind.itemsize)})

    return run


def _classes(core: np.ndarray, whole: np.ndarray, *order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(runs by key and context, the first of each one's context, contexts so far, contexts of each one's key so sorted).

    Runs of one context keep their order, or follow `order` (first key last) if given.
    """
    by = np.lexsort((*order, whole, core))
    if not len(by):
        return by, by, by, by
    new_core = np.concatenate([[True], core[by][1:] != core[by][:-1]])
    new = new_core | np.concatenate([[True], whole[by][1:] != whole[by][:-1]])
    at = np.arange(len(by))
    key = np.cumsum(new_core) - 1
    nth = np.cumsum(new)  # contexts so far, and within the key:
    nth = nth - nth[np.maximum.accumulate(np.where(new_core, at, 0))]
    return by, np.maximum.accumulate(np.where(new, at, 0)), nth, np.bincount(key, weights=new).astype(np.int64)[key]


def _list_runs(buckets: int):
    """Batches of (doc, sub, text) to rows (bucket, kind, part, data); there are as many parts as buckets."""

    def run(batches):
        powers = [Powers(b) for b in _BASES]
        for batch in batches:
            doc, sub = (batch.column(k).to_numpy() for k in (0, 1))
            texts, rows, weight = batch.column(2), [], 0
            for r in range(batch.num_rows):
                rows.append(r)
                weight += len(texts[r].as_buffer() or b"") if texts[r].is_valid else 0
                if weight > _BATCH_BYTES or r + 1 == batch.num_rows:
                    yield from _listed(doc, sub, texts, np.array(rows), powers, buckets).to_batches()
                    rows, weight = [], 0

    return run


def _listed(doc, sub, texts, rows, powers, buckets) -> pa.Table:
    rows = rows[np.lexsort((sub[rows], doc[rows]))]
    found, held, weight = [], [], 0
    # nothing of a text stays but its runs; they follow the order of documents and places
    for part in pieces(texts[r].as_buffer().to_pybytes() if texts[r].is_valid else b"" for r in rows.tolist()):
        held.append(part)
        weight += len(part[4])
        if weight > _CHUNK:
            found.append(runs(held, powers))
            held, weight = [], 0
    found.append(runs(held, powers))
    text, first, left_out, count, core, whole = (np.concatenate(x) for x in zip(*found, strict=True))
    doc, sub = doc[rows[text]], sub[rows[text]]
    by, lead, nth, contexts = _classes(core, whole)
    again, asked = _answers(by, lead, contexts, doc, sub, first)
    out = [_by_part(0, _spans(doc[again], sub[again], first[again], first[again] + count[again] + SPAN - 1), buckets), _by_part(2, _records(doc, sub, core, first, left_out, count)[asked], buckets)]
    out = [t.add_column(0, "bucket", t.column("part")) for t in out]
    # two contexts are enough to tell other batches that a key has several; these are asked for already
    left_out = left_out + _ASKED * (np.bincount(asked, minlength=len(core)) if len(core) else 0)
    sent = np.sort(by[(lead == np.arange(len(by))) & (nth < 2)])
    bucket = (core[sent] % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    sent, bucket = sent[order], bucket[order]
    place = np.arange(len(sent)) - np.searchsorted(bucket, bucket)
    cut = np.flatnonzero(place % _PACKED == 0)
    packs = [_pack(doc[own], sub[own], core[own], whole[own], first[own], left_out[own], count[own]) for own in np.split(sent, cut[1:]) if len(own)]
    out.append(pa.table({"bucket": pa.array(bucket[cut], pa.int32()), "kind": np.ones(len(cut), dtype=np.int32), "part": pa.nulls(len(cut), pa.int32()), "data": pa.array(packs, pa.binary())}))
    return pa.concat_tables(out).combine_chunks()


def _answers(by, lead, contexts, doc, sub, first) -> tuple[np.ndarray, np.ndarray]:
    """(runs that equal an earlier one, runs to ask for: the first of each context of a key with several)."""
    ahead = by[lead]
    again = by[~((doc[by] == doc[ahead]) & (sub[by] == sub[ahead]) & (first[by] == first[ahead]))]
    return again, by[(lead == np.arange(len(by))) & (contexts > 1)]


#: Added to the starts left out of a run that is asked for already.
_ASKED = 128


def _pack(doc, sub, core, whole, first, left_out, count) -> bytes:
    """Columns one after another; ids as differences from the least, in four bytes where they fit."""
    base = doc.min()
    more = doc.view("u8") - base.view("u8")
    more = more.astype("<u4" if more.max() < 1 << 32 else "<u8")
    parts = (np.array([len(doc), base, more.itemsize], "<i8"), core.astype("<u8"), whole.astype("<u8"), first.astype("<i4"), left_out.astype("u1"), count.astype("u1"), more, sub.astype("<i8"))
    return b"".join(p.tobytes() for p in parts)


def _unpack(data: pa.Buffer) -> tuple[np.ndarray, ...]:
    n, base, size = np.frombuffer(data, "<i8", 3).tolist()
    at, out = 24, []
    for kind in ("<u8", "<u8", "<i4", "u1", "u1", f"<u{size}", "<i8"):
        out.append(np.frombuffer(data, kind, n, at))
        at += out[-1].nbytes
    core, whole, first, left_out, count, more, sub = out
    return (more.astype(np.uint64) + np.array(base).view("u8")).view(np.int64), sub, core, whole, first, left_out, count


def _settle(parts: int):
    """A bucket's rows: spans and asks pass; runs become spans or asks."""

    def run(table: pa.Table) -> pa.Table:
        is_run = pc.equal(table.column("kind"), 1)
        out = [table.filter(pc.invert(is_run)).select(["kind", "part", "data"])]
        packed = [_unpack(x.as_buffer()) for x in table.column("data").filter(is_run)]
        if packed:
            core = np.concatenate([p[2] for p in packed])
            order = np.argsort(core, kind="stable")
            same = core[order][1:] == core[order][:-1]
            twice = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
            del core, order, same
            doc, sub, core, whole, first, left_out, count = (np.concatenate([p[k] for p in packed])[twice] for k in range(7))
            del packed
            first, left_out, count = (x.astype(np.int64) for x in (first, left_out, count))
            by, lead, _, contexts = _classes(core, whole, first, sub, doc)
            again, asked = _answers(by, lead, contexts, doc, sub, first)
            asked = asked[left_out[asked] < _ASKED]
            out += [_by_part(0, _spans(doc[again], sub[again], first[again], first[again] + count[again] + SPAN - 1), parts), _by_part(2, _records(doc, sub, core, first, left_out, count)[asked], parts)]
        return pa.concat_tables(out)

    return run


class SuffixArray:
    """Suffixes of at least `least` bytes of some short texts in order, and their maximal repeats.

    Suffixes are sorted by their bytes, each held whole (a context has 138 bytes at most); common
    prefixes of neighbours are counted on the same bytes; a stack over them walks the tree of
    common-prefix intervals. An interval is kept if the bytes before its suffixes differ (the
    start of a text differs from all).

    owner and place: text number and place of each suffix. length, low, high: of each maximal
    repeat its length and its first and last suffix; all suffixes between are its occurrences.
    """

    def __init__(self, texts: list[bytes], least: int):
        size = np.array([len(t) for t in texts], dtype=np.int64)
        widest = int(size.max(initial=1))
        raw = np.frombuffer(b"".join(texts) + bytes(widest), dtype=np.uint8)
        begin = np.cumsum(size) - size
        count = np.maximum(size - least + 1, 0)
        owner = np.repeat(np.arange(len(texts)), count)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        left = size[owner] - place  # bytes up to the text's end
        whole = np.lib.stride_tricks.sliding_window_view(raw, widest)[begin[owner] + place]
        whole[np.arange(widest) >= left[:, None]] = 0
        # a shorter suffix comes before one that goes on with zero bytes
        order = np.argsort(left, kind="stable")
        order = order[np.argsort(whole.view(f"S{widest}").ravel()[order], kind="stable")]
        self.owner, self.place, whole, left = owner[order], place[order], whole[order], left[order]
        suffix = begin[self.owner] + self.place
        none = np.zeros(0, dtype=np.int64)
        self.length = self.low = self.high = none
        if len(suffix) < 2:
            return
        differ = whole[1:] != whole[:-1]
        common = np.where(differ.any(axis=1), differ.argmax(axis=1), widest)
        del whole, differ
        common = np.minimum(common, np.minimum(left[1:], left[:-1]))
        before = np.where(self.place > 0, raw[suffix - 1].astype(np.int64), -1 - suffix)
        # differs[i]: how many neighbours up to i have differing bytes before them
        differs = np.concatenate([[0], np.cumsum(before[1:] != before[:-1])])
        open_ = common >= least
        edge = np.flatnonzero(np.diff(np.concatenate([[False], open_, [False]]).astype(np.int8))).reshape(-1, 2)
        edge = edge[differs[edge[:, 1]] > differs[edge[:, 0]]]  # without any difference no interval below has one
        found: list[tuple[int, int, int]] = []
        for x, y in edge.tolist():  # suffixes x..y share `least` bytes
            stack: list[tuple[int, int]] = []
            for i, now in enumerate([*common[x:y].tolist(), 0], x):
                low = i
                while stack and stack[-1][0] > now:
                    length, low = stack.pop()
                    if differs[i] > differs[low]:
                        found.append((length, low, i))
                if now and (not stack or stack[-1][0] < now):
                    stack.append((now, low))
        if found:
            self.length, self.low, self.high = np.array(found, dtype=np.int64).T

    def later(self, order: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(suffix, length) of every occurrence but the first, by `order`, of each maximal repeat; some repeats at a time."""
        count = self.high - self.low + 1
        if not len(count):
            return
        cut = np.flatnonzero(np.diff(np.cumsum(count) // _OCCURRENCES, prepend=-1))
        for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(count)], strict=True):
            some = count[i:j]
            at = np.cumsum(some) - some
            suffix = np.repeat(self.low[i:j] - at, some) + np.arange(some.sum())
            own = order[suffix]
            rest = own > np.repeat(np.minimum.reduceat(own, at), some)
            yield suffix[rest], np.repeat(self.length[i:j], some)[rest]


def maximal_repeats(texts: list[bytes], least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, text numbers, places) of every maximal repeat of at least `least` bytes, all occurrences."""
    array = SuffixArray(texts, least)
    for length, low, high in zip(array.length.tolist(), array.low.tolist(), array.high.tolist(), strict=True):
        yield length, array.owner[low : high + 1], array.place[low : high + 1]


def _repeat_spans(table: pa.Table) -> np.ndarray:
    """Covered spans of contexts (key, doc, sub, start, data) of whole keys."""
    key, doc, sub, start = (table.column(n).to_numpy() for n in ("key", "doc", "sub", "start"))
    order = np.lexsort((start, sub, doc, key))
    key, doc, sub, start = key[order], doc[order], sub[order], start[order].astype(np.int64)
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | (sub[1:] != sub[:-1]) | (start[1:] != start[:-1])])
    order, key, doc, sub, start = order[new], key[new], doc[new], sub[new], start[new]
    data = table.column("data")
    cut = [*np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])).tolist(), len(key)]
    widest = SPAN - 1 + max(b - a + 1 for a, b in RUNS)
    out = [_spans(doc[:0], sub[:0], start[:0], start[:0])]
    at = k = 0
    while at < len(key):
        # as many whole keys as fit, one at least
        k += 1
        while k + 1 < len(cut) and (cut[k + 1] - at) * widest <= _ARRAY_BYTES:
            k += 1
        array = SuffixArray(data.take(pa.array(order[at : cut[k]])).to_pylist(), SPAN)
        own = array.owner + at
        where = start[own] + array.place
        # the order of occurrences: by document and place; the same place in two contexts counts once
        by = np.lexsort((where, sub[own], doc[own]))
        d, s, w = doc[own][by], sub[own][by], where[by]
        rank = np.empty(len(by), dtype=np.int64)
        rank[by] = np.cumsum(np.concatenate([[0], (d[1:] != d[:-1]) | (s[1:] != s[:-1]) | (w[1:] != w[:-1])])[: len(by)])
        best = np.zeros(len(own), dtype=np.int64)
        for suffix, length in array.later(rank):
            np.maximum.at(best, suffix, length)
        hit = np.flatnonzero(best)
        out.append(_spans(doc[own[hit]], sub[own[hit]], where[hit], where[hit] + best[hit]))
        at = cut[k]
    return np.concatenate(out).astype(_SPAN)  # in its byte order again


_CONTEXTS = "key long, starts int, left_out int, doc long, sub long, start int, data binary"


def _contexts(batches):
    """Documents and their asked runs to the runs' bytes; starts: how many the run has in the middle of a text."""
    most = max(b - a + 1 for a, b in RUNS)
    rows = _ROW_BYTES // (SPAN + most)
    for batch in batches:
        texts, asked = batch.column(0), batch.column(1)
        given = np.frombuffer(b"".join(x.as_py() for x in asked), _RUN)
        row = np.repeat(np.arange(batch.num_rows), np.asarray(pc.binary_length(asked)) // _RUN.itemsize)
        begin = np.frombuffer(texts.buffers()[1], np.int32, len(texts), 4 * texts.offset).astype(np.int64)
        raw = np.frombuffer(texts.buffers()[2], np.uint8)
        for at in range(0, len(given), rows):
            r = given[at : at + rows]
            n = r["count"].astype(np.int64) + SPAN - 1
            end = np.cumsum(n)
            data = raw[np.repeat(begin[row[at : at + rows]] + r["first"] - (end - n), n) + np.arange(end[-1])]
            columns = {"key": r["core"].view("<i8"), "starts": np.full(len(r), most, dtype=np.int32), "left_out": r["left_out"].astype(np.int32), "doc": r["doc"], "sub": r["sub"], "start": r["first"]}
            yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(c)) for c in columns.values()), _binary(data, np.append(0, end))], names=[*columns, "data"])


def _halves(contexts: DataFrame) -> DataFrame:
    """Each context's two: the spans of the first half of its run's starts, and those of the rest, under the hashes of their cores.

    The starts of a context are its run's from `left_out` on, as many as its bytes hold spans.
    """
    half = F.expr("starts div 2")
    count = F.expr(f"octet_length(data) - {SPAN - 1}")
    c = contexts.withColumns({"half": half, "end": F.col("left_out") + count})
    parts = F.array(
        F.struct(F.lit(0).alias("part"), F.col("left_out").alias("low"), F.least("end", "half").alias("high"), F.col("half").alias("starts"), F.lit(0).alias("shift")),
        F.struct(F.lit(1).alias("part"), F.greatest("left_out", "half").alias("low"), F.col("end").alias("high"), (F.col("starts") - F.col("half")).alias("starts"), F.col("half").alias("shift")),
    )
    c = c.select("key", "left_out", "doc", "sub", "start", "data", F.explode(parts).alias("p")).where("p.low < p.high")
    bytes_ = lambda low, high: F.expr(f"substring(data, int({low}) - left_out + 1, int({high}) - int({low}))")
    return c.select(
        F.xxhash64("key", "p.part", bytes_("p.shift + p.starts - 1", f"p.shift + {SPAN}")).alias("key"),
        F.col("p.starts").alias("starts"),
        (F.col("p.low") - F.col("p.shift")).alias("left_out"),
        "doc",
        "sub",
        (F.col("start") + F.col("p.low") - F.col("left_out")).alias("start"),
        bytes_("p.low", f"p.high + {SPAN - 1}").alias("data"),
    )


def _split(contexts: DataFrame, most: int, parts: int) -> tuple[DataFrame, DataFrame | None]:
    """(contexts under keys of at most `most` rows, records of spans covered on the way there)."""
    narrow, covered = [], []
    while True:
        wide = saved(contexts.groupBy("key").count().where(F.col("count") > most).select("key"))
        if wide.isEmpty():
            narrow.append(contexts)
            break
        narrow.append(contexts.join(wide, "key", "left_anti"))
        contexts = saved(contexts.join(wide, "key", "left_semi"))
        # minima first: their join can be split however many rows one of them has
        at = F.struct("doc", "sub", "start")
        firsts = saved(contexts.groupBy("key", "starts", "left_out", "data").agg(F.min(at).alias("first"), F.count("*").alias("rows")))
        again = contexts.join(firsts.where("rows > 1").select("key", "left_out", "data", "first"), ["key", "left_out", "data"]).where(at > F.col("first"))
        number = lambda x, digits: F.to_binary(F.right(F.lpad(F.hex(x.cast("long")), 16, "0"), F.lit(digits)), F.lit("hex"))
        start = F.col("start")
        record = F.concat(number(F.col("doc"), 16), number(F.col("sub"), 16), number(start, 8), number(start + F.octet_length("data"), 8))
        covered.append(again.select(F.pmod(F.col("doc").bitwiseXOR(F.col("sub")), F.lit(parts)).cast("int").alias("part"), record.alias("data")))
        contexts = saved(_halves(firsts.where("starts > 1").select("key", "starts", "left_out", "first.*", "data")))
    join = lambda x: functools.reduce(DataFrame.unionByName, x)
    return join(narrow), join(covered) if covered else None


def _removed(batches):
    """(doc, text, merged spans) to the result columns."""
    for batch in batches:
        rows = []
        for doc, text, spans in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
            raw = text.as_buffer() if text.is_valid else b""
            found = np.frombuffer(spans.as_buffer() if spans.is_valid else b"", _SPAN)
            start, end = found["start"].astype(np.int64), found["end"].astype(np.int64)
            kept, at, raw = hashlib.sha256(), 0, memoryview(raw)
            for a, b in zip(start.tolist(), end.tolist(), strict=True):
                kept.update(raw[at:a])
                at = b
            kept.update(raw[at:])
            id_ = doc.as_py()
            rows.append((None if id_ == _NULL_ID else id_, len(raw), int((end - start).sum()), len(start), kept.hexdigest()))
        columns = zip(*rows, strict=True) if rows else [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def covered_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_contexts: int = MOST_CONTEXTS) -> tuple[DataFrame, DataFrame]:
    """(documents, covered spans): columns doc, sub, _text, and doc, sub, data with all merged spans of a document."""
    docs = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("doc"), F.xxhash64(text_col).alias("sub"), F.col(text_col).alias("_text"))
    total = int(docs.agg(F.sum(F.octet_length("_text"))).first()[0] or 0)
    parts = max(8, -(-total // BUCKET_BYTES))
    by_part = lambda df, kind: df.repartition(parts, "part").groupBy("part").applyInArrow(_gathered(kind), "doc long, sub long, data binary")
    listed = docs.mapInArrow(_list_runs(parts), f"bucket int, {_FOUND}").repartition(parts, "bucket")
    found = saved(listed.groupBy("bucket").applyInArrow(_settle(parts), _FOUND))
    asked = by_part(found.where("kind = 2"), _RUN).withColumnRenamed("data", "asked")
    # the built side of a partition has about as many bytes as its texts at most
    near = docs.join(asked.hint("shuffle_hash"), ["doc", "sub"]).select("_text", "asked")
    contexts, covered = _split(saved(near.mapInArrow(_contexts, _CONTEXTS)), most_contexts, parts)
    packs = max(8, -(-int(found.where("kind = 2").agg(F.sum(F.length("data"))).first()[0] or 0) // _RUN.itemsize * SPAN // PACK_BYTES))
    packed = contexts.select("key", "doc", "sub", "start", "data", F.pmod("key", F.lit(packs)).alias("pack")).repartition(packs, "pack")
    repeats = packed.groupBy("pack").applyInArrow(lambda table: _by_part(0, _repeat_spans(table), parts), _FOUND)
    spans = found.where("kind = 0").unionByName(repeats).select("part", "data")
    return docs, by_part(spans if covered is None else spans.unionByName(covered), _SPAN)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_contexts: int = MOST_CONTEXTS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of df.

    A null text counts as empty. Rows with a null id come before all others; rows that share an
    id are ordered by a hash of 64 bits of their texts, and rows that share both are one document to the
    search (each gets the same result). An empty table gives none; other columns are not read.
    """
    docs, spans = covered_spans(df, id_col, text_col, most_contexts)
    joined = docs.join(spans.hint("shuffle_hash"), ["doc", "sub"], "left").select("doc", "_text", "data")
    return joined.mapInArrow(_removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


#: The same rows by hashing every span of every text.
ORACLE = r"""
WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS raw FROM documents),
p AS (SELECT doc_id, unnest(range(1, octet_length(raw) - 98)) AS i FROM b),
h AS (SELECT p.doc_id, i, md5(raw[i:i+99]) AS h FROM p JOIN b USING (doc_id)),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1 AS again FROM h),
g AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS fresh FROM f WHERE again),
k AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM g),
r AS (SELECT doc_id, island, min(i) AS a, max(i) + 100 AS z FROM k GROUP BY 1, 2),
o AS (SELECT doc_id, a, z, lag(z, 1, 1) OVER (PARTITION BY doc_id ORDER BY a) AS was FROM r),
q AS (SELECT o.doc_id, count(*) AS n_spans, sum(z - a) AS n_removed, max(z) AS last, list(raw[was:a-1] ORDER BY a) AS parts FROM o JOIN b USING (doc_id) GROUP BY 1)
SELECT b.doc_id, CAST(octet_length(raw) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(CASE WHEN q.doc_id IS NULL THEN raw ELSE list_reduce(list_append(parts, raw[last:octet_length(raw)]), lambda x, y: x || y) END) AS kept_sha256
FROM b LEFT JOIN q USING (doc_id)
"""
