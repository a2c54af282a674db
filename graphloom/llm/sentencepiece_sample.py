"""SentencePiece encoding by Gumbel top-k sampling without replacement, and decoding.

All segmentations of a text form a lattice of pieces. A piece's weight follows its rank in the
vocabulary (Zipf), and exact completion sums turn the weights into the chance of each next
piece. Segmentations get perturbed log-chances (Gumbel noise on leaves, sampled top-down): a
subtree's largest value is drawn at once, the piece chosen inherits it, and each step's group
of other pieces gets the largest value among them, cut off at its parent's. A best-first (A*)
search opens the group with the largest value and so emits distinct segmentations in the order
of their perturbed values. Its next value is the threshold of their inclusion scores.

The lattice falls apart at word starts, so it is built once for each distinct word of a batch,
for all words together as arrays, and the fresh part of each sample is drawn for all words of a
batch at once. All noise is a hash of seed, row key, sample and place: batches don't matter.
"""

from __future__ import annotations

import math
import re
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import give_back, mix64

SPACE = "▁"
#: Characters of text worked on at once.
BATCH_CHARS = 2_500_000
#: Rows of a batch at most.
_ROWS = 1024
_BASE = np.uint64(0x9E3779B97F4A7C15)
_TWIST = np.uint64(0xD1342543DE82EF95)
#: No noise is larger: uniform numbers are at least 2**-54 from 1.
_MOST_NOISE = 54 * math.log(2) + 1e-6
#: Steps of a row whose groups are looked at for all rows of a batch at once.
_STEPS = 512
_SMALL = mix64(np.arange(256, dtype=np.uint64) + np.uint64(0x51ED27))
_BYTES = -2  # the piece of an edge that spells one character in bytes


class Pieces:
    """A vocabulary: pieces, log-weights, a hash table of all their prefixes, and byte pieces."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        score = [model.get_score(i) for i in range(n)]
        rank = np.array([-s if s > -1e8 else n for s in score])
        self.byte = np.full(256, -1, dtype=np.int64)
        self.spelled: list[bytes] = []
        plain = {}
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                rank[i] = n
                self.spelled.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.spelled.append(b"")
            else:
                plain[piece.replace(SPACE, " ")] = i  # a text with plain spaces stays in one byte a character
                self.spelled.append(piece.replace(SPACE, " ").encode("utf-8"))
        weight = -np.log(2.0 + rank)
        used = np.array([*plain.values(), *self.byte[self.byte >= 0]])
        self.weight = weight - np.log(np.exp(weight[used]).sum())
        self.byte_weight = float(self.weight[self.byte[self.byte >= 0]].mean()) if (self.byte >= 0).any() else -30.0
        self.unknown = model.unk_id()
        letters = set("".join(plain))
        self.cut = "".join(c for c in "\n\t\r" if c not in letters)
        self.longest = max(map(len, plain))
        letter = {c: int(_letter(np.array([ord(c)], dtype=np.uint64))[0]) for c in letters}
        base, mask = int(_BASE), (1 << 64) - 1
        table, count = {}, len({p[:k] for p in plain for k in range(1, len(p) + 1)})
        for p in plain:
            h = 0
            for k, c in enumerate(p, 1):
                h = (h * base + letter[c]) & mask
                if k < len(p):
                    table.setdefault(h, -1)
            table[h] = plain[p]
        keys = np.array(sorted(table), dtype=np.uint64)
        if len(keys) != count:
            raise ValueError("two prefixes of pieces share a hash")
        self.keys, self.piece_of = keys, np.array([table[k] for k in sorted(table)], dtype=np.int64)
        # two levels of lookup: the top bits find a short run of keys
        self.bits = 20
        self.first = np.searchsorted(keys, np.arange((1 << self.bits) + 1, dtype=np.uint64) << np.uint64(64 - self.bits)) if len(keys) else None
        self.first[-1] = len(keys)
        self.units = re.compile(rf" *[^ {self.cut}]+" + (f"|[{self.cut}]" if self.cut else "") + "| +")
        self.objects = np.empty(n, dtype=object)
        self.objects[:] = self.spelled

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places in keys, -1 where a hash is not there."""
        top = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.first[top], self.first[top + 1]
        out = np.full(len(h), -1, dtype=np.int64)
        live = np.flatnonzero(at < end)
        while len(live):
            hit = self.keys[at[live]] == h[live]
            out[live[hit]] = at[live[hit]]
            live = live[~hit]
            at[live] += 1
            live = live[at[live] < end[live]]
        return out

    def of_byte(self, values: np.ndarray) -> np.ndarray:
        ids = self.byte[values.astype(np.int64)]
        return np.where(ids < 0, self.unknown, ids)

    def split(self, text: str | None) -> list[str]:
        """The units between which no piece reaches, in order; together the normalised text."""
        return self.units.findall(" " + (text.replace(SPACE, " ") if SPACE in text else text)) if text else []

    def decode(self, ids) -> str:
        raw = b"".join(self.objects[ids].tolist())
        return raw[1:].decode("utf-8", "replace") if raw[:1] == b" " else raw.decode("utf-8", "replace")


@cache
def pieces_at(path: str) -> Pieces:
    """A vocabulary, read once in each process."""
    return Pieces(path)


def _letter(code: np.ndarray) -> np.ndarray:
    out = _SMALL[np.minimum(code, np.uint64(255)).astype(np.uint8)]
    large = np.flatnonzero(code > 255)
    if len(large):
        out[large] = mix64(code[large] + np.uint64(0x51ED27))
    return out


class Lattice:
    """The lattices of distinct units: edges by source state with log-chance and running chance."""

    def __init__(self, units: list[str], pieces: Pieces):
        size = np.array([len(u) for u in units], dtype=np.int64)
        joined = "".join(units)
        try:
            code = np.frombuffer(joined.encode("latin-1"), dtype=np.uint8).astype(np.uint64)
        except UnicodeEncodeError:
            code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        n = len(code)
        self.start = np.concatenate([[0], np.cumsum(size)])[:-1] if len(units) else np.zeros(0, np.int64)
        left = np.repeat(self.start + size, size) - np.arange(n)  # characters to the end, this one included
        self.left, self.code = left, code
        letter = _letter(code)
        active, h = np.arange(n), np.zeros(n, dtype=np.uint64)
        sources, widths, kinds = [], [], []
        for width in range(1, pieces.longest + 1):
            h = h * _BASE + letter[active + width - 1]
            at = pieces.find(h)
            piece = np.where(at >= 0, pieces.piece_of[at], -1)
            if width == 1:
                none = active[piece < 0]
                sources.append(none)
                widths.append(np.ones(len(none), dtype=np.int64))
                kinds.append(np.full(len(none), _BYTES, dtype=np.int64))
            hit = piece >= 0
            sources.append(active[hit])
            widths.append(np.full(int(hit.sum()), width, dtype=np.int64))
            kinds.append(piece[hit])
            go = (at >= 0) & (left[active] > width)
            active, h = active[go], h[go]
            if not len(active):
                break
        source, width, kind = (np.concatenate(x) for x in (sources, widths, kinds))
        del sources, widths, kinds, h, letter
        # by characters left, then source: completion sums then need one pass over the edges
        order = np.argsort((left[source] * (n + 1) + source) * (pieces.longest + 1) + width)
        source, width, kind = source[order].astype(np.int32), width[order].astype(np.int16), kind[order].astype(np.int32)
        del order
        weight = np.where(kind >= 0, pieces.weight[np.maximum(kind, 0)], 0.0)
        spelled = np.flatnonzero(kind == _BYTES)
        if len(spelled):
            letters = code[source[spelled]]
            weight[spelled] = pieces.byte_weight * _utf8_bytes(letters)
            one = letters < 0x80  # such a character is one piece
            kind[spelled[one]] = pieces.of_byte(letters[one])
        self.kind, self.width = kind, width
        self.log = np.empty(len(source))
        self.sum = np.empty(len(source))
        total = np.zeros(n + 1)  # log of the completion sums; an end state has 0
        new = np.flatnonzero(np.concatenate([[True], source[1:] != source[:-1]])) if len(source) else np.zeros(0, np.int64)
        self.first = np.zeros(n, dtype=np.int64)
        self.first[source[new]] = new
        self.count = np.zeros(n, dtype=np.int64)
        self.count[source[new]] = np.diff(np.append(new, len(source)))
        level = left[source[new]]
        cut = np.flatnonzero(np.concatenate([[True], level[1:] != level[:-1]])) if len(level) else []
        for a, b in zip(cut, [*cut[1:], len(new)], strict=True):
            x, y = new[a], new[b] if b < len(new) else len(source)
            ends = np.where(width[x:y] == left[source[x:y]], 0.0, total[np.minimum(source[x:y] + width[x:y], n)])
            value = weight[x:y] + ends
            seg = new[a:b] - x
            count = np.diff(np.append(seg, y - x))
            top = np.maximum.reduceat(value, seg)
            whole = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, count)), seg))
            total[source[new[a:b]]] = whole
            log = value - np.repeat(whole, count)
            self.log[x:y] = log
            run = np.cumsum(np.exp(log))
            run -= np.repeat(np.concatenate([[0.0], run[seg[1:] - 1]]), count)
            run[np.append(seg[1:], y - x) - 1] = 2.0  # the last edge takes what rounding leaves
            self.sum[x:y] = run

    def draw(self, unit: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One independent segmentation of each occurrence: edges in order, and how many each has."""
        state, step = self.start[unit].copy(), 0
        left = self.left[state].copy()
        active, taken = np.arange(len(unit)), []
        number = np.zeros(len(unit), dtype=np.int64)
        turn = np.full(1, _TWIST, dtype=np.uint64)
        while len(active):
            u = _uniform(key[active] + turn)
            turn = turn + _TWIST
            edge = self.first[state[active]]
            more = np.flatnonzero(u > self.sum[edge])
            while len(more):
                edge[more] += 1
                more = more[u[more] > self.sum[edge[more]]]
            taken.append((active, edge))
            number[active] += 1
            width = self.width[edge]
            state[active] += width
            left[active] -= width
            active = active[left[active] > 0]
            step += 1
        at = np.concatenate([[0], np.cumsum(number)])
        out = np.empty(at[-1], dtype=np.int64)
        for k, (who, edge) in enumerate(taken):
            out[at[who] + k] = edge
        return out, number


def _utf8_bytes(code: np.ndarray) -> np.ndarray:
    return 1 + (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF)


def _uniform(x: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1) from 64-bit words."""
    return ((mix64(x) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _gumbel(u):
    return -np.log(-np.log(u))


def _capped(location, noise, top):
    """The largest of Gumbel values at `location`, given that it is under `top`."""
    return -np.logaddexp(-top, -(location + noise))


def _log_rest(log):
    """log(1 - exp(log)); -inf for a certain step."""
    with np.errstate(divide="ignore"):
        return np.log(-np.expm1(np.minimum(log, 0.0)))


class _Spare:
    """A row's own uniform numbers; more are hashed when the first ones run out."""

    def __init__(self, row: int, first: list[float]):
        self.row, self.have, self.at = row, first, 0

    def __call__(self) -> float:
        if self.at == len(self.have):
            count = np.arange(len(self.have), len(self.have) + 1024, dtype=np.uint64)
            self.have = self.have + _uniform(count * _BASE + np.uint64(self.row)).tolist()
        self.at += 1
        return self.have[self.at - 1]


class _Fresh:
    """One independent draw for every unit of a batch, with what the search needs of its first steps."""

    def __init__(self, grid: Lattice, units: np.ndarray, first: np.ndarray, key: np.ndarray, row: np.ndarray):
        self.edges, number = grid.draw(units, key)
        self.at = np.concatenate([[0], np.cumsum(number)])
        self.log = grid.log[self.edges]
        begin = self.at[first]
        self.begin, self.size = begin[:-1], np.diff(begin)
        total = np.concatenate([[0.0], np.cumsum(self.log)])
        self.total = total[begin[1:]] - total[begin[:-1]]
        # a matrix of the first steps of each row: log-chance before a step, and value of its group before location and cap
        width = min(_STEPS, int(self.size.max(initial=1)) + 1)
        place = np.minimum(self.begin[:, None] + np.arange(width), max(len(self.log) - 1, 0))
        log = np.where(np.arange(width) < self.size[:, None], self.log[place] if len(self.log) else 0.0, 0.0)
        self.before = np.cumsum(log, axis=1) - log
        noise = _gumbel(_uniform(mix64(row)[:, None] + np.arange(width, dtype=np.uint64) * _TWIST))
        self.lift = _log_rest(log) + noise  # a step beyond the end is certain: its group has -inf
        self.row = row


class Sampler:
    """Top-k segmentations without replacement of texts by row key."""

    def __init__(self, pieces: Pieces, k: int = 2, seed: int = 1):
        self.pieces, self.k, self.seed = pieces, k, seed

    def sample(self, keys: list[int | None], texts: list[str | None]) -> list[list[tuple[np.ndarray, float, float, float]]]:
        """For each text a list of (ids, log-chance, perturbed value, log-inclusion), best first."""
        split = [self.pieces.split(t) for t in texts]
        flat = list(chain.from_iterable(split))
        known = {u: i for i, u in enumerate(dict.fromkeys(flat))}
        units = np.fromiter(map(known.__getitem__, flat), dtype=np.int64, count=len(flat))
        size = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        del flat, split
        grid = Lattice(list(known), self.pieces)
        row = mix64(np.array([(0 if k is None else k) & 0xFFFFFFFFFFFFFFFF for k in keys], dtype=np.uint64) ^ mix64(np.array([self.seed], dtype=np.uint64)))
        first = np.concatenate([[0], np.cumsum(size)])
        within = (np.arange(first[-1]) - np.repeat(first[:-1], size)).astype(np.uint64) * _TWIST
        fresh = []
        for s in range(self.k):
            own = row + np.full(1, s + 1, dtype=np.uint64) * _BASE
            fresh.append(_Fresh(grid, units, first, mix64(np.repeat(own, size) + within), own))
        spare = _uniform(mix64(row ^ _TWIST)[:, None] + np.arange(32, dtype=np.uint64) * _BASE).tolist()
        seeds = mix64(row ^ _TWIST).tolist()
        top = _gumbel(np.array([x[0] for x in spare]))
        best = fresh[0]
        values = _capped(best.before, best.lift, top[:, None])
        out = []
        for d in range(len(texts)):
            a, b = int(first[d]), int(first[d + 1])
            if a == b:
                out.append([(np.zeros(0, dtype=np.int64), 0.0, 0.0, 0.0)])
            else:
                out.append(self._search(grid, d, units[a:b], a, fresh, values[d], float(top[d]), _Spare(seeds[d], spare[d])))
        return out

    def _more(self, fresh: _Fresh, d: int, low: int, value: np.ndarray, ahead: np.ndarray, top: float) -> tuple[np.ndarray, np.ndarray]:
        """value and ahead of a path's groups, continued beyond the first steps where noise could still lift one to the best k + 1.

        low: how many steps of the row's fresh draw lie in value; ahead has one entry more than value, for the next step.
        """
        size, begin = int(fresh.size[d]), int(fresh.begin[d])
        while low < size:
            bound = np.partition(value, -self.k - 1)[-self.k - 1] if len(value) > self.k else -math.inf
            if ahead[-1] + _MOST_NOISE < bound:
                break
            high = min(size, 2 * low + _STEPS)
            log = fresh.log[begin + low : begin + high]
            upto = ahead[-1] + np.cumsum(log)
            noise = _gumbel(_uniform(mix64(fresh.row[d : d + 1]) + np.arange(low, high, dtype=np.uint64) * _TWIST))
            value = np.concatenate([value, _capped(np.concatenate([ahead[-1:], upto[:-1]]) + _log_rest(log), noise, top)])
            ahead = np.concatenate([ahead, upto])
            low = high
        return value, ahead

    def _search(self, grid: Lattice, d: int, units: np.ndarray, first: int, fresh: list[_Fresh], value: np.ndarray, top: float, spare: _Spare) -> list:
        own = fresh[0]
        n = min(int(own.size[d]), _STEPS)
        begin, size = int(own.begin[d]), int(own.size[d])
        ahead = np.append(own.before[d, :n], own.before[d, n - 1] + own.log[begin + n - 1])
        value, ahead = self._more(own, d, n, value[:n].copy(), ahead, top)
        # of each path: edges, value and log-chance before each step, as far as its groups can matter
        paths = [(own.edges[begin : begin + size], value, ahead)]
        found = [(paths[0][0], float(own.total[d]), top)]
        narrowed: list[tuple[float, int, int, frozenset]] = []  # groups of which pieces were taken
        while True:
            best, source, step, taken = -math.inf, 0, 0, frozenset()
            for p, (edges, value, _) in enumerate(paths):
                i = int(value.argmax())
                if value[i] > best:
                    best, source, step, taken = float(value[i]), p, i, frozenset((int(edges[i]),))
            for g in narrowed:
                if g[0] > best:
                    best, source, step, taken = g
            if len(found) == self.k or best == -math.inf:
                break
            old, value, ahead = paths[source]
            value[step] = -math.inf
            narrowed = [g for g in narrowed if (g[1], g[2]) != (source, step)]
            # the piece taken from the group, and what is left of the group
            here, unit = self._state_of(grid, old, step, units)
            edge = int(grid.first[here])
            options = [e for e in range(edge, edge + int(grid.count[here])) if e not in taken]
            chance = [math.exp(grid.log[e]) for e in options]
            pick, u = options[-1], spare() * math.fsum(chance)
            for e, c in zip(options, chance, strict=True):
                if u < c:
                    pick = e
                    break
                u -= c
            rest = math.fsum(c for e, c in zip(options, chance, strict=True) if e != pick)
            if rest > 0:
                narrowed.append((float(_capped(ahead[step] + math.log(rest), _gumbel(spare()), best)), source, step, taken | {pick}))
            # on to the end of the unit, each step with its own group, then this sample's fresh draw
            tail, before, groups = [pick], [float(ahead[step])], [-math.inf]
            here, left = here + int(grid.width[pick]), int(grid.left[here]) - int(grid.width[pick])
            log = before[0] + float(grid.log[pick])
            while left > 0:
                e, u = int(grid.first[here]), spare()
                while u > grid.sum[e]:
                    e += 1
                tail.append(e)
                before.append(log)
                groups.append(float(_capped(log + _log_rest(grid.log[e]), _gumbel(spare()), best)))
                log += float(grid.log[e])
                here, left = here + int(grid.width[e]), left - int(grid.width[e])
            own = fresh[len(found)]
            begin = int(own.begin[d])
            low, high = int(own.at[first + unit + 1]) - begin, int(own.size[d])
            n = min(high, _STEPS)
            if low < n:
                skipped = float(own.before[d, low])
                part = own.before[d, low:n] + (log - skipped)
                group = _capped(part, own.lift[d, low:n], best)
                after = float(part[-1] + own.log[begin + n - 1])
                whole = log + float(own.total[d]) - skipped
            else:
                part, group, after, n = np.zeros(0), np.zeros(0), log, low
                whole = log + float(own.log[begin + low : begin + high].sum())
            value = np.concatenate([np.full(step, -math.inf), groups, group])
            ahead = np.concatenate([ahead[:step], before, part, [after]])
            value, ahead = self._more(own, d, n, value, ahead, best)
            edges = np.concatenate([old[:step], tail, own.edges[begin + low : begin + high]])
            paths.append((edges, value, ahead))
            found.append((edges, whole, best))
        out = []
        for edges, log, value in found:
            chance = -math.expm1(-math.exp(log - best)) if best > -math.inf and log - best < 30 else 1.0
            inclusion = math.log(chance) if chance > 1e-12 else log - best
            out.append((self._ids(grid, edges, units), log, value, inclusion))
        return out

    def _state_of(self, grid: Lattice, edges: np.ndarray, step: int, units: np.ndarray) -> tuple[int, int]:
        """(state, unit number) at which a step of a path starts."""
        before = int(grid.width[edges[:step]].sum())
        # units have a character at least: the step lies within the first `before` + 1
        ends = np.cumsum(grid.left[grid.start[units[: before + 1]]])
        unit = int(np.searchsorted(ends, before, side="right"))
        return int(grid.start[units[unit]]) + before - (int(ends[unit - 1]) if unit else 0), unit

    def _ids(self, grid: Lattice, edges: np.ndarray, units: np.ndarray) -> np.ndarray:
        kind = grid.kind[edges]
        spelled = np.flatnonzero(kind == _BYTES)
        if not len(spelled):
            return kind
        width = grid.width[edges]
        place = np.concatenate([[0], np.cumsum(width)[:-1]])[spelled]
        ends = np.cumsum(grid.left[grid.start[units]])
        unit = np.searchsorted(ends, place, side="right")
        code = grid.code[grid.start[units[unit]] + place - np.where(unit > 0, ends[unit - 1], 0)]
        parts, at = [], 0
        for k, c in zip(spelled.tolist(), code.tolist(), strict=True):
            parts.append(kind[at:k])
            parts.append(self.pieces.of_byte(np.frombuffer(chr(c).encode("utf-8"), dtype=np.uint8)))
            at = k + 1
        return np.concatenate([*parts, kind[at:]])


def _batches(batch: pa.RecordBatch, most: int):
    """Rows of a batch in lists of bounded length of text and of _ROWS rows at most; a longer text stands alone."""
    ids, texts = batch.column(0), batch.column(1)
    own_ids, own, weight = [], [], 0
    for i, t in zip(ids, texts, strict=True):
        t = t.as_py()
        if own and (weight + len(t or "") > most or len(own) == _ROWS):
            yield own_ids, own
            own_ids, own, weight = [], [], 0
        own_ids.append(i.as_py())
        own.append(t)
        weight += len(t or "")
    if own:
        yield own_ids, own


def sample_segmentations(df: DataFrame, path: str, k: int = 2, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", ids: bool = True, digest: bool = False, batch_chars: int = BATCH_CHARS, keep_vocabulary: bool = True, one_row: bool = False) -> DataFrame:
    """Up to k distinct sampled segmentations of each row's whole text, best perturbed value first.

    doc_id, sample_no (from 1), n_tokens, log_prob, perturbed, log_inclusion; with ids the piece
    ids as little-endian 32-bit integers (token_ids, binary), with digest their SHA-256
    (ids_sha256) and round_trip: whether the ids decode to the text (not where it holds
    U+2581, which the pieces write for a space). The row key seeds the noise,
    so equal keys and texts give equal samples, whatever batch_chars (the text worked on at once,
    which bounds memory); a null key counts as 0. A null or empty text has
    one segmentation, the empty one. Fewer than k rows come only where no more segmentations
    exist. An empty table gives none; other columns are not read. keep_vocabulary: a worker keeps
    the vocabulary for its next task; without, it is read again for each and the memory is free
    for whatever the worker does next. one_row: a row for each row of df, with the best sample's
    columns and, in `more`, an array of structs with those of all others.
    """
    names = ["doc_id long", "sample_no int", "n_tokens long", "log_prob double", "perturbed double", "log_inclusion double"]
    names += ["token_ids binary"] * ids + ["ids_sha256 string", "round_trip boolean"] * digest
    own_names = names[1:]
    names += [f"more array<struct<{', '.join(own_names)}>>"] * one_row

    def run(batches):
        import hashlib

        sampler = Sampler(pieces_at(path), k, seed)
        kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}
        kind_of = lambda n: (n.split()[0], kinds[n.split()[1]])
        schema = pa.schema([kind_of(n) for n in ["doc_id long", *own_names]] + [("more", pa.list_(pa.struct([kind_of(n) for n in own_names])))] * one_row)
        for batch in batches:
            for keys, texts in _batches(batch, batch_chars):
                rows = []
                for key, text, found in zip(keys, texts, sampler.sample(keys, texts), strict=True):
                    samples = []
                    for no, (own, log, value, inclusion) in enumerate(found, 1):
                        row = [key, no, len(own), log, value, inclusion]
                        raw = own.astype("<i4").tobytes()
                        if ids:
                            row.append(raw)
                        if digest:
                            row += [hashlib.sha256(raw).hexdigest(), sampler.pieces.decode(own) == (text or "")]
                        samples.append(row)
                    rows += [[*samples[0], [dict(zip(schema.names[1:], x[1:], strict=False)) for x in samples[1:]]]] if one_row else samples
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        if not keep_vocabulary:
            del sampler
            pieces_at.cache_clear()
            give_back()

    return df.select(id_col, text_col).mapInArrow(run, ", ".join(names))


def decode_ids(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """doc_id and text of each row of df with token_ids as sample_segmentations writes them; null ids give a null text."""

    def run(batches):
        pieces = pieces_at(path)
        for batch in batches:
            texts = [None if raw.as_py() is None else pieces.decode(np.frombuffer(raw.as_py(), "<i4")) for raw in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(texts, type=pa.string())], names=["doc_id", "text"])

    return df.select(id_col, ids_col).mapInArrow(run, "doc_id long, text string")
