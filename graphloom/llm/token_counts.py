"""Token counts of byte-level BPE by rank-synchronous array merging.

The distinct pre-tokens of a batch of texts are held as one ragged numpy array of symbols.
In each round every sequence finds its own lowest-rank adjacent pair, all occurrences of
that pair in it merge at once, and sequences without a known pair leave the array. What
survives is counted. A merge can only create pairs of a higher rank than its own, so the
rounds give the same symbols as merging one pair at a time. A very long pre-token takes many
rounds that each change little of it; it keeps the places of its pairs by rank instead, and a
round touches only those of the lowest.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import cache, cached_property

import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import mapped

#: The byte-level pre-tokenisation pattern of the public vocabulary.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: Bytes from which on a pre-token is merged by places.
LONG = 2048


def byte_letters() -> dict[str, int]:
    """The printable letters by which byte-level vocabularies write the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class BpeCounter:
    """Counts tokens as the `tokenizers` library does without added begin and end tokens.

    Added tokens that stand in a text are matched first and count 1 each, which is that
    library's default. cache: at most so many distinct pre-tokens are remembered.
    """

    def __init__(self, path: str, cache: int = 400_000):
        spec = json.load(open(path, encoding="utf-8"))
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("only byte-level BPE without prefix space and normaliser is counted")
        vocab, letters = model["vocab"], byte_letters()
        self.of_byte = np.full(256, -1, dtype=np.int64)
        for letter, b in letters.items():
            self.of_byte[b] = vocab.get(letter, -1)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.width = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.none = len(pairs)
        self.pattern = regex.compile(PRETOKEN)
        added = sorted((t["content"] for t in spec.get("added_tokens", ())), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        self.marks = added
        self.cache, self.most = {}, cache

    @cached_property
    def ranks(self) -> dict[int, int]:
        return dict(zip(self.keys.tolist(), self.rank.tolist(), strict=True))

    def merged_by_places(self, token: bytes) -> int:
        """Symbols that survive in one token: the rounds of merged(), each over the lowest rank's places only."""
        symbol = self.of_byte[np.frombuffer(token, dtype=np.uint8)].tolist()
        n, ranks, width = len(symbol), self.ranks, self.width
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        places: dict[int, list[int]] = {}

        def note(at: int) -> None:
            rank = ranks.get(symbol[at] * width + symbol[after[at]])
            if rank is not None:
                if rank not in places:
                    places[rank] = []
                    heapq.heappush(heap, rank)
                places[rank].append(at)

        heap: list[int] = []
        for at in range(n - 1):
            note(at)
        count = n
        while heap:
            rank = heapq.heappop(heap)
            made = int(self.made[rank])
            for at in sorted(places.pop(rank)):
                gone = after[at]
                # merged away, or changed, since it was noted
                if symbol[at] < 0 or gone >= n or ranks.get(symbol[at] * width + symbol[gone]) != rank:
                    continue
                symbol[at], symbol[gone] = made, -1
                after[at] = after[gone]
                if after[at] < n:
                    before[after[at]] = at
                    note(at)
                if before[at] >= 0:
                    note(before[at])
                count -= 1
        return count

    def merged(self, tokens: list[bytes]) -> np.ndarray:
        """Symbols that survive in each token."""
        long = [k for k, t in enumerate(tokens) if len(t) >= LONG]
        if long:
            out = np.zeros(len(tokens), dtype=np.int64)
            out[long] = [self.merged_by_places(tokens[k]) for k in long]
            rest = [k for k, t in enumerate(tokens) if len(t) < LONG]
            out[rest] = self.merged([tokens[k] for k in rest])
            return out
        size = np.array([len(t) for t in tokens], dtype=np.int64)
        counts = size.copy()
        owner = np.repeat(np.arange(len(tokens)), size)
        symbol = self.of_byte[np.frombuffer(b"".join(tokens), dtype=np.uint8)]
        while len(symbol) > 1:
            same = owner[1:] == owner[:-1]
            key = symbol[:-1] * self.width + symbol[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where(same & (self.keys[at] == key), self.rank[at], self.none)
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            rank = np.append(rank, self.none)
            low = np.minimum.reduceat(rank, first)
            span = np.diff(np.append(first, len(symbol)))
            live = low < self.none
            if not live.any():
                break
            low_at = np.repeat(low, span)
            hit = (rank == low_at) & (rank < self.none)
            # in a run of overlapping hits (a pair of equal symbols), every second one merges, from the left
            run = hit & np.r_[False, hit[:-1]] & np.r_[False, owner[1:] == owner[:-1]]
            if run.any():
                index = np.arange(len(hit))
                start = np.maximum.accumulate(np.where(hit & ~run, index, 0))
                hit &= (index - start) % 2 == 0
            place = np.flatnonzero(hit)
            symbol[place] = self.made[rank[place]]
            np.subtract.at(counts, owner[place], 1)
            keep = np.repeat(live, span)
            keep[place + 1] = False
            symbol, owner = symbol[keep], owner[keep]
        return counts

    def learn(self, unseen: list[str]) -> None:
        if len(self.cache) + len(unseen) > self.most:
            self.cache.clear()
        for at in range(0, len(unseen), 50_000):
            part = unseen[at : at + 50_000]
            self.cache.update(zip(part, self.merged([t.encode("utf-8") for t in part]).tolist(), strict=True))

    def count(self, texts: list[str | None]) -> list[int]:
        found, total = [], []
        for text in texts:
            text, extra = text or "", 0
            if self.special and any(m in text for m in self.marks):
                parts = self.special.split(text)
                extra = len(parts) - 1
                tokens = [t for p in parts for t in self.pattern.findall(p)]
            else:
                tokens = self.pattern.findall(text)
            found.append(tokens)
            total.append(extra)
        distinct = set().union(*found) if found else set()
        unseen = [t for t in distinct if t not in self.cache]
        if unseen:
            if len(self.cache) + len(unseen) > self.most:
                self.cache.clear()
                unseen = list(distinct)
            self.learn(unseen)
        get = self.cache.__getitem__
        return [n + sum(map(get, tokens)) for n, tokens in zip(total, found, strict=True)]


@cache
def counter_at(path: str) -> BpeCounter:
    """A counter, made once in each process."""
    return BpeCounter(path)


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of df.

    A null text counts as empty (0 bytes, 0 tokens); a null id stays null; repeated rows give
    repeated results; an empty table gives none; other columns of df are not read. path: a
    vocabulary file that every executor can open at the same place.
    """

    def make():
        counter = counter_at(path)

        def work(columns):
            ids, texts = columns
            n = counter.count(texts)
            return {"doc_id": ids, "n_bytes": [len((t or "").encode("utf-8")) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

        return work

    return mapped(df, [id_col, text_col], "doc_id long, n_bytes long, n_tokens long, over_limit boolean", make, rows=256)
