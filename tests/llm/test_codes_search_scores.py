"""Vector codes, lexical search and language-model scores against brute force, and on odd rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import language_model, lexical_search, vector_codes

# ---- vector codes


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 40), st.integers(1, 5), st.integers(1, 6), st.integers(0, 10**6))
def test_trees_find_the_first_of_the_nearest(entries, width, spread, seed):
    rng = np.random.default_rng(seed)
    points, queries = rng.integers(-spread, spread + 1, (entries, width)), rng.integers(-2 * spread, 2 * spread + 1, (60, width))
    index, square = vector_codes.VantageTree(points, leaf=3).nearest(queries)
    every = ((queries[:, None] - points[None]) ** 2).sum(axis=2)
    assert (index == every.argmin(axis=1)).all() and (square == every.min(axis=1)).all()


def test_trees_leave_entries_unseen():
    points = np.random.default_rng(3).integers(-500, 500, (256, 2))
    tree = vector_codes.VantageTree(points)
    tree.nearest(points)
    assert tree.seen < 256 * 256 / 4


def plain_codes(rows, parts, entries, rounds):
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    cut = lambda v: [v[p * len(v) // parts : (p + 1) * len(v) // parts] for p in range(parts)]
    first = {}
    for i, v, _ in kept:
        if i is not None:
            first[i] = min(first.get(i, v), v)
    books = [[cut(first[i])[p] for i in sorted(first)[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    pick = lambda v, p: min((far(cut(v)[p], e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            own = [[cut(v)[p] for _, v, _ in kept if pick(v, p)[1] == k] for k in range(len(books[p]))]
            new.append([[sum(c) // len(g) for c in zip(*g, strict=True)] if g else books[p][k] for k, g in enumerate(own)])
        books = new
    out = [(i, "".join(f"{pick(v, p)[1]:02x}" for p in range(parts)), sum(pick(v, p)[0] for p in range(parts)), label) for i, v, label in kept]
    sums = Counter()
    for _, _, e, label in out:
        sums[label] += e
    return sorted(((i, c, e, sums[label]) for i, c, e, label in out), key=repr)


def test_codes_of_odd_rows(spark):
    rng = random.Random(5)
    rows = [(k, [rng.choice([-0.5, 0.25, 0.001, -0.002, 1.5]) for _ in range(8)], k % 3 or None) for k in range(40)]
    rows += [(None, rows[0][1], 1), (3, rows[7][1], 2), (3, rows[3][1], 2), (41, None, 1), (42, [None] + rows[0][1][1:], 1), (43, [float("nan")] * 8, 1), (44, [float("inf")] * 8, None)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<float>, label int, code string, _v string")
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    got = vector_codes.compress_vectors(df, entries=6, rounds=3).collect()
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=repr) == plain_codes(rows, 4, 6, 3)
    assert len({r.codebooks_sha256 for r in got}) == 1
    assert vector_codes.compress_vectors(df.limit(0)).collect() == []
    for bad in ([0.0] * 7, [0.0] * 12, [1e9] * 8):
        with pytest.raises(ValueError):
            vector_codes.compress_vectors(spark.createDataFrame([(1, [0.5] * 8, 1), (2, bad, 1)], "vec_id long, embedding array<double>, label int"))


# ---- lexical search

WORDS = "the a of corpus spark word Ärger naïve x1 rare block max wand tree".split()


def plain_search(docs, items, k):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    own = [(i, Counter(cut(t))) for i, t in docs]
    n, total = sum(1 for _, c in own if c), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    queries = {}
    for q, t in items:
        queries.setdefault(q, set()).update(cut(t))
    out = []
    for q, ts in queries.items():
        scored = []
        for i, c in own:
            m = 10 + (90 * sum(c.values()) * n) // max(1, total)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in ts if c[t])
            if score > 0:
                scored.append((-score, i is None, i, score))
        out += [(q, r, x[2], x[3]) for r, x in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=repr)


def test_search_equals_scoring_of_all(spark):
    rng = random.Random(7)
    text = lambda n: "".join(rng.choices(WORDS)[0] + rng.choice([" ", ", ", "\n", "\x00", "-"]) for _ in range(n))
    docs = [(k, text(rng.randrange(60))) for k in range(900)] + [(None, "rare Wand"), (7, "rare wand"), (7, "rare wand"), (8, None), (9, ""), (10, " .,; "), (11, "wand " * 9000)]
    items = [(k, text(rng.randrange(8))) for k in range(12)] + [(None, "rare tree"), (50, None), (51, ""), (52, "nowhere"), (53, "RARE"), (53, "wand")]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, score string, rank int").repartition(5)
    queries = spark.createDataFrame([(*i, 0.5) for i in items], "item_id long, text string, score double")
    want = plain_search(docs, items, 10)
    for only, size in ((lexical_search.query_terms(queries), 1 << 24), (None, 3000)):
        index = lexical_search.index_documents(df, only=only, segment_bytes=size).cache()
        for query_bytes in (1 << 24, 40):
            got = lexical_search.search(index, queries, query_bytes=query_bytes)
            assert sorted((tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()), key=repr) == want
    assert lexical_search.search_documents(df.limit(0), queries).collect() == [] == lexical_search.search_documents(df, queries.limit(0)).collect()


def test_blocks_below_the_threshold_stay_packed():
    rng = random.Random(1)
    texts = [" ".join(rng.choices(["a", "b", "c"], k=20)) for _ in range(6000)]
    texts[3] = "a rare rare wand"
    seg = lexical_search.segment(list(range(6000)), texts)
    s = lexical_search.Searcher([[(b"a", 10), (b"rare", 9000), (b"wand", 9000)]], lexical_search.Corpus(6000, 120000), 1)
    s.add(seg)
    assert s.found()[0][1] == 3 and s.unpacked < s.blocks / 3
    assert max(seg["size"]) <= lexical_search.BLOCK and seg["size"][0] == lexical_search.BLOCK


# ---- language model


def plain_scores(rows, order, rounds=20, tolerance=1e-5):
    """Every count by tuples of words, and the same learning in plain Python."""
    role = lambda i: 0 if i is None or zlib.crc32(str(i).encode()) % 10 == 0 else 1 if zlib.crc32(str(i).encode()) % 10 == 1 else 2
    lines = [(i, ["<s>"] * (order - 1) + re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) + [None]) for i, t in rows]
    kept, whole = ({"gram": Counter(), "context": Counter()} for _ in range(2))
    for i, ts in lines:
        for table in (kept, whole) if role(i) == 2 else (whole,) if role(i) == 1 else ():
            for k in range(order - 1, len(ts)):
                for n in range(order):
                    table["gram"][tuple(ts[k - n : k + 1])] += 1
                    table["context"][tuple(ts[k - n : k])] += 1
    even = lambda b: [1 / (b // 64 + 2) if k <= b // 64 + 1 else 0.0 for k in range(order + 1)]
    vocabulary = lambda table: sum(len(g) == 1 for g in table["gram"])

    def events(table, ts):
        total, words = table["context"][()], vocabulary(table)
        for k in range(order - 1, len(ts)):
            p, b = [1 / (words + 1), table["gram"][(ts[k],)] / max(1, total)], 0
            for n in range(1, order):
                c = table["context"][tuple(ts[k - n : k])]
                p.append(table["gram"][tuple(ts[k - n : k + 1])] / c if c else 0.0)
                b = 64 * n + c.bit_length() - 1 if c else b
            yield b, tuple(p), table["gram"][(ts[k],)]

    seen = Counter((b, p) for i, ts in lines if role(i) == 1 for b, p, _ in events(kept, ts))
    weights, sums, before = {b: even(b) for b, _ in seen}, {}, None
    for _ in range(rounds if seen else 0):
        sums, now = {b: [0.0] * (order + 2) for b in weights}, 0.0
        for (b, p), n in seen.items():
            share = [w * x for w, x in zip(weights[b], p, strict=True)]
            now += n * math.log(sum(share))
            sums[b] = [x + n * y for x, y in zip(sums[b], [1, *(s / sum(share) for s in share)], strict=True)]
        weights = {b: [(x + e) / (s[0] + 1) for x, e in zip(s[1:], even(b), strict=True)] for b, s in sums.items()}
        if before is not None and now - before <= tolerance * abs(before):
            break
        before = now
    pooled = {}
    for level in {b // 64 for b in sums}:
        s = [sum(x) for x in zip(*(sums[b] for b in sums if b // 64 == level), strict=True)]
        pooled[level] = [(x + e) / (s[0] + 1) for x, e in zip(s[1:], even(64 * level), strict=True)]
    out, total, words = [], whole["context"][()], vocabulary(whole)
    for i, ts in lines:
        found = [(c, sum(w * x for w, x in zip(weights.get(b) or pooled.get(b // 64) or even(b), p, strict=True))) for b, p, c in events(whole, ts)]
        out.append((i, i is not None and role(i) == 0, len(found), sum(c > 0 for c, _ in found), total, sum(math.log10((c + 0.1) / (total + 0.1 * (words + 1))) for c, _ in found), sum(math.log10(p) for _, p in found)))
    return out


def same_scores(got, want):
    key = lambda r: repr((r[0], r[2], round(r[5], 6)))
    got, want = sorted((tuple(r) for r in got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for a, b in zip(got, want, strict=True):
        assert a[5:] == pytest.approx(b[5:], rel=1e-10)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_plain_counting(spark, order):
    rng = random.Random(order)
    rows = [(k, " ".join(rng.choices(WORDS, weights=range(1, 15), k=rng.randrange(40)))) for k in range(120)]
    rows += [(None, "the corpus"), (5, None), (6, ""), (7, " \t\n"), (5, "again again"), (5, "again again"), (130, "the " * 3000), (131, "unseen\x1fword   x")]
    df = spark.createDataFrame([(*r, "x", "y", 3) for r in rows], "doc_id long, text string, role string, batch string, score int")
    saved = df.coalesce(3)
    same_scores(language_model.score_documents(saved, order=order, batch_bytes=2000, bucket_bytes=1500).collect(), plain_scores(rows, order))


def test_scores_without_training_rows(spark):
    rows = [(i, "some words") for i in range(60) if zlib.crc32(str(i).encode()) % 10 == 0]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    same_scores(language_model.score_documents(df).collect(), plain_scores(rows, 2))
    assert language_model.score_documents(df.limit(0)).collect() == []


def test_longer_contexts_help_on_held_out_rows(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    total = [sum(r.score for r in language_model.score_documents(df, order=n).collect() if r.held_out) for n in (1, 2, 3)]
    base = sum(r.base_score for r in language_model.score_documents(df).collect() if r.held_out)
    assert total[2] > total[1] > total[0] > base
