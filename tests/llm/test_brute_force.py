"""Operators against plain reimplementations on small data."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pytest

from graphloom.llm import components, decontaminate, license_scan, near_dup, quality_classifier, quality_rules, secret_scan, sentencepiece_sample, suffix_dedup, token_counts
from graphloom.llm.queries import vocabulary


def words(rng, n, size=60):
    return [rng.choice("abcdefghij") + str(rng.randrange(size)) for _ in range(n)]


def near_copies(seed=1, n=160):
    """(doc_id, text): fresh texts, exact copies and copies with a few words changed."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        if rows and rng.random() < 0.6:
            own = rng.choice(rows)[1].split(" ")
            for _ in range(rng.choice((0, 0, 1, 2, 4))):
                own[rng.randrange(len(own))] = "z" + str(rng.randrange(999))
        else:
            own = words(rng, rng.randrange(1, 160))
        rows.append((i * 3 + 1, " ".join(own)))
    return rows


def brute_components(rows, percent):
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in rows if (w := t.lower().split())}
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if label[b] < label[a] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    label[a], changed = label[b], True
    return label


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates(spark, percent):
    rows = near_copies()
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_components(rows, percent)


def test_near_duplicates_across_blocks(spark, monkeypatch):
    rows = near_copies(4)
    monkeypatch.setattr(near_dup, "BLOCK_SHINGLES", 400)  # clusters then split into many blocks
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_components(rows, 85)


def test_circulant_coordinates_estimate_jaccard():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 900).astype(np.uint64)
    ring = near_dup.Circulant(50)
    a, b = ring.signature(base[:600]), ring.signature(base[300:])
    assert abs((a == b).mean() - 300 / 900) < 0.1


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(0, k) for k in range(90, 140)] + [(None, 3), (5, 5)]
    label = {k: k for k in range(200)}
    for _ in range(200):
        for u, v in links:
            if u is not None:
                label[u] = label[v] = min(label[u], label[v])
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    ends = {x for u, v in links if u is not None and u != v for x in (u, v)}
    assert got == {k: label[k] for k in ends}


@pytest.mark.parametrize("most", [suffix_dedup.MOST_CONTEXTS, 1])
def test_repeats(spark, most):
    rng, rows = random.Random(5), []
    pool = ["".join(rng.choice("abc é\n") for _ in range(rng.randrange(60, 400))) for _ in range(12)]
    for i in range(90):
        parts = [rng.choice(pool) if rng.random() < 0.5 else "".join(rng.choice("abcdefg ") for _ in range(rng.randrange(150))) for _ in range(rng.randrange(5))]
        rows.append((i * 7 % 100, "".join(p[rng.randrange(20) :] for p in parts)))
    rows.append((200, "ab" * 400))
    seen, want = set(), {}
    for i, t in sorted(rows):
        raw = t.encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - 99):
            span = raw[s : s + 100]
            if span in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(span)
        runs = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        want[i] = (len(raw), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest())
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.remove_repeats(df, most_contexts=most).collect()}
    assert got == want


@pytest.mark.parametrize("most", [suffix_dedup.MOST_CONTEXTS, 1])
def test_passages_shorter_than_a_span(spark, most):
    rng = random.Random(8)
    fresh = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passage, rows = fresh(99), []
    for i in range(8):
        rows.append((i, fresh(120) + str(i) + passage + str(i) + fresh(120)))
    # keys with several contexts, and no repeat in any of their arrays
    got = [tuple(r) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), most_contexts=most).collect()]
    assert sorted(got) == [(i, len(t), 0, 0, hashlib.sha256(t.encode()).hexdigest()) for i, t in rows]


def test_arrays_without_repeats():
    for texts in ([], [b"abc"], [b"abcd", b"abce"], [b"aaa", b"b"]):
        array = suffix_dedup.SuffixArray(texts, 4)
        assert not len(array.length) and not list(array.later(np.arange(len(array.owner))))


def test_maximal_repeats_have_all_occurrences():
    rng = random.Random(3)
    for _ in range(60):
        texts = ["".join(rng.choice("ab\0") for _ in range(rng.randrange(1, 25))).encode() for _ in range(rng.randrange(1, 5))]
        places = collections.defaultdict(set)
        for k, t in enumerate(texts):
            for a in range(len(t)):
                for b in range(a + 3, len(t) + 1):
                    places[t[a:b]].add((k, a))
        want = set()
        for s, at in places.items():
            left = {texts[k][a - 1 : a] if a else (k, a) for k, a in at}
            right = {texts[k][a + len(s) : a + len(s) + 1] or (k, a) for k, a in at}
            if len(at) > 1 and len(left) > 1 and len(right) > 1:
                want.add((len(s), frozenset(at)))
        got = {(n, frozenset(zip(o.tolist(), p.tolist()))) for n, o, p in suffix_dedup.maximal_repeats(texts, 3)}
        assert got == want


def brute_tiles(a, b, least):
    free_a, free_b, out = [True] * len(a), [True] * len(b), []
    while True:
        best, found = least, []
        for p in range(len(b)):
            for t in range(len(a)):
                n = 0
                while p + n < len(b) and t + n < len(a) and free_b[p + n] and free_a[t + n] and a[t + n] == b[p + n] >= 0:
                    n += 1
                if n == best:
                    found.append((p, t, n))
                elif n > best:
                    best, found = n, [(p, t, n)]
        if not found:
            return out
        for p, t, n in found:
            if all(free_a[t : t + n]) and all(free_b[p : p + n]):
                free_a[t : t + n] = free_b[p : p + n] = [False] * n
                out.append((t, p, n))


def test_tiles_are_greedy():
    rng = random.Random(9)
    for _ in range(300):
        a = [rng.randint(-1, 3) for _ in range(rng.randint(0, 25))]
        b = [rng.randint(0, 3) for _ in range(rng.randint(0, 14))]
        least = rng.randint(1, 4)
        assert decontaminate.tile(np.array(a, dtype=np.int64), np.array(b, dtype=np.int64), least) == brute_tiles(a, b, least)


def test_leaks_in_another_order(spark):
    rng = random.Random(1)
    item = words(rng, 40)
    docs = [(1, " ".join(words(rng, 50) + item + words(rng, 9))), (2, " ".join(item[20:] + words(rng, 30) + item[:20]).upper()), (3, " ".join(words(rng, 200))), (4, " ".join(item[:20] + words(rng, 90)))]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(5, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: (r.item_id, r.n_covered, r.n_tiles) for r in decontaminate.find_leaks(df, bench).collect()}
    assert got == {1: (5, 40, 1), 2: (5, 40, 2)}
    assert sorted(r.doc_id for r in decontaminate.drop_leaks(df, bench).collect()) == [3, 4]


@pytest.mark.parametrize("broadcast", [decontaminate.BROADCAST_SEEDS, 0])
def test_leaks_of_many_items_with_a_template(spark, monkeypatch, broadcast):
    """Items share half of their words; a document with only the template matches none of them."""
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", broadcast)
    monkeypatch.setattr(decontaminate, "BROADCAST_KEYS", broadcast)
    rng = random.Random(6)
    template = words(rng, 15)
    items = [(k, " ".join(template + words(rng, 15, 500))) for k in range(1500)] + [(5000, "one two"), (5001, "one two three four five"), (None, "null id " + " ".join(template))]
    docs = [(k, "x " + items[k][1].upper() + " y") for k in range(0, 1500, 50)] + [(2000, " ".join(template * 3)), (2001, "zero one two"), (2002, "one two three four five six"), (2002, "one two three four five six")]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = []
    for i, t in docs:
        for j, u in items:
            own = decontaminate.words(u)
            known = {w: k for k, w in enumerate(dict.fromkeys(own))}
            if sum(w in decontaminate.words(t) for w in own) < 0.8 * len(own):
                continue
            tiles = brute_tiles([known.get(w, -1) for w in decontaminate.words(t)], [known[w] for w in own], min(5, len(own)))
            if sum(n for *_, n in tiles) >= 0.8 * len(own):
                want.append((i, j, sum(n for *_, n in tiles), len(tiles)))
    got = [(r.doc_id, r.item_id, r.n_covered, r.n_tiles) for r in decontaminate.find_leaks(df, bench).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {i for i, *_ in want} >= set(range(0, 1500, 50)) | {2001, 2002}
    kept = decontaminate.drop_leaks(df, bench).collect()
    assert sorted(r.doc_id for r in kept) == sorted({i for i, _ in docs} - {i for i, *_ in want})
    index = decontaminate.Index(bench, "item_id", "text", 0.8)
    assert index.seeds.groupBy("seed").count().agg({"count": "max"}).first()[0] < 30


def test_seeds_left_out_cannot_cover():
    rng = random.Random(2)
    for _ in range(200):
        n, size, share = rng.randrange(5, 60), 5, rng.choice((0.5, 0.8, 1.0))
        seeds = [(rng.randrange(1, 9), k, k) for k in range(n - size + 1)]
        kept = set(decontaminate.rare(seeds, n, size, share))
        inside = {k + j for _, k, h in seeds if h not in kept for j in range(size)}
        assert kept and len(inside) < share * n


def test_tokens_as_the_library_counts():
    from tokenizers import Tokenizer

    path, rng = vocabulary("byte_bpe_50k.json"), random.Random(4)
    texts = ["", "Hello  world", "aaaaaaaaaaaaa", "<|endoftext|>x<|endoftext|>", "é日本語\n\n\t  x's 12345", "".join(chr(rng.randrange(32, 0x2FFF)) for _ in range(3000)), " ".join(words(rng, 500))]
    texts += ["".join(rng.choice("ab ,.\n<|>endoftxé'") for _ in range(rng.randrange(200))) for _ in range(200)]
    want = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert token_counts.BpeCounter(path).count(texts) == want


def test_long_pretokens_as_the_library_counts():
    from tokenizers import Tokenizer

    path, rng = vocabulary("byte_bpe_50k.json"), random.Random(9)
    long = ["a" * 30_000, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20_000)), "the" * 9000 + " x", "é日" * 4000, "=" * 12_345, "ab" * 3000 + "".join(rng.choice("etaoin") for _ in range(5000))]
    texts = [*long, " ".join(long[:2]) + " and some words"]
    want = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    counter = token_counts.BpeCounter(path)
    assert counter.count(texts) == want
    short = [t.encode()[:1500] for t in long]
    assert [counter.merged_by_places(t) for t in short] == counter.merged(short).tolist()
    began = time.perf_counter()
    counter.count(["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(300_000))])
    assert time.perf_counter() - began < 30


def brute_ftrl(rows, bits, alpha=0.3, beta=1.0, l1=1e-3, l2=1e-2, epochs=4, scale=30.0):
    """FTRL-proximal on dictionaries, one coordinate at a time."""
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    ones = sum(y for _, y in rows)
    for _ in range(epochs):
        for buckets, y in rows:
            x = {b: scale * c / max(1, len(buckets)) for b, c in collections.Counter(buckets).items()} | {"bias": 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            cost = len(rows) / 2 / (ones if y else len(rows) - ones)
            for i, v in x.items():
                g = cost * (p - y) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
    return {i: weight(i) for i in z}


def brute_buckets(text, bits):
    """Buckets of tokens, pairs and pairs of shapes, in integers."""
    m, tokens = 2**64 - 1, re.findall(r"\w+|[^\w\s]+", text or "")
    crc = lambda t: zlib.crc32(t.encode())
    shape = lambda t: crc(t) if not (t[0].isalnum() or t[0] == "_") else crc("\0upper" if len(t) > 1 and t.isupper() else "\0title" if t[0].isupper() else "\0lower")
    again = [k > 0 and tokens[k] == tokens[k - 1] for k in range(len(tokens))]
    own = [crc("\0repeat") if a else crc(t) for t, a in zip(tokens, again)]
    form = [crc("\0repeat") if a else shape(t) for t, a in zip(tokens, again)]
    x = own + [(a * 0x9E3779B97F4A7C15 + b) & m for a, b in zip(own, own[1:])] + [(a * 0xC2B2AE3D27D4EB4F + b + 1) & m for a, b in zip(form, form[1:])]
    x = [((v ^ (v >> 29)) * 0xBF58476D1CE4E5B9) & m for v in x]
    return [(v ^ (v >> 32)) & (2**bits - 1) for v in x]


def test_classifier_against_plain_python():
    rng, bits = random.Random(3), 12
    texts = [" ".join(rng.choice(("The", "word", "word", "ISO", "!!!!!!!!!!", "!!!!!!!!!?", "x_1", "é", "#")) for _ in range(rng.randrange(1, 40))) for _ in range(40)] + ["", "one"]
    hasher = quality_classifier.Hasher(bits, cache=5)
    assert [hasher.buckets(t).tolist() for t in texts] == [brute_buckets(t, bits) for t in texts]
    labels = [int(t.count("word") > t.count("ISO")) for t in texts]
    model = quality_classifier.train([(hasher.buckets(t), y) for t, y in zip(texts, labels)], bits)
    want = brute_ftrl([(brute_buckets(t, bits), y) for t, y in zip(texts, labels)], bits)
    assert math.isclose(model.bias, want.pop("bias"), abs_tol=1e-6)
    assert all(math.isclose(model.weights[i], w, rel_tol=1e-4, abs_tol=1e-5) for i, w in want.items()) and np.count_nonzero(model.weights) == sum(w != 0 for w in want.values())
    for t in texts:
        own = brute_buckets(t, bits)
        dot = model.bias + (30 * sum(float(model.weights[b]) for b in own) / len(own) if own else 0)
        assert math.isclose(model.score(np.array(own, dtype=np.int64)), 1 / (1 + math.exp(-dot)), rel_tol=1e-5)


def test_classifier_bounds_hold_for_repeated_ids(spark):
    docs = spark.createDataFrame([(k % 20, f"word{k} is {'good' if k % 2 else 'bad'} " * (k + 1)) for k in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)], "doc_id long, quality int")
    seen = []
    train, quality_classifier.train = quality_classifier.train, lambda rows, bits: seen.append(rows) or train(rows, bits)
    try:
        quality_classifier.fit(docs, labels, bits=10)
        quality_classifier.fit(docs, labels, bits=10, max_bytes=12_000)
    finally:
        quality_classifier.train = train
    assert 10 < len(seen[0]) <= 20 and 0 < len(seen[1]) < len(seen[0]) and sum(4 * len(b) for b, _ in seen[1]) <= 12_000


def test_rule_statistics():
    rng = random.Random(8)
    for _ in range(200):
        text = "".join(rng.choice("ab ab\n #*$A1. é") for _ in range(rng.randrange(120)))
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = collections.Counter(zip(w, w[1:], w[2:]))
        inside = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert quality_rules.statistics(text)[:5] == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside))


def test_forest_isolates_outliers():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (500, 3)), [[9, 9, 9]]])
    score = quality_rules.IsolationForest(x).score(x)
    assert score.argmax() == 500 and score[500] > 2 * np.sort(score)[-2]


def documents(spark, sf="sf0.01"):
    d = f"/root/testdata/{sf}"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def test_rules_keep_good_and_drop_bad(spark):
    docs, labels = documents(spark)
    got = quality_rules.apply_rules(docs, quality_rules.fit(docs, labels)).join(labels, "doc_id").where("not base_failed").collect()
    good = [r.kept for r in got if r.quality == 1]
    bad = [r.kept for r in got if r.quality == 0]
    assert sum(good) / len(good) > 0.98 and sum(bad) / len(bad) < 0.3
    model = quality_rules.fit(docs, labels)
    kept = {r.doc_id for r in quality_rules.keep_good(docs, model).collect()}
    assert kept == {r.doc_id for r in quality_rules.apply_rules(docs, model).where("kept").collect()}


def test_classifier_on_held_out_rows(spark):
    docs, labels = documents(spark, "sf0.1")
    got = quality_classifier.score_documents(docs, quality_classifier.fit(docs, labels, max_rows=1500)).join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in got)
    assert sum(r.predicted == r.quality for r in got) / len(got) > 0.97


def test_licence_scan_bases_and_suppression():
    phrases = {p: label for p, label in license_scan.BASE_PHRASES}
    scanner, rng = license_scan.Scanner(), random.Random(2)
    vocabulary_ = [w for p in phrases for w in p.split()] + ["x", "É", "version", "2"]
    for _ in range(300):
        text = rng.choice((" ", ", ", "-")).join(rng.choice(vocabulary_).upper() if rng.random() < 0.3 else rng.choice(vocabulary_) for _ in range(rng.randrange(40)))
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        at = [(k, label) for p, label in phrases.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        got = license_scan.scan(text, scanner)
        assert (got["n_words"], got["n_base"], got["base_labels"]) == (len(w), len(at), ",".join(sorted({label for _, label in at})))
        assert (got["first_word"], got["last_word"]) == (min((k for k, _ in at), default=None), max((k for k, _ in at), default=None))
        assert {label for _, label in at} <= set(got["labels"].split(","))
    found = scanner.detect("licensed under the apache license version 2 0 see the gnu lesser general public license")
    assert [d.label for d in found] == ["apache-2.0", "lgpl"]


def test_suppression_against_all_pairs():
    rng = random.Random(4)
    for n in [*range(12)] * 20 + [300]:
        found = [license_scan.Detection(s, s + rng.randrange(1, 40), rng.choice("abc"), rng.choice((10, 20, 30)), 0.5) for s in (rng.randrange(60) for _ in range(n))]
        order = sorted(set(found), key=lambda d: (-d.priority, d.start - d.end, d.label, d.start))
        kept = []
        for d in order:
            if not any(k.start <= d.start and k.end >= d.end for k in kept):
                kept.append(d)
        assert license_scan.resolve(found) == sorted(kept)


def test_labels_against_ungated_rules():
    """Every rule over the whole text, without the keyword gate."""
    scanner, rng = license_scan.Scanner(most=20), random.Random(7)
    from re import _parser

    for _ in range(60):
        parts = [sample(_parser.parse(rng.choice(license_scan.RULES).pattern), rng) if rng.random() < 0.5 else rng.choice(("and so on", "see the license", "gnu", "x" * 30)) for _ in range(rng.randrange(6))]
        line = " ".join(" ".join(parts).split())
        found = [license_scan.Detection(m.start(), m.end(), r.label, r.priority, r.confidence) for r in license_scan.RULES for m in re.finditer(rf"(?<![^ ])(?:{r.pattern})(?![^ ])", line)]
        assert scanner.detect(line) == license_scan.resolve(found)
        assert set(filter(None, license_scan.scan(line, scanner)["labels"].split(","))) >= {d.label for d in license_scan.resolve(found)}


def test_very_many_detections():
    scanner = license_scan.Scanner()
    text = "licensed under the mit license, gnu general public license version 2\n" * 50_000
    got = license_scan.scan(text, scanner)
    assert got["n_base"] == 100_000 and got["labels"] == "gpl,gpl-2.0,mit" and got["n_detections"] >= 100_000


def sample(tree, rng):
    """A random text that a parsed pattern matches."""
    out = []
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            out.append(chr(arg))
        elif name == "ANY":
            out.append("x")
        elif name == "IN":
            out.append(chr(rng.choice([v for o, v in arg if str(o) == "LITERAL"] or [v for o, r in arg if str(o) == "RANGE" for v in range(r[0], r[1] + 1)])))
        elif name == "BRANCH":
            out.append(sample(rng.choice(arg[1]), rng))
        elif name == "SUBPATTERN":
            out.append(sample(arg[3], rng))
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            out += [sample(arg[2], rng) for _ in range(rng.randint(arg[0], min(arg[1], arg[0] + 2)))]
        else:
            raise ValueError(name)
    return "".join(out)


def test_keyword_gate_loses_nothing():
    """Each rule's keyword stands in whatever its pattern matches, so the prefilter is exact."""
    from re import _parser

    rng = random.Random(1)
    for rule in license_scan.RULES:
        tree = _parser.parse(rule.pattern)
        for _ in range(30):
            text = sample(tree, rng)
            assert re.fullmatch(rule.pattern, text) and rule.keyword in text, (rule, text)


def python_features(value, before, after):
    """The features of a candidate, written again in Python."""
    count = lambda p, s: len(re.findall(p, s))
    n = len(value)
    low = before.lower()
    dictionary = "|".join(sorted(secret_scan.DICTIONARY, key=lambda w: (-len(w), w)))
    s, p = secret_scan._SECRET_WORDS, secret_scan._PLAIN_WORDS
    is_ = lambda p, s: float(bool(re.search(p, s)))
    return [
        n,
        (count("[a-z](?=[^a-z])", value) + count("[A-Z](?=[^A-Z])", value) + count("[0-9](?=[^0-9])", value) + count("[^A-Za-z0-9](?=[A-Za-z0-9])", value)) / max(n - 1, 1),
        count("[0-9]", value) / n,
        count("[A-Z]", value) / n,
        count("[+/_-]", value) / n,
        is_(r"^(?:[0-9a-f]+|[0-9A-F]+)\Z", value),
        len(set(value)) / min(n, 64),
        count(r"(.)\1\1", value) / n,
        1 - len(re.sub(dictionary, "", value.lower())) / n,
        count("/", value) / n + is_(r"(?:[/\\.?&#]|://[^ ]*)\Z", before),
        is_(r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\Z", value),
        is_("^(?:-----BEGIN|AKIA|ASIA|gh[pousr]_|sk[-_](?:live|test|proj)|xox[abprs]-|AIza|eyJ|glpat-|npm_)", value),
        is_("example|xxxx|changeme|your[-_]|dummy|placeholder|redacted|12345678|abcdef01", value.lower()),
        is_("[=:]>?\\s*[\"'`]?\\Z", before),
        float(bool(re.search("[\"'`]\\Z", before)) and bool(re.match("[\"'`]", after))),
        is_(rf"(?:{s})[^a-z]{{0,12}}\Z", low),
        is_(rf"(?:{s})", low),
        is_(rf"(?<![a-z])(?:{p})[^a-z]{{0,12}}\Z", low),
    ]


def test_secret_scan_against_python(spark):
    forest = secret_scan.fit(spark)
    rows = [(k, f"{b}{v}{a} and {b}{v}") for k, (v, b, a, _) in enumerate(secret_scan.labelled_findings(240, 77))]
    rows.append((999, "x -----BEGIN RSA PRIVATE KEY----- y"))
    want = []
    for i, t in rows:
        for m in re.finditer(secret_scan.CANDIDATE, t):
            want.append((i, m.start(), len(m.group())))
    got = secret_scan.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string"), forest).collect()
    assert sorted((r.doc_id, r.start, r.n_chars) for r in got) == sorted(want)
    texts = dict(rows)
    for r in got:
        t = texts[r.doc_id]
        before = [m for m in re.finditer(secret_scan.CANDIDATE, t)]
        k = next(k for k, m in enumerate(before) if m.start() == r.start)
        around = secret_scan._AROUND
        features = python_features(before[k].group(), t[max(0, r.start - around) : r.start], t[before[k].end() : before[k].end() + around])
        assert math.isclose(r.score, forest.predict(features), abs_tol=2e-6)
        assert r.value_sha256 == hashlib.sha256(before[k].group().encode()).hexdigest()


def test_secret_forest_on_held_out_findings(spark):
    forest = secret_scan.fit(spark)
    rows = secret_scan.labelled_findings(400, 12345)
    right = sum((forest.predict(python_features(v, b, a)) >= 0.5) == bool(y) for v, b, a, y in rows)
    assert right / len(rows) > 0.95


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece_sample.Pieces(vocabulary("piece_bpe_32k.model"))


def test_segmentations_decode_as_the_library_does(pieces):
    import sentencepiece

    model, rng = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model")), random.Random(3)
    texts = [" Hello  wörld\nnew\tline", "日本語 emoji 🙂 ͸x", "a", "   ", "\n"] + ["".join(rng.choice("abc the\n é🙂") for _ in range(rng.randrange(60))) for _ in range(80)]
    for text, found in zip(texts, sentencepiece_sample.Sampler(pieces, 3).sample(list(range(len(texts))), texts), strict=True):
        assert len({tuple(i.tolist()) for i, *_ in found}) == len(found) >= 1
        for ids, log, value, inclusion in found:
            assert pieces.decode(ids.tolist()) == model.decode(ids.tolist()) == text
            assert log <= 1e-9 and inclusion <= 1e-9
        assert [f[2] for f in found] == sorted((f[2] for f in found), reverse=True)


def segmentations(pieces, text):
    """All segmentations of a short text with their chances, by enumeration."""
    by_text = {}
    for i, raw in enumerate(pieces.spelled):
        if raw and i not in set(pieces.byte.tolist()):
            by_text.setdefault(raw.decode(), i)
    text, out = " " + text, {}

    def walk(at, ids, weight):
        if at == len(text):
            out[ids] = weight
        for end in range(at + 1, len(text) + 1):
            if text[at:end] in by_text:
                i = by_text[text[at:end]]
                walk(end, (*ids, i), weight + pieces.weight[i])

    walk(0, (), 0.0)
    total = sum(map(math.exp, out.values()))
    return {ids: math.exp(w) / total for ids, w in out.items()}


def test_sampling_without_replacement(pieces):
    text, n, k = "of it", 3000, 3
    chance = segmentations(pieces, text)
    found = sentencepiece_sample.Sampler(pieces, k, 5).sample(list(range(n)), [text] * n)
    first = collections.Counter(tuple(f[0][0].tolist()) for f in found)
    second = collections.Counter(tuple(f[1][0].tolist()) for f in found)
    for ids, p in chance.items():
        again = sum(q * p / (1 - q) for other, q in chance.items() if other != ids)
        assert abs(first[ids] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-3
        assert abs(second[ids] / n - again) < 5 * math.sqrt(again * (1 - again) / n) + 1e-3
    # inclusion scores make sums over the samples unbiased
    estimate = np.mean([sum(math.exp(log - inclusion) for _, log, _, inclusion in f[:k]) for f in found])
    assert abs(estimate - 1) < 0.05
    assert all(math.isclose(math.exp(f[0][1]), chance[tuple(f[0][0].tolist())], rel_tol=1e-6) for f in found[:50])


def test_noise_depends_on_rows_not_batches(pieces):
    texts = [" ".join(words(random.Random(k), 40)) for k in range(6)]
    whole = sentencepiece_sample.Sampler(pieces, 2).sample(list(range(6)), texts)
    alone = [sentencepiece_sample.Sampler(pieces, 2).sample([k], [t])[0] for k, t in enumerate(texts)]
    assert all(np.array_equal(x[0], y[0]) and math.isclose(x[2], y[2]) for a, b in zip(whole, alone) for x, y in zip(a, b))


def test_all_segmentations_when_few(pieces):
    chance = segmentations(pieces, "a")
    found = sentencepiece_sample.Sampler(pieces, 10).sample([1], ["a"])[0]
    assert {tuple(f[0].tolist()) for f in found} == set(chance)
    assert all(f[3] == 0.0 for f in found)


def test_ids_table_round_trip(spark):
    docs, _ = documents(spark, "sf0.001")
    path = vocabulary("piece_bpe_32k.model")
    encoded = sentencepiece_sample.sample_segmentations(docs, path, k=1)
    back = {r.doc_id: r.text for r in sentencepiece_sample.decode_ids(encoded, path).collect()}
    assert back == {r.doc_id: r.text for r in docs.collect()}
