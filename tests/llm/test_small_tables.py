"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import pytest

from graphloom.llm import decontaminate, license_scan, near_dup, quality_classifier, quality_rules, secret_scan, sentencepiece_sample, suffix_dedup, token_counts, url_filter
from graphloom.llm.queries import vocabulary

LONG = "many words make a long text and " * 4000
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today.", "a", 1.0, "x"),
    (1, "The quick brown fox jumps over the lazy dog near the river bank today.", "a", 1.0, "x"),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today.", "b", None, None),
    (3, None, None, None, None),
    (4, "", "c", 0.5, "y"),
    (None, "A row without an id, Licensed under the MIT License.", "d", 0.1, "z"),
    (5, LONG, "e", 0.2, "w"),
    (6, " \n\t ", "e", 0.2, "w"),
]
SCHEMA = "doc_id long, text string, labels string, score double, kept string"
DOC_MARKS = [(1, 1), (2, 0), (None, 1), (4, None)]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    return docs, spark.createDataFrame(DOC_MARKS, "doc_id long, quality int"), spark.createDataFrame([(7, "brown fox jumps over the lazy dog"), (None, None), (8, ""), (9, "mit license")], "item_id long, text string")


def operators(spark, docs, labels, items):
    yield "licences", lambda d: license_scan.scan_licenses(d), len(ROWS)
    yield "leaks", lambda d: decontaminate.find_leaks(d, items), 4
    yield "rules", lambda d: quality_rules.apply_rules(d, quality_rules.fit(d, labels)), len(ROWS)
    forest = secret_scan.fit(spark, trees=3)
    yield "secrets", lambda d: secret_scan.scan_secrets(d, forest), 0
    yield "quality", lambda d: quality_classifier.score_documents(d, quality_classifier.fit(d, labels, bits=10)), len(ROWS)
    yield "near", lambda d: near_dup.near_duplicates(d), len(ROWS)
    yield "tokens", lambda d: token_counts.count_tokens(d, vocabulary("byte_bpe_50k.json")), len(ROWS)
    yield "pieces", lambda d: sentencepiece_sample.sample_segmentations(d, vocabulary("piece_bpe_32k.model"), digest=True), None
    yield "repeats", lambda d: suffix_dedup.remove_repeats(d), len(ROWS)


def test_every_operator_takes_odd_and_empty_tables(spark, tables):
    docs, labels, items = tables
    for name, run, rows in operators(spark, docs, labels, items):
        got = run(docs).collect()
        if rows is not None:
            assert len(got) == rows, name
        assert run(docs.limit(0)).collect() == [], name


def test_defined_results(spark, tables):
    docs, _, _ = tables
    near = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(docs).collect()}
    assert {(1, 10, 1, True), (2, 10, 1, False), (3, 0, 3, True), (4, 0, 4, True), (None, 6, None, True)} <= near
    got = {r.doc_id: r for r in license_scan.scan_licenses(docs).collect()}
    assert got[None].base_labels == "mit" and got[3].n_words == 0 and got[3].first_word is None and got[4].labels == ""
    rep = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs).collect()}
    assert rep[3].n_bytes == 0 and rep[1].n_removed == 0 and rep[5].n_removed == len(LONG) - len("many words make a long text and ")
    pieces = [r for r in sentencepiece_sample.sample_segmentations(docs, vocabulary("piece_bpe_32k.model"), digest=True).collect()]
    assert all(r.round_trip for r in pieces) and [r.n_tokens for r in pieces if r.doc_id == 3] == [0]


def test_pages(spark):
    rows = [(1, None, "u"), (2, "", "v"), (3, "no scheme", "w"), (None, "http://A.Example.ORG/es/1", "x"), (5, "http://x.org", "y"), (6, "http://x.com?/de/", "z"), (6, "http://x.com/de/#", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    got = [tuple(r) for r in url_filter.filter_urls(pages).collect()]
    assert sorted(got, key=str) == sorted(
        [
            (1, "", "", None, "allow"),
            (2, "", "", None, "allow"),
            (3, "", "", None, "allow"),
            (None, "a.example.org", "/es/1", "example.org/es/", "block"),
            (5, "x.org", "", None, "allow"),
            (6, "x.com", "", None, "allow"),
            (6, "x.com", "/de/", "com/de/", "block"),
        ],
        key=str,
    )
    assert url_filter.filter_urls(pages.limit(0)).collect() == []


def test_masking_keeps_rows_and_columns(spark, tables):
    docs, _, _ = tables
    extra = spark.createDataFrame([(9, 'token = "9f14a7029c8514dfe98aba92898d323168e199da" and order 9807915762804490', "q", 0.1, "k")], SCHEMA)
    forest = secret_scan.fit(spark)
    got = secret_scan.mask_secrets(docs.unionByName(extra), forest)
    assert got.columns == docs.columns
    texts = {r.doc_id: r.text for r in got.collect()}
    assert texts[9] == 'token = "[SECRET]" and order 9807915762804490' and texts[3] is None and texts[5] == LONG


def test_many_rules_against_brute_force(spark):
    """5,000 rules of many shapes, as tuples broadcast and as a table joined by shuffles."""
    import random

    rng = random.Random(3)
    names = ["a", "bb", "example", "news", "shop", "x1"]
    host = lambda: ".".join([*(rng.choice(names) for _ in range(rng.randrange(3))), rng.choice(names) + str(rng.randrange(40)), rng.choice(("org", "com"))])
    path = lambda n: "".join("/" + rng.choice(names) for _ in range(rng.randrange(n)))
    rules = [(rng.choice(("allow", "block")), host(), (path(5) + "/" * 3)[: rng.randrange(40)]) for _ in range(5000)]
    urls = [(k, f"http://{host()}{path(9)}/") for k in range(400)] + [(500, "http://" + "deep." * 3000 + "a1.org/shop")]
    best = {}
    for v, h, p in rules:
        best[h, p] = max(v, best.get((h, p), ""))
    want = {}
    for i, u in urls:
        h, _, p = u[7:].partition("/")
        fits = [(len(rh) + len(rp), len(rh), rh + rp, v) for (rh, rp), v in best.items() if (h == rh or h.endswith("." + rh)) and ("/" + p).startswith(rp)]
        want[i] = max(fits)[2:] if fits else (None, "allow")
    pages = spark.createDataFrame(urls, "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules).collect()}
    assert got == want and sum(r is not None for r, _ in want.values()) > 50
    before, url_filter.BROADCAST_RULES = url_filter.BROADCAST_RULES, 10
    try:
        table = spark.createDataFrame([(*r, k) for k, r in enumerate(rules)], "verdict string, host string, path string, page_id int")
        assert {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(pages, table).collect()} == want
    finally:
        url_filter.BROADCAST_RULES = before
    with pytest.raises(Exception, match="verdict maybe"):
        url_filter.filter_urls(pages, [("maybe", "a.org", "/")]).collect()


def test_very_long_texts(spark, tables):
    """10 MB of distinct words, one word of 1 MB, and a copy of the former with a word changed."""
    _, labels, items = tables
    words = [f"w{k}" for k in range(1_250_000)]
    other = [*words[:600_000], "changed", *words[600_001:]]
    word = "".join(chr(97 + k * k % 26) for k in range(1_000_000))
    rows = [(1, " ".join(words)), (2, word), (3, " ".join(other))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sizes = {i: len(t) for i, t in rows}
    got = {r.doc_id: r for r in license_scan.scan_licenses(docs).collect()}
    assert (got[1].n_words, got[2].n_words, got[1].labels) == (1_250_000, 1, "")
    assert decontaminate.find_leaks(docs, items).collect() == []
    near = {r.doc_id: r for r in near_dup.near_duplicates(docs).collect()}
    assert near[1].n_shingles == 1_249_996 and near[3].component_id == 1 and near[2].component_id == 2
    rules = {r.doc_id: r for r in quality_rules.apply_rules(docs, quality_rules.fit(docs.limit(0), labels)).collect()}
    assert rules[1].n_words == 1_250_000 and rules[2].base_failed
    model = quality_classifier.fit(docs.limit(0), labels, bits=10)
    assert len(quality_classifier.score_documents(docs, model).collect()) == 3
    tokens = {r.doc_id: r for r in token_counts.count_tokens(docs, vocabulary("byte_bpe_50k.json")).collect()}
    assert tokens[2].n_bytes == 1_000_000 and tokens[1].n_tokens > 1_250_000
    removed = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs).collect()}
    assert removed[1].n_removed == 0 and removed[3].n_spans == 2
    assert sizes[3] - 300 < removed[3].n_removed < sizes[3]
    # the word repeats itself with a short period: all but the first period and a span is gone
    assert removed[2].n_removed == 1_000_000 - 26


def test_round_trips_are_held_against_the_text(spark):
    docs = spark.createDataFrame([(1, "a \u2581b"), (2, "a b"), (3, None)] + [(k, "short") for k in range(10, 3000)], "doc_id long, text string").coalesce(1)
    got = sentencepiece_sample.sample_segmentations(docs, vocabulary("piece_bpe_32k.model"), k=1, digest=True).collect()
    assert {r.doc_id for r in got if not r.round_trip} == {1} and len(got) == 2993


def test_keep_first_keeps_every_different_text(spark):
    long = lambda c: " ".join(f"{c}{k}" for k in range(40))
    rows = [(1, long("a")), (2, long("a")), (2, long("u")), (None, long("n")), (None, long("n")), (None, long("a")), (3, long("r")), (3, long("r")), (4, None), (None, ""), (None, ""), (5, long("a") + " tail")]
    df = spark.createDataFrame([(*r, k, "x") for k, r in enumerate(rows)], "doc_id long, text string, score long, kept string")
    got = [(r.doc_id, r.text) for r in near_dup.keep_first(df, percent=80).collect()]
    assert sorted(got, key=repr) == sorted([(1, long("a")), (2, long("u")), (None, long("n")), (3, long("r")), (4, None), (None, "")], key=repr)
    assert near_dup.keep_first(df, percent=80).columns == df.columns
    # where ids are proper ones, the smallest of a component stays
    proper = df.where("score < 2 OR score = 11")
    assert [r.doc_id for r in near_dup.keep_first(proper, percent=80).collect()] == [1]
    assert near_dup.keep_first(df.limit(0)).collect() == []


def test_rows_of_one_id_and_equal_short_hashes_are_two_documents(spark):
    from pyspark.sql import functions as F

    part = lambda k: F.sha2(F.concat(F.col("id").cast("string"), F.lit(f"/{k}")).cast("binary"), 256)
    once = F.concat(*map(part, range(6)))
    texts = spark.range(150_000).select("id", F.when(F.col("id") % 2 == 0, F.concat(once, F.lit(" "), once)).otherwise(once).alias("text")).withColumn("h", F.hash("text"))
    pair = texts.join(texts.groupBy("h").agg(F.count_distinct(F.col("id") % 2).alias("n")).where("n = 2"), "h").orderBy("h", "id").limit(2).collect()
    assert len(pair) == 2 and pair[0].h == pair[1].h
    for id_ in (None, 7):
        got = suffix_dedup.remove_repeats(spark.createDataFrame([(id_, r.text) for r in pair], "doc_id long, text string")).collect()
        want = sorted((len(r.text), 384 if r.id % 2 == 0 else 0) for r in pair)
        assert sorted((r.n_bytes, r.n_removed) for r in got) == want
