"""The pipeline's stages: columns, odd rows, and each stage against a plain version."""

import re

import numpy as np
import pytest

import corpus_pipeline
from graphloom.llm import decontaminate, quality_rules, secret_scan
from tests.llm.test_brute_force import brute_components, python_features

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_are_the_five_in_order():
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["quality", "dedup", "decontamination", "secrets", "encoding"]


@pytest.fixture(scope="module")
def inputs(spark):
    """What each stage reads, as lists of rows, with the DataFrames."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(spark.createDataFrame(stage(spark, out[-1], SF).collect(), stage(spark, out[-1], SF).schema))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_quality_stage(spark, inputs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality_rules.fit(inputs[0], labels)
    kept = set()
    for i, t in texts(inputs[0]).items():
        s = quality_rules.statistics(t)
        _, odd = model.judge(quality_rules.features(np.array([s])))
        if s[0] >= 50 and 2 * s[4] <= s[0] and not odd[0]:
            kept.add(i)
    assert inputs[1].columns == COLUMNS and set(texts(inputs[1])) == kept


def test_dedup_stage(inputs):
    label = brute_components(sorted(texts(inputs[1]).items()), 80)
    assert inputs[2].columns == COLUMNS and set(texts(inputs[2])) == {i for i in texts(inputs[1]) if label[i] == i}


def test_decontamination_stage(spark, inputs):
    """All pairs, without the seeds' prefilter."""
    known: dict[str, int] = {}
    ids = lambda t: np.array([known.setdefault(w, len(known)) for w in decontaminate.words(t)], dtype=np.int64)
    items = [ids(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = set()
    for i, t in texts(inputs[2]).items():
        own = ids(t)
        if all(sum(n for _, _, n in decontaminate.tile(own, item, 5)) < 0.8 * len(item) for item in items):
            clean.add(i)
    assert inputs[3].columns == COLUMNS and set(texts(inputs[3])) == clean and len(clean) < inputs[2].count()


def test_secret_stage(spark, inputs):
    forest, around, want = secret_scan.fit(spark), secret_scan._AROUND, {}
    for i, t in texts(inputs[3]).items():
        found = list(re.finditer(secret_scan.CANDIDATE, t))
        out, at = "", 0
        for k, m in enumerate(found):
            low = found[k - 1].end() if k else 0
            high = found[k + 1].start() if k + 1 < len(found) else len(t)
            f = python_features(m.group(), t[max(low, m.start() - around) : m.start()], t[m.end() : min(high, m.end() + around)])
            out += t[at : m.start()] + (secret_scan.MASK if forest.predict(f) >= 0.5 else m.group())
            at = m.end()
        want[i] = out + t[at:]
    assert inputs[4].columns == COLUMNS and texts(inputs[4]) == want
    assert all(r.n_chars == len(r.text) for r in inputs[4].collect())


def test_encoding_stage(inputs):
    import sentencepiece

    from graphloom.llm.queries import vocabulary

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    rows = {r.doc_id: r for r in inputs[5].collect()}
    assert set(rows) == set(texts(inputs[4]))
    for i, t in texts(inputs[4]).items():
        ids = np.frombuffer(rows[i].token_ids, "<i4").tolist()
        assert rows[i].round_trip and rows[i].n_tokens == len(ids) and model.decode(ids) == t


def test_run_is_all_stages(spark, inputs):
    got = {(r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {(r.doc_id, r.ids_sha256) for r in inputs[5].collect()}


def test_stages_take_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score string, _text int, __sub long"
    words = " ".join(f"word{k % 70} and" for k in range(90))
    rows = [
        (1, words, "en", None, len(words), None, "s", 1, 2),
        (1, words, "en", None, len(words), None, "s", 1, 2),
        (2, words, None, "x", None, True, None, None, None),
        (None, words + ' token = "9f14a7029c8514dfe98aba92898d323168e199da"', None, None, None, None, None, None, None),
        (3, None, None, None, None, None, None, None, None),
        (4, "", "en", "x", 0, False, "", 0, 0),
        (5, " ".join(f"w{k}" for k in range(4000)), "en", "x", 1, False, "", 0, 0),
    ]
    docs = spark.createDataFrame(rows, schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs.limit(0), SF).collect() == []
    # one row of the group of copies stays: of the repeated row, its copy under another id and the one without an id
    dedup = sorted((r.doc_id or 0) for r in corpus_pipeline.dedup(spark, docs, SF).collect())
    assert dedup == [1, 3, 4, 5]
    masked = {r.doc_id: r for r in corpus_pipeline.secrets(spark, docs, SF).collect()}
    assert masked[None].text == words + ' token = "[SECRET]"' and masked[None].n_chars == len(masked[None].text) and masked[2].n_chars is None and masked[3].text is None
    assert corpus_pipeline.encoding(spark, docs, SF).count() == len(rows)


def test_encoding_stage_samples_twice_without_replacement(spark, inputs):
    """The rows are those that the operator gives for k = 2, the second sample within the first one's row."""
    from graphloom.llm import sentencepiece_sample
    from graphloom.llm.queries import vocabulary

    columns = ("sample_no", "n_tokens", "log_prob", "perturbed", "log_inclusion", "token_ids", "ids_sha256", "round_trip")
    want = {(r.doc_id, r.sample_no): tuple(r[c] for c in columns) for r in sentencepiece_sample.sample_segmentations(inputs[4], vocabulary("piece_bpe_32k.model"), k=2, digest=True).collect()}
    got = {(r.doc_id, x.sample_no): tuple(x[c] for c in columns) for r in inputs[5].collect() for x in (r, *r.more)}
    assert got == want and len(want) == 2 * inputs[4].count()
    assert all(want[i, 1][6] != want[i, 2][6] for i, _ in want)
