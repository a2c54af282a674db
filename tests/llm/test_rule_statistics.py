"""Each rule statistic alone can reject a document."""

import random

import numpy as np

from graphloom.llm import quality_rules

SF = "/root/testdata/sf0.01"


def test_one_bad_statistic_is_enough(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_rules.fit(docs, labels)
    good = [r.text for r in docs.join(labels.where("quality = 1"), "doc_id").where("length(text) between 1500 and 3000").orderBy("doc_id").limit(20).collect()]
    rng = random.Random(4)
    words = good[0].split()
    distinct = lambda n: [rng.choice(words) + str(k) if k % 9 == 0 else rng.choice(words) for k in range(n)]
    cases = {
        "repeated words": " ".join(words + ["the same three"] * int(len(words) * 0.27)),
        "digits": " ".join(w if k % 2 else str(rng.randrange(10**5, 10**7)) for k, w in enumerate(words)),
        "run-together words": " ".join("".join(words[k : k + 4]) for k in range(0, len(words) * 2, 4) if k < len(words)) + " " + " ".join("".join(rng.sample(words, 4)) for _ in range(60)),
        "repeated lines": "\n".join([" ".join(distinct(40)) for _ in range(6)] + ["ok then"] * 14),
    }
    for name, text in cases.items():
        s = np.array([quality_rules.statistics(text)])
        assert s[0, 0] >= 50 and 100 * s[0, 4] <= 50 * s[0, 0], name
        assert model.judge(quality_rules.features(s))[1][0], name
    _, odd = model.judge(quality_rules.features(np.array([quality_rules.statistics(t) for t in good])))
    assert odd.sum() <= 1


def test_paths_against_walked_trees():
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (300, 8))
    forest = quality_rules.IsolationForest(x, trees=9, sample=64, width=quality_rules.LEAST_WIDTH)

    def path(tree, row):
        feature, split, left, right, length = (a.tolist() for a in tree)
        at, steps = 0, 0
        while feature[at] >= 0:
            at, steps = left[at] if row[feature[at]] <= split[at] else right[at], steps + 1
        rest = length[at] - steps
        assert 0 <= rest <= quality_rules._usual_path(64) and steps <= forest.depth
        return length[at]

    probe = np.concatenate([x[:40], rng.normal(0, 9, (40, 8))])
    want = [2 ** (-np.mean([path(t, r) for t in forest.trees]) / quality_rules._usual_path(64)) for r in probe]
    assert np.allclose(forest.score(probe), want) and forest.score(probe)[40:].mean() > forest.score(probe)[:40].mean() + 0.1


def test_verdict_is_no_rule_on_one_statistic(spark):
    """Several statistics that are each within what good rows have are anomalous together."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = quality_rules.fit(docs, labels)
    rows = docs.join(labels, "doc_id").select("quality", "text").collect()
    s = np.array([quality_rules.statistics(r.text) for r in rows])
    y = np.array([r.quality for r in rows])[~quality_rules.base_failed(s)]
    x = quality_rules.features(s[~quality_rules.base_failed(s)])
    _, odd = model.judge(x)
    good = x[y == 1]
    inside = ((x >= good.min(0)) & (x <= good.max(0))).all(1)
    corner = np.where(np.arange(8) % 2, good.max(0), good.min(0))[None]
    assert model.judge(corner)[1][0] and odd[y == 0].mean() > 0.98 and odd[y == 1].mean() < 0.005
    assert not (odd == ~inside).all()


def test_threshold_comes_from_all_labelled_rows(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 11))) for _ in range(400)]
    rows = [(k, " ".join(rng.choices(words, k=rng.randrange(52, 70))), int(k % 150 > 0)) for k in range(7500)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    model = quality_rules.fit(docs, labels, trees=20)
    s = np.array([quality_rules.statistics(t) for _, t, y in rows if y])
    assert len(s) == 7450 and not quality_rules.base_failed(s).any()
    assert abs(model.threshold - np.quantile(model.forest.score(quality_rules.features(s)), 0.999)) < 1e-12


def test_quantiles_by_counting(spark):
    values = np.round(np.random.default_rng(5).normal(0, 1, 3000), 2)
    df = spark.createDataFrame([(float(v),) for v in values], "score double")
    for share in (0.0, 0.5, 0.999, 1.0):
        assert abs(quality_rules._quantile(df, "score", 3000, share) - np.quantile(values, share)) < 1e-12
