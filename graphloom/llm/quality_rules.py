"""Quality rules with an isolation forest over the rules' own statistics.

Each text is reduced to counts (words, symbols, repeated lines and windows, ...) and these to
shares. A forest of random splits over all of them, as they are, is grown on documents marked
good, each tree on rows drawn from all of them; every document gets its mean path length, and short paths mark documents
that differ from those. Splits are drawn from the rows' range and BEYOND times as far to either side,
so a row outside of it soon stands alone. The threshold on the anomaly score is calibrated on
all labelled rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_array, forget, give_back, mapped, may_hold, saved

#: The statistics the forest splits on, in the order of features(), and the least width of a range to split.
FEATURES = ("log_words", "word_len", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "mark_share")
LEAST_WIDTH = np.array([0.3, 0.3, 0.02, 0.05, 0.05, 0.01, 0.02, 0.02])
#: How far beyond the range of its rows a split may fall, in widths of that range.
BEYOND = 2.0
_SPACE = b" \t\n\r\x0b\x0c"
_STATS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_upper long, n_digits long, n_marks long, n_lines long"
_ASCII_UPPER = bytes(range(65, 91))
_ASCII_DIGIT = bytes(range(48, 58))
_ASCII_MARK = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_SYMBOLS = b"#*$%&|<>"
#: Bins of one round of counting.
_BINS = 1024


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words that lie in a window of `width` words found twice or more, the first included."""
    n = len(words)
    if n <= width:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=n)
    size = len(known) + 1
    if size**width < 2**62:
        key = ids[: n - width + 1].copy()
        for i in range(1, width):
            key = key * size + ids[i : n - width + 1 + i]
    else:
        key = np.unique(np.stack([ids[i : n - width + 1 + i] for i in range(width)]), axis=1, return_inverse=True)[1].ravel()
    _, back, count = np.unique(key, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(count[back] > 1)
    if not len(twice):
        return 0
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def statistics(text: str | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper, n_digits, n_marks, n_lines of a whole text; a null has none of anything."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()  # on bytes: space and 09-0D only
    spaces = len(raw) - len(raw.translate(None, _SPACE))
    seen, again, lines = set(), 0, 0
    for line in raw.split(b"\n"):
        if line.strip():
            lines += 1
            if line in seen:
                again += 1
            else:
                seen.add(line)
    cut = lambda letters: len(raw) - len(raw.translate(None, letters))
    return (len(words), len(text or "") - spaces, cut(_SYMBOLS), again, repeated_words(words), cut(_ASCII_UPPER), cut(_ASCII_DIGIT), cut(_ASCII_MARK), lines)


def features(s: np.ndarray) -> np.ndarray:
    """Rows of statistics() as rows of FEATURES: the logarithm of the words, shares of the words, the lines or the characters in words."""
    s = np.asarray(s, dtype=float).reshape(-1, 9)
    words, chars = np.maximum(s[:, 0], 1), np.maximum(s[:, 1], 1)
    return np.stack([np.log(words), chars / words, s[:, 2] / chars, s[:, 3] / np.maximum(s[:, 8], 1), s[:, 4] / words, s[:, 5] / chars, s[:, 6] / chars, s[:, 7] / chars], axis=1)


def _usual_path(n: float) -> float:
    """Mean path of an unsuccessful search among n points."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


class IsolationForest:
    """Random axis splits; arrays hold all trees, so a forest is a small picklable value.

    A split's place is drawn from its rows' range and `BEYOND` times its width to either side; a
    range narrower than `width` counts as that wide. As most splits then part off nothing, trees
    are twice as deep as usual.
    """

    def __init__(self, x: np.ndarray, trees: int = 100, sample: int = 256, seed: int = 7, width: np.ndarray | float = 1e-9):
        rng = np.random.default_rng(seed)
        self.sample = min(sample, len(x))
        self.depth = 2 * math.ceil(math.log2(max(2, self.sample)))
        width = np.broadcast_to(np.asarray(width, dtype=float), x.shape[1:])
        # no row twice as long as there are enough
        order = rng.permutation(len(x))[: trees * self.sample].reshape(-1, self.sample) if len(x) >= max(1, trees * self.sample) else None
        rows = lambda k: rng.choice(len(x), self.sample, replace=False) if order is None else order[k]
        self.trees = [self._grow(x[rows(k)], rng, width) for k in range(trees)] if len(x) else []

    def _grow(self, x, rng, width):
        feature, split, left, right, length = [], [], [], [], []

        def node(rows, depth):
            me = len(feature)
            for a, v in ((feature, -1), (split, 0.0), (left, me), (right, me), (length, depth + _usual_path(len(rows)))):
                a.append(v)
            if depth >= self.depth or len(rows) < 2:
                return me
            f = int(rng.integers(rows.shape[1]))
            low, high = float(rows[:, f].min()), float(rows[:, f].max())
            far = BEYOND * (high - low + width[f])
            at = float(rng.uniform(low - far, high + far))
            side = rows[:, f] <= at
            feature[me], split[me] = f, at
            left[me] = node(rows[side], depth + 1)
            right[me] = node(rows[~side], depth + 1)
            return me

        node(x, 0)
        return tuple(np.array(a) for a in (feature, split, left, right, length))

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-path / usual path): near 1 for anomalies, lower for the bulk."""
        if not self.trees or not len(x):
            return np.zeros(len(x))
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, split, left, right, length in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                f = feature[at]
                at = np.where(f < 0, at, np.where(x[rows, np.maximum(f, 0)] <= split[at], left[at], right[at]))
            total += length[at]
        return np.exp2(-total / len(self.trees) / max(_usual_path(self.sample), 1e-9))


class RuleModel:
    """A forest over FEATURES and a threshold of its score."""

    def __init__(self, forest: IsolationForest, threshold: float):
        self.forest, self.threshold = forest, threshold

    def judge(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        score = self.forest.score(x)
        return score, score > self.threshold


def _nth(values: DataFrame, column: str, n: int) -> float:
    """The n-th least (from 0) of a column without nulls: counts of ever narrower bins, so no row is gathered."""
    x = F.col(column)
    low, high = values.agg(F.min(x), F.max(x)).first()
    while low < high:
        place = F.least(F.floor((x - F.lit(low)) / F.lit((high - low) / _BINS)), F.lit(_BINS - 1))
        bins = values.where(x.between(low, high)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min(x).alias("low"), F.max(x).alias("high")).collect()
        for b in sorted(bins, key=lambda b: b.low):
            low, high = b.low, b.high
            if n < b.n:
                break
            n -= b.n
    return low


def _quantile(values: DataFrame, column: str, count: int, share: float) -> float:
    """np.quantile of a column of `count` rows."""
    at = (count - 1) * share
    below = math.floor(at)
    low = _nth(values, column, below)
    high = low if below == at else _nth(values, column, below + 1)
    return low + (high - low) * (at - below)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", trees: int = 100, sample: int = 256, false_alarms: float = 0.001) -> RuleModel:
    """Forest and threshold from all labelled rows.

    The forest grows on rows marked good, each tree on `sample` of them (the method's own way),
    drawn from all; the threshold is the score that a share of `false_alarms` of all of them
    exceeds. An id counts once: of repeated documents the one with the least statistics. Rows
    that the base rules fail are not learnt from. Without ten good rows and a bad one nothing is
    anomalous. An array of bits of the labelled ids, bounded in size, keeps most other documents
    from being measured; only statistics are shuffled, no texts.
    """
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("i")).agg(F.min(label_col).cast("int").alias("y"))
    marks = saved(marks)
    some = may_hold(docs.select(F.col(id_col).cast("long").alias("_i"), F.col(text_col).alias("_t")), bit_array(marks, "i", marks.count()))
    stats = mapped(some, ["_i", "_t"], "i long, s array<long>", lambda: lambda c: {"i": c[0], "s": [list(statistics(t)) for t in c[1]]})
    stats = stats.groupBy("i").agg(F.min("s").alias("s"))
    rows = saved(stats.join(marks, "i").where("s[0] >= 50 and 100 * s[4] <= 50 * s[0]"))
    counts = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    good, n = rows.where("y = 1"), counts.get(1, 0)
    # all rows, or by their ids' hashes as many as the trees take, and a few more that are cut off here
    need = trees * sample
    share = min(1.0, (need + 10 * math.sqrt(need)) / max(n, 1))
    drawn = good if share == 1 else good.where(F.xxhash64("i") < F.lit(int((share - 0.5) * 2.0**64)))
    x = features(np.array([r.s for r in sorted(drawn.select(F.xxhash64("i").alias("h"), "i", "s").collect())], dtype=float))
    if n < 10 or n == sum(counts.values()):
        forget(rows)
        return RuleModel(IsolationForest(x), math.inf)
    forest = IsolationForest(x, trees, sample, width=LEAST_WIDTH)
    scores = saved(mapped(good, ["s"], "score double", lambda: lambda c: {"score": forest.score(features(np.array(c[0], dtype=float)))}, rows=8192))
    threshold = _quantile(scores, "score", n, 1 - false_alarms)
    forget(rows, scores, marks)
    return RuleModel(forest, threshold)


def base_failed(s: np.ndarray) -> np.ndarray:
    """Rows of statistics() with under 50 words, or over half of the words repeated."""
    return (s[:, 0] < 50) | (100 * s[:, 4] > 50 * s[:, 0])


def apply_rules(df: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the statistics, base_failed, kept and the anomaly score of each row of df.

    base_failed: under 50 words, or over half of the words repeated. A null or empty text has
    no words and fails; null ids stay null; repeated rows give repeated results; other columns
    of df are not read.
    """

    def make():
        def work(columns):
            ids, texts = columns
            s = np.array([statistics(t) for t in texts], dtype=np.int64).reshape(-1, 9)
            score, odd = model.judge(features(s))
            failed = base_failed(s)
            out = {"doc_id": ids, "base_failed": failed, "kept": ~failed & ~odd, "score": score}
            return out | {n: s[:, i] for i, n in enumerate(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))}

        return work

    return mapped(df, [id_col, text_col], "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double", make)


def keep_good(df: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df, all columns, that the rules and the forest keep.

    A null or empty text has no words and goes, as apply_rules fails it; ids are not read, so null
    and repeated ones are judged by their texts; an empty table stays empty.
    """
    schema = df.schema
    i = schema.fieldNames().index(text_col)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                s = np.array([statistics(t) for t in part.column(i).to_pylist()], dtype=np.int64).reshape(-1, 9)
                _, odd = model.judge(features(s))
                yield part.filter(pa.array(~base_failed(s) & ~odd))
            part = batch = None
        give_back()

    return df.mapInArrow(run, schema)
