"""Quality classifier: a generalised additive model with pairwise interactions, learned by cyclic boosting.

Each feature of a text is put into one of a few quantile bins.  Training cycles over the features;
each step fits a shallow tree (up to LEAVES leaves) to the log-loss gradient along one feature's bins
and adds its steps, shrunk, to that feature's lookup table.  Then the pairs of features whose
quadrants explain most of what is left get two-dimensional tables the same way, by
trees with one cut along each axis.  A score is a sum of table entries put through
the logistic function, so a batch is scored by array gathers.

Training sees at most TRAIN_ROWS labelled rows, chosen by a hash of doc_id.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievestone.llm.common import free_name, map_rows, repeated_lines, repeated_words
from sievestone.session import table

THRESHOLD, FOLDS = 0.3, 5
#: The bound on labelled rows that the model is fitted on.
TRAIN_ROWS = 12_000
BINS, ROUNDS, RATE, LEAVES, PAIRS, PAIR_ROUNDS = 32, 120, 0.15, 3, 6, 40

#: Characters that are counted one by one.
MARKS, STOPS, STRANGE = ".,;:!?\"'()-", ".!?", "#*$%&|<>@^~_=+\\/{}[]`"
FEATURES = (
    "log_words", "word_length", "longest_word", "upper", "digit", "mark", "strange", "exclaim", "bar", "other",
    "new_lines", "log_line_words", "repeated_lines", "repeated_words", "distinct_words", "stops", "short_words", "long_words", "char_entropy", "capital_words",
)


def _classes() -> np.ndarray:
    """For each code point: 0 lower or caseless letter, 1 upper, 2 digit, 3 blank, 4 mark, 5 strange, 6 other."""
    out = np.full(0x110000, 6, dtype=np.uint8)
    for c in range(0x30000):
        x = chr(c)
        if x.isalpha():
            out[c] = 1 if x.isupper() else 0
        elif x.isdigit():
            out[c] = 2
        elif x.isspace():
            out[c] = 3
    out[[ord(c) for c in MARKS]] = 4
    out[[ord(c) for c in STRANGE]] = 5
    return out


def features(texts: list, classes: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text; a null or empty text, or one of blanks, has zeros."""
    out = np.zeros((len(texts), len(FEATURES)))
    for row, text in zip(out, texts, strict=True):
        words = (text or "").split()
        if not words:
            continue
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        of = np.bincount(classes[codes], minlength=7)
        n, solid = len(words), max(1, len(codes) - int(of[3]))
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
        counts = np.unique(codes, return_counts=True)[1] / len(codes)
        lines, twice = repeated_lines(text)
        row[:] = (
            np.log1p(n), lengths.mean(), np.log1p(lengths.max()), of[1] / solid, of[2] / solid, of[4] / solid, of[5] / solid, text.count("!") / n, text.count("|") / n, of[6] / solid,
            text.count("\n") / n, np.log1p(n / max(1, lines)), twice / max(1, lines), repeated_words(words) / n, len(set(words)) / n, sum(map(text.count, STOPS)) / n, (lengths <= 2).mean(), (lengths >= 15).mean(), -(counts * np.log2(counts)).sum(), sum(w[0].isupper() for w in words) / n,
        )
    return out


class Model:
    """Bin edges of each feature, and lookup tables: (feature, steps) and (feature, feature, steps)."""

    def __init__(self, edges: list, base: float, single: list, pairs: list):
        self.edges, self.base, self.single, self.pairs = edges, base, single, pairs

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(self.edges)], axis=1) if len(x) else np.zeros((0, len(self.edges)), dtype=np.int64)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = np.full(len(x), self.base)
        for i, steps in enumerate(self.single):
            total += steps[b[:, i]]
        for i, j, steps in self.pairs:
            total += steps[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """Steps of a regression tree over ordered bins, grown by the best gain; g and h are the bins' sums."""
    parts = [(0, len(g))]
    cg, ch = np.append(0, np.cumsum(g)), np.append(0, np.cumsum(h))
    worth = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + 1.0)
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for a, b in parts:
            cuts = np.arange(a + 1, b)
            if len(cuts):
                gain = worth(a, cuts) + worth(cuts, b) - worth(a, b)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], (a, b), int(cuts[k]))
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    steps = np.zeros(len(g))
    for a, b in parts:
        steps[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + 1.0)
    return steps


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut along each axis of a table, by gain over no cut, and its four steps."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    tg, th = cg[-1, -1], ch[-1, -1]
    gain = 0.0
    quarters = []
    for a, b in ((cg, ch),):
        quarters = [(a[:-1, :-1], b[:-1, :-1]), (a[:-1, -1:] - a[:-1, :-1], b[:-1, -1:] - b[:-1, :-1]), (a[-1:, :-1] - a[:-1, :-1], b[-1:, :-1] - b[:-1, :-1])]
    rest = (tg - sum(q[0] for q in quarters), th - sum(q[1] for q in quarters))
    total = sum(q[0] ** 2 / (q[1] + 1.0) for q in [*quarters, rest]) - tg**2 / (th + 1.0)
    if not total.size:
        return 0.0, np.zeros_like(g)
    i, j = np.unravel_index(int(total.argmax()), total.shape)
    gain, steps = float(total[i, j]), np.zeros_like(g)
    for rows, cols in ((slice(None, i + 1), slice(None, j + 1)), (slice(None, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(None, j + 1)), (slice(i + 1, None), slice(j + 1, None))):
        steps[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + 1.0)
    return gain, steps


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting over single features, then over the strongest pairs.  No rows: every score is 0.5."""
    k = x.shape[1]
    edges = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for i in range(k)]
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    base = float(np.log(share / (1 - share))) if len(y) else 0.0
    model = Model(edges, base, [np.zeros(len(e) + 1) for e in edges], [])
    if not len(y) or y.min() == y.max():
        return model
    b = model.bins(x)
    total = np.full(len(y), base)

    def sums(at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return np.bincount(at, weights=y - p, minlength=size), np.bincount(at, weights=p * (1 - p), minlength=size)

    for _ in range(ROUNDS):
        for i in range(k):
            steps = RATE * _tree(*sums(b[:, i], len(edges[i]) + 1), LEAVES)
            model.single[i] += steps
            total += steps[b[:, i]]
    pairs = []
    for i, j in combinations(range(k), 2):
        shape = (len(edges[i]) + 1, len(edges[j]) + 1)
        g, h = sums(b[:, i] * shape[1] + b[:, j], shape[0] * shape[1])
        pairs.append((_quadrants(g.reshape(shape), h.reshape(shape))[0], i, j))
    model.pairs = [(i, j, np.zeros((len(edges[i]) + 1, len(edges[j]) + 1))) for _, i, j in sorted(pairs, key=lambda p: (-p[0], p[1:]))[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for i, j, steps in model.pairs:
            g, h = sums(b[:, i] * steps.shape[1] + b[:, j], steps.size)
            add = RATE * _quadrants(g.reshape(steps.shape), h.reshape(steps.shape))[1]
            steps += add
            total += add[b[:, i], b[:, j]]
    return model


def held_out(doc_id: str = "doc_id"):
    """Whether a row is kept from training: crc32 of its id as text leaves no remainder by FOLDS."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _feature_columns():
    classes = _classes()
    return lambda texts: {"x": list(features(texts, classes))}


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """The model of at most `rows` labelled documents outside the held-out fold.

    A document with several labels counts as good if one says so; one with several texts has
    the first of their feature rows in order.  No label: every score is 0.5.
    """
    known = labels.filter("doc_id is not null and quality is not null").filter(~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", F.col("text").alias("__text")).join(F.broadcast(chosen), "doc_id")
    got = map_rows(texts, "__text", "x array<double>", _feature_columns, ["doc_id", "quality"]).groupBy("doc_id", "quality").agg(F.min("x").alias("x"))
    sample = sorted(got.collect(), key=lambda r: r["doc_id"])
    x = np.array([r["x"] for r in sample]).reshape(len(sample), len(FEATURES))
    return fit(x, np.array([float(r["quality"] > 0) for r in sample]))


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple = ("doc_id",), name: str = "score") -> DataFrame:
    """The columns `keep` and the score of each whole text, 0 to 1; null counts as empty.

    Equal texts have equal scores; repeated rows have a row each, an empty table gives none, and extra columns may have any name.
    """

    def make():
        classes = _classes()
        return lambda texts: {name: model.score(features(texts, classes))}

    return map_rows(docs, text, f"`{name}` double", make, list(keep))


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows of `docs` with a score of at least the threshold, with their columns.

    Null and empty texts have a score like any other.  Repeated rows stay or go together; an empty table gives no rows, and extra
    columns may have any name.
    """
    name = free_name(docs, "__score")
    return score(docs, model, text, tuple(docs.columns), name).filter(F.col(name) >= threshold).select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_quality_gam(spark, sf_dir: str) -> DataFrame:
    """held_out, score and predicted for every row of `documents`."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
