"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of every whole text are computed once and written to the shared
folder. Trees are fitted on a bounded sample of labelled rows
(``PER_CLASS`` of each class, weighed to the class mix of all usable labels): features are cut into at most ``BINS`` bins, each
node chooses the split with the largest gain from gradient histograms, and
the ensemble is flattened into arrays that a batch of rows walks level by
level in numpy.

Defined cases: null and empty texts have zero statistics and are scored like
any other; rows without usable labels are only scored; with labels of one
class or none, every score is the smoothed base rate; repeated rows are
scored each; extra columns do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labels import held_out, training_ids
from .text import as_text, written

FOLDS, FOLD = 5, 0
CUT = 0.3
PER_CLASS = 10_000
TREES, DEPTH, BINS, RATE, MIN_LEAF, RIDGE = 60, 4, 48, 0.15, 20, 1.0
STATS = ["chars", "words", "lines", "word_len", "word_len_sd", "distinct_words", "commonest_word", "line_len",
         "repeated_lines", "short_lines", "lines_with_stop", "letters", "digits", "upper", "spaces", "stops",
         "commas", "bangs", "bars", "hashes", "other_symbols", "non_ascii", "symbol_words", "capital_words",
         "repeated_pairs", "longest_word"]
_CLASSES = {"digits": b"0123456789", "upper": bytes(range(65, 91)), "spaces": b" \t\n\r", "stops": b".?", "commas": b",;:",
            "bangs": b"!", "bars": b"|", "hashes": b"#$%&*", "other_symbols": b"+-/<=>@[\\]^_`{}~()\"'"}
_LETTERS = np.array([i for i in range(256) if 65 <= i <= 90 or 97 <= i <= 122])


def statistics(text: str) -> list[float]:
    """The values of ``STATS`` for one text."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    counts, n = np.bincount(raw, minlength=256), max(1, len(raw))
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    nw, nl = max(1, len(words)), max(1, len(lines))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    tally: dict[str, int] = {}
    for w in words:
        tally[w] = tally.get(w, 0) + 1
    share = {k: counts[list(v)].sum() / n for k, v in _CLASSES.items()}
    return [np.log1p(len(text)), np.log1p(len(words)), np.log1p(len(lines)), lengths.mean(), lengths.std(),
            len(tally) / nw, max(tally.values(), default=0) / nw, np.log1p(len(text) / nl),
            1 - len(set(lines)) / nl if lines else 0.0, sum(len(x) < 30 for x in lines) / nl,
            sum(x.rstrip()[-1] in ".!?" for x in lines) / nl, counts[_LETTERS].sum() / n, share["digits"], share["upper"],
            share["spaces"], share["stops"], share["commas"], share["bangs"], share["bars"], share["hashes"],
            share["other_symbols"], counts[128:].sum() / n, sum(c for w, c in tally.items() if not any(map(str.isalnum, w))) / nw,
            sum(c for w, c in tally.items() if w[:1].isupper()) / nw, 1 - len(set(zip(words, words[1:]))) / nw, np.log1p(lengths.max())]


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and ``stats`` (array<float>) of every row."""
    def measure(batches):
        for batch in batches:
            rows = [statistics(t.as_py()) for t in as_text(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float32()))], ["doc_id", "stats"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(measure, "doc_id long, stats array<float>")


@dataclass
class Forest:
    """All trees as arrays [tree, node]: node i has children 2i+1 and 2i+2; a leaf's feature is -1."""

    base: float
    feature: np.ndarray
    limit: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for rows of statistics."""
        total = np.full(len(x), self.base)
        if len(self.feature):
            trees, rows = np.arange(len(self.feature)), np.arange(len(x))[:, None]
            node = np.zeros((len(x), len(trees)), np.int64)
            for _ in range(self.depth):
                f = self.feature[trees, node]
                right = x[rows, np.maximum(f, 0)] > self.limit[trees, node]
                node = np.where(f < 0, node, 2 * node + 1 + right)
            total = total + self.value[trees, node].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE,
        min_leaf: int = MIN_LEAF, ridge: float = RIDGE) -> Forest:
    """Histogram gradient boosting with logistic loss; ``weight``: rows that each row stands for (1 each)."""
    weight = np.ones(len(y)) if weight is None else weight
    odds = np.log((weight @ y + 1) / (weight @ (1 - y) + 1))
    if not len(y) or y.min() == y.max():
        return Forest(float(odds), *(np.zeros((0, 1), t) for t in (np.int64, float, float)), depth)
    weight = weight / weight.mean()
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    cells = binned + np.arange(x.shape[1]) * bins
    size, score = 2 ** (depth + 1) - 1, np.full(len(y), odds)
    feature, limit, value = np.full((trees, size), -1), np.zeros((trees, size)), np.zeros((trees, size))
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        grad, hess, node = weight * (y - p), weight * p * (1 - p), np.zeros(len(y), np.int64)
        for level in range(depth + 1):
            for i in range(2 ** level - 1, 2 ** (level + 1) - 1):
                own = np.flatnonzero(node == i)
                if not len(own):
                    continue
                g, h = grad[own].sum(), hess[own].sum()
                value[t, i] = rate * g / (h + ridge)
                if level == depth or len(own) < 2 * min_leaf:
                    continue
                at = cells[own].ravel()
                hist = [np.bincount(at, np.repeat(v, x.shape[1]), x.shape[1] * bins).reshape(x.shape[1], bins).cumsum(axis=1)
                        for v in (grad[own], hess[own], np.ones(len(own)))]
                gl, hl, nl = hist
                gain = gl ** 2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g ** 2 / (h + ridge)
                gain[(nl < min_leaf) | (len(own) - nl < min_leaf)] = 0
                f, b = divmod(int(gain.argmax()), bins)
                if gain[f, b] <= 1e-6 or b >= len(edges[f]):
                    continue
                feature[t, i], limit[t, i] = f, edges[f][b]
                node[own] = 2 * i + 1 + (binned[own, f] > b)
        score = score + value[t, node]
    return Forest(float(odds), feature, limit, value, depth)


def score_quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    stats = written(document_statistics(docs), "quality-stats")
    # of an id's texts the least statistics count, whatever the order of rows
    rows = (stats.join(training_ids(labels, "quality", FOLDS, FOLD, per_class), "doc_id")
            .groupBy("doc_id", "label", "weight").agg(F.min("stats").alias("stats")).orderBy("doc_id").toPandas())
    x = np.array(rows["stats"].tolist(), float).reshape(len(rows), len(STATS))
    forest = fit(x, rows["label"].to_numpy(float), rows["weight"].to_numpy(float))

    def judge(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(forest.score(x), pa.float64())], ["doc_id", "score"])

    scored = stats.mapInArrow(judge, "doc_id long, score double")
    return scored.select("doc_id", held_out(FOLDS, FOLD).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
