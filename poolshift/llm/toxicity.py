"""Toxicity: a lexicon trie searched with Levenshtein automata, scored in context.

1. The lexicon is learned: words and word stems that documents labelled toxic
   hold and clean ones do not (counted by Spark over a bounded sample of
   labelled rows, ``PER_CLASS`` of each class).
2. All terms share one trie. Its product with the Levenshtein automata of
   the terms (1 edit from 5 letters on, 2 from 9 on) is determinised as it is
   walked, so a word costs one table lookup per letter until it falls out.
3. Each hit is weighed by the words around it: hits inside quotation marks or
   after a reporting verb count as quotation, the others as abuse.
4. A logistic regression over those counts, fitted on the same sample weighed
   to the class mix of all usable labels, gives the score.

Defined cases: null and empty texts hold no hits and get the score of a text
without hits; with labels of one class or none there is no lexicon and every
score is the smoothed base rate; repeated rows are scored each; extra columns
are kept where documents are filtered, and rows of any doc_id are judged.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labels import held_out, training_ids
from .text import as_text, lean, ship, small, written

FOLDS, FOLD = 3, 1
CUT = 0.7
PER_CLASS = 5_000
STEM_LENGTHS = (5, 6, 7)
MAX_TERMS = 2_000
WINDOW = 8
#: Words and automaton states that a task remembers; both only save time.
CACHE = 100_000
STATES = 60_000
FEATURES = ["any", "exact", "misspelt", "quoted", "share", "addressed"]

# Reporting verbs and pronouns of address, English.
REPORTING = frozenset("said says wrote writes called calls quoted quote quotes replied answered shouted claimed".split())
ADDRESS = frozenset("you your yours youre u ur he she they are is such".split())
# Signs often written for letters.
SIGNS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"})
QUOTES = frozenset("\"“”«»„")
_STRIP = "\"“”«»„'.,;:!?()[]{}<>|#%&*-_=+~`…\n\t "


def normal(token: str) -> str:
    """Lower case, without signs at the ends, with look-alike signs inside turned to letters."""
    token = token.lower().strip(_STRIP)
    return token if token.isalpha() else token.translate(SIGNS)


def edits_allowed(term: str) -> int:
    return 2 if len(term) >= 9 else 1 if len(term) >= 5 else 0


@dataclass
class Lexicon:
    """Trie of words and stems with a lazily determinised Levenshtein automaton.

    A state is the set of (trie node, edits so far) that the letters read so
    far allow. ``find`` gives (kind, edits): kind "word" if the whole word is
    within the allowed edits of a term, "stem" if it begins with a stem. Words
    in ``clean`` are no misspellings.
    """

    words: list[str]
    stems: list[str]
    clean: frozenset = frozenset()
    _children: list[dict] = field(default_factory=lambda: [{}])
    _allowed: dict = field(default_factory=dict)
    _reach: list[int] = field(default_factory=lambda: [0])
    _stem: set = field(default_factory=set)
    _states: dict = field(default_factory=dict)
    _sets: list = field(default_factory=list)
    _moves: list = field(default_factory=list)
    _accept: list = field(default_factory=list)
    _cache: dict = field(default_factory=dict)

    def __post_init__(self):
        for term in self.words:
            self._allowed[self._insert(term, edits_allowed(term))] = edits_allowed(term)
        for stem in self.stems:
            self._stem.add(self._insert(stem, 0))
        self._start = self._state(self._closure({0: 0}))

    def _insert(self, term: str, reach: int) -> int:
        node = 0
        self._reach[0] = max(self._reach[0], reach)
        for c in term:
            nxt = self._children[node].get(c)
            if nxt is None:
                nxt = self._children[node][c] = len(self._children)
                self._children.append({})
                self._reach.append(0)
            node = nxt
            self._reach[node] = max(self._reach[node], reach)
        return node

    def _closure(self, nodes: dict[int, int]) -> dict[int, int]:
        """Adds the nodes reached by leaving out letters of terms."""
        work = list(nodes.items())
        while work:
            node, e = work.pop()
            for child in self._children[node].values():
                if e + 1 <= self._reach[child] and nodes.get(child, 9) > e + 1:
                    nodes[child] = e + 1
                    work.append((child, e + 1))
        return nodes

    def _state(self, nodes: dict[int, int]) -> int:
        key = frozenset(nodes.items())
        if key not in self._states:
            self._states[key] = len(self._sets)
            self._sets.append(nodes)
            self._moves.append({})
            ends = [e for n, e in nodes.items() if e <= self._allowed.get(n, -1)]
            self._accept.append((min(ends) if ends else -1, any(n in self._stem and e == 0 for n, e in nodes.items())))
        return self._states[key]

    def _move(self, state: int, c: str) -> int:
        nxt: dict[int, int] = {}
        for node, e in self._sets[state].items():
            if e + 1 <= self._reach[node]:
                nxt[node] = min(nxt.get(node, 9), e + 1)
            for letter, child in self._children[node].items():
                cost = e + (letter != c)
                if cost <= self._reach[child] or cost == 0:
                    nxt[child] = min(nxt.get(child, 9), cost)
        to = self._state(self._closure(nxt)) if nxt else -1
        self._moves[state][c] = to
        return to

    def find(self, word: str) -> tuple[str, int] | None:
        try:
            return self._cache[word]
        except KeyError:
            pass
        if len(self._cache) >= CACHE:
            self._cache.clear()
        if len(self._sets) > STATES:
            self.__init__(self.words, self.stems, self.clean)
        state, stem = self._start, False
        for c in word:
            to = self._moves[state].get(c)
            state = self._move(state, c) if to is None else to
            if state < 0:
                break
            stem = stem or self._accept[state][1]
        edits = self._accept[state][0] if state >= 0 else -1
        found = self._cache[word] = ("word", edits) if edits == 0 else ("stem", 0) if stem else ("word", edits) if edits > 0 and word not in self.clean else None
        return found

    def __getstate__(self):
        return {"words": self.words, "stems": self.stems, "clean": self.clean}

    def __setstate__(self, state):
        self.__init__(**state)


def measure(text: str, lexicon: Lexicon) -> list[float]:
    """The values of ``FEATURES`` for one text."""
    tokens = text.split()
    known: dict[str, tuple | None] = {}
    hits = []
    for i, token in enumerate(tokens):
        if token not in known:
            known[token] = lexicon.find(normal(token))
        if known[token]:
            hits.append((i, *known[token]))
    exact = fuzzy = quoted = addressed = 0
    for i, _, edits in hits:
        if _is_quoted(tokens, i):
            quoted += 1
            continue
        near = {normal(t) for t in tokens[max(0, i - WINDOW):i + WINDOW + 1]}
        addressed += bool(near & ADDRESS)
        if edits:
            fuzzy += 1
        else:
            exact += 1
    per_hundred = 100 * (exact + fuzzy) / max(1, len(tokens))
    return [float(exact > 0), math.log1p(exact), math.log1p(fuzzy), math.log1p(quoted), math.log1p(per_hundred), math.log1p(addressed)]


def _is_quoted(tokens: list[str], i: int) -> bool:
    """An opening quotation mark up to ``WINDOW`` words before and a closing one up to ``WINDOW`` after, or a reporting verb just before an opened quotation."""
    before, after = tokens[max(0, i - WINDOW):i + 1], tokens[i:i + WINDOW + 1]
    opened = closed = False
    for t in reversed(before):
        if t is not before[-1] and t[-1] in QUOTES:
            break
        if t[0] in QUOTES:
            opened = True
            break
    for t in after:
        if t.rstrip(".,;:!?")[-1:] in QUOTES and (len(t) > 1 or t not in before[-1:]):
            closed = True
            break
    return opened and (closed or any(normal(t) in REPORTING for t in before[:-1]))


def learn_lexicon(docs: DataFrame, sample: DataFrame, max_terms: int = MAX_TERMS) -> Lexicon:
    """Words and stems typical of the toxic rows of ``sample`` (doc_id, label; bounded)."""
    def count(batches):
        for batch in batches:
            toxic, clean = Counter(), Counter()
            for text, label in zip(as_text(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                words = {w for w in map(normal, set(text.as_py().split())) if w.isalpha() and 3 <= len(w) <= 40}
                terms = words | {w[:n] + "*" for w in words for n in STEM_LENGTHS if len(w) > n}
                (toxic if label else clean).update(terms)
            terms = list(toxic.keys() | clean.keys())
            yield pa.RecordBatch.from_arrays([
                pa.array(terms, pa.string()), pa.array([toxic[t] for t in terms], pa.int64()),
                pa.array([clean[t] for t in terms], pa.int64())], ["term", "toxic", "clean"])

    sample = F.broadcast(sample)
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if not sizes.get(1) or not sizes.get(0):
        return Lexicon([], [])
    counts = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(sample, "doc_id").select("text", "label")
              .mapInArrow(count, "term string, toxic long, clean long").groupBy("term")
              .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "toxic-terms")
    # rate among toxic rows against the smoothed rate among clean rows
    rate = (F.col("toxic") / sizes[1]) / ((F.col("clean") + 0.5) / sizes[0])
    best = (counts.where((F.col("toxic") >= max(4, sizes[1] // 100)) & (rate >= 20))
            .orderBy(F.desc("toxic"), "term").limit(max_terms).collect())
    stems = [r["term"][:-1] for r in best if r["term"].endswith("*")]
    kept = [s for s in stems if not any(s != o and s.startswith(o) for o in stems)]
    lexicon = Lexicon([r["term"] for r in best if not r["term"].endswith("*")], kept)

    def near(batches):
        for batch in batches:
            yield batch.filter(pa.array([(hit := lexicon.find(t)) is not None and hit[1] > 0 for t in batch.column(0).to_pylist()], pa.bool_()))

    # words of clean rows that resemble a term are words of their own, not misspellings
    own = counts.where((F.col("clean") >= 1) & ~F.col("term").endswith("*")).select("term").mapInArrow(near, "term string").collect()
    return Lexicon(lexicon.words, lexicon.stems, frozenset(r["term"] for r in own))


def fit_weights(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-4, steps: int = 50) -> np.ndarray:
    """Logistic regression with an intercept (Newton steps); ``weight``: rows that each row stands for (1 each), so both classes weigh as they occur."""
    weight = np.ones(len(y)) if weight is None else weight
    if not len(y) or y.min() == y.max():
        return np.concatenate([[np.log((weight @ y + 1) / (weight @ (1 - y) + 1))], np.zeros(x.shape[1])])
    weight = weight / weight.mean()
    z = np.hstack([np.ones((len(x), 1)), x])
    penalty = np.diag([1e-6] + [ridge] * x.shape[1])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (weight * p * (1 - p))[:, None]) / len(y) + penalty, z.T @ (weight * (y - p)) / len(y) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Scorer:
    """Lexicon and fitted weights (intercept first)."""

    lexicon: Lexicon
    weights: np.ndarray

    def scores(self, texts: pa.Array) -> np.ndarray:
        x = np.array([measure(t.as_py(), self.lexicon) for t in texts], float).reshape(len(texts), len(FEATURES))
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -500, 500)))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Scorer:
    """Lexicon and weights from the labelled rows that are not held out (at most ``per_class`` of each class)."""
    sample = written(training_ids(labels, "toxic", FOLDS, FOLD, per_class), "toxic-sample")
    lexicon = learn_lexicon(docs, sample)

    def run(batches):
        for batch in batches:
            rows = [measure(t.as_py(), lexicon) for t in as_text(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64())), batch.column(2), batch.column(3)],
                                             ["doc_id", "hits", "label", "weight"])

    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
            .mapInArrow(lean(run), "doc_id long, hits array<double>, label int, weight double")
            # of an id's texts the least counts, whatever the order of rows
            .groupBy("doc_id", "label", "weight").agg(F.min("hits").alias("hits")).orderBy("doc_id").toPandas())
    x = np.array(rows["hits"].tolist(), float).reshape(len(rows), len(FEATURES))
    return Scorer(lexicon, fit_weights(x, rows["label"].to_numpy(float), rows["weight"].to_numpy(float)))


def score_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    sent = ship(docs.sparkSession, train(docs, labels, per_class))

    def run(batches):
        scorer = sent()
        for batch in small(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scorer.scores(as_text(batch.column(1))))],
                                             ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, score double")
    return scored.select("doc_id", held_out(FOLDS, FOLD).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, cut: float = CUT) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic; all columns kept, nothing shuffled."""
    sent = ship(docs.sparkSession, train(docs, labels, per_class))
    at = docs.columns.index("text")

    def run(batches):
        scorer = sent()
        for batch in small(batches):
            yield batch.filter(pa.array(scorer.scores(as_text(batch.column(at))) < cut))

    return docs.mapInArrow(lean(run), docs.schema)
