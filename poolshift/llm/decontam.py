"""Benchmark decontamination by greedy string tiling.

Words are letter/digit runs, lower-cased. Every run of ``seed_words`` words
of an item is a seed; documents that share a seed with an item (a join of
seed hashes against a block of the benchmark) are tiled against it: the
longest common runs of unmarked words are marked first, then shorter ones
down to ``min_match`` words, each length searched by a running Karp-Rabin
hash and confirmed word by word. Tiles may come in any order and from any
place, so reordered passages count. An item is leaked by a document when its
tiles cover at least ``threshold`` of the item's words.

The benchmark is taken in blocks of at most ``block_words`` words, each sent
to the tasks in turn (the bound holds for a benchmark of any size). Each
document row is judged against all blocks and gives one result row. Documents
are never shuffled.

Defined cases: null texts and items are empty; items with fewer than
``seed_words`` words are seeded by their whole word sequence; empty items
match nothing; repeated items count once each; a repeated document row is
judged by itself; an empty benchmark leaks nothing; extra columns stay where
documents are filtered, and rows of any doc_id are judged.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import as_text, ship, window_hashes

SEED_WORDS = 4
MIN_MATCH = 3
THRESHOLD = 0.6
BLOCK_WORDS = 1 << 20
RESULT = "doc_id long, n_words long, items array<long>, coverage double"
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


class _Hashed(dict):
    """Word -> 64-bit hash, computed at first use."""

    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _hashes(words: list[str], known: _Hashed) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _seeds(hashes: np.ndarray, k: int) -> np.ndarray:
    return window_hashes(hashes, min(k, len(hashes)))


def tile(item: np.ndarray, doc: np.ndarray, min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two sequences of word hashes.

    Returns tiles (start in item, start in document, words). From the longest
    possible length down: the Karp-Rabin hashes of all unmarked runs of that
    length are compared, equal runs are checked word by word and marked from
    left to right; no word belongs to two tiles.
    """
    free_item, free_doc = np.ones(len(item), bool), np.ones(len(doc), bool)
    tiles, length = [], min(len(item), len(doc))
    length = min(length, _longest(item, doc, free_item, free_doc, length))
    while length >= min_match:
        marked = False
        for i, j in _equal_runs(item, doc, free_item, free_doc, length):
            free_item[i:i + length] = False
            free_doc[j:j + length] = False
            tiles.append((i, j, length))
            marked = True
        length = _longest(item, doc, free_item, free_doc, length if marked else length - 1)
    return tiles


def _equal_runs(item, doc, free_item, free_doc, length):
    """Pairs (i, j) of unmarked equal runs, in order of i, then j, found as
    they are asked for. Runs that the caller marks meanwhile are left out:
    each i is paired at most once if it is, and starts in the document that
    are no longer free are passed over once for all."""
    def runs(seq, free):
        if len(seq) < length:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        before = np.concatenate([[0], np.cumsum(free)])
        whole = np.flatnonzero(before[length:] - before[:-length] == length)
        return whole, window_hashes(seq, length)[whole] if len(whole) else np.empty(0, np.uint64)

    at_i, h_i = runs(item, free_item)
    at_j, h_j = runs(doc, free_doc)
    near = np.isin(h_j, h_i)
    places = defaultdict(list)
    for j, h in zip(at_j[near].tolist(), h_j[near].tolist(), strict=True):
        places[h].append(j)
    first = dict.fromkeys(places, 0)
    for i, h in zip(at_i.tolist(), h_i.tolist(), strict=True):
        starts = places.get(h, ())
        while starts and first[h] < len(starts) and not free_doc[starts[first[h]]:starts[first[h]] + length].all():
            first[h] += 1
        for n in range(first.get(h, 0), len(starts)):
            j = starts[n]
            if not free_item[i:i + length].all():
                break
            if free_doc[j:j + length].all() and np.array_equal(item[i:i + length], doc[j:j + length]):
                yield i, j


def _longest(item, doc, free_item, free_doc, most: int) -> int:
    """Length of the longest equal unmarked run, at most ``most`` (a run of n words holds equal runs of n - 1: bisect)."""
    low, high = 0, most
    while low < high:
        mid = (low + high + 1) // 2
        if next(_equal_runs(item, doc, free_item, free_doc, mid), None):
            low = mid
        else:
            high = mid - 1
    return low


def _blocks(items: DataFrame, block_words: int):
    """The benchmark in blocks of (item_id, word hashes); at most ``block_words`` words are held at a time, plus one item."""
    block, held, known = [], 0, _Hashed()
    for r in items.select("item_id", "text").toLocalIterator():
        h = _hashes(words_of(r["text"]), known)
        if len(h) and r["item_id"] is not None:
            block.append((r["item_id"], h))
            held += len(h)
        if held >= block_words:
            yield block
            block, held, known = [], 0, _Hashed()
    if block:
        yield block


def leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, seed_words: int = SEED_WORDS,
          min_match: int = MIN_MATCH, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per row of ``docs``, over the whole benchmark: doc_id, n_words, items (ids leaked, ascending), coverage.

    ``coverage`` is the largest among the items tiled; items that cannot reach
    the threshold, by an upper bound, are not tiled (0 if none was).
    """
    sent = [ship(docs.sparkSession, Block(block, seed_words, min_match, threshold)) for block in _blocks(items, block_words)]
    if not sent:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n_words"),
                           F.array().cast("array<long>").alias("items"), F.lit(0.0).alias("coverage"))

    def run(batches):
        # a task holds one block at a time
        block = sent[0]()
        for batch in batches:
            texts = as_text(batch.column(1))
            n_words, leaked, most = [0] * len(texts), [set() for _ in texts], [0.0] * len(texts)
            for other in sent:
                block = other() if len(sent) > 1 else block
                for i, t in enumerate(texts):
                    n_words[i], found, covered = block.judge(t.as_py())
                    leaked[i].update(found)
                    most[i] = max(most[i], covered)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(n_words, pa.int64()), pa.array([sorted(x) for x in leaked], pa.list_(pa.int64())),
                pa.array(most, pa.float64())], ["doc_id", "n_words", "items", "coverage"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, RESULT)


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, seed_words: int = SEED_WORDS,
                  min_match: int = MIN_MATCH, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` that leak no item; all columns kept, nothing shuffled."""
    at = docs.columns.index("text")
    for block in _blocks(items, block_words):
        sent = ship(docs.sparkSession, Block(block, seed_words, min_match, threshold))

        def run(batches, sent=sent):
            block = sent()
            for batch in batches:
                yield batch.filter(pa.array([not block.judge(t.as_py())[1] for t in as_text(batch.column(at))], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


class Block:
    """A block of items with its seeds sorted by hash."""

    def __init__(self, items, seed_words: int, min_match: int, threshold: float):
        self.items, self.min_match, self.threshold = items, min_match, threshold
        each = [_seeds(h, seed_words) for _, h in items]
        seeds = np.concatenate(each)
        order = np.argsort(seeds, kind="stable")
        self.seeds = seeds[order]
        self.owner = np.repeat(np.arange(len(each)), [len(x) for x in each])[order]
        self.lengths = sorted({min(seed_words, len(h)) for _, h in items})
        self.known = _Hashed()

    def judge(self, text: str) -> tuple[int, list[int], float]:
        """Words of the text, ids of the items it leaks, largest coverage."""
        if len(self.known) > 1_000_000:
            self.known.clear()
        return _judge(_hashes(words_of(text), self.known), self.items, self.seeds, self.owner, self.lengths,
                      self.min_match, self.threshold)


def _judge(doc, block, seeds, owner, lengths, min_match, threshold):
    hit: set[int] = set()
    for k in lengths:
        grams = np.unique(window_hashes(doc, k))
        lo, hi = np.searchsorted(seeds, grams, "left"), np.searchsorted(seeds, grams, "right")
        for a, b in zip(lo[lo < hi].tolist(), hi[lo < hi].tolist(), strict=True):
            hit.update(owner[a:b].tolist())
    leaked, most, short = [], 0.0, {}
    for n in sorted(hit):
        item_id, item = block[n]
        k = min(min_match, len(item))
        if k not in short:
            short[k] = np.unique(window_hashes(doc, k))
        if _within_reach(item, short[k], k) < threshold:
            continue
        covered = sum(x[2] for x in tile(item, doc, k)) / len(item)
        most = max(most, covered)
        if covered >= threshold:
            leaked.append(item_id)
    return len(doc), sorted(set(leaked)), most


def _within_reach(item, doc_runs, k: int) -> float:
    """Upper bound of the coverage: the share of the item's words in a run of k words that the document has too."""
    known = np.flatnonzero(np.isin(window_hashes(item, k), doc_runs))
    covered = np.zeros(len(item), bool)
    for d in range(k):
        covered[known + d] = True
    return covered.mean()
