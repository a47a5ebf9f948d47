"""Scoring documents by the cross-entropy difference of two word n-gram models.

The target model is counted over the documents labelled good, the background
model over all documents; both have all words, all pairs of words and the
same smoothing. A token's loss is minus the log of
``LAMBDA * c(previous, word) / c(previous) + (1 - LAMBDA) * (c(word) + 1) / (tokens + words)``;
a document's score is the mean over its tokens of background loss minus
target loss, so text like the target scores above 0.

1. Texts are read once, in blocks of about ``BLOCK`` bytes. A block keeps its
   distinct words, the place of each token's word and the lengths of its texts.
2. It asks the buckets about its distinct words (by 64-bit hash, lower-cased
   A-Z) and pairs (by a 64-bit hash within buckets dealt by another one), and
   tells them its own counts. A pair is one entry of a block however often it
   occurs, so frequent words and pairs are no hot keys.
3. Each bucket (about ``BUCKET`` tokens) sums the counts and answers every
   block in the order it asked; both models are these answers and grow with
   the documents.
4. Blocks meet their answers and sum the losses of their texts.

Nothing is left out or merged: ``BLOCK`` and ``BUCKET`` choose where a pair is
counted, not whether. Only totals go through the driver.

Defined cases: null and empty texts have no tokens, zero losses and score 0;
without target documents the target model is the uniform one; repeated rows
count and are scored each; a row counts as target if any label row of its
doc_id has the target label; null ids are never target; extra columns do not
matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import THIN, as_text, lean, mix64, small, split_words, written

BLOCK = 8 << 20
BUCKET = 1 << 20
LAMBDA = 0.7
#: The context of a text's first word; no word holds a line break.
START = np.uint64(xxhash.xxh3_64_intdigest("\n"))
#: Turns a word's hash into a second one, for the keys of pairs.
_SECOND = np.uint64(xxhash.xxh3_64_intdigest("pair"))
_BLOCKS = "block long, words binary, tokens binary, rows binary"
_ASKED = "bucket int, block long, words binary, pairs binary"
_ANSWERS = "bucket int, block long, words binary, pairs binary, size long, every long, ours long"
_SCORES = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"


def packed(*columns: np.ndarray) -> bytes:
    """Columns of one length of numbers from 0 up, compressed, each in as few bytes a number as its largest needs.

    The bytes of a column lie plane by plane, so that high ones that hardly differ compress.
    """
    least = [np.ascontiguousarray(c, np.min_scalar_type(int(c.max(initial=0)))) for c in columns]
    raw = b"".join(c.view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in least)
    head = np.array([len(columns[0]), len(raw)], "<i8").tobytes() + bytes(c.itemsize for c in least)
    return head + pa.compress(raw, "zstd", asbytes=True)


def unpacked(blob: bytes, columns: int) -> list[np.ndarray]:
    n, size = np.frombuffer(blob, "<i8", 2).tolist()
    raw = np.frombuffer(pa.decompress(blob[16 + columns:], size, "zstd"), np.uint8)
    at, out = 0, []
    for width in blob[16:16 + columns]:
        out.append(np.ascontiguousarray(raw[at:at + n * width].reshape(width, n).T).view(f"<u{width}").reshape(n))
        at += n * width
    return out


def _steps(ascending: np.ndarray) -> np.ndarray:
    """Differences of ascending numbers, the first from 0."""
    return np.diff(ascending, prepend=ascending.dtype.type(0))


def joined(blobs: list[bytes], columns: int) -> list[np.ndarray]:
    """The columns of all ``blobs``, one after the other."""
    parts = [unpacked(x, columns) for x in blobs]
    return [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.empty(0, np.uint64)] * columns


class Block:
    """Words and pairs of some texts, each in the order of the buckets that count them.

    ``h``: hashes of the distinct words and ``START``; ``w``: place of each
    token's word; ``n``: tokens of each text. ``at`` is the place of each
    token's pair, ``b`` and ``pair_w`` are the words of each pair.
    """

    def __init__(self, h: np.ndarray, w: np.ndarray, n: np.ndarray, buckets: int):
        self.n, self.buckets = n.astype(np.int64), buckets
        mixed = mix64(h)
        order, self.word_bucket = self._dealt(mixed, h)
        self.h, mixed, self.w = h[order], mixed[order], _places(order)[w]
        start = int(np.flatnonzero(self.h == START)[0])
        self.before = np.concatenate([[start], self.w[:-1]])[:len(self.w)]
        self.before[(np.cumsum(self.n) - self.n)[self.n > 0]] = start
        pair, at = np.unique(self.before * len(h) + self.w, return_inverse=True)
        b, pair_w = pair // len(h), pair % len(h)
        with np.errstate(over="ignore"):
            key = mix64(mix64(self.h ^ _SECOND)[b] + mixed[pair_w])
            order, self.pair_bucket = self._dealt(mix64(mixed[b] + self.h[pair_w]), key)
        self.b, self.pair_w, self.key, self.at = b[order], pair_w[order], key[order], _places(order)[at]

    def _dealt(self, mixed: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """An order by bucket and the first bits of the key, and the buckets in that order."""
        bucket, bits = mixed % np.uint64(self.buckets), np.uint64(max(1, self.buckets.bit_length()))
        order = np.argsort((bucket << (np.uint64(64) - bits)) | (key >> bits), kind="stable")
        return order, bucket[order]

    def asked(self, good: np.ndarray):
        """(bucket, words, pairs): what the block asks each bucket, with its own counts; ``good`` flags its texts."""
        ours = np.repeat(good, self.n)
        counts = lambda x, n: (np.bincount(x, minlength=n), np.bincount(x[ours], minlength=n))
        words = counts(self.w, len(self.h)) + counts(self.before, len(self.h))
        pairs = counts(self.at, len(self.key))
        ids = np.union1d(self.word_bucket, self.pair_bucket)
        cuts = [np.searchsorted(x, ids, side) for x in (self.word_bucket, self.pair_bucket) for side in ("left", "right")]
        for k, i, j, p, q in zip(ids.tolist(), *cuts, strict=True):
            yield k, packed(_steps(self.h[i:j]), *(c[i:j] for c in words)), packed(_steps(self.key[p:q]), *(c[p:q] for c in pairs))


def _places(order: np.ndarray) -> np.ndarray:
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order))
    return out


def _texts(batches, size: int):
    """Batches joined to about ``size`` bytes each."""
    held, total = [], 0
    for batch in small(batches, 100):
        held.append(batch)
        total += batch.nbytes
        if total >= size:
            yield pa.Table.from_batches(held).combine_chunks()
            held, total = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def read_blocks(marked: DataFrame, size: int) -> DataFrame:
    """One pass over doc_id, text, good: the distinct words, tokens and rows of every block."""
    def read(batches):
        block = TaskContext.get().partitionId() << 33
        for t in _texts(batches, size):
            words, offsets = split_words(as_text(t.column(1)), lower=True)
            coded = words.dictionary_encode()
            h = np.fromiter((START, *(xxhash.xxh3_64_intdigest(x) for x in coded.dictionary.to_pylist())), np.uint64, len(coded.dictionary) + 1)
            ids, good = t.column(0).combine_chunks(), t.column(2).to_numpy().astype(np.uint8)
            rows = packed(ids.fill_null(0).to_numpy().view(np.uint64), ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8), good, np.diff(offsets))
            tokens = packed(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *(pa.array([x], pa.binary()) for x in (packed(h), tokens, rows))],
                                             ["block", "words", "tokens", "rows"])
            block += 1

    return written(marked.mapInArrow(lean(read), _BLOCKS), "token-blocks")


def _block(words: bytes, tokens: bytes, rows: bytes, buckets: int) -> tuple[Block, list[np.ndarray]]:
    """A block as it was read, and doc_id, known, good and tokens of its rows."""
    (h,), (w,), facts = unpacked(words, 1), unpacked(tokens, 1), unpacked(rows, 4)
    return Block(h.astype(np.uint64), w, facts[3], buckets), facts


def ask(read: DataFrame, buckets: int) -> DataFrame:
    """What every block asks the buckets."""
    def asking(batches):
        for batch in small(batches, 1):
            block, facts = _block(*(batch.column(i)[0].as_py() for i in range(1, 4)), buckets)
            out = list(block.asked(facts[2] > 0))
            for i in range(0, len(out), 64):
                bucket, words, pairs = zip(*out[i:i + 64], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(batch.column(0).to_pylist() * len(bucket), pa.int64()),
                                                  pa.array(words, pa.binary()), pa.array(pairs, pa.binary())],
                                                 ["bucket", "block", "words", "pairs"])

    return read.mapInArrow(lean(asking), _ASKED)


def _answered(t: pa.Table) -> pa.Table:
    """One bucket's counts for each block that asked, and (block null) its distinct words and tokens."""
    def summed(name, columns):
        parts = [unpacked(x, columns) for x in t.column(name).to_pylist()]
        ends = np.cumsum([len(steps) for steps, *_ in parts])[:-1]
        _, at = np.unique(np.concatenate([np.cumsum(steps, dtype=np.uint64) for steps, *_ in parts]), return_inverse=True)
        counts = [np.concatenate(c) for c in list(zip(*parts, strict=True))[1:]]
        sums = [np.bincount(at, c).astype(np.int64) for c in counts]
        return sums, [packed(*x) for x in zip(*(np.split(s[at], ends) for s in sums), strict=True)]

    (every, ours, *_), words = summed("words", 5)
    _, pairs = summed("pairs", 3)
    n = len(words)
    total = [int((every > 0).sum()), int(every.sum()), int(ours.sum())]
    bucket = t.column("bucket")[0].as_py()
    return pa.table([pa.array([bucket] * (n + 1), pa.int32()), pa.array([*t.column("block").to_pylist(), None], pa.int64()),
                     pa.array([*words, None], pa.binary()), pa.array([*pairs, None], pa.binary()),
                     *(pa.array([None] * n + [x], pa.int64()) for x in total)],
                    ["bucket", "block", "words", "pairs", "size", "every", "ours"])


def _scored(own: pa.Table, answers: pa.Table, buckets: int, tokens: dict, size: int) -> pa.Table:
    """The rows of a block, scored by the answers to it."""
    block, (ids, known, _, n) = _block(*(own.column(c)[0].as_py() for c in ("words", "tokens", "rows")), buckets)
    answers = answers.sort_by("bucket")
    words = dict(zip(("every", "ours", "c_every", "c_ours"), joined(answers.column("words").to_pylist(), 4), strict=True))
    pairs = dict(zip(("every", "ours"), joined(answers.column("pairs").to_pylist(), 2), strict=True))
    owner = np.repeat(np.arange(len(n)), block.n)
    means = {}
    for side in ("ours", "every"):
        contexts = words["c_" + side][block.b].astype(np.float64)
        base = (words[side][block.pair_w] + 1.0) / (tokens[side] + size)
        weight = np.where(contexts > 0, LAMBDA, 0.0)
        losses = -np.log(weight * pairs[side] / np.maximum(contexts, 1) + (1 - weight) * base)
        means[side] = np.bincount(owner, losses[block.at], minlength=len(n)) / np.maximum(block.n, 1)
    return pa.table([pa.array(ids.astype(np.uint64).view(np.int64), mask=known == 0), pa.array(block.n), pa.array(means["ours"]),
                     pa.array(means["every"]), pa.array(means["every"] - means["ours"])],
                    ["doc_id", "n_tokens", "target_loss", "background_loss", "score"])


def marked_texts(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, text and whether the doc_id is one of ``target``.

    Up to ``THIN`` target ids are broadcast. Of more, hash slots are (never more
    than ``THIN``); texts of these slots are shuffled and the join decides.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    target = target.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(True).alias("good")).where("doc_id is not null").distinct()
    good = F.coalesce("good", F.lit(False)).alias("good")
    if target.count() <= THIN:
        return docs.join(F.broadcast(target), "doc_id", "left").select("doc_id", "text", good)
    slot = F.when(F.col("doc_id").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.lit(THIN)).cast("int"))
    slots = F.broadcast(target.select(slot.alias("slot")).distinct())
    dealt = docs.withColumn("slot", slot)
    near = dealt.join(slots, "slot", "left_semi").join(target, "doc_id", "left").select("doc_id", "text", good)
    return near.unionByName(dealt.join(slots, "slot", "left_anti").select("doc_id", "text", F.lit(False).alias("good")))


def score_documents(docs: DataFrame, target: DataFrame, vocabulary_size: int | None = None, slots: int | None = None,
                    bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss (means) and score of every row of ``docs``.

    ``bucket``: tokens whose pairs are counted in one place, about; ``block``:
    bytes of texts read together. ``vocabulary_size`` and ``slots`` bounded
    counts that were sent to the tasks; none are any more, and both are ignored.
    """
    # a token is a word and a blank, some 6 bytes
    length = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-length // (6 * bucket)))
    read = read_blocks(marked_texts(docs, target), block)
    answers = written(ask(read, buckets).groupBy("bucket").applyInArrow(_answered, _ANSWERS), "block-answers")
    total = answers.where("block is null").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("size", "every", "ours"))).first()
    tokens, size = {"every": total["every"], "ours": total["ours"]}, total["size"] + 2
    held = answers.where("block is not null").select("block", "bucket", "words", "pairs").groupBy("block")
    return read.groupBy("block").cogroup(held).applyInArrow(lambda a, b: _scored(a, b, buckets, tokens, size), _SCORES)
