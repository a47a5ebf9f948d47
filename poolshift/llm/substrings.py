"""Removal of long spans that an earlier document holds too.

A window is ``WINDOW`` consecutive words of one document. Every word in a
window whose words also start somewhere in a document with a smaller doc_id
is removed; windows are judged on the input.

1. Of the ``K``-word runs of each window the one with the smallest hash is its
   node (a minimizer): equal windows have equal nodes, and about one run in
   eighteen is a node. Texts whose whole word sequence is equal are one class,
   named by its smallest doc_id, and take part once.
2. In the De Bruijn graph of the texts the edges are the stretches between
   consecutive nodes. One aggregation by node tells which nodes occur in two
   classes or more, and which of those are inner nodes of a nonbranching path
   (one way in and one way out in the whole corpus; a text's first and last
   node always branch). Joined back to the texts, it compacts each path.
3. A window with an inner node that lies within the node's path occurs
   wherever the path does, so a path is looked up once by the hash of its
   words, however long. The other windows of repeated nodes, at the ends of
   paths, are looked up by their own hash. Both give the smallest doc_id.
4. Source coordinates (window starts in each text) mark the words to go.

Defined cases: null and empty texts have no words; a text shorter than a
window loses nothing; rows with one doc_id are one document, whether their
texts are equal or not, and each row is answered; a row with a null doc_id
is not compared and keeps all its words; extra columns do not matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import as_text, hash_words, having, mix64, sequence_hash, signed, small, split_words, window_hashes, written

WINDOW = 50
K = 16
OWN = np.uint64(0x5851F42D4C957F2D)


def _minimizers(grams: np.ndarray, per_window: int) -> np.ndarray:
    """For each window, the position of the run with the smallest hash (leftmost of equals)."""
    view = np.lib.stride_tricks.sliding_window_view(grams, per_window)
    return view.argmin(axis=1) + np.arange(len(view))


class Text:
    """Word hashes of one text with its windows, nodes and stretches."""

    def __init__(self, w: np.ndarray, grams: np.ndarray, window: int, k: int):
        self.w, self.window, self.k = w, window, k
        self.node_of = _minimizers(grams, window - k + 1)
        self.nodes = self.node_of[np.concatenate([[True], np.diff(self.node_of) > 0])]
        self.names = grams[self.nodes]

    def stretch_names(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of w[start:end] for each pair; equal words give equal names."""
        return np.array([sequence_hash(self.w[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.uint64)

    def edges(self, own: int) -> tuple[np.ndarray, np.ndarray]:
        """Names of the stretches into and out of each node; those at the ends of the text are like no other."""
        between = self.stretch_names(self.nodes[:-1], self.nodes[1:] + self.k)
        ends = mix64(np.array([own, own], np.uint64) ^ np.array([OWN, ~OWN], np.uint64))
        return np.concatenate([ends[:1], between]), np.concatenate([between, ends[1:]])

    def lookups(self, repeated: dict[int, bool]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(name, first window, last window) of every path and window to look up.

        ``repeated``: repeated nodes, true where they are inner nodes of a path.
        """
        inner = np.array([repeated.get(h, False) for h in self.names.tolist()], bool)
        known = np.array([h in repeated for h in self.names.tolist()], bool)
        first = np.searchsorted(self.node_of, self.nodes, "left")
        last = np.searchsorted(self.node_of, self.nodes, "right") - 1
        names, lo, hi = [], [], []
        alone = np.repeat(known & ~inner, last - first + 1)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], inner.astype(np.int8), [0]])))
        runs = list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))
        for a, b in runs:
            # a path runs from the node before its first inner node to the node after its last one
            begin, end = self.nodes[a - 1], self.nodes[b] + self.k
            x, y = max(first[a], begin), min(last[b - 1], end - self.window)
            alone[first[a]:last[b - 1] + 1] = True
            if x <= y:
                alone[x:y + 1] = False
                names.append(sequence_hash(self.w[begin:end]))
                lo.append(x)
                hi.append(y)
        names, lo, hi = np.array(names, np.uint64), np.array(lo, int), np.array(hi, int)
        single = np.flatnonzero(alone)
        if len(single):
            names = np.concatenate([names, window_hashes(self.w, self.window)[single]])
            lo, hi = np.concatenate([lo, single]), np.concatenate([hi, single])
        return names, lo, hi


class _Batch:
    """A batch of texts: words, their hashes, and where each text's begin and end."""

    def __init__(self, col: pa.Array):
        self.words, self.offsets = split_words(as_text(col))
        self.w = hash_words(self.words)

    def bounds(self):
        return zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist(), strict=True)

    def texts(self, window: int, k: int):
        """(row, sequence identity, Text) of the texts that hold a window."""
        grams = window_hashes(self.w, k)
        for i, (a, b) in enumerate(self.bounds()):
            if b - a >= window:
                yield i, sequence_hash(self.w[a:b]), Text(self.w[a:b], grams[a:b - k + 1], window, k)

    def joined_sha256(self, stays: np.ndarray | None = None) -> pa.Array:
        """sha256 of each text's words (of those that stay) joined by a space."""
        words, offsets = self.words, self.offsets
        if stays is not None:
            before = np.concatenate([[0], np.cumsum(stays)])
            words, offsets = words.filter(pa.array(stays)), before[offsets]
        lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), words)
        return pa.array([hashlib.sha256(x.as_buffer() or b"").hexdigest() for x in pc.binary_join(lists, " ")], pa.string())


def _id(h: int) -> int:
    """A 64-bit hash as a long."""
    return h - (1 << 64) if h >> 63 else h


def sequences(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, seq (identity of the word sequence) and all_sha256 (of all words joined) of every row."""
    def run(batches):
        for batch in small(batches):
            b = _Batch(batch.column(1))
            seq = [_id(sequence_hash(b.w[x:y])) for x, y in b.bounds()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(b.offsets)), pa.array(seq, pa.int64()), b.joined_sha256()],
                                             ["doc_id", "n_words", "seq", "all_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, seq long, all_sha256 string")


def graph_nodes(docs: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """(node, seq, way_in, way_out) of every node of every distinct word sequence of a batch."""
    def run(batches):
        for batch in batches:
            parts, seen = [], set()
            for piece in small([batch]):
                for _, own, t in _Batch(piece.column(0)).texts(window, k):
                    if own in seen:
                        continue
                    seen.add(own)
                    way_in, way_out = t.edges(own)
                    parts.append((t.names, np.full(len(t.names), own, np.uint64), way_in, way_out))
            for i in range(0, len(parts), 1024):
                cols = [signed(np.concatenate(c)) for c in zip(*parts[i:i + 1024], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["node", "seq", "way_in", "way_out"])

    return docs.select("text").mapInArrow(run, "node long, seq long, way_in long, way_out long")


def repeats(docs: DataFrame, window: int = WINDOW, k: int = K) -> tuple[DataFrame, DataFrame]:
    """``sequences`` of all rows, and (doc_id, seq, text, spans) of the texts that lose words but are not copies of a smaller doc_id.

    ``spans`` is an array of (lo, hi): first and last window start.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    named = written(sequences(docs), "word-sequences")
    first = named.where(f"n_words >= {window}").groupBy("seq").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null")
    nodes = graph_nodes(docs, window, k)
    # nodes of two word sequences or more; inner nodes have one way in and one way out
    known = (nodes.groupBy("node").agg(F.min("seq").alias("s0"), F.max("seq").alias("s1"), F.min("way_in").alias("i0"), F.max("way_in").alias("i1"),
                                       F.min("way_out").alias("o0"), F.max("way_out").alias("o1"))
             .where("s0 <> s1").select("node", F.expr("i0 = i1 and o0 = o1").alias("inner_node")))
    known = written(known, "repeated-nodes")
    holders = (nodes.select("node", "seq").join(known, "node").groupBy("seq")
               .agg(F.collect_set(F.struct("node", "inner_node")).alias("nodes")).join(first, "seq").select("doc_id", "seq", "nodes"))
    def own_text(batches):
        """Rows whose text has the sequence named beside it (a doc_id may have several texts)."""
        for batch in small(batches):
            b = _Batch(batch.column(2))
            yield batch.filter(pa.array([_id(sequence_hash(b.w[x:y])) == s for (x, y), s in zip(b.bounds(), batch.column(1).to_pylist(), strict=True)], pa.bool_()))

    holders = having(docs, written(holders, "repeat-nodes"), "inner").select("doc_id", "seq", "text", "nodes")
    holders = written(holders.mapInArrow(own_text, holders.schema), "repeat-holders")

    def look(batches):
        for batch in small(batches):
            ids, seqs, parts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for i, _, t in _Batch(batch.column(2)).texts(window, k):
                repeated = {x["node"] & (1 << 64) - 1: x["inner_node"] for x in batch.column(3)[i].as_py()}
                names, lo, hi = t.lookups(repeated)
                parts.append((np.full(len(names), ids[i]), np.full(len(names), seqs[i]), signed(names), lo, hi))
            if parts:
                cols = [np.concatenate(c) for c in zip(*parts, strict=True)]
                yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int64)) for c in cols[:3]), *(pa.array(c.astype(np.int32)) for c in cols[3:])],
                                                 ["doc_id", "seq", "name", "lo", "hi"])

    looked = holders.mapInArrow(look, "doc_id long, seq long, name long, lo int, hi int")
    least = looked.groupBy("name").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("name", "least")
    late = (looked.join(least, "name").where("least < doc_id").groupBy("doc_id", "seq")
            .agg(F.collect_set(F.struct("lo", "hi")).alias("spans")))
    return named, holders.select("doc_id", "seq", "text").dropDuplicates(["doc_id", "seq"]).join(late, ["doc_id", "seq"])


def _kept(n: int, spans: list[dict], window: int) -> np.ndarray:
    """Which of n words stay: window starts lo..hi of each span cover the words lo..hi + window - 1."""
    edge = np.zeros(n + 1, np.int64)
    for s in spans:
        edge[s["lo"]] += 1
        edge[s["hi"] + window] -= 1
    return np.cumsum(edge[:-1]) == 0


def remove_repeats(docs: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of ``docs``."""
    named, late = repeats(docs, window, k)

    def cut(batches):
        for batch in small(batches):
            b = _Batch(batch.column(2))
            stays = np.concatenate([_kept(y - x, batch.column(3)[i].as_py(), window) for i, (x, y) in enumerate(b.bounds())] or [np.empty(0, bool)])
            gone = np.concatenate([[0], np.cumsum(~stays)])[b.offsets]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(gone)), b.joined_sha256(stays)],
                                             ["doc_id", "seq", "gone", "cut_sha256"])

    changed = late.select("doc_id", "seq", "text", "spans").mapInArrow(cut, "doc_id long, seq long, gone long, cut_sha256 string")
    first = named.groupBy("seq").agg(F.min("doc_id").alias("least"))
    copy = F.col("doc_id") > F.col("least")
    rows = named.join(first, "seq").join(changed, ["doc_id", "seq"], "left")
    whole = copy & (F.col("n_words") >= window)
    return rows.select(
        "doc_id", "n_words", F.when(whole, F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("cut_sha256", "all_sha256")).alias("kept_sha256"))
