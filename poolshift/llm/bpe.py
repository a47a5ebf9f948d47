"""Byte-level BPE encoding and decoding.

Encoding; texts are not shuffled:

1. each whole text is split by the tokenizer's pattern (Spark's
   ``regexp_extract_all``);
2. the words of a block of documents are turned into a list of distinct words
   and a stream of positions in it (Arrow dictionary encoding); words that
   occur in several blocks are folded once for all blocks (at most ``SHARED``
   words, the ones in most blocks; the rest are folded with their block);
3. Spark higher-order functions fold the merges over the bytes of each
   distinct word: in every step the adjacent pair whose concatenation has
   the lowest rank is joined, until no pair has a rank. The rank map is a
   literal: 8,192 small maps, chosen by the crc32 of the piece, so a lookup
   costs the same whatever the size of the vocabulary;
4. the ids of the distinct words are laid out by the positions.

Words of more than ``LONG_WORD`` bytes take the same merges from a heap
(the fold is quadratic in the word's length). Decoding concatenates the
binary pieces of the ids.

Defined cases: null and empty texts have no ids; repeated rows are encoded
each; ids outside the vocabulary cannot be decoded and raise; further columns
named in ``keep`` are carried along under their own names.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import hash_words, lean, written

#: The pattern that splits texts, as the tokenizer's users write it; white space and letters are Unicode's ("(?U)").
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BUCKETS = 1 << 13
LONG_WORD = 64
COUNT_BLOCK, BLOCK = 4_000_000, 500_000  # words of a block: when words are counted, when texts are encoded
SHARED = 1 << 19


def read_ranks(path: str) -> dict[bytes, int]:
    """Piece -> rank from a rank file (base64 piece, space, rank on each line); a vocabulary, bounded by its file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _latin(piece: bytes) -> str:
    """Bytes as a string with one character for each byte."""
    return piece.decode("latin-1")


def rank_map(ranks: dict[bytes, int]) -> Column:
    """The ranks as a literal: array of maps from piece to rank."""
    maps: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for piece, rank in ranks.items():
        key = _latin(piece)
        maps[zlib.crc32(key.encode()) % BUCKETS][key] = rank
    return F.from_json(F.lit(json.dumps(maps, separators=(",", ":"))), "array<map<string,int>>")


def _let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once (indexing or flattening an expression asks for its type again each time; a variable has it)."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda kept, _: kept, use)


def fold_merges(word: Column, ranks: Column) -> Column:
    """Ids of one word: ranked merges folded over its bytes, held as pieces (p), each with the rank (r) of its pair with the next."""
    def rank(piece: Column) -> Column:
        return ranks[(F.crc32(piece.cast("binary")) % BUCKETS).cast("int")][piece]

    def piece(p: Column, r: Column) -> Column:
        return F.struct(p.alias("p"), r.alias("r"))

    def step(state: Column, _: Column) -> Column:
        def merge(at: Column) -> Column:
            """State after joining pieces ``at`` and ``at + 1``; the ranks beside them are looked up anew."""
            def put(joined: Column) -> Column:
                after, before = F.get(state, at + 1)["p"], F.get(state, at - 2)["p"]
                last = piece(joined, rank(F.concat(joined, after)))
                return _let(F.array(  # flatten: much cheaper here than concat of arrays
                    F.slice(state, 1, F.greatest(at - 2, F.lit(0))),
                    F.when(at > 1, F.array(piece(before, rank(F.concat(before, joined))), last)).otherwise(F.array(last)),
                    F.slice(state, at + 2, LONG_WORD)), F.flatten)

            return F.when(at.isNull(), state).otherwise(_let(F.concat(F.get(state, at - 1)["p"], F.get(state, at)["p"]), put))

        # not by array_position: each place that it finds costs an exception
        places = F.transform(state, lambda s, i: s["r"] * LONG_WORD + i)
        return _let(F.array_min(places) % LONG_WORD + 1, merge)

    def ids(chars: Column) -> Column:
        start = F.transform(chars, lambda c, i: piece(c, rank(F.concat(c, F.get(chars, i + 1)))))
        return F.aggregate(F.sequence(F.lit(2), F.size(chars)), start, step, lambda s: F.transform(s["p"], rank))

    def text_ids(text: Column) -> Column:
        return _let(rank(text), lambda whole: F.when(whole.isNotNull(), F.array(whole)).when(
            F.octet_length(word) <= LONG_WORD, _let(F.split(text, ""), ids)))

    return _let(F.decode(word.cast("binary"), "ISO-8859-1"), text_ids)


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for one long word, with a heap of adjacent pairs (lowest rank first, then leftmost)."""
    n = len(word)
    start, end = list(range(n)), list(range(1, n + 1))
    prev, nxt = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(word[i:i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, mid, stop = heapq.heappop(heap)
        j = nxt[i]
        if not alive[i] or j >= n or end[i] != mid or end[j] != stop:
            continue
        end[i], alive[j], nxt[i] = end[j], False, nxt[j]
        if nxt[i] < n:
            prev[nxt[i]] = i
            if (r := ranks.get(word[start[i]:end[nxt[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[i], end[nxt[i]]))
        if prev[i] >= 0:
            h = prev[i]
            if (r := ranks.get(word[start[h]:end[i]])) is not None:
                heapq.heappush(heap, (r, h, end[h], end[i]))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[start[i]:end[i]]])
        i = nxt[i]
    return out


def _by_hash(words: pa.Array, lists: pa.Array) -> tuple[pa.Array, np.ndarray, pa.Array]:
    """Words and their ids in the order of the words' hashes, with the hashes: one table for all blocks, none built for each."""
    hashes = hash_words(words)
    order = np.argsort(hashes)
    return words.take(pa.array(order)), hashes[order], lists.take(pa.array(order))


def _places(words: pa.Array, shared: pa.Array, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each word in ``shared``, and whether it is another word than the one there."""
    if not len(shared):
        return np.zeros(len(words), int), np.ones(len(words), bool)
    at = np.minimum(np.searchsorted(hashes, hash_words(words)), len(shared) - 1)
    return at, pc.not_equal(shared.take(pa.array(at)), words).to_numpy(zero_copy_only=False)


def _blocks(batches, shared: pa.Array, hashes: np.ndarray):
    """Blocks of documents: their rows, words for each row, positions in ``shared`` and the block's further words, those words."""
    rows, lists, held = [], [], 0

    def block():
        words = pa.concat_arrays([x.flatten() for x in lists])
        per_row = np.concatenate([np.diff(x.offsets.to_numpy()) for x in lists]).astype(np.int32)
        coded = words.dictionary_encode()
        at, own = _places(coded.dictionary, shared, hashes)
        place = np.where(own, len(shared) + np.cumsum(own) - 1, at)
        more = coded.dictionary.filter(pa.array(own))
        kept = pa.Table.from_batches(rows).combine_chunks().to_batches()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, kept[0].schema) as out:
            out.write_batch(kept[0])
        return pa.RecordBatch.from_arrays([
            pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([per_row.tobytes()], pa.binary()),
            pa.array([place[coded.indices.to_numpy(zero_copy_only=False)].astype(np.int32).tobytes()], pa.binary()),
            pa.ListArray.from_arrays(pa.array([0, len(more)], pa.int32()), more)],
            ["rows", "per_row", "positions", "words"])

    for batch in batches:
        n = batch.num_columns - 1
        for piece in (batch.slice(i, 200) for i in range(0, batch.num_rows, 200)):
            rows.append(piece.select(range(n)))
            lists.append(piece.column(n))
            held += len(lists[-1].flatten())
            if held >= BLOCK:
                yield block()
                rows, lists, held = [], [], 0
    if rows:
        yield block()


def _folded(words: Column, ranks: Column) -> Column:
    """Ids of each word of an array (null for long words); the literal occurs once."""
    return F.transform(F.array(ranks), lambda r: F.transform(words, lambda w: fold_merges(w, r)))[0]


def shared_words(split: DataFrame, ranks: Column, size: int = SHARED) -> pa.Table:
    """word and ids of the words found in most blocks, at most ``size``, each in two blocks or more.

    ``split``: rows with ``bpe_words``. The words are counted by Spark; how many
    blocks a word must be in follows from the counts of counts.
    """
    def distinct(batches):
        seen, held = [], 0
        for batch in batches:
            seen.append(batch.column(0).flatten().unique())
            held += len(batch.column(0).flatten())
            if held >= COUNT_BLOCK:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(seen).unique()], ["word"])
                seen, held = [], 0
        if seen:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(seen).unique()], ["word"])

    counts = written(split.select("bpe_words").mapInArrow(lean(distinct), "word string").groupBy("word").agg(F.count(F.lit(1)).alias("blocks"))
                     .where(f"blocks > 1 and octet_length(word) <= {LONG_WORD}"), "bpe-words")
    least, total = 2, 0
    for r in counts.groupBy("blocks").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("blocks")).collect():
        total += r["n"]
        if total > size:
            least = r["blocks"] + 1
            break
    words = counts.where(F.col("blocks") >= least)
    return words.select("word", _folded(F.array("word"), ranks)[0].alias("ids")).toArrow().combine_chunks()


def _one(table: pa.Table, name: str, kind: pa.DataType) -> pa.Array:
    return table.column(name).combine_chunks().cast(kind) if table.num_rows else pa.array([], kind)


def encode(docs: DataFrame, ranks: dict[bytes, int], keep: list[str], finish, schema: str, pattern: str = PATTERN,
           shared: int = SHARED) -> DataFrame:
    """Encodes every whole text of ``docs``.

    ``finish(rows, ids, ends)`` gets a record batch of the ``keep`` columns, the
    ids of all its texts as one int32 array and the end of each text's ids,
    and returns the record batches of ``schema``.
    """
    merges, send = rank_map(ranks), docs.sparkSession.sparkContext.broadcast
    split = docs.select(*keep, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("(?U)" + pattern), F.lit(0)).alias("bpe_words"))
    known = shared_words(split, merges, shared)
    words, hashes, lists = map(send, _by_hash(_one(known, "word", pa.string()), _one(known, "ids", pa.list_(pa.int32()))))
    sent = send(ranks)

    def pack(batches):
        yield from _blocks(batches, words.value, hashes.value)

    def lay_out(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                own = _with_long(batch.column(3)[i].values.cast(pa.list_(pa.int32())), batch.column(4)[i].as_py(), sent)
                table = pa.concat_arrays([lists.value, own])
                starts, flat = table.offsets.to_numpy().astype(np.int64), table.values.to_numpy(zero_copy_only=False)
                positions = np.frombuffer(batch.column(2)[i].as_py(), np.int32)
                per_row = np.frombuffer(batch.column(1)[i].as_py(), np.int32)
                rows = pa.ipc.open_stream(batch.column(0)[i].as_py()).read_all().combine_chunks().to_batches()
                yield from finish(rows[0], *_laid_out(starts, flat, positions, per_row))

    blocks = split.mapInArrow(lean(pack), "rows binary, per_row binary, positions binary, words array<string>")
    coded = blocks.select("rows", "per_row", "positions", _folded(F.col("words"), merges).alias("ids"),
                          F.filter("words", lambda w: F.octet_length(w) > LONG_WORD).alias("long_words"))
    return coded.mapInArrow(lean(lay_out), schema)


def _with_long(lists: pa.Array, long_words: list[str], ranks) -> pa.Array:
    """Ids of a block's words, those of its long words filled in."""
    if not lists.null_count:
        return lists
    late = iter([merge_long(w.encode(), ranks.value) for w in long_words if w.encode() not in ranks.value])
    return pa.array([next(late) if x is None else x for x in lists.to_pylist()], pa.list_(pa.int32()))


def _laid_out(starts, flat, positions, per_row):
    """All ids in text order and the end of each row's ids."""
    sizes = np.diff(starts)[positions]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(ends[-1]) - np.repeat(ends[:-1] - starts[positions], sizes)
    return flat[at], ends[np.cumsum(per_row)]


def decode_pieces(ids: np.ndarray, pieces: list[bytes]) -> bytes:
    """The bytes of a sequence of ids."""
    return b"".join(map(pieces.__getitem__, ids.tolist()))


def pieces_of(ranks: dict[bytes, int]) -> list[bytes]:
    out = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        out[rank] = piece
    return out


def encode_documents(docs: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """doc_id and ``ids`` (array<int>) of every row."""
    def finish(rows, ids, ends):
        offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))], ["doc_id", "ids"])

    return encode(docs.withColumn("doc_id", F.col("doc_id").cast("long")), ranks, ["doc_id"], finish, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """doc_id and ``decoded`` (binary) of rows with ``ids``."""
    sent = encoded.sparkSession.sparkContext.broadcast(pieces_of(ranks))

    def run(batches):
        for batch in batches:
            out = [decode_pieces(np.array(x or [], np.int64), sent.value) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "decoded"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, decoded binary")


def round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str = PATTERN) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row; ids are decoded where they are made."""
    sent = docs.sparkSession.sparkContext.broadcast(pieces_of(ranks))

    def finish(rows, ids, ends):
        n, hashes, decoded = [], [], []
        for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            own = ids[a:b]
            n.append(b - a)
            hashes.append(hashlib.sha256(own.astype("<u4").tobytes()).hexdigest())
            decoded.append(hashlib.sha256(decode_pieces(own, sent.value)).hexdigest())
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n, pa.int64()), pa.array(hashes), pa.array(decoded)],
                                         ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encode(docs.withColumn("doc_id", F.col("doc_id").cast("long")), ranks, ["doc_id"], finish,
                  "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", pattern)
