"""Near-duplicate join of word n-gram sets by prefix trees.

A text's set holds its distinct 5-word shingles (words lower-cased, A-Z
only); two texts link when 100 * intersection >= 75 * union.

1. A global order of all shingles is fixed: rare ones by hash, then the most
   frequent ones (counted over all texts) by frequency. Texts with equal sets
   are one class and are compared once.
2. Two linked sets share a shingle among the first ``n - ceil(3n/4) + 1`` of
   each, so those are dealt out by shingle. A shingle that very many sets
   hold is dealt to a triangle of tiles, every two of its sets meeting in one
   of them. Within a tile, every set is paired first with the tile's two hubs,
   the sets with the smallest scrambled identities (mostly the same two all
   over a group of near copies).
3. Pairs that share too few of these first shingles to reach the overlap
   needed are left out; the others are verified by tries: for each left set, the right sets are stored
   in a trie in the global order and walked with the left set; sets with a
   common beginning share the partial overlap, and a subtree is left as soon
   as the words remaining on either side cannot reach the overlap needed.
4. Verified links are contracted to components. In ``ROUNDS`` rounds, every
   set outside the largest component of its tile then meets up to ``MEETINGS``
   sets of other components, others in every tile and round, which contracts
   nearly all of a group. The remaining pairs of a tile that pass the length and position
   bounds and lie in different components are verified last, so no link
   between components is lost, while groups of thousands of near copies never
   become all pairs. Of these, a pair is left out where either set has too few
   first shingles that any other set holds, and in the tile of a shingle
   shortly before which both hold another: they meet in that one's tile.

Sets are held as 64-bit hashes; a set's identity is a 64-bit hash of all of
them with their number.

Defined cases: null and empty texts and texts without words have no
shingles, link with nothing and are their own component; repeated rows have
equal sets and link; rows with equal doc_id are one document in the links
and keep a row each; a null doc_id gets a null component; extra columns stay
in ``one_of_each``.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components, joined
from .text import as_text, hash_words, having, lean, mix64, sequence_hash, ship, signed, small, split_words, unused, window_hashes, written

N = 5
FREQUENT = 1 << 16
#: Shingles whose counts a task holds at most before it drops those seen once.
COUNTED = 1 << 20
MEETINGS = 4
ROUNDS = 2
TILE = 1_000
TRIE_SETS = 256
#: Shingles before an entry's own by which pairs that have met already are told.
BEFORE = 3


def needed(a: int, b: int) -> int:
    """Smallest intersection of linked sets of sizes a and b: 100 x >= 75 (a + b - x)."""
    return -(-3 * (a + b) // 7)


def prefix_length(n: int) -> int:
    return n - -(-3 * n // 4) + 1


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The distinct shingle hashes of every text, ascending; a few hundred texts are worked on at a time."""
    if len(texts) > 500:
        return [s for i in range(0, len(texts), 500) for s in shingle_sets(texts.slice(i, 500))]
    words, offsets = split_words(as_text(texts), lower=True)
    w = hash_words(words)
    grams, out = window_hashes(w, N), []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= N:
            out.append(np.unique(grams[a:b - N + 1]))
        else:
            out.append(np.array([sequence_hash(w[a:b])], np.uint64) if b > a else np.empty(0, np.uint64))
    return out


class Order:
    """The global order: shingles not listed by hash, then the listed ones, most frequent last."""

    def __init__(self, frequent: np.ndarray, counts: np.ndarray):
        rank = np.argsort(np.lexsort((frequent, counts)))
        at = np.argsort(frequent)
        self.known, self.rank, self.count = frequent[at], rank[at], counts[at]

    def find(self, s: np.ndarray) -> np.ndarray:
        """Place of each shingle in the list, -1 if not listed."""
        if not len(self.known):
            return np.full(len(s), -1)
        at = np.minimum(np.searchsorted(self.known, s), len(self.known) - 1)
        return np.where(self.known[at] == s, at, -1)

    def sort(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The set in global order, and the corpus count of each (0 if not listed)."""
        at = self.find(s)
        first = np.where(at < 0, -1, self.rank[at] if len(self.rank) else 0)
        order = np.lexsort((s, first))
        count = np.where(at < 0, 0, self.count[at] if len(self.count) else 0)
        return s[order], count[order]


def _signature(s: np.ndarray) -> int:
    return int(np.uint64(sequence_hash(s)).view(np.int64))


class Counts:
    """Counts of shingles of a task's texts, in bounded memory: beyond ``most`` shingles, those seen once are forgotten.

    Counts are too small by the times a shingle was forgotten; they only set an order.
    """

    def __init__(self, most: int = COUNTED):
        self.most, self.held, self.rows = most, [], 0

    def add(self, sets: list[np.ndarray]) -> None:
        h = np.sort(np.concatenate(sets)) if sets else np.empty(0, np.uint64)
        ends = _bounds([h]) if len(h) else np.zeros(1, int)
        self.held.append((h[ends[:-1]], np.diff(ends)))
        self.rows += len(ends) - 1
        if self.rows > self.most:
            self._merge()
            if self.rows > self.most // 2:
                h, n = self.held[0]
                self.held, self.rows = [(h[n > 1], n[n > 1])], int((n > 1).sum())

    def _merge(self) -> None:
        h = np.concatenate([x for x, _ in self.held]) if self.held else np.empty(0, np.uint64)
        n = np.concatenate([x for _, x in self.held]) if self.held else np.empty(0, int)
        order = np.argsort(h)
        h, n = h[order], n[order]
        starts = _bounds([h])[:-1] if len(h) else np.empty(0, int)
        self.held = [(h[starts], np.add.reduceat(n, starts) if len(h) else n)]
        self.rows = len(starts)

    def often(self) -> tuple[np.ndarray, np.ndarray]:
        """Shingles of two texts or more, and their counts."""
        self._merge()
        h, n = self.held[0]
        return h[n > 1], n[n > 1]


def read_sets(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One pass over the texts: (doc_id, n, sig) of every row, and (h, n) counts of common shingles.

    ``sig`` is the identity of the set of n shingles. Each task reports the
    shingles that it holds in two texts or more.
    """
    def out(ids, n, sig, h):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, n, sig, h)], ["doc_id", "n", "sig", "h"])

    def run(batches):
        counts = Counts()
        for batch in small(batches):
            sets = shingle_sets(batch.column(1))
            counts.add(sets)
            yield out(batch.column(0), [len(s) for s in sets], [_signature(s) for s in sets], pa.nulls(len(sets), pa.int64()))
        h, n = counts.often()
        for i in range(0, len(h), 100_000):
            part = signed(h[i:i + 100_000])
            none = pa.nulls(len(part), pa.int64())
            yield out(none, n[i:i + 100_000].astype(np.int64), none, part)

    read = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
                   .mapInArrow(lean(run), "doc_id long, n long, sig long, h long"), "shingle-pass")
    return read.where("sig is not null").select("doc_id", "n", "sig"), read.where("h is not null").select("h", "n")


def global_order(counts: DataFrame, size: int = FREQUENT) -> Order:
    """The order by the ``size`` largest counts. Any list gives the same links; a better one gives fewer candidates."""
    rows = counts.groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(size).toArrow()
    return Order(rows.column(0).to_numpy().astype(np.int64).view(np.uint64), rows.column(1).to_numpy().astype(np.int64))


def _tiles_of(count: np.ndarray, sig: int, tile: int) -> list[tuple[int, int]]:
    """(entry, tile) for entries of a set: one tile up to ``tile`` sets, else a row and column of a triangle of tiles."""
    out = []
    for i, c in enumerate(count.tolist()):
        m = -(-c // tile)
        if m <= 1:
            out.append((i, 0))
        else:
            b = sig % m
            out += [(i, min(b, o) * m + max(b, o)) for o in range(m)]
    return out


def prefix_entries(docs: DataFrame, order, tile: int = TILE) -> DataFrame:
    """(token, tile, n, sig, pos) of the prefix of every distinct set of a batch. ``order`` gives the Order in a task."""
    def run(batches):
        own = order()
        for batch in small(batches):
            columns, seen = [], set()
            for s in shingle_sets(batch.column(0)):
                if not len(s) or (sig := _signature(s)) in seen:
                    continue
                seen.add(sig)
                k = prefix_length(len(s))
                tokens, count = own.sort(s)
                tokens, count = tokens[:k], count[:k]
                if count.max(initial=0) > tile:
                    at, t = (np.array(x) for x in zip(*_tiles_of(count, sig, tile), strict=True))
                else:
                    at, t = np.arange(k), np.zeros(k, int)
                columns.append((signed(tokens)[at], t, np.full(len(at), len(s)), np.full(len(at), sig), at))
            for i in range(0, len(columns), 512):
                part = [np.concatenate(c) for c in zip(*columns[i:i + 512], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(part[0]), *(pa.array(c.astype(np.int32)) for c in part[1:3]),
                                                  pa.array(part[3].astype(np.int64)), pa.array(part[4].astype(np.int32))],
                                                 ["token", "tile", "n", "sig", "pos"])

    return docs.select("text").mapInArrow(lean(run), "token long, tile int, n int, sig long, pos int")


def _groups(batches, keys: int):
    """Arrow tables of whole groups: consecutive rows with the same first ``keys`` columns, many groups a table."""
    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if rest is not None:
            t = pa.concat_tables([rest, t]).combine_chunks()
        if not t.num_rows:
            continue
        ends = _bounds([t.column(i).to_numpy() for i in range(keys)])
        if len(ends) > 2:
            yield t.slice(0, ends[-2])
        rest = t.slice(ends[-2])
    if rest is not None and rest.num_rows:
        yield rest


def _bounds(cols) -> np.ndarray:
    """Starts of the runs of equal keys, and the end."""
    n = len(cols[0])
    change = np.zeros(n - 1, bool)
    for c in cols:
        change |= c[1:] != c[:-1]
    return np.concatenate([[0], np.flatnonzero(change) + 1, [n]])


def _shared(batches):
    """Entries whose tile holds two sets or more, each with the tile's two hubs where both pass the bounds."""
    for t in _groups(batches, 2):
        token, tile, n, sig, pos = (t.column(i).to_numpy() for i in range(5))
        same_tile = (token[1:] == token[:-1]) & (tile[1:] == tile[:-1])
        again = np.concatenate([[False], same_tile & (sig[1:] == sig[:-1])])  # equal sets of several batches
        token, tile, n, sig, pos = (c[~again] for c in (token, tile, n, sig, pos))
        if len(token) < 2:
            continue
        ends = _bounds([token, tile])
        size = np.repeat(np.diff(ends), np.diff(ends))
        group = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        ranked = np.lexsort((mix64(sig.view(np.uint64)), group))  # each tile's sets, hubs first
        m, left, hubs = n.astype(np.int64), n.astype(np.int64) - pos, []
        for place in (0, 1):
            hub = ranked[np.minimum(ends[:-1] + place, len(ranked) - 1)][group]
            a, b = np.minimum(m, m[hub]), np.maximum(m, m[hub])
            bad = (size < 2) | (sig == sig[hub]) | (4 * a < 3 * b) | (np.minimum(left, left[hub]) < -(-3 * (a + b) // 7))
            hubs.append(pa.array(sig[hub], mask=bad))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (token, tile, n, sig, pos)] + hubs,
                                         ["token", "tile", "n", "sig", "pos", "hub", "hub2"]).filter(pa.array(size > 1))


def _fits(n, m, left, rest):
    """Length and position bounds of two sets of n and m shingles, ``left`` and ``rest`` of them from a shared one on."""
    return (4 * np.minimum(n, m) >= 3 * np.maximum(n, m)) & (np.minimum(left, rest) >= -(-3 * (n + m) // 7))


def _apart(batches, choose):
    """Tables of entries with their components, and the places (i, j) of entries of one tile, in different components, that pass the bounds.

    ``choose(fits, component, dealt)`` gives the places of a tile of three sets
    or more from the matrix of fitting pairs; ``dealt`` is an order of the
    tile's sets that differs from tile to tile. Further columns, if any, are the
    set's number of shared first shingles and those before this entry's (its
    own: none); pairs go that share too few or have met before.
    """
    def kept(i, j):
        ok = np.minimum(held[i], held[j]) >= needed(m[i], m[j]) - np.maximum(m[i] - prefix_length(m[i]), m[j] - prefix_length(m[j]))
        i, j = i[ok], j[ok]
        met = np.zeros(len(i), bool)
        for x in before:
            for y in before:
                met |= (x[i] == y[j]) & (x[i] != token[i])
        return i[~met], j[~met]

    for t in _groups(batches, 2):
        token, tile, n, sig, pos, comp = (t.column(i).to_numpy() for i in range(6))
        held, *before = (t.column(i).to_numpy() for i in range(6, t.num_columns)) if t.num_columns > 6 else (None,)
        m = n.astype(np.int32)  # a tile's matrices are a few million values
        left = (m - pos).astype(np.int32)
        ends = _bounds([token, tile])
        starts, sizes = ends[:-1], np.diff(ends)
        mixed = np.minimum.reduceat(comp, starts) != np.maximum.reduceat(comp, starts)
        two = starts[mixed & (sizes == 2)]
        two = two[_fits(m[two], m[two + 1], left[two], left[two + 1])]
        pairs = [(two, two + 1)]
        for a, b in zip(starts[mixed & (sizes > 2)].tolist(), ends[1:][mixed & (sizes > 2)].tolist(), strict=True):
            c = comp[a:b]
            fits = np.empty((b - a, b - a), bool)
            for k in range(0, b - a, 128):  # rows of the matrix at a time: its numbers take many times its room
                r = slice(a + k, min(b, a + k + 128))
                fits[k:k + 128] = _fits(m[r, None], m[None, a:b], left[r, None], left[None, a:b]) & (comp[r, None] != c[None])
            i, j = choose(fits, c, np.argsort(mix64((sig[a:b] ^ token[a]).view(np.uint64))))
            pairs.append((a + i, a + j))
            if held is not None:
                pairs[-1] = kept(*pairs[-1])
        if held is not None:
            pairs[0] = kept(*pairs[0])
        yield t, *(np.concatenate(x) for x in zip(*pairs, strict=True))


def _every_pair(fits, component, dealt):
    return np.nonzero(np.triu(fits))


def _few_pairs(fits, component, dealt):
    """Each set outside the tile's largest component with its first ``MEETINGS`` in the order dealt."""
    _, part, sizes = np.unique(component, return_inverse=True, return_counts=True)
    rows = np.flatnonzero(part != sizes.argmax())
    held = fits[rows][:, dealt]
    i, j = np.nonzero(held & (held.cumsum(axis=1, dtype=np.int16) <= MEETINGS))
    return rows[i], dealt[j]


def _pairs(choose):
    """A task giving the pairs (a, b) of set identities that ``choose`` takes."""
    def run(batches):
        for t, i, j in _apart(batches, choose):
            if len(i):
                sig = t.column(3).to_numpy()
                pairs = np.unique(np.stack([np.minimum(sig[i], sig[j]), np.maximum(sig[i], sig[j])], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return run


_crossing, _meetings = _pairs(_every_pair), _pairs(_few_pairs)


def _open(batches):
    """Entries that have a fitting partner in another component."""
    for t, i, j in _apart(batches, _every_pair):
        if len(i):
            yield from t.take(np.unique(np.concatenate([i, j]))).to_batches()


class Trie:
    """Sets in global order, stored with shared beginnings; nodes hold runs of shingles (labels) until sets part."""

    def __init__(self, sets: list[tuple[int, np.ndarray]]):
        self.sets = sorted(sets, key=lambda x: x[1].tolist())

    def linked(self, probe: np.ndarray) -> list[int]:
        """Names of the stored sets that link with ``probe`` (ascending hashes)."""
        out: list[int] = []
        # a node: the stored sets lo..hi agree on their first ``depth`` shingles, of which ``overlap`` are in the probe
        work = [(0, len(self.sets), 0, 0)]
        while work:
            lo, hi, depth, overlap = work.pop()
            first = self.sets[lo][1]
            label_end = len(first) if hi - lo == 1 else self._agree(lo, hi, depth)
            label = first[depth:label_end]
            if len(label):
                at = np.minimum(np.searchsorted(probe, label), len(probe) - 1)
                overlap += int((probe[at] == label).sum())
            sizes = [len(s) for _, s in self.sets[lo:hi]] if hi - lo > 1 else [len(first)]
            # bound by the words remaining on either side
            if not any(overlap + min(m - label_end, len(probe) - overlap) >= needed(m, len(probe)) for m in set(sizes)):
                continue
            while lo < hi and len(self.sets[lo][1]) == label_end:
                if overlap >= needed(label_end, len(probe)):
                    out.append(self.sets[lo][0])
                lo += 1
            while lo < hi:
                token, end = self.sets[lo][1][label_end], lo + 1
                while end < hi and self.sets[end][1][label_end] == token:
                    end += 1
                work.append((lo, end, label_end, overlap))
                lo = end
        return out

    def _agree(self, lo: int, hi: int, depth: int) -> int:
        """How many first shingles the sets lo..hi have in common (they are sorted: compare the outer two)."""
        a, b = self.sets[lo][1], self.sets[hi - 1][1]
        m = min(len(a), len(b))
        parted = np.flatnonzero(a[depth:m] != b[depth:m])
        return depth + int(parted[0]) if len(parted) else m


def _promising(batches):
    """Rows (a, b, n, tokens): b null is a itself and comes first; yields the pairs whose shared first shingles leave the overlap in reach.

    With c first shingles shared, the set whose first shingles end earlier in
    the global order has all its other common shingles among its last ones.
    """
    own, size, probe = None, 0, None
    for batch in batches:
        left, right = [], []
        for a, b, n, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
            t = tokens.values.to_numpy()
            if b is None:
                own, size, probe = a, n, np.sort(t)
            elif a == own:
                at = np.minimum(np.searchsorted(probe, t), len(probe) - 1)
                rest = max(n - prefix_length(n), size - prefix_length(size))
                if int((probe[at] == t).sum()) + rest >= needed(n, size):
                    left.append(a)
                    right.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])


def _verify(batches):
    """Rows (a, b, set): b null holds a's own set and comes first; yields the linked pairs."""
    own, probe, held = None, None, []

    def walk():
        found = Trie(held).linked(probe) if held and probe is not None else []
        return pa.RecordBatch.from_arrays([pa.array([own] * len(found), pa.int64()), pa.array(found, pa.int64())], ["u", "v"])

    for batch in batches:
        for a, b, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if a != own or len(held) >= TRIE_SETS:
                if held:
                    yield walk()
                held = []
            if a != own:
                own, probe = a, None
            s = np.frombuffer(raw.as_py(), np.uint64)
            if b is None:
                probe = np.sort(s)
            else:
                held.append((b, s))
    if held:
        yield walk()


def _beside(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """Pairs (a, b) with b's columns of ``facts`` (by sig), after a row for each a with its own, dealt by a."""
    rights = pairs.join(facts.withColumnRenamed("sig", "b"), "b").select("a", "b", *facts.columns[1:])
    lefts = pairs.select("a").distinct().join(facts.withColumnRenamed("sig", "a"), "a").select("a", F.lit(None).cast("long").alias("b"), *facts.columns[1:])
    return rights.unionByName(lefts).repartition("a").sortWithinPartitions("a", F.asc_nulls_first("b"))


def verified(pairs: DataFrame, docs: DataFrame, firsts: DataFrame, firstly: DataFrame, order) -> DataFrame | None:
    """The pairs (a, b) of set identities whose sets link, as (u, v); None if no pair is promising.

    ``firsts``: sig and a doc_id with that set; ``firstly``: sig, n and the first
    shingles it shares with any set. Sets are made anew from the texts of
    promising pairs only.
    """
    pairs = written(_beside(pairs, firstly).mapInArrow(lean(_promising), "a long, b long"), "shingle-pairs")
    if pairs.isEmpty():
        return None
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct().join(firsts, "sig").select("doc_id").distinct()

    def collect(batches):
        own = order()
        for batch in small(batches):
            kept = {_signature(s): own.sort(s)[0].tobytes() for s in shingle_sets(batch.column(0)) if len(s)}
            yield pa.RecordBatch.from_arrays([pa.array(kept.keys(), pa.int64()), pa.array(kept.values(), pa.binary())], ["sig", "shingles"])

    texts = having(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), wanted)
    sets = written(texts.select("text").mapInArrow(lean(collect), "sig long, shingles binary").dropDuplicates(["sig"]), "shingle-sets")
    return _beside(pairs, sets).mapInArrow(lean(_verify), "u long, v long")


def _rows(docs: DataFrame, tile: int = TILE, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n, sig (set identity) and component_id of every row of ``docs``."""
    named, counts = read_sets(docs)
    order = ship(docs.sparkSession, global_order(counts, frequent))
    entries = (prefix_entries(docs, order, tile).repartition("token", "tile").sortWithinPartitions("token", "tile", "n", "sig")
               .mapInArrow(lean(_shared), "token long, tile int, n int, sig long, pos int, hub long, hub2 long"))
    entries = written(entries, "shingle-entries")
    firsts = named.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("doc_id"))
    firstly = entries.groupBy("sig").agg(F.first("n").alias("n"), F.collect_set("token").alias("tokens"))
    held = written(firstly.withColumn("held", F.size("tokens")), "first-shingles")
    firstly, held = held.select("sig", "n", "tokens"), held.select("sig", "held")
    near = entries.where("hub is not null").select("sig", "hub").unionByName(
        entries.where("hub2 is not null").select("sig", F.col("hub2").alias("hub"))).select(
        F.least("hub", "sig").alias("a"), F.greatest("hub", "sig").alias("b")).distinct()

    def dealt(entries, parts, task, schema):
        """What ``task`` finds in the tiles of ``entries``, given the components so far."""
        marked = (entries.join(parts.withColumnRenamed("node", "sig"), "sig", "left")
                  .select("token", "tile", "n", "sig", "pos", F.coalesce("component", "sig").alias("component"), *entries.columns[5:]))
        return marked.repartition("token", "tile").sortWithinPartitions("token", "tile", "n", "sig").mapInArrow(lean(task), schema)

    pair = "a long, b long"
    tested = written(near, "hub-pairs")
    links = verified(tested, docs, firsts, firstly, order)
    none = docs.sparkSession.createDataFrame([], "u long, v long")
    parts = written(components(none if links is None else links), "hub-components")
    # entries without a fitting partner in another component are done with
    left = written(dealt(entries.drop("hub", "hub2"), parts, _open, "token long, tile int, n int, sig long, pos int, component long")
                   .drop("component"), "open-entries")
    more = None
    if not left.isEmpty():
        for n in range(ROUNDS):
            # another order of the sets of a tile in every round
            turned = left.withColumn("token", F.col("token").bitwiseXOR(n))
            met = written(dealt(turned, parts, _meetings, pair).distinct().join(tested, ["a", "b"], "left_anti"), "met-pairs")
            links = verified(met, docs, firsts, firstly, order)
            if links is not None:
                parts = written(joined(parts, links), "met-components")
            tested = tested.unionByName(met)
        earlier = Window.partitionBy("sig").orderBy("pos")
        before = [F.coalesce(F.lag("token", k).over(earlier), "token").alias(f"before{k}") for k in range(1, BEFORE + 1)]
        crossing = dealt(left.join(held, "sig").select(*left.columns, "held", *before), parts, _crossing, pair)
        crossing = written(crossing.distinct().join(tested, ["a", "b"], "left_anti"), "crossing-pairs")
        more = verified(crossing, docs, firsts, firstly, order)
    # the sets of a doc_id that has several, or an empty one too, are one document
    own = F.when(F.col("n") > 0, F.col("sig"))
    several = written(named.where("doc_id is not null").groupBy("doc_id")
                      .agg(F.min(own).alias("u"), F.max(own).alias("last"), F.min("n").alias("least"))
                      .where("u <> last or (least = 0 and u is not null)"), "several-sets")
    same = named.where("n > 0").join(several.where("u <> last").select("doc_id", "u"), "doc_id").select("u", F.col("sig").alias("v"))
    # classes as nodes; a class's smallest doc_id names its component
    rest = [links for links in (more, None if several.isEmpty() else same) if links is not None]
    if rest:
        parts = joined(parts, reduce(DataFrame.unionByName, rest))
    class_of = firsts.join(parts.withColumnRenamed("node", "sig"), "sig", "left").select(
        "sig", "doc_id", F.coalesce("component", "sig").alias("component"))
    names = class_of.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named_classes = class_of.join(names, "component").select("sig", "component_id")
    whole = (named.join(several.where("least = 0").select("doc_id", "u"), "doc_id", "left")
             .select("doc_id", "n", F.when(F.col("n") > 0, F.col("sig")).otherwise(F.col("u")).alias("sig")))
    return (whole.join(named_classes, "sig", "left")
            .select("doc_id", "n", "sig", F.coalesce("component_id", "doc_id").alias("component_id")))


def near_duplicates(docs: DataFrame, tile: int = TILE, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``."""
    return _rows(docs, tile, frequent).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, **kw) -> DataFrame:
    """One row of each group of near copies: of the doc_id that names it, texts with words first, then by hash.

    A row of null doc_id stays if no row with an id is in its group, once for
    each set; without words it is a group of its own.
    """
    rows = written(_rows(docs, **kw), "row-components")
    names = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count("*").alias("rows")).where("doc_id = component_id")
    order = F.struct(F.coalesce(F.trim("text"), F.lit("")) == "", F.xxhash64("text"), F.xxhash64(*docs.columns))
    first = F.min_by(F.struct(*docs.columns), order).alias("row")
    once = docs.join(names.where("rows = 1").select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    repeated = docs.join(names.where("rows > 1").select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(first).select("row.*")

    sig = unused(docs, "sig")
    at, names_out = docs.columns.index("text"), [*docs.columns, sig]

    def sign(batches):
        for batch in small(batches):
            sets = [_signature(s) if len(s) else None for s in shingle_sets(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sets, pa.int64())], names_out)

    unnamed = docs.where("doc_id is null").mapInArrow(sign, T.StructType([*docs.schema.fields, T.StructField(sig, T.LongType())]))
    taken = rows.where("doc_id is null and component_id is not null").select(F.col("sig").alias(sig)).distinct()
    alone = unnamed.where(F.col(sig).isNotNull()).join(taken, sig, "left_anti").groupBy(sig).agg(first).select("row.*")
    wordless = unnamed.where(F.col(sig).isNull()).select(*docs.columns)
    return once.unionByName(repeated).unionByName(alone).unionByName(wordless)
