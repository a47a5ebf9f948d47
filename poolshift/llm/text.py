"""Words, word hashes and n-gram hashes of Arrow text batches.

A word is a maximal run of characters other than space and \\t\\n\\v\\f\\r. Each
distinct word of a batch is hashed once (64-bit xxh3) and the rest is numpy
on whole batches, so no Python code runs per word occurrence.
"""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def as_text(col: pa.Array) -> pa.Array:
    """The column as strings; nulls become empty texts."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_string(col.type):
        col = col.cast(pa.string())
    return col.fill_null("")


def split_words(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All words of the batch in order, and ``offsets``: document i owns words[offsets[i]:offsets[i+1]]."""
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets, words = offsets - offsets[0], lists.flatten()
    full = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    if not full.all():
        before = np.concatenate([[0], np.cumsum(full)])
        offsets, words = before[offsets], words.filter(pa.array(full))
    return words, offsets


def small(batches, rows: int = 1000):
    """The batches in slices of at most ``rows`` rows, so that a task's arrays stay small."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def lean(task):
    """``task`` over Arrow batches, handing Arrow's unused memory back when it is done: Python workers live on with what they hold."""
    def run(batches):
        yield from task(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()

    return run


def hash_words(words: pa.Array) -> np.ndarray:
    """64-bit hash of every word; each distinct word is hashed once."""
    if not len(words):
        return np.empty(0, np.uint64)
    coded = words.dictionary_encode()
    table = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()),
                        np.uint64, len(coded.dictionary))
    return table[coded.indices.to_numpy(zero_copy_only=False)]


def window_hashes(w: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` word hashes (rolling polynomial mod 2^64, then mixed).

    Element i stands for w[i:i+k]; length max(0, len(w) - k + 1). Runs are
    taken over the whole array: the caller keeps those within one document.
    """
    n = len(w)
    if n < k:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        powers = np.full(n, _BASE, np.uint64)
        powers[0] = 1
        powers = np.cumprod(powers, dtype=np.uint64)
        inverse = np.full(n - k + 1, _BASE_INV, np.uint64)
        inverse[0] = 1
        inverse = np.cumprod(inverse, dtype=np.uint64)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(w) * powers, dtype=np.uint64)])
        return mix64((sums[k:] - sums[: n - k + 1]) * inverse + np.uint64(k))


def sequence_hash(w: np.ndarray) -> int:
    """64-bit hash of a whole sequence of 64-bit values, order and length included."""
    return xxhash.xxh3_64_intdigest(np.ascontiguousarray(w).tobytes(), seed=len(w))


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark longs."""
    return x.view(np.int64)


#: Bytes of an Arrow batch of texts, at most.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. The session's Arrow batches are held to
    ``BATCH_BYTES`` from here on: by rows alone, a batch of long texts has no bound."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: lineage is cut, executors may be lost, columns stay prunable."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores as it takes to be none of the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ship(spark: SparkSession, value):
    """Broadcasts an object of bounded size with its class; the function returned gives a copy inside a task."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: cloudpickle.loads(sent.value)


#: Rows of the broadcast that thins out a table before a join by doc_id, at most.
THIN = 1 << 20


def having(docs: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """``docs`` joined with ``ids`` by doc_id; few texts are shuffled where few are wanted.

    Texts whose id falls in none of the ``THIN`` hash slots that wanted ids fall
    in go before the shuffle; the broadcast holds slots, never more than
    ``THIN`` rows, and the join after it decides.
    """
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(THIN)).cast("int")
    slots = ids.select(slot.alias("slot")).distinct()
    near = docs.withColumn("slot", slot).join(F.broadcast(slots), "slot", "left_semi").drop("slot")
    return near.join(ids, "doc_id", how)
