"""Sharding by histogram sort (DataFrame operations only).

Documents are laid out in the order (crc32 of the text, doc_id), in which
equal texts are neighbours, and cut into shards of near equal bytes. The key
space is probed in rounds: each round counts exact bytes and rows below
equally spaced candidate boundaries of the cells that still matter (a cell
in which a cut falls, or with more than ``1 / max_share`` of all bytes or
rows) and splits those further, until every cut is known to the row and no
cell is heavy. Then the rows are exchanged once, by cell.

A cell is a range of crc values or, for a text with very many copies, one
crc value and a range of doc_ids, so hot texts are spread over many tasks.
What reaches the driver per round is at most 4,096 counts plus 256 for each
split cell (at most ``n_shards + 2 * max_share`` a level), whatever the input.

Defined cases: a null text counts as empty (size 1, crc 0); a null doc_id is
taken as the smallest long; repeated rows get one slot each; rows with the
same text and doc_id count as equally long when a cut falls between them; an
empty table gives no rows; further columns are kept (those named as an
output column are replaced).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import written

LAW = "bytes"
#: Bits of the crc dropped by the cells of each level: 4,096 cells, then 256, 256 and 16 in each split one.
SHIFTS = (20, 12, 4, 0)
FAN = 256
MAX_SHARE = 1024
LOWEST = -(1 << 63)
ADDED = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]


@dataclass
class Probes:
    """Which cells are split: crc cells by level, and crc/doc_id cells by depth as path -> (first id, ids per part)."""

    crc: list[set[int]] = field(default_factory=lambda: [set() for _ in SHIFTS[:-1]])
    ids: list[dict[str, tuple[int, int]]] = field(default_factory=list)

    def cells(self, keys: DataFrame) -> DataFrame:
        """``keys`` with the path ``cell`` of its leaf cell: ``level:crc cell[/id part ...]``."""
        path = F.concat(F.lit("0:"), F.shiftright("text_crc32", SHIFTS[0]))
        for lv, split in enumerate(self.crc):
            if split:
                path = F.when(F.shiftright("text_crc32", SHIFTS[lv]).isin(sorted(split)),
                              F.concat(F.lit(f"{lv + 1}:"), F.shiftright("text_crc32", SHIFTS[lv + 1]))).otherwise(path)
        keys = keys.withColumn("cell", path).withColumn("cell_id", F.coalesce("doc_id", F.lit(LOWEST)))
        wide = T.DecimalType(20, 0)
        schema = T.StructType([T.StructField("cell", T.StringType()), T.StructField("first_id", T.LongType()),
                               T.StructField("ids_each", T.LongType())])
        for split in self.ids:
            parts = keys.sparkSession.createDataFrame([(c, *x) for c, x in split.items()], schema)
            part = F.floor((F.col("cell_id").cast(wide) - F.col("first_id").cast(wide)) / F.col("ids_each").cast(wide))
            keys = (keys.join(F.broadcast(parts), "cell", "left")
                    .withColumn("cell", F.when(F.col("first_id").isNull(), F.col("cell"))
                                .otherwise(F.concat("cell", F.lit("/"), part.cast("string"))))
                    .drop("first_id", "ids_each"))
        return keys


@dataclass(frozen=True)
class Cell:
    path: str
    bytes: int
    rows: int
    least: int
    most: int

    @property
    def level(self) -> int:
        return int(self.path[0])

    @property
    def crc(self) -> int:
        return int(self.path[2:].split("/")[0])

    @property
    def order(self) -> tuple:
        return (self.crc << SHIFTS[self.level], *map(int, self.path.split("/")[1:]))

    @property
    def one_key(self) -> bool:
        return self.rows == 1 or self.level == len(SHIFTS) - 1 and self.least == self.most


def histogram_cells(keys: DataFrame, n_shards: int, max_share: int) -> tuple[Probes, list[Cell]]:
    """Rounds of exact counts; the probes and the leaf cells in key order."""
    probes = Probes()
    while True:
        counted = (probes.cells(keys).groupBy("cell")
                   .agg(F.sum("size"), F.count(F.lit(1)), F.min("cell_id"), F.max("cell_id")).collect())
        cells = sorted((Cell(*r) for r in counted), key=lambda c: c.order)
        total, rows = sum(c.bytes for c in cells), sum(c.rows for c in cells)
        below, split = 0, []
        for c in cells:
            cut_inside = below * n_shards // total != (below + c.bytes - 1) * n_shards // total
            if (cut_inside or c.bytes * max_share > total or c.rows * max_share > rows) and not c.one_key:
                split.append(c)
            below += c.bytes
        if not split:
            return probes, cells
        for c in split:
            if c.level < len(SHIFTS) - 1:
                probes.crc[c.level].add(c.crc)
                continue
            depth = c.path.count("/")
            while len(probes.ids) <= depth:
                probes.ids.append({})
            probes.ids[depth][c.path] = (c.least, max(1, -(-(c.most - c.least + 1) // FAN)))


def shard_documents(docs: DataFrame, n_shards: int = 8, max_share: int = MAX_SHARE) -> DataFrame:
    """``docs`` with size, text_crc32, law, shard, slot and grown_shard.

    Shard of a row: ``floor(n_shards * bytes before it / all bytes)`` in key
    order, so each shard's bytes are within one document of equal. ``slot``
    counts a shard's rows from 0 without gaps, in key order. ``grown_shard``
    is null under this law.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    # further columns travel in a struct, so that none meets a name used here
    others = [c for c in docs.columns if c.lower() not in ("doc_id", "text", *ADDED)]
    kept = [F.struct(*(F.col(f"`{c}`") for c in others)).alias("other_columns")] if others else []
    sized = (docs.select("doc_id", "text", *kept).withColumn("size", F.octet_length(text).cast("long") + 1)
             .withColumn("text_crc32", F.crc32(text.cast("binary"))))
    keys = written(sized.select("doc_id", "size", "text_crc32"), "shard-keys")
    probes, cells = histogram_cells(keys, n_shards, max_share)
    total = sum(c.bytes for c in cells)

    def shard_at(below: int) -> int:
        return below * n_shards // total

    placed, below, used, shard = [], 0, 0, 0
    for c in cells:
        if shard_at(below) != shard:
            shard, used = shard_at(below), 0
        placed.append((c.path, c.bytes, c.rows, below, shard, used))
        # rows of a cell with a cut inside have one key and count as equally long
        last = shard_at(below + (c.rows - 1) * c.bytes // c.rows)
        if last == shard:
            used += c.rows
        else:
            shard, used = last, sum(shard_at(below + i * c.bytes // c.rows) == last for i in range(c.rows))
        below += c.bytes
    schema = T.StructType([T.StructField("cell", T.StringType())] + [
        T.StructField(n, T.LongType()) for n in ("cell_bytes", "cell_rows", "cell_below", "cell_shard", "cell_slot")])
    offsets = sized.sparkSession.createDataFrame(placed, schema)
    row = F.col("cell_row")
    in_cell = Window.partitionBy("cell").orderBy("text_crc32", "cell_id")
    return (probes.cells(sized).join(F.broadcast(offsets), "cell")
            .withColumn("cell_row", F.row_number().over(in_cell).cast("long") - 1)
            .withColumn("law", F.lit(LAW))
            .withColumn("shard", F.when(F.col("cell_rows") == 1, F.col("cell_shard")).otherwise(F.expr(
                f"(cell_below + if(cell_shard = (cell_below + cell_bytes - 1) * {n_shards} div {max(total, 1)}, 0L, "
                f"cell_row * cell_bytes div cell_rows)) * {n_shards} div {max(total, 1)}")).cast("int"))
            .withColumn("slot", F.when(F.col("shard") == F.col("cell_shard"), F.col("cell_slot") + row)
                        .otherwise(row - F.min(row).over(Window.partitionBy("cell", "shard"))))
            .withColumn("grown_shard", F.lit(None).cast("int"))
            .select(*(F.col("other_columns")[c].alias(c) if c in others else c for c in docs.columns if c.lower() not in ADDED), *ADDED))
