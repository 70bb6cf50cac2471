"""Best-fit packing of documents into sequences of several permitted lengths."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesift.session import stage

LENGTHS = (512, 1024, 2048, 4096)
SEQUENCE_COST = 256
ATTENTION_TOKENS = 8192
SHARD_PIECES = 20_000

PACKED_FIELDS = "piece long, first_token long, n_tokens long, bin_id long, bin_length int, bin_offset long"


def word_tokens(text: Column) -> Column:
    """Words parted by ASCII white space, and one end of text."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long") + 1


def bin_cost(length: int) -> float:
    """What a sequence costs: a fixed part, its tokens, and their attention to each other."""
    return SEQUENCE_COST + length + length * length / ATTENTION_TOKENS


class Packer:
    """Best fit by decreasing size over bins of several lengths.

    A piece goes to the open bin with the least room that holds it. If there is none, a bin
    opens whose length has the least cost per token among those that hold the piece; of equal
    ones, the longest. In the end each bin shrinks to the cheapest length that holds its
    contents. Room is kept as counts of bins by free tokens, so a choice looks at lengths, not
    at bins.
    """

    def __init__(self, lengths: Sequence[int], cost=bin_cost):
        self.lengths = sorted(set(lengths))
        self.cost = cost
        longest = self.lengths[-1]
        self.free: list[list[int]] = [[] for _ in range(longest + 1)]
        self.rooms: list[int] = []  # free token counts that some open bin has, in order
        self.filled: list[int] = []
        self.opened: list[int] = []
        ways = [[n for n in self.lengths if n >= size] for size in range(longest + 1)]
        self.best_new = [min(w, key=lambda n: (cost(n) / n, -n)) for w in ways]

    def place(self, size: int) -> tuple[int, int]:
        """The bin and the offset of a piece."""
        at = bisect_left(self.rooms, size)
        if at < len(self.rooms):
            room = self.rooms[at]
            number = self.free[room].pop()
            if not self.free[room]:
                del self.rooms[at]
        else:
            number = len(self.filled)
            self.filled.append(0)
            room = self.best_new[size]
            self.opened.append(room)
        offset, left = self.filled[number], room - size
        self.filled[number] += size
        if left:
            if not self.free[left]:
                self.rooms.insert(bisect_left(self.rooms, left), left)
            self.free[left].append(number)
        return number, offset

    def final_lengths(self) -> list[int]:
        """The cheapest permitted length for each bin's contents."""
        by_cost = sorted(self.lengths, key=lambda n: (self.cost(n), n))
        return [next(n for n in by_cost if n >= filled) for filled in self.filled]


def _pack(batches: Iterator[pa.RecordBatch], lengths: Sequence[int]) -> Iterator[pa.RecordBatch]:
    """Packs the task's pieces; each task holds about SHARD_PIECES of them."""
    table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
    if table is None or not table.num_rows:
        return
    sizes = table.column("n_tokens").to_numpy()
    number, offset = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
    packer = Packer(lengths)
    for at in np.argsort(-sizes, kind="stable").tolist():
        number[at], offset[at] = packer.place(int(sizes[at]))
    final = np.array(packer.final_lengths(), dtype=np.int32)
    shard = TaskContext.get().partitionId()
    table = table.append_column("bin_id", pa.array((shard << 32) + number))
    table = table.append_column("bin_length", pa.array(final[number])).append_column("bin_offset", pa.array(offset))
    yield from table.to_batches(max_chunksize=10_000)


def pack(docs: DataFrame, lengths: Sequence[int] = LENGTHS, id_col: str = "doc_id", text_col: str = "text",
         tokens: Column | None = None, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Pieces of documents in bins: id and PACKED_FIELDS.

    A document's tokens (`tokens`, by default its words and an end) are cut into pieces of
    the longest permitted length and a rest; no token is dropped. `first_token` is where a
    piece begins in its document, `bin_offset` where in its bin, `bin_length` the bin's final
    permitted length. The tokens of a bin never overlap.

    Pieces are dealt in turn to as many tasks as there are portions of `shard_pieces`, whatever
    their ids, and each task packs its portion: at most the last few bins of a portion stay
    open for want of pieces.

    A null or empty text has the one end token; null ids and repeated rows are packed as
    documents of their own; a count of null or under 1 gives no piece; other columns are not
    read; an empty table gives an empty result.
    """
    longest = max(lengths)
    counted = docs.select(
        F.col(id_col).alias("_id"), (word_tokens(F.col(text_col)) if tokens is None else tokens).alias("_n")
    ).filter(F.col("_n") > 0)
    pieces = counted.select(
        "_id", "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / longest))).alias("piece")
    ).select(
        "_id", "piece", (F.col("piece") * longest).alias("first_token"),
        F.least(F.lit(longest), F.col("_n") - F.col("piece") * longest).alias("n_tokens"),
    )
    pieces = stage(pieces, "pack-pieces")
    dealt = pieces.repartition(pieces.count() // shard_pieces + 1)
    kind = pieces.schema["_id"].dataType.simpleString()
    return dealt.mapInArrow(partial(_pack, lengths=tuple(lengths)), f"_id {kind}, {PACKED_FIELDS}").withColumnRenamed(
        "_id", id_col
    )


def packing_summary(packed: DataFrame) -> DataFrame:
    """Per final length: bins, pieces, tokens, and the share of the bins' room that is used."""
    bins = packed.groupBy("bin_id", "bin_length").agg(
        F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("tokens")
    )
    return bins.groupBy("bin_length").agg(
        F.count(F.lit(1)).alias("bins"), F.sum("pieces").alias("pieces"), F.sum("tokens").alias("tokens"),
        (F.sum("tokens") / F.sum("bin_length")).alias("used"),
    )
