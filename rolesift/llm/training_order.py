"""Token sequences in training order: a keyed permutation of slots, and fixed-stride shards."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import tiktoken
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rolesift.llm.bloom import mix
from rolesift.session import fresh_path, stage

SEQUENCE_TOKENS = 2048
SHARD_SEQUENCES = 4096
ROUNDS = 6

# Fixed value: how text is split before the vocabulary's merges
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TOKEN_TYPE = np.dtype("<u2")


@dataclass(frozen=True)
class Vocabulary:
    """A byte-level rank file; `end` is an id that the ranks leave free."""

    lines: bytes
    end: int

    @classmethod
    def from_file(cls, path: str, end: int = 50256) -> Vocabulary:
        with open(path, "rb") as file:
            return cls(file.read(), end)

    def encoding(self) -> tiktoken.Encoding:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.lines.splitlines())}
        return tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


class Feistel:
    """A keyed permutation of 0..size-1.

    A balanced Feistel network permutes the least domain of 2**(2k) that holds `size`; a value
    that falls outside is put in again until it falls inside. The domain is less than four
    times `size` (or 4), so this takes under four turns on average.
    """

    def __init__(self, size: int, key: str, rounds: int = ROUNDS):
        self.size = size
        self.half = max(1, (max(0, size - 1).bit_length() + 1) // 2)
        digest = hashlib.sha256(key.encode()).digest()
        self.keys = [
            np.uint64(int.from_bytes(hashlib.sha256(digest + bytes([r])).digest()[:8], "little")) for r in range(rounds)
        ]

    def _turn(self, x: np.ndarray, keys: list[np.uint64], back: bool) -> np.ndarray:
        half, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        left, right = x >> half, x & mask
        for key in keys:
            if back:
                left, right = right ^ (mix(left ^ key) & mask), left
            else:
                left, right = right, left ^ (mix(right ^ key) & mask)
        return (left << half) | right

    def _walk(self, x: np.ndarray, keys: list[np.uint64], back: bool) -> np.ndarray:
        out = self._turn(np.asarray(x, dtype=np.uint64), keys, back)
        outside = np.flatnonzero(out >= self.size)
        while len(outside):
            out[outside] = self._turn(out[outside], keys, back)
            outside = outside[out[outside] >= self.size]
        return out.astype(np.int64)

    def slot(self, index: np.ndarray) -> np.ndarray:
        return self._walk(index, self.keys, False)

    def index(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, self.keys[::-1], True)


def _sequences(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, width: int) -> Iterator[pa.RecordBatch]:
    """The task's texts as one token stream, each text closed by an end, cut every `width`."""
    encoding, part, local = vocabulary.encoding(), TaskContext.get().partitionId(), 0
    rest = np.empty(0, dtype=TOKEN_TYPE)

    def rows(stream: np.ndarray, count: int) -> pa.RecordBatch:
        nonlocal local
        cut = [stream[k * width : (k + 1) * width] for k in range(count)]
        numbers, local = np.arange(local, local + count), local + count
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(count, part)), pa.array(numbers), pa.array([len(c) for c in cut], pa.int32()),
             pa.array([c.tobytes() for c in cut], pa.binary())],
            names=["part", "local", "n_tokens", "tokens"],
        )

    for batch in batches:
        parts, size = [rest], len(rest)
        for text in batch.column("text"):
            tokens = encoding.encode_ordinary(text.as_py() or "")
            parts.append(np.array([*tokens, vocabulary.end], dtype=TOKEN_TYPE))
            size += len(parts[-1])
            if size >= 1 << 20:
                stream = np.concatenate(parts)
                yield rows(stream, size // width)
                parts, size = [stream[size // width * width :]], size % width
        stream = np.concatenate(parts)
        yield rows(stream, size // width)
        rest = stream[size // width * width :]
    if len(rest):
        yield rows(rest, 1)


def _slots(batches: Iterator[pa.RecordBatch], order: Feistel, shard_sequences: int) -> Iterator[pa.RecordBatch]:
    """Gives each sequence its slot and packs its tokens for the shuffle."""
    coder = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        index = batch.column("index").to_numpy()
        slot = order.slot(index)
        packed = [coder.compress(t.as_py()) for t in batch.column("tokens")]
        yield pa.RecordBatch.from_arrays(
            [pa.array(index), pa.array(slot), pa.array((slot // shard_sequences).astype(np.int32)),
             batch.column("n_tokens"), pa.array(packed, pa.binary())],
            names=["index", "slot", "shard", "n_tokens", "tokens"],
        )


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def _write(batches: Iterator[pa.RecordBatch], folder: str, width: int, shard_sequences: int, end: int
           ) -> Iterator[pa.RecordBatch]:
    """Writes rows that come by slot; a shard has its name only when it is whole."""
    files, root = fs.FileSystem.from_uri(folder)
    files.create_dir(root, recursive=True)
    decoder, stride = zstandard.ZstdDecompressor(), width * TOKEN_TYPE.itemsize
    padding = np.full(width, end, dtype=TOKEN_TYPE).tobytes()
    open_shard, out, temporary = None, None, ""

    def finish() -> None:
        if out is not None:
            out.close()
            files.move(temporary, f"{root}/{shard_name(open_shard)}")

    for batch in batches:
        checks, offsets = [], []
        for slot, shard, tokens in zip(*(batch.column(c).to_pylist() for c in ("slot", "shard", "tokens"))):
            if shard != open_shard:
                finish()
                open_shard, temporary = shard, f"{root}/.{shard_name(shard)}-{uuid.uuid4().hex}"
                out = files.open_output_stream(temporary, compression=None)
            content = decoder.decompress(tokens, max_output_size=stride)
            checks.append(zlib.crc32(content))
            offsets.append(slot % shard_sequences * stride)
            out.write(content + padding[len(content) :])
        yield pa.RecordBatch.from_arrays(
            [batch.column("slot"), batch.column("index"), batch.column("shard"), pa.array(offsets, pa.int64()),
             batch.column("n_tokens"), pa.array(checks, pa.int64())],
            names=["slot", "index", "shard", "byte_offset", "n_tokens", "checksum"],
        )
    finish()


@dataclass(frozen=True)
class TokenShards:
    """Shards in `folder` and their index: slot, index, shard, byte_offset, n_tokens, checksum."""

    folder: str
    rows: DataFrame
    sequences: int
    width: int
    shard_sequences: int

    def read(self, slot: int, count: int) -> list[np.ndarray]:
        """`count` sequences in training order from `slot` on, padded; for resuming a run."""
        files, root = fs.FileSystem.from_uri(self.folder)
        stride, out = self.width * TOKEN_TYPE.itemsize, []
        last = min(slot + count, self.sequences)
        while slot < last:
            shard, first = divmod(slot, self.shard_sequences)
            n = min(last - slot, self.shard_sequences - first)
            with files.open_input_file(f"{root}/{shard_name(shard)}") as file:
                file.seek(first * stride)
                tokens = np.frombuffer(file.read(n * stride), dtype=TOKEN_TYPE).reshape(n, self.width)
            out += list(tokens)
            slot += n
        return out


def materialise(docs: DataFrame, vocabulary: Vocabulary, key: str = "epoch-0", folder: str | None = None,
                width: int = SEQUENCE_TOKENS, shard_sequences: int = SHARD_SEQUENCES, text_col: str = "text"
                ) -> TokenShards:
    """Tokenise all texts and write their sequences in the order of a keyed permutation.

    Each task joins its texts, each closed by an end, and cuts the stream into sequences of
    `width` tokens; only the last of a task is shorter, and padded by ends in its shard. The
    written sequences are counted and numbered; sequence `index` goes to slot
    `Feistel(sequences, key).slot(index)`. One shuffle brings each range of
    `shard_sequences` slots to one task, which writes it as one file of two-byte ids. A
    failed task is repeated with the same content; a file has its name only when it is whole.

    A null or empty text is one end. Repeated rows are texts of their own; ids and other
    columns are not read; an empty table gives no shard and no row.
    """
    spark = docs.sparkSession
    if vocabulary.end >= 1 << 16:
        raise ValueError("token ids must fit two bytes")
    made = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(
        partial(_sequences, vocabulary=vocabulary, width=width), "part long, local long, n_tokens int, tokens binary"
    )
    made = _stage_small(made, "sequences")
    counts = made.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    # One row per task of the scan: a proven bound for the window and the broadcast
    before = stage(
        counts.select("part", "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")), "sequence-parts"
    )
    total = before.agg(F.sum("n")).first()[0] or 0
    folder = folder or _as_uri(fresh_path(spark, "token-shards"))
    numbered = made.join(F.broadcast(before.select("part", "before")), "part").select(
        (F.col("before") + F.col("local")).alias("index"), "n_tokens", "tokens"
    )
    slots = numbered.mapInArrow(
        partial(_slots, order=Feistel(total, key), shard_sequences=shard_sequences),
        "index long, slot long, shard int, n_tokens int, tokens binary",
    )
    shards = max(1, -(-total // shard_sequences))
    ranged = slots.repartitionById(shards, F.col("shard")).sortWithinPartitions("slot")
    rows = ranged.mapInArrow(
        partial(_write, folder=folder, width=width, shard_sequences=shard_sequences, end=vocabulary.end),
        "slot long, index long, shard int, byte_offset long, n_tokens int, checksum long",
    )
    return TokenShards(folder, stage(rows, "shard-rows"), total, width, shard_sequences)


def _stage_small(df: DataFrame, label: str) -> DataFrame:
    """`stage` with a stronger coding: token ids are written once and read once."""
    path = fresh_path(df.sparkSession, label)
    df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "9").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _as_uri(path: str) -> str:
    return path if "://" in path or path.startswith("file:") else f"file://{path}"
