"""SimHash near-duplicates: fingerprints joined on pigeonhole blocks, checked by distance."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolesift.llm.components import components
from rolesift.llm.words import SPACED, word_slices
from rolesift.operators.joins import many_to_one
from rolesift.session import stage

SHINGLE_WORDS = 3
MAX_BITS = 3
BLOCKS = 6
SEED = 42
GROUP_ROWS = 2048
_HASHES = 1 << 18


def fingerprint(text: bytes | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """The 64-bit SimHash of all shingles, repeats included; 0 without words."""
    votes, total = np.zeros(64, dtype=np.int64), 0
    tail: list[bytes] = []
    for words in word_slices(text, SPACED):
        words = tail + words
        if len(words) < shingle_words:
            tail = words
            continue
        tail = words[len(words) - shingle_words + 1 :]
        added, n = _votes(words, shingle_words)
        votes, total = votes + added, total + n
    if not total and tail:
        votes, total = _votes(tail, len(tail))
    ones = (2 * votes > total).astype(np.uint64)
    return int((ones << np.arange(64, dtype=np.uint64)).sum())


def _votes(words: list[bytes], size: int) -> tuple[np.ndarray, int]:
    """How many shingle hashes have each bit, and how many hashes there are."""
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    first, last = starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist()
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(first, last)), dtype=np.uint64, count=len(first))
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _HASHES):
        bits = np.unpackbits(hashes[at : at + _HASHES].view(np.uint8), bitorder="little").reshape(-1, 64)
        votes += bits.sum(axis=0, dtype=np.int64)
    return votes, len(hashes)


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("_text")
        found = [fingerprint(t.as_py(), shingle_words) for t in batch.column(at)]
        yield batch.set_column(at, "fp", pa.array(np.array(found, dtype=np.uint64).view(np.int64)))


def block_masks(blocks: int, max_bits: int) -> list[int]:
    """Masks of all choices of `blocks - max_bits` of the blocks that 64 bits are cut into.

    Two fingerprints that differ in at most `max_bits` bits differ in at most as many
    blocks, so they agree under at least one mask.
    """
    edge = [64 * k // blocks for k in range(blocks + 1)]
    masks = [(1 << high) - (1 << low) for low, high in zip(edge, edge[1:])]
    return [sum(chosen) for chosen in combinations(masks, blocks - max_bits)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _forest(batches: Iterator[pa.RecordBatch], max_bits: int) -> Iterator[pa.RecordBatch]:
    """Edges that connect, within each list, all that links of at most `max_bits` connect."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for batch in batches:
        edges_a, edges_b = [], []
        for group in batch.column(0):
            left = np.unique(group.values.to_numpy(zero_copy_only=False)).view(np.uint64)
            reached: list[np.uint64] = []
            while len(left):
                if not reached:
                    reached, left = [left[0]], left[1:]
                at = reached.pop()
                near = np.bitwise_count(left ^ at) <= max_bits
                found = left[near]
                left = left[~near]
                reached.extend(found)
                edges_a += [at] * len(found)
                edges_b.extend(found)
        pair = [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (edges_a, edges_b)]
        yield pa.RecordBatch.from_arrays(pair, schema=schema)


def links(fingerprints: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS,
          group_rows: int = GROUP_ROWS) -> DataFrame:
    """Edges (a, b) between different values of column `fp` that connect all linked ones.

    Fingerprints meet under each block mask. A pair that is alone is checked at once. Larger
    groups of one masked value are checked in Python, by lists of at most about twice
    `group_rows`: a larger group is dealt by hash into parts of that size, and each two parts
    are one list. Each list gives at most one edge less than it has members, so a group never
    gives all its pairs.
    """
    masks = [_signed(m) for m in block_masks(blocks, max_bits)]
    keyed = fingerprints.select(
        "fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in masks))).alias("mask", "part")
    )
    met = keyed.groupBy("mask", "part").agg(
        F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")
    ).filter(F.col("n") > 1)
    met = stage(met, "simhash-met")
    pairs = met.filter(F.col("n") == 2).select("a", "b").filter(
        F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    )
    larger = met.filter(F.col("n") > 2).select("mask", "part", F.ceil(F.col("n") / group_rows).alias("deals"))
    members = many_to_one(keyed, larger, ["mask", "part"]).withColumn(
        "own", F.pmod(F.xxhash64("fp"), F.col("deals"))
    ).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals") - 1)))
    lists = members.groupBy("mask", "part", F.least("own", "other"), F.greatest("own", "other")).agg(
        F.collect_list("fp").alias("fps")
    )
    # Part k with itself is also in its lists with others, if there are any
    forest = lists.select("fps").mapInArrow(partial(_forest, max_bits=max_bits), "a long, b long")
    return pairs.union(forest)


def near_groups(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS,
                blocks: int = BLOCKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of `docs`: id, fingerprint, component_id.

    Texts are whole: A-Z in lower case, words parted by ASCII white space, shingles of
    `shingle_words` words hashed by XXH64; a fingerprint bit is set if it is in over half of
    them. Fingerprints that differ in at most `max_bits` bits are linked, and component_id is
    the least id that links reach. A fingerprint that many rows share is linked once.

    A null or empty text has fingerprint 0 and is linked as any other; a text of fewer words
    is one shingle. A null id is never the least unless all are null; then component_id is
    null. Repeated rows share their component. Other columns are not read; an empty table
    gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text"))
    schema = f"_id {rows.schema['_id'].dataType.simpleString()}, fp long"
    hashed = stage(rows.mapInArrow(partial(_fingerprints, shingle_words=shingle_words), schema), "simhash-rows")
    values = stage(hashed.groupBy("fp").agg(F.min("_id").alias("least")), "simhash-values")
    edges = links(values.select("fp"), max_bits, blocks)
    roots = components(edges).select(F.col("node").alias("fp"), "root")
    rooted = stage(many_to_one(values, roots, ["fp"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")),
                   "simhash-roots")
    least = stage(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-components")
    by_value = stage(many_to_one(rooted, least, ["root"]).select("fp", "component_id"), "simhash-labels")
    hex_digits = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return many_to_one(hashed, by_value, ["fp"]).select(F.col("_id").alias(id_col), hex_digits, "component_id")
