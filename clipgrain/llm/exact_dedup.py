"""Exact dedup by counting quotient filters.

Each partition puts the 64-bit fingerprints of its normalised texts into a
counting quotient filter: the high bits (quotient) name a slot range, the rest
(remainder) is stored sorted within it, with a count. Filters of the same size
merge without loss, by merging the sorted remainders of equal quotients and
adding counts. Fingerprints whose merged count is above one go on to byte
verification: only those texts are shuffled, and they are grouped by their bytes.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipgrain.llm.common import SPACES, checkpoint, scratch, small, without

#: Quotients of one block, as bits; with the bits that choose the block they make the quotient.
SLOT_BITS = 12
#: Blocks are as many as leave each about so many fingerprints to merge; two to this power at least.
BLOCK_ROWS, LEAST_BITS = 1 << 18, 8


def normalised(text: Column) -> Column:
    """Each run of the six white-space bytes as one space; null as the empty text."""
    return F.coalesce(F.regexp_replace(text, SPACES, " "), F.lit(""))


class QuotientFilter:
    """One block of a counting quotient filter: sorted remainders and counts per quotient."""

    def __init__(self, remainder: int, runs: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.remainder, self.runs, self.remainders, self.counts = remainder, runs, remainders, counts

    @classmethod
    def of(cls, low: np.ndarray, counts: np.ndarray, remainder: int) -> QuotientFilter:
        """From the fingerprints' bits below the block, sorted, each once; ``remainder`` is how many bits are below the quotient."""
        quotient = (low >> np.uint64(remainder)).astype(np.int64)
        runs = np.bincount(quotient, minlength=1 << SLOT_BITS).astype("<u4")
        return cls(remainder, runs, (low & np.uint64((1 << remainder) - 1)).astype("<u8"), np.minimum(counts, 2**32 - 1).astype("<u4"))

    def fingerprints(self) -> np.ndarray:
        quotient = np.repeat(np.arange(len(self.runs), dtype=np.uint64), self.runs)
        return (quotient << np.uint64(self.remainder)) | self.remainders

    @classmethod
    def merged(cls, filters: list[QuotientFilter]) -> QuotientFilter:
        """All of one block in one merge of their sorted runs."""
        low = np.concatenate([f.fingerprints() for f in filters])
        counts = np.concatenate([f.counts for f in filters]).astype(np.int64)
        order = np.argsort(low, kind="stable")
        low, counts = low[order], counts[order]
        first = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1]))) if len(low) else np.zeros(0, np.int64)
        return cls.of(low[first], np.add.reduceat(counts, first) if len(low) else counts, filters[0].remainder)

    def pack(self) -> bytes:
        """Slot occupancy in two bytes each, then six-byte remainders, then counts in one byte (255: four bytes follow at the end)."""
        body = np.frombuffer(self.remainders.tobytes(), np.uint8).reshape(-1, 8)[:, :6] if len(self.remainders) else np.zeros((0, 6), np.uint8)
        wide = np.minimum(self.counts, 255).astype(np.uint8)
        occupied = np.flatnonzero(self.runs).astype("<u2")
        return b"".join([np.array([self.remainder, len(occupied), len(wide)], "<u4").tobytes(), occupied.tobytes(), self.runs[occupied].tobytes(), body.tobytes(), wide.tobytes(), self.counts[wide == 255].tobytes()])

    @classmethod
    def unpack(cls, raw: bytes) -> QuotientFilter:
        remainder, slots, n = np.frombuffer(raw, "<u4", 3).tolist()
        at = 12
        occupied = np.frombuffer(raw, "<u2", slots, at)
        runs = np.zeros(1 << SLOT_BITS, "<u4")
        runs[occupied] = np.frombuffer(raw, "<u4", slots, at + 2 * slots)
        at += 6 * slots
        body = np.zeros((n, 8), np.uint8)
        body[:, :6] = np.frombuffer(raw, np.uint8, 6 * n, at).reshape(-1, 6)
        at += 6 * n
        counts = np.frombuffer(raw, np.uint8, n, at).astype("<u4")
        wide = counts == 255
        counts[wide] = np.frombuffer(raw, "<u4", int(wide.sum()), at + n)
        return cls(remainder, runs, body.reshape(-1).view("<u8"), counts)


#: Fingerprints that a task holds before it sends off its filter and starts another.
HELD = 4_000_000


def _build(bits: int):
    """The filter of one partition, block by block, from fingerprints; ``bits`` choose the block."""

    def drain(held: list[np.ndarray]):
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        low = values & np.uint64((1 << (64 - bits)) - 1)
        block = (values >> np.uint64(64 - bits)).astype(np.int64)
        edges = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1], [True])))
        rows = [(int(block[a]), QuotientFilter.of(low[a:b], counts[a:b], 64 - bits - SLOT_BITS).pack()) for a, b in pairwise(edges.tolist())]
        return pa.RecordBatch.from_pydict({"block": pa.array([r[0] for r in rows], pa.int64()), "filter": pa.array([r[1] for r in rows], pa.binary())})

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch["fp"].to_numpy(zero_copy_only=False).view(np.uint64))
            size += len(held[-1])
            if size >= HELD:  # bounded memory: a long partition sends several filters
                yield drain(held)
                held, size = [], 0
        if size:
            yield drain(held)

    return run


def _merge(bits: int):
    """Merges all filters of each block (rows are sorted by block) and gives the fingerprints with counts above one."""

    def repeated(block: int, filters: list[QuotientFilter]):
        whole = QuotientFilter.merged(filters)
        many = whole.counts > 1
        fp = (np.uint64(block) << np.uint64(64 - bits)) | whole.fingerprints()[many]
        return pa.RecordBatch.from_pydict({"fp": pa.array(fp.view(np.int64)), "copies": pa.array(whole.counts[many].astype(np.int64))})

    def run(batches):
        current, held = None, []
        for batch in batches:
            for block, raw in zip(batch["block"].to_pylist(), batch["filter"].to_pylist(), strict=True):
                if block != current and held:
                    yield repeated(current, held)
                    held = []
                current = block
                held.append(QuotientFilter.unpack(raw))
        if held:
            yield repeated(current, held)

    return run


def repeated_fingerprints(prints: DataFrame, column: str = "fp") -> DataFrame:
    """``fp, copies`` of the 64-bit values that ``column`` holds more than once; ``prints`` is a kept table.

    The number of blocks follows the number of rows. A block travels as about ten
    bytes a value, already summed per partition, so a value with a third of all rows is
    one entry a task. Counts stop at four bytes: above one is all that routing asks for.
    """
    bits = max(LEAST_BITS, (prints.count() // BLOCK_ROWS).bit_length())
    filters = prints.where(F.col(column).isNotNull()).select(F.col(column).alias("fp")).mapInArrow(_build(bits), "block long, filter binary")
    return filters.repartition("block").sortWithinPartitions("block").mapInArrow(_merge(bits), "fp long, copies long")


def _grouped(docs: DataFrame) -> DataFrame:
    """``doc_id, fp, sha, keep_id, group_size`` of every row of ``docs`` (doc_id, text)."""
    text = normalised(F.col("text"))
    rows = docs.select("doc_id", text.alias("text"))
    prints = checkpoint(rows.select("doc_id", F.xxhash64("text").alias("fp"), F.unhex(F.sha2("text", 256)).alias("sha")))
    repeated = checkpoint(repeated_fingerprints(prints).select("fp"))
    # Byte verification: texts themselves are the grouping key, counted within each task first.
    verified = rows.withColumn("fp", F.xxhash64("text")).join(small(repeated), "fp", "left_semi").groupBy("text").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = checkpoint(verified.where("group_size > 1").select(F.xxhash64("text").alias("fp"), F.unhex(F.sha2("text", 256)).alias("sha"), "keep_id", "group_size"))
    joined = prints.join(small(groups), ["fp", "sha"], "left")
    return joined.select("doc_id", "fp", "sha", F.coalesce("keep_id", "doc_id").alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"))


def group_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group texts that are equal once each run of white space is one space.

    Returns one row per row of ``docs``: ``doc_id, keep_id`` (the smallest doc_id of
    its group, which stays), ``group_size, kept, text_sha256`` (of the normalised
    text). Defined cases: a null text counts as the empty text; a null doc_id sorts
    after all others and is never a keep_id unless its whole group has none; rows
    that repeat a doc_id with the same text all count in group_size, and each of the
    keep_id's rows says kept; texts of any length are read whole; an empty table gives
    no rows; other columns are ignored.
    """
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull())
    return _grouped(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all columns: of equal texts the one with the smallest doc_id.

    Of equal texts that share the smallest doc_id one stays; where no row of a group
    has a doc_id, all stay; rows that repeat a doc_id are each judged by their own text.
    """
    with scratch() as keep:
        grouped = keep(checkpoint(_grouped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", F.col("fp").alias("mark"), "keep_id")))
    gone = grouped.where("keep_id is not null and not doc_id <=> keep_id")
    repeats = not grouped.where("doc_id is not null").groupBy("doc_id", "mark").count().where("count > 1").isEmpty()
    return without(docs, F.xxhash64(normalised(F.col("text"))), gone.select("doc_id", "mark"), repeats)
