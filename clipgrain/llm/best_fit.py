"""Best-fit packing of whole documents under several capacities.

Texts are tokenised once, into pieces of at most one sequence. A piece asks for
tokens, for one place among a sequence's documents and for attention cost (the
square of its length), so pieces of one length ask for the same: all that choosing
sequences needs is how many pieces of each length there are, at most ``sequence``
numbers for any corpus. Vector best-fit goes through the lengths from the longest
on: of the open bins in which a piece fits under every capacity, the score of the
residual capacities picks one, and pieces of its length go there while they fit.
Bins with one history lie side by side, so that a run of equal choices is one step.

The choices come out as runs: pieces of a length, numbered from a first rank on,
go in order to bins numbered from a first bin on. Pieces get their ranks within
their length from the counts of each partition; no piece is shuffled for it but
where those counts are many.
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clipgrain.llm.common import checkpoint, small
from clipgrain.llm.packing import _encoder
from clipgrain.llm.textops import bytes_of, slices

SEQUENCE = 2048
END_ID = 0
RULES = ("norm", "dot")
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Capacity(NamedTuple):
    """What a sequence holds at most, and what each part weighs in a rule."""

    tokens: int = SEQUENCE
    documents: int = SEQUENCE
    attention: int = SEQUENCE**2
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0)


class Run(NamedTuple):
    """Pieces of ``length`` from rank ``first`` on, ``each`` to a bin from ``bin`` on, behind ``offset`` tokens."""

    length: int
    first: int
    bin: int
    each: int
    offset: int


def _scores(rule: str, left: np.ndarray, asks: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The lower the better, over shares of the capacities: the weighted norm of what would be left, or the demand's weighted
    dot product with what is left, as a share of the latter's norm and negated; the norm decides between equals."""
    after = np.sqrt((weights * (left - asks) ** 2).sum(axis=1))
    if rule == "norm":
        return after
    size = np.sqrt((weights * left**2).sum(axis=1))
    return -np.round((weights * left * asks).sum(axis=1) / np.maximum(size, 1e-12), 9) + 1e-12 * after


def best_fit(counts: dict[int, int], capacity: Capacity, rule: str) -> tuple[list[Run], int]:
    """Runs that place ``counts`` (pieces by length), and how many bins they fill.

    A piece that by itself breaks a capacity besides the tokens has a bin to itself.
    """
    whole = np.array(capacity[:3], np.int64)
    weights = np.array(capacity.weights)
    left, first, many = np.zeros((0, 3), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)  # bins with one history: what is left, the first one, how many
    runs: list[Run] = []
    end = 0
    for length in sorted(counts, reverse=True):
        asks, done, rest = np.array([length, 1, length**2], np.int64), 0, counts[length]
        alone = max(1, int((whole // asks).min()))
        while rest:
            fits = np.flatnonzero((left >= asks).all(axis=1))
            if len(fits):
                at = fits[np.argmin(_scores(rule, left[fits] / whole, asks / whole, weights))]
                each = min(int((left[at] // asks).min()), rest)
                bins = min(int(many[at]), max(1, rest // each))
            else:  # new bins, as many as the rest of this length fills
                each, at = min(alone, rest), len(first)
                bins = rest // each
                left, first, many = np.vstack([left, whole]), np.append(first, end), np.append(many, bins)
                end += bins
            runs.append(Run(length, done, int(first[at]), each, int(whole[0] - left[at, 0])))
            done, rest = done + each * bins, rest - each * bins
            if bins < many[at]:  # the others stay as they were
                left, first, many = np.vstack([left, left[at]]), np.append(first, first[at] + bins), np.append(many, many[at] - bins)
            left[at] -= asks * each
            many[at] = bins
        least = left[:, 0] > 0  # full bins are out of the way
        left, first, many = left[least], first[least], many[least]
    return runs, end


def plan(counts: dict[int, int], capacity: Capacity) -> tuple[list[Run], int]:
    """The runs of the rule that fills fewer bins."""
    return min((best_fit(counts, capacity, rule) for rule in RULES), key=lambda found: found[1])


def _pieces(path: str, sequence: int, end_id: int, keep_ids: bool):
    def run(batches):
        encoder = _encoder(path)
        seen = np.zeros(sequence + 1, np.int64)
        part = TaskContext.get().partitionId()
        for batch in batches:
            data, off = bytes_of(batch["text"])
            for a, b in slices(off):
                flat, first = encoder.ids(data[off[a] : off[b]], off[a : b + 1] - off[a])
                rows = []
                for doc_id, i, j in zip(batch["doc_id"].slice(a, b - a).to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                    ids = np.append(flat[i:j], end_id).astype("<u4")
                    for piece, start in enumerate(range(0, len(ids), sequence)):
                        own = ids[start : start + sequence]
                        rows.append((doc_id, piece, start, len(own), zlib.crc32(own), seen[len(own)], part, own.tolist() if keep_ids else None))
                        seen[len(own)] += 1
                columns = list(zip(*rows, strict=True)) or [[]] * 8
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64())]
                arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "nth", "part", "ids"]
                yield pa.RecordBatch.from_arrays(arrays[: 7 + keep_ids], names[: 7 + keep_ids])

    return run


def _place(runs: list[Run], sequence: int):
    """Sequence and offset of each piece from its length and rank."""
    table = np.array(sorted(runs), np.int64).reshape(-1, 5)

    def run(batches):
        lengths, first = table[:, 0], table[:, 1]
        begins = np.searchsorted(lengths, np.arange(sequence + 2))  # the runs of a length
        for batch in batches:
            length, rank = (batch[c].to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.zeros(len(length), np.int64)
            for n in np.unique(length).tolist():
                own = length == n
                at[own] = begins[n] + np.searchsorted(first[begins[n] : begins[n + 1]], rank[own], side="right") - 1
            beyond, each = rank - first[at], table[at, 3]
            place = [pa.array(table[at, 2] + beyond // each), pa.array(table[at, 4] + beyond % each * length)]
            keep = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), *place], [*keep, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: Capacity = Capacity(), end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Pack all rows of ``docs`` (doc_id, text) into as few sequences as best-fit finds, without cutting what fits into one.

    Returns one row per piece: ``doc_id, piece, start`` (tokens of its text before it),
    ``length, ids_crc32, sequence_id, offset`` and, with ``keep_ids``, the ids. Every
    text ends with ``end_id``; one of more than ``capacity.tokens`` ids is cut into pieces
    of so many, the last being shorter.

    Defined cases: a null or empty text is the end id alone; a null doc_id stays null;
    repeated rows are each packed; a very long text gives as many pieces as it needs; a
    piece whose attention cost alone is beyond the capacity has a sequence to itself;
    an empty table gives no rows, and partitions may be empty; other columns are ignored.
    """
    sequence = capacity.tokens
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids = ", ids array<long>" if keep_ids else ""
    pieces = checkpoint(rows.mapInArrow(_pieces(tokenizer, sequence, end_id, keep_ids), f"{PIECE}, nth long, part int{ids}"))
    counts = checkpoint(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")))
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one row a length
    runs, _ = plan(total, capacity)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = checkpoint(counts.select("length", "part", F.coalesce(before, F.lit(0)).alias("before")))
    placed = pieces.join(small(starts), ["length", "part"]).withColumn("rank", F.col("before") + F.col("nth"))
    kept = [c for c in pieces.columns if c not in ("nth", "part")]
    return placed.select(*kept, "rank").mapInArrow(_place(runs, sequence), f"{PIECE}{ids}, sequence_id long, offset long")
