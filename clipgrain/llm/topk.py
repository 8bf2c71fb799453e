"""Exact top-k by inner product, with no-random-access aggregation in blocks.

Candidates are dealt into blocks of bounded size, each of which is sent once; every
block meets all queries, which stream past it. Within a block each dimension is a
list sorted by value. The queries at hand read the lists in turn, each from the end
that helps it most, all to the same depth. What has been read, plus the worst or the
last-read value of each list that hasn't shown the row, bounds a row's score from
below and above. Reading goes on, deeper each time, until hardly any row but the k
best of a query can still qualify; the scores of those rows, and of no others, are
then resolved. Block results meet per query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a block at most, and numbers they hold together.
CANDIDATES_PER_BLOCK, NUMBERS_PER_BLOCK = 8192, 1 << 22
#: Queries that read together; their bounds for a whole block are held at once.
TOGETHER = 64
#: Shares of the lists that are read before bounds are looked at again, in eighths.
DEPTHS = (2, 4, 5, 6, 7)
#: A query stops reading when no more than so many times k rows are left.
FEW = 4


def usable(vector: Column) -> Column:
    """Neither null nor empty, and without null or non-finite components."""
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


class SortedLists:
    """One list per dimension over the rows of a block, by value; ``rank`` is a row's place from below."""

    def __init__(self, vectors: np.ndarray):
        self.vectors, self._shown = vectors, {}
        order = np.argsort(vectors, axis=0, kind="stable")
        self.values = np.take_along_axis(vectors, order, axis=0)
        self.rank = np.empty(vectors.shape, np.int32)
        np.put_along_axis(self.rank, order, np.arange(len(vectors), dtype=np.int32)[:, None], axis=0)

    def _read(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Per row and list (from above, from below): the value if shown by that depth, and whether still hidden."""
        if depth not in self._shown:
            shown = np.hstack([self.rank >= len(self.rank) - depth, self.rank < depth])
            self._shown[depth] = np.where(shown, np.hstack([self.vectors, self.vectors]), 0), (~shown).astype(self.vectors.dtype)
        return self._shown[depth]

    def survivors(self, queries: np.ndarray, k: int, slack: float = 0.0) -> np.ndarray:
        """A mask (query, row) of the rows that may be among a query's ``k`` best; ``slack`` is how far any sum may be off."""
        n = len(self.vectors)
        left = np.ones((len(queries), n), bool)
        split = np.hstack([np.maximum(queries, 0), np.minimum(queries, 0)])  # read from above, from below
        worst = split * np.hstack([self.values[0], self.values[-1]])
        going, rows = np.arange(len(queries)), np.arange(n)
        for depth in sorted({max(1, n * share // 8) for share in DEPTHS}):
            if not len(going) or len(rows) <= k:
                break
            read, hidden = (x if len(rows) == n else x[rows] for x in self._read(depth))
            last = split[going] * np.hstack([self.values[n - depth], self.values[depth - 1]])
            gained = split[going] @ read.T
            low, high = gained + worst[going] @ hidden.T, gained + last @ hidden.T
            if slack:  # scores are held within 64 bits, so what lies beyond is a tie
                low, high = np.clip(low, -(2.0**63), 2.0**63), np.clip(high, -(2.0**63), 2.0**63)
            bound = np.partition(low, len(rows) - k, axis=1)[:, len(rows) - k]
            mine = left[np.ix_(going, rows)] & (high + slack >= bound[:, None] - slack)
            left[np.ix_(going, rows)] = mine
            more = mine.sum(axis=1) > FEW * k
            going, rows = going[more], rows[mine[more].any(axis=0)]
        return left


def _held(largest: float):
    """The narrowest type in which all sums of integer products up to ``largest`` are exact; None if doubles could round."""
    return np.float32 if largest < 2**23 else np.float64 if largest < 2**52 else None


def _long_scores(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Scores through Python's integers, held within 64 bits."""
    q = [int(x) for x in query]
    return np.array([max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(map(int, v), q, strict=True)))) for v in vectors], np.int64)


def _scores(query: np.ndarray, vectors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Scores of ``rows`` only."""
    return vectors[rows] @ query


def best_in_block(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, lists: dict | None = None):
    """(query_id, vec_ids, scores) of each query's k best rows of the block, its own left out; ``lists`` keeps the block's lists for the next call."""
    lists = {} if lists is None else lists
    most = lists.setdefault("most", np.abs(vectors).max(initial=0.0) * max(1, vectors.shape[1]))
    largest = most * np.abs(queries).max(initial=0.0)
    kind = _held(largest)
    # Beyond exact doubles the bounds are taken with room for all that rounding can do, and what they leave is scored exactly.
    bounded = kind or (np.float64 if largest < 1e300 else None)
    slack = 0.0 if kind else largest * max(1, vectors.shape[1]) * 2.0**-48
    if bounded and bounded not in lists:
        lists[bounded] = SortedLists(vectors.astype(bounded))
    for a in range(0, len(queries), TOGETHER):
        names = query_ids[a : a + TOGETHER]
        own = ids[None, :] == names[:, None]
        left = ~own
        if bounded:
            part = queries[a : a + TOGETHER].astype(bounded)
            left &= lists[bounded].survivors(part, k + int(own.sum(axis=1).max(initial=0)), slack)
        for i, name in enumerate(names.tolist()):
            rows = np.flatnonzero(left[i])
            got = _scores(part[i], lists[kind].vectors, rows).astype(np.int64) if kind else _long_scores(vectors[rows], queries[a + i])
            if len(rows) > k:
                near = np.flatnonzero(got >= np.partition(got, len(got) - k)[len(got) - k])
                rows, got = rows[near], got[near]
            best = np.lexsort((ids[rows], -got))[:k]
            yield name, ids[rows][best], got[best]


def _matrix(column: pa.Array, dims: int, scale: float) -> np.ndarray:
    """floor(scale * x) of vectors of up to ``dims`` components, shorter ones padded with zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if len(lengths) and (lengths == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(lengths), dims))
    at = np.repeat(np.arange(len(lengths)) * dims, lengths) + np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out.reshape(-1)[at] = flat
    return out


_FOUND = "query_id long, vec_id long, score long"


def _answered(k: int, scale: float, dims: int):
    """Rows sorted by (block, asks): a block's candidates are gathered, then its queries stream past."""

    def run(batches):
        block, held, lists = None, [], {}
        for batch in batches:
            blocks, asks, ids = (batch[c].to_numpy(zero_copy_only=False) for c in ("block", "asks", "vec_id"))
            asks = asks.astype(bool)
            edges = np.flatnonzero(np.concatenate(([True], (blocks[1:] != blocks[:-1]) | (asks[1:] != asks[:-1]), [True]))) if len(ids) else []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if blocks[a] != block:
                    block, held, lists = blocks[a], [], {}
                part = ids[a:b], _matrix(batch["vector"].slice(a, b - a), dims, scale)
                if not asks[a]:
                    held.append(part)
                    continue
                if len(held) > 1:
                    held = [tuple(np.concatenate(x) for x in zip(*held, strict=True))]
                found = list(best_in_block(*held[0], *part, k, lists)) if held else []
                sizes = [len(f[1]) for f in found]
                columns = [np.repeat([f[0] for f in found], sizes), np.concatenate([f[1] for f in found]), np.concatenate([f[2] for f in found])] if found else [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)) for x in columns], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each query's ``k`` rows of highest integer inner product, of floor(scale * x).

    Queries are the rows of ``vectors`` where ``is_query`` holds; candidates are all
    rows but those with the query's own id. Returns ``query_id, rank, vec_id, score``;
    ties go to the smaller id.

    Defined cases: vectors (or ids) that are null, empty, or hold null or non-finite
    components take no part; shorter vectors count as padded with zeros; of rows that
    repeat an id each is a candidate and one, of the least hash, asks; where sums may pass
    2**52 the rows that the bounds leave are scored in whole numbers of any size, and scores
    beyond 64 bits are held at the ends of their range, where ties go to the smaller id; fewer
    than k candidates give all of them; empty tables give no rows; other columns are
    ignored.
    """
    rows = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    n, dims = rows.agg(F.count(F.lit(1)), F.max(F.when(F.col("asks"), F.size("vector")))).first()
    dims = dims or 1  # components beyond the longest query's meet zeros only
    blocks = -(-n // max(1, min(CANDIDATES_PER_BLOCK, NUMBERS_PER_BLOCK // dims))) or 1
    candidates = rows.select(F.pmod(F.xxhash64("vec_id", "vector"), F.lit(blocks)).cast("int").alias("block"), F.lit(False).alias("asks"), "vec_id", F.slice("vector", 1, dims).alias("vector"))
    asking = rows.where("asks").groupBy("vec_id").agg(F.min_by("vector", F.xxhash64("vector")).alias("vector"))
    queries = asking.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("asks"), "vec_id", "vector")
    dealt = candidates.unionByName(queries).repartition(blocks, "block").sortWithinPartitions("block", "asks")
    found = dealt.mapInArrow(_answered(k, scale, dims), _FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
