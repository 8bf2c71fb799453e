"""Numbers of rows in an order, without a task that sees all rows of a group."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clipgrain.llm.common import checkpoint, unused


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before; nulls are equal."""
    one, two = column.slice(0, len(column) - 1), column.slice(1)
    differ = pc.fill_null(pc.not_equal(one, two), False)
    return pc.or_(differ, pc.xor(one.is_null(), two.is_null())).to_numpy(zero_copy_only=False)


def ranked(df: DataFrame, group: list[str], order: list[str], place: str, amount: str | None = None) -> DataFrame:
    """Adds ``place``: the row's number from 0 in ``order`` among the rows that agree in ``group`` (nulls first).

    With ``amount``, ``before`` is the sum of that column over the rows before it.

    ``df`` must give its rows in one order whenever it is read (a kept table, or a scan):
    rows equal in ``order`` are told apart by their position, so that they are spread over
    tasks. Rows are sorted by ranges and kept; the counts of each range's last group, one
    row a range, say where the next range goes on.
    """
    at = unused(df, "at")
    sort = [*group, *order, at]
    rows = checkpoint(df.withColumn(at, F.monotonically_increasing_id()).repartitionByRange(*sort).sortWithinPartitions(*sort).drop(at))
    key = F.struct(*group, F.lit(0).alias(at))
    size = F.sum(amount) if amount else F.lit(0)
    groups = rows.groupBy(F.spark_partition_id().alias("p"), key.alias("k")).agg(F.count(F.lit(1)).alias("n"), size.cast("long").alias("size"))
    ends = groups.groupBy("p").agg(F.min("k").alias("low"), F.max("k").alias("high"), F.max_by("n", "k").alias("n"), F.max_by("size", "k").alias("size")).orderBy("p")
    before, carried, held, sums = {}, None, 0, 0
    for p, low, high, n, size in ends.toLocalIterator():  # one row a range
        before[p] = (held, sums) if carried == low else (0, 0)
        carried, held, sums = high, n + (before[p][0] if low == high else 0), size + (before[p][1] if low == high else 0)
    shared = df.sparkSession.sparkContext.broadcast(before)

    def number(batches):
        count, past = shared.value.get(TaskContext.get().partitionId(), (0, 0))
        last = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            fresh = np.zeros(n, bool)
            for name in group:
                fresh[1:] |= _changes(batch[name])
            first = [batch[name][0].as_py() for name in group]
            fresh[0] = last is not None and first != last
            last = [batch[name][n - 1].as_py() for name in group]
            starts = np.flatnonzero(fresh)
            index = np.arange(n)
            base = np.full(n, -count)
            if len(starts):
                base[starts[0] :] = np.repeat(starts, np.diff(np.append(starts, n)))
            count = int(index[-1] - base[-1]) + 1
            more = []
            if amount:
                own = batch[amount].to_numpy(zero_copy_only=False)
                upto = np.concatenate(([0], np.cumsum(own)))
                begins = np.where(base < 0, -past, upto[np.maximum(base, 0)])  # below 0: the group began before this batch
                more = [pa.array(upto[:-1] - begins)]
                past = int(upto[-1] - begins[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(index - base), *more], [*batch.schema.names, place, *["before"] * len(more)])

    added = [T.StructField(place, T.LongType()), *[T.StructField("before", T.LongType())] * bool(amount)]
    return rows.mapInArrow(number, T.StructType([*rows.schema.fields, *added]))
