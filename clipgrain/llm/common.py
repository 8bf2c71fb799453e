"""Small helpers that the corpus operators share."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clipgrain.shipping import ship


#: Rows of a batch that goes to Python; texts make batches of the default size large.
BATCH_ROWS = "1000"


#: Has Spark delete a checkpoint's files once nothing refers to them.
CLEAN = "spark.cleaner.referenceTracking.cleanCheckpoints"


def ready(spark: SparkSession) -> None:
    """Send the sources to the executors; where nothing else is set, have batches to Python small and files of checkpoints deleted after use."""
    ship(spark)
    conf = spark.sparkContext._conf  # the live one: Spark reads CLEAN at each checkpoint
    if conf.get(CLEAN) is None:
        conf.set(CLEAN, "true")
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, through Spark's own reader."""
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where none is set, a temporary one, and on a cluster an error."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="clipgrain-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        context.setCheckpointDir(own)
    return context._jsc.sc().getCheckpointDir().get()


_open = threading.local()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage by writing ``df`` to the shared folder.

    The files go at the end of the ``scratch`` block they were made in; those that a
    result still reads go when nothing refers to them any more (see ``ready``).
    """
    shared_folder(df.sparkSession)
    kept = df.checkpoint(eager=True)
    if getattr(_open, "blocks", None):
        _open.blocks[-1].append(kept)
    return kept


#: Tasks for a table of few rows, and rows for which there is one more.
LEAST_TASKS, TASK_ROWS = 12, 5_000


def fitted(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of so many rows at most, in no more tasks than they are worth; what is shuffled below is dealt as before."""
    return df.coalesce(LEAST_TASKS + rows // TASK_ROWS)


def stored(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Like ``checkpoint``, as Parquet, for tables that no result reads after the ``scratch`` block around them.

    Spark knows how large such a table is: a small one is read by few tasks and broadcast
    by itself. ``rows``: how many it has at most, if that is known (see ``fitted``).
    """
    df = df if rows is None else fitted(df, rows)
    if not getattr(_open, "blocks", None):
        return checkpoint(df)
    folder = f"{shared_folder(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    kept = df.sparkSession.read.schema(df.schema).parquet(folder)
    kept.stored_in = folder
    _open.blocks[-1].append(kept)
    return kept


def drop(kept: DataFrame) -> None:
    """Delete the files of a table, checkpointed or stored, that nothing reads any more."""
    if folder := kept.__dict__.get("stored_in"):
        delete(kept.sparkSession, folder)
        return
    file = kept._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        delete(kept.sparkSession, file.get())


#: Seconds between two collections of the driver's garbage.
FREE_EVERY = 5.0


def _free(spark: SparkSession) -> None:
    """Have Spark remove the shuffle files of plans that are gone: it does so when the driver's garbage is collected, which a driver with little to do leaves for half an hour."""
    if time.monotonic() - getattr(_open, "freed", 0.0) > FREE_EVERY:
        gc.collect()
        spark._jvm.System.gc()
        _open.freed = time.monotonic()


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A step whose checkpointed tables are deleted at its end, but for those that it hands out by the function that ``with`` gives."""
    blocks = _open.__dict__.setdefault("blocks", [])
    made: list[DataFrame] = []
    handed: list[DataFrame] = []
    blocks.append(made)
    try:
        yield lambda df: handed.append(df) or df
    finally:
        blocks.pop()
        stay = {id(df) for df in handed}
        for df in made:
            if id(df) not in stay:
                drop(df)
        if made:
            _free(made[0].sparkSession)
        if blocks:  # what is handed out belongs to the step around this one
            blocks[-1].extend(df for df in made if id(df) in stay)


@contextmanager
def written(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` as Parquet in the shared folder, for many rows that compress well; the files are deleted when the block ends."""
    folder = f"{shared_folder(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    try:
        yield df.sparkSession.read.schema(df.schema).parquet(folder)
    finally:
        delete(df.sparkSession, folder)


def delete(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared file system, whichever that is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows, of a few numbers each, that are sent to all executors at most.
SMALL_ROWS = 500_000


def small(df: DataFrame) -> DataFrame:
    """``df``, a kept table of a few numbers a row, marked for broadcast if it is found to have SMALL_ROWS at most."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def few(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of so many rows of a few numbers at most, for a join: fitted and broadcast, unless they are more than SMALL_ROWS."""
    return F.broadcast(fitted(df, rows)) if rows <= SMALL_ROWS else df


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken or f"{name}2" in taken:
        name = f"_{name}"
    return name


def without(docs: DataFrame, mark: Column, gone: DataFrame, repeats: bool) -> DataFrame:
    """The rows of ``docs`` that ``gone`` (doc_id, mark) doesn't name, all columns.

    ``mark`` tells rows of one doc_id apart. ``repeats``: of the rows with a doc_id
    that agree in it and in the mark, only one stays.
    """
    doc, own = unused(docs, "doc"), unused(docs, "mark")
    named = checkpoint(gone.distinct().select(F.col("doc_id").alias(doc), F.col("mark").alias(f"{own}2")))
    marked = docs.withColumn(own, mark)
    kept = marked.join(small(named), marked["doc_id"].cast("long").eqNullSafe(F.col(doc)) & (marked[own] == F.col(f"{own}2")), "left_anti")
    if repeats:
        kept = kept.where("doc_id is null").unionByName(kept.where("doc_id is not null").dropDuplicates(["doc_id", own]))
    return kept.drop(own)


def ascii_lower(column):
    """A-Z only, unlike lower(), which follows Unicode."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: The separators of words, as a regular expression that Java, RE2 and Python read alike.
SPACES = "[ \\t\\n\\x0B\\f\\r]+"
