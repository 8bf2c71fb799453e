"""Text files in which a block of lines counts, read in splits of their bytes."""

from __future__ import annotations

import glob
import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Split(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class LineSource(DataSource):
    """``path, offset, line`` of the text files at ``path`` (a file, or a pattern): a line belongs to the split in which it begins, and ``offset`` is where."""

    @classmethod
    def name(cls) -> str:
        return "placed_lines"

    def schema(self) -> str:
        return "path string, offset long, line string"

    def reader(self, schema) -> LineReader:
        return LineReader(self.options["path"], int(self.options.get("split_bytes", 1 << 20)))


class LineReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int):
        self.path, self.split_bytes = path, split_bytes

    def partitions(self) -> list[Split]:
        found = sorted(glob.glob(self.path)) if glob.has_magic(self.path) else [self.path]
        sizes = [(p, os.path.getsize(p)) for p in found]
        return [Split(p, a, min(a + self.split_bytes, n)) for p, n in sizes for a in range(0, max(n, 1), self.split_bytes)]

    def read(self, split: Split):
        with open(split.path, "rb") as f:
            at = max(0, split.start - 1)
            f.seek(at)
            if split.start:  # the line that ends here, or goes on into this split, began before
                at += len(f.readline())
            while at < split.end and (raw := f.readline()):
                yield split.path, at, raw.decode("utf-8", "replace").rstrip("\r\n")
                at += len(raw)


def block_lines(spark: SparkSession, path: str, opens: str, closes: str, split_bytes: int = 1 << 20) -> DataFrame:
    """``path, offset, line`` of the lines between the first that begins with ``opens`` and the next that is ``closes``.

    Splits know nothing of each other: markers are rows like other lines. The place of
    the opening one, and of the first closing one behind it, is one row a file.
    """
    spark.dataSource.register(LineSource)
    lines = spark.read.format("placed_lines").option("path", path).option("split_bytes", split_bytes).load()
    bare = F.regexp_replace("line", r"(?U)^\s+|\s+$", "")
    marks = lines.where(bare.startswith(opens) | (bare == closes)).select("path", "offset", bare.startswith(opens).alias("opening"))
    begin = F.min(F.when(F.col("opening"), F.col("offset"))).over(Window.partitionBy("path"))
    held = marks.withColumn("begin", begin).groupBy("path").agg(F.first("begin").alias("begin"), F.min(F.when(~F.col("opening") & (F.col("offset") > F.col("begin")), F.col("offset"))).alias("end"))
    rows = lines.join(held, "path").where((F.col("offset") > F.col("begin")) & (F.col("end").isNull() | (F.col("offset") < F.col("end"))))
    return rows.where(~bare.startswith(opens)).select("path", "offset", "line")
