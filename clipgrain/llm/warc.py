"""WARC records and a Merkle fixity audit of replicas.

A replica's records are in order of archive and record id. Each replica hashes its own
manifest into a tree: a leaf is a record id of an archive with the lengths and digests
of its records, a node the range of up to sixteen neighbouring ids, or nodes, with the
number of records and bytes it covers. Ranges are cut by the ids, not by counting, so a
lost record changes the nodes above it and no other, and both replicas cut alike
without knowing of each other. Where a record lies (its ordinal and byte offset in the
archive) is the sum of what lies before it on each level.

Two replicas are compared at the root, and on the next level only the children of nodes
that differ are read, down to the ids that differ. Only records of these are looked at
one by one.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clipgrain.llm.common import checkpoint, scratch, small, written
from clipgrain.llm.numbering import ranked

FAN_OUT = 16
#: Four times as many ids as ``records`` puts into one archive.
ARCHIVE_RECORDS = 16**3


def record_text(record_id: Column, uri: Column, payload: Column) -> Column:
    """A WARC/1.0 response record as text; null parts are empty."""
    body = F.coalesce(payload, F.lit(""))
    lines = ["WARC/1.0", "WARC-Type: response", F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(record_id.cast("string"), F.lit("")), F.lit(">")), F.concat(F.lit("WARC-Target-URI: "), F.coalesce(uri, F.lit(""))), F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")), ""]
    return F.concat(*[F.concat(x if isinstance(x, Column) else F.lit(x), F.lit("\r\n")) for x in lines], body, F.lit("\r\n\r\n"))


def records(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", per_archive: int = ARCHIVE_RECORDS // 4) -> DataFrame:
    """``archive, record_id, length, digest`` of every page, without the payload.

    Ids run into archives in blocks of ``per_archive``; a null id goes to archive 0
    as record -1. The record itself is read once, for its length and digest.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-1))
    text = record_text(F.col(id_col), F.col(uri_col), F.col(payload_col))
    archive = F.greatest(F.floor(key / per_archive), F.lit(0)).cast("long")
    return pages.select(archive.alias("archive"), key.alias("record_id"), F.octet_length(text).cast("long").alias("length"), F.sha2(text, 256).alias("digest"))


#: Bits of an id that a level's nodes take together.
_BITS = FAN_OUT.bit_length() - 1


def _leaves(rows: DataFrame) -> DataFrame:
    """``side, archive, at, n, bytes, h``: the ids of each replica.

    The hash of an id covers its number of records and the sums of their digests' parts, each
    record's digest made with its length: equal for equal records in any order, and summed
    within tasks first, so an id of very many records is no large group.
    """
    own = F.sha2(F.concat_ws(":", F.col("length").cast("string"), F.hex("digest")), 256)
    parts = [F.sum(F.conv(F.substring(own, 8 * i + 1, 8), 16, 10).cast("long")).alias(f"s{i}") for i in range(8)]
    sums = rows.groupBy("side", "archive", F.col("record_id").alias("at")).agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"), *parts)
    return sums.select("side", "archive", "at", "n", "bytes", F.unhex(F.sha2(F.concat_ws(":", "at", "n", "bytes", *[f"s{i}" for i in range(8)]), 256)).alias("h"))


def _parents(level: DataFrame, keys: list[str], up: Column | None) -> DataFrame:
    """Nodes over the nodes of a level that agree in ``side``, ``keys`` and ``up``: what they cover, and the digest of all, in order."""
    children = F.array_sort(F.collect_list(F.struct("at", "n", "bytes", "h")))
    text = F.array_join(F.transform(children, lambda c: F.concat_ws(":", c["at"].cast("string"), c["n"].cast("string"), c["bytes"].cast("string"), F.hex(c["h"]))), ",")
    of = [] if up is None else [up.alias("up")]
    nodes = level.groupBy("side", *keys, *of).agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.unhex(F.sha2(text, 256)).alias("h"))
    return nodes.withColumn("at", F.lit(0).cast("long") if up is None else F.col("up")).select("side", *keys, "at", "n", "bytes", "h")


def _up(at: str = "at") -> Column:
    return F.shiftright(at, _BITS)


def tree(rows: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """Kept levels of both replicas' trees over ``side, archive, record_id, length, digest``, from the nodes above single ids on.

    First those within archives (``side, archive, at``), up to one node an archive, then
    those over archives (``side, at``), up to one root a replica. Levels end when no
    parent would have more than FAN_OUT children.
    """
    inner = [checkpoint(_parents(_leaves(rows), ["archive"], _up()))]
    while (inner[-1].groupBy("side", "archive").count().agg(F.max("count")).first()[0] or 0) > FAN_OUT:
        inner.append(checkpoint(_parents(inner[-1], ["archive"], _up())))
    inner.append(checkpoint(_parents(inner[-1], ["archive"], None)))
    outer = [inner[-1].select("side", F.col("archive").alias("at"), "n", "bytes", "h")]
    while (outer[-1].groupBy("side").count().agg(F.max("count")).first()[0] or 0) > FAN_OUT:
        outer.append(checkpoint(_parents(outer[-1], [], _up())))
    return inner, [*outer[1:], checkpoint(_parents(outer[-1], [], None))]


def _children(level: DataFrame, differ: DataFrame, keys: list[str], up: Column) -> DataFrame:
    """The nodes of a level below nodes that differ (``keys, up``, and ``records, offset``: what lies before these in the first replica's archive)."""
    return level.withColumn("up", up).join(small(differ), [*keys, "up"])


def _differing(children: DataFrame, keys: list[str]) -> DataFrame:
    """The children whose hashes differ, or that one replica lacks, as ``keys, up, records, offset`` for the next level. Kept."""
    before = Window.partitionBy("side", *keys, "up").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)  # up to FAN_OUT rows
    placed = children.withColumns({c: F.col(c) + F.coalesce(F.sum(x).over(before), F.lit(0)) for c, x in (("records", "n"), ("offset", "bytes"))})
    own = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    met = placed.groupBy(*keys, "at").agg(own(0, "h").alias("h0"), own(1, "h").alias("h1"), own(0, "records").alias("records"), own(0, "offset").alias("offset"))
    return checkpoint(met.where(~F.col("h0").eqNullSafe(F.col("h1"))).select(*keys, F.col("at").alias("up"), F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("offset", F.lit(0)).alias("offset")))


def descend(rows: DataFrame) -> DataFrame:
    """``archive, record_id, records, offset`` of the ids whose records differ, with what lies before them in the first replica's archive. Kept."""
    inner, outer = tree(rows)
    none = {"records": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}
    roots = outer[-1].select("side", F.lit(0).cast("long").alias("up"), "at", "n", "bytes", "h").withColumns(none)
    differ = _differing(roots, [])
    for level in [*reversed(outer[:-1]), inner[-1].select("side", F.col("archive").alias("at"), "n", "bytes", "h")]:
        top = level is outer[-2] if len(outer) > 1 else True
        differ = _differing(_children(level, differ, [], F.lit(0).cast("long") if top else _up()), []).withColumns(none)
    differ = differ.withColumns({"archive": F.col("up"), "up": F.lit(0).cast("long")})
    for k, level in enumerate(reversed(inner[:-1])):
        differ = _differing(_children(level, differ, ["archive"], F.lit(0).cast("long") if not k else _up()), ["archive"])
    below = rows.withColumn("up", _up("record_id")).join(small(differ.select("archive", "up")), ["archive", "up"], "left_semi").drop("up")
    found = _differing(_children(_leaves(below), differ, ["archive"], _up()), ["archive"])
    return checkpoint(found.withColumnRenamed("up", "record_id"))


def audit(first: DataFrame, second: DataFrame) -> DataFrame:
    """Locate where the records of ``second`` differ from those of ``first`` (see ``records``).

    Returns one row per damaged record: ``archive, ordinal, offset, length`` (where it
    should be), ``record_id, kind`` (``payload``: other bytes of the same length,
    ``length``: other length, ``missing``, ``extra``), ``digest_first, digest_second``.
    Defined cases: ids may be negative, or null (record -1 of archive 0); records of an
    archive lie in order of id and digest; repeated records of one id (or of none) first
    meet their equals, and what is left is paired in order of digest; extra records have
    no place; a payload of any length is hashed whole, a null one as empty; archives may
    be of any size; equal replicas, and empty ones, give no rows; other columns are ignored.
    """
    side = lambda df, k: df.select(F.lit(k).alias("side"), "archive", "record_id", "length", F.unhex("digest").alias("digest"))
    with written(side(first, 0).unionByName(side(second, 1))) as rows:
        key = ["archive", "record_id"]
        with scratch() as keep:
            differ = keep(descend(rows))
        mine = checkpoint(rows.join(small(differ).select(*key), key, "left_semi"))
    same = [*key, "length", "digest"]
    placed = ranked(mine.where("side = 0").drop("side"), key, ["digest", "length"], "nth", "length")
    # Of equal records those with the highest places are left without a partner.
    counts = mine.groupBy(*same).agg(F.count_if(F.col("side") == 0).alias("one"), F.count_if(F.col("side") == 1).alias("two"))
    odd = checkpoint(counts.where("one <> two"))
    starts = checkpoint(placed.join(small(odd.where("one > two")), same).groupBy(*same).agg(F.min("nth").alias("begins"), F.first("two").alias("two")))
    left = placed.join(small(starts), same).where(F.col("nth") - F.col("begins") >= F.col("two")).join(small(differ), key)
    left = checkpoint(left.select(*key, (F.col("records") + F.col("nth")).alias("ordinal"), (F.col("offset") + F.col("before")).alias("offset"), "length", F.col("digest").alias("d1")))
    other = checkpoint(odd.where("two > one").select(*key, F.col("length").alias("length2"), F.col("digest").alias("d2"), F.explode(F.expr("sequence(1, two - one)")).alias("copy")).drop("copy"))
    left, other = ranked(left, key, ["ordinal"], "twin"), ranked(other, key, ["d2"], "twin")
    met = left.join(other, [*key, "twin"], "full_outer")
    kind = F.when(F.col("d2").isNull(), "missing").when(F.col("d1").isNull(), "extra").when(F.col("length") == F.col("length2"), "payload").otherwise("length")
    return met.select("archive", F.col("ordinal").cast("int").alias("ordinal"), "offset", "length", "record_id", kind.alias("kind"), *[F.lower(F.hex(c)).alias(n) for c, n in (("d1", "digest_first"), ("d2", "digest_second"))])


def parse_warc(content: bytes) -> list[tuple[str, str, int, bytes]]:
    """(record id, uri, offset, payload) of each response record of an uncompressed WARC file."""
    out, at = [], 0
    while (start := content.find(b"WARC/1.0\r\n", at)) >= 0:
        head_end = content.index(b"\r\n\r\n", start)
        head = dict(line.split(": ", 1) for line in content[start:head_end].decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
        size = int(head.get("Content-Length", 0))
        if head.get("WARC-Type") == "response":
            out.append((head.get("WARC-Record-ID", "").strip("<>"), head.get("WARC-Target-URI", ""), start, content[head_end + 4 : head_end + 4 + size]))
        at = head_end + 4 + size
    return out


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``path, record_id, uri, offset, payload`` of the response records of uncompressed WARC files; one file is read in one task."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                rows = parse_warc(content)
                cols = list(zip(*rows, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary())], ["path", "record_id", "uri", "offset", "payload"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, record_id string, uri string, offset long, payload binary")
