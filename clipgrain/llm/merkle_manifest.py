"""A Merkle manifest of documents by nested-struct rollup.

Every document is a leaf. The leaves of a language are numbered by doc_id, and the
number's octal digits name a leaf's place in a tree of eight children a node. In
blocks of BLOCK leaves the lowest digits are grouped away one after the other, each
grouping nesting the structs of the one before, until a block is one row that holds
its whole tree. Block roots are nodes of the next stage, which has 1/BLOCK of the
rows, up to one row a language; the languages' roots go the same way up to the root.

Proofs come down again: a stage's row is exploded into its nodes, each with the
hashes left and right of it on every level above, and the nodes of one stage meet
the rows of the stage below by grouping, so that nothing is joined. No row holds
more than BLOCK leaves and no task more than the blocks that are dealt to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipgrain.llm.common import ascii_lower, checkpoint
from clipgrain.llm.numbering import ranked

FAN_OUT = 8
DIGITS = 3
BLOCK = FAN_OUT**DIGITS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_STEP = "struct<before:string,after:string>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 length, a colon and the value, so that fields can't run into each other."""
    value = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_digest(fields: dict[str, Column]) -> Column:
    return digest(*[field(fields[name]) for name in FIELDS])


def _hashes(nodes: Column) -> Column:
    return F.transform(nodes, lambda k: k["h"])


def _joined(hashes: Column) -> Column:
    return F.array_join(hashes, "")


def _nest(nodes: DataFrame, group: list[str]) -> DataFrame:
    """Blocks of nodes (``group, r, h, p``) as rows ``group, b, n, h, kids``: the block's number, nodes, root and nested tree.

    A block of a group that has no other is only as high as its nodes need.
    """
    digit = lambda i: F.shiftright("r", 3 * i).bitwiseAND(FAN_OUT - 1).cast("int")
    rows = nodes.select(*group, F.shiftright("r", 3 * DIGITS).alias("b"), *[digit(i).alias(f"d{i}") for i in range(DIGITS)], F.lit(1).alias("n"), "h", F.col("p").alias("kids"))
    rows = rows.repartition(*group, "b")
    for i in range(DIGITS):  # the shuffle above serves all groupings
        kids = F.array_sort(F.collect_list(F.struct(F.col(f"d{i}").alias("d"), "h", "kids"))).alias("kids")
        rows = rows.groupBy(*group, "b", *[f"d{j}" for j in range(DIGITS - 1, i, -1)]).agg(F.sum("n").cast("int").alias("n"), kids)
        rows = rows.withColumn("h", digest(_joined(_hashes(F.col("kids")))))
    root = _first(0)
    for i in range(DIGITS):
        root = F.when(_hashed(i), _first(i + 1)).otherwise(root)
    return rows.select(*group, "b", "n", root.alias("h"), "kids")


def _first(level: int) -> Column:
    """The hash of a block's first node on a level; level 0 has the leaves, DIGITS the root of all."""
    node = F.struct("h", "kids")
    for _ in range(DIGITS - level):
        node = node["kids"][0]
    return node["h"]


def _hashed(level: int) -> Column:
    """Whether nodes of a level are hashed together: always, but in a lone block that has one node there."""
    return (F.col("b") > 0) | (F.col("n") > FAN_OUT**level)


def _explode(blocks: DataFrame, group: list[str], carried: list[str]) -> DataFrame:
    """Blocks back to their nodes, ``group, r, h, p, path``; ``path`` goes on from the block's own ``path``, lowest level first."""
    rows = blocks.withColumn("r", F.col("b"))
    for i in range(DIGITS - 1, -1, -1):
        hashes = _hashes(F.col("kids"))

        def placed(k, j):
            around = F.struct(_joined(F.slice(hashes, 1, j)).alias("before"), _joined(F.slice(hashes, j + 2, FAN_OUT)).alias("after"))
            return F.struct(k["d"].alias("d"), k["h"].alias("h"), k["kids"].alias("kids"), around.alias("step"))

        rows = rows.select(*group, "b", "n", "r", "path", *carried, F.explode(F.transform("kids", placed)).alias("node"))
        path = F.when(_hashed(i), F.concat(F.array("node.step"), "path")).otherwise(F.col("path"))
        rows = rows.select(*group, "b", "n", (F.col("r") * FAN_OUT + F.col("node.d")).alias("r"), F.col("node.h").alias("h"), F.col("node.kids").alias("kids"), path.alias("path"), *carried)
    return rows.select(*group, "r", "h", F.col("kids").alias("p"), "path", *carried)


def _stages(nodes: DataFrame, group: list[str]) -> list[DataFrame]:
    """Kept stages of blocks, up to one of a single block a group."""
    stages: list[DataFrame] = []
    while True:
        stages.append(checkpoint(_nest(nodes, group)))
        if not stages[-1].agg(F.max("b")).first()[0]:
            return stages
        nodes = stages[-1].select(*group, F.col("b").alias("r"), "h", F.lit(0).alias("p"))


def _down(stages: list[DataFrame], group: list[str], above: DataFrame, carried: list[str]) -> DataFrame:
    """The lowest nodes with their paths; ``above`` has ``group, r, path`` and ``carried`` for the last stage's blocks.

    The nodes of a stage and the blocks they stand for meet by grouping on the
    block's number: two rows a key.
    """
    for blocks in reversed(stages):
        both = blocks.select(*group, "b", "n", "kids").unionByName(above.select(*group, F.col("r").alias("b"), "path", *carried), allowMissingColumns=True)
        met = both.groupBy(*group, "b").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("n", "kids", "path", *carried)])
        above = _explode(met, group, carried)
    return above


def manifest(docs: DataFrame, tampered: dict[str, Column] | None = None) -> DataFrame:
    """``doc_id, lang, leaf, claimed, subroot, root, path`` of every row of ``docs`` (doc_id, source, lang, n_chars, text).

    ``leaf`` is the digest of the row's fields, ``subroot`` that of its language's
    tree, ``path`` the hashes before and after on every level up to ``root``.
    ``tampered`` gives other expressions for some fields, as a later copy has them;
    ``claimed`` is the leaf over those, null where it is the same.

    Defined cases: null fields are leaves of their own kind (``-``), an empty text is
    not a null one; null languages form the first tree, null doc_ids come first in
    theirs; rows with equal doc_ids go by their leaves' digests, and equal rows are a
    leaf each; texts of any length are hashed whole; a language of one document has its
    leaf as subroot, and one language its subroot as root; an empty table gives no
    rows; other columns are ignored.
    """
    cols = {name: F.col(name) for name in FIELDS}
    leaf, other = leaf_digest(cols), leaf_digest(cols | (tampered or {}))
    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("long").alias("doc_id"), leaf.alias("h"), other.alias("claimed") if tampered else F.lit(None).cast("string").alias("claimed"))
    rows = checkpoint(rows.withColumn("claimed", F.when(F.col("claimed") != F.col("h"), F.col("claimed"))))
    leaves = ranked(rows, ["lang"], ["doc_id", "h"], "r")
    trees = _stages(leaves.select("lang", "r", "h", F.struct("doc_id", "claimed").alias("p")), ["lang"])
    roots = checkpoint(trees[-1].select("lang", "h"))
    tops = _stages(ranked(roots, [], ["lang"], "r").select("r", "h", F.struct("lang").alias("p")), [])
    none = F.array().cast(f"array<{_STEP}>")
    found = _down(tops, [], tops[-1].select(F.col("b").alias("r"), none.alias("path"), F.col("h").alias("root")), ["root"])
    above = found.select("p.lang", F.lit(0).cast("long").alias("r"), "path", F.col("h").alias("subroot"), "root")
    found = _down(trees, ["lang"], above, ["subroot", "root"])
    return found.select("p.doc_id", "lang", F.col("h").alias("leaf"), "p.claimed", "subroot", "root", "path")


def siblings_digest(path: Column) -> Column:
    """One digest of all siblings, level by level from the leaf up, left to right."""
    return F.sha2(_joined(F.flatten(F.transform(path, lambda s: F.array(s["before"], s["after"])))), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda acc, s: digest(s["before"], acc, s["after"]))


def proofs(docs: DataFrame, tampered: dict[str, Column] | None = None) -> DataFrame:
    """``doc_id, lang, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row (see ``manifest``).

    ``folded_root`` is made anew from the tampered leaf, where there is one, and the siblings.
    """
    rows = manifest(docs, tampered)
    made = rows.select("doc_id", "lang", "leaf", "subroot", "root", siblings_digest(F.col("path")).alias("proof_sha256"), folded(F.coalesce("claimed", "leaf"), F.col("path")).alias("folded_root"))
    return made.withColumn("verified", F.col("folded_root") == F.col("root"))


def lowered_text(every: int = 3) -> dict[str, Column]:
    """Tampering for tests of proofs: of every third document, by its id's checksum, A-Z of the text are lower-cased."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0
    return {"text": F.when(hit, ascii_lower(F.col("text"))).otherwise(F.col("text"))}
