"""Blocks of a response that may fail: an error stays with its block and becomes a note of the clip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a note calls each block that may fail.
BLOCK_NOTES = {
    "quality": "quality measurement unavailable: ",
    "smoothing": "confusion smoothing unavailable: ",
    "language_match": "language match unavailable: ",
    "aligned_phonemes": "forced alignment unavailable: ",
    "phonemes": "phoneme detection unavailable: ",
    "vot": "VOT estimation unavailable: ",
}


def faulty(*faults: tuple[Column, str]) -> Column:
    """The name of the first fault whose condition holds in a row, or null; an unknown condition is no fault."""
    out = F.lit(None).cast("string")
    for condition, name in reversed(faults):
        out = F.when(condition, name).otherwise(out)
    return out


def isolated(rows: DataFrame, error: Column, block) -> DataFrame:
    """``clip_id, value, error``: ``block`` over the clips without faulty rows, the first error of the others.

    ``block`` takes rows and gives one row a clip; it never sees a row of a clip that has
    a faulty one, so what would fail there isn't run. Of several errors the first by
    name counts. Errors are found per row and summed up with the clip, without a second
    read of the rows: a clip is one group.
    """
    from pyspark.sql import Window

    marked = rows.withColumn("_error", error).withColumn("_failed", F.min("_error").over(Window.partitionBy("clip_id")))
    sound = block(marked.where("_failed is null").drop("_error", "_failed"))
    fields = [c for c in sound.columns if c != "clip_id"]
    sound = sound.select("clip_id", F.struct(*fields).alias("value"), F.lit(None).cast("string").alias("error"))
    failed = marked.where("_failed is not null").groupBy("clip_id").agg(F.min("_failed").alias("error"))
    return sound.unionByName(failed, allowMissingColumns=True)


def assembled(clips: DataFrame, blocks: dict[str, DataFrame], notes: str = "notes") -> DataFrame:
    """Joins each block (``clip_id, value, error``) as a struct of its name, null where it failed, and adds a note a failure, in the blocks' order."""
    out, said = clips, []
    for name, block in blocks.items():
        out = out.join(block.select("clip_id", F.col("value").alias(name), F.col("error").alias(f"_{name}")), "clip_id", "left")
        said.append(F.when(F.col(f"_{name}").isNotNull(), F.concat(F.lit(BLOCK_NOTES[name]), f"_{name}")))
    own = F.col(notes) if notes in clips.columns else F.array().cast("array<string>")
    return out.withColumn(notes, F.concat(own, F.array_compact(F.array(*said)))).drop(*[f"_{name}" for name in blocks])
