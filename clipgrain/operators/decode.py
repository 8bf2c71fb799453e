"""From frame scores to phoneme occurrences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipgrain.functions.text import held
from clipgrain.sources import reference_data as R


def argmax(scores: Column) -> Column:
    """Index of the largest value, the first of equal ones."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def log_softmax(logits: Column) -> Column:
    """Log probabilities of one frame's scores; its maximum and its sum are made once, not once an entry."""
    total = lambda v, most: F.aggregate(v, F.lit(0.0), lambda acc, x: acc + F.exp(x - most))
    return held(logits, lambda v: held(F.array_max(v), lambda most: held(most + F.ln(total(v, most)), lambda all_: F.transform(v, lambda x: x - all_))))


def top_k(scores: Column, k: int = 3) -> Column:
    """The k largest as structs (idx, score), the smaller index first among equal ones."""
    pairs = F.transform(scores, lambda x, i: F.struct((-x).alias("neg"), i.alias("idx")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda p: F.struct(p["idx"].alias("idx"), (-p["neg"]).alias("score")))


def runs(frames: DataFrame, value: str, order: str = "frame_idx", keys: tuple[str, ...] = ("clip_id",), **more: Column) -> DataFrame:
    """Maximal runs of equal values: ``keys, run, value, start_frame, end_frame`` (past the run), and ``more`` aggregates of each run."""
    o = Window.partitionBy(*keys).orderBy(order)
    rows = frames.withColumn("_new", F.coalesce(~F.col(value).eqNullSafe(F.lag(value).over(o)), F.lit(True)) | (F.row_number().over(o) == 1))
    rows = rows.withColumn("run", F.sum(F.col("_new").cast("int")).over(o))
    return rows.groupBy(*keys, "run").agg(F.first(value).alias(value), F.min(order).alias("start_frame"), (F.max(order) + 1).alias("end_frame"), *[c.alias(name) for name, c in more.items()])


def label_of(token: Column, vocab: list[str]) -> Column:
    """The symbol of an id; ``<vocab:id>`` for ids that the vocabulary lacks."""
    return F.coalesce(F.try_element_at(F.array(*[F.lit(v) for v in vocab]), token + 1), F.format_string("<vocab:%d>", token))


def occurrences(frames: DataFrame, vocab: list[str], blank: int = 0) -> DataFrame:
    """Greedy decoding of ``clip_id, frame_idx, log_probs, duration_s``: ``clip_id, seq, phoneme, start_s, end_s``.

    Equal ids in a row collapse; blanks and what is no phoneme part runs but are dropped after that.
    """
    ids = frames.select("clip_id", "frame_idx", argmax(F.col("log_probs")).alias("token"))
    clips = frames.groupBy("clip_id").agg(F.count(F.lit(1)).alias("n"), F.max("duration_s").alias("duration_s"))
    found = runs(ids, "token").where((F.col("token") != blank) & (F.col("token") >= 0)).join(clips, "clip_id").where("duration_s > 0")
    found = found.withColumn("phoneme", label_of(F.col("token"), vocab)).where(~F.col("phoneme").isin(*R.NON_PHONEMES))
    per_frame = F.col("duration_s") / F.col("n")
    seq = F.row_number().over(Window.partitionBy("clip_id").orderBy("run"))
    return found.select("clip_id", seq.alias("seq"), "phoneme", (F.col("start_frame") * per_frame).alias("start_s"), (F.col("end_frame") * per_frame).alias("end_s"))
