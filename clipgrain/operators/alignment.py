"""Transcript alignment: tokens, the aligned path, and evidence per position and phoneme."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipgrain.functions.kernels import forced_alignment
from clipgrain.functions.text import held, lookup
from clipgrain.functions.tokens import FORMATS, format_of, nfc, transcript_symbols
from clipgrain.operators.decode import argmax, runs, top_k
from clipgrain.operators.notation import forms
from clipgrain.sources import reference_data as R


def transcript_tokens(transcripts: DataFrame, vocab: dict[str, int]) -> DataFrame:
    """``clip_id, position, symbol, phoneme, vocab_idx`` from ``clip_id, format, content``.

    A symbol in the vocabulary is itself; else its ASCII spelling is looked up, the
    first entry that claims an IPA form winning. Without either the vocab_idx is null.
    """
    spelled = forms(transcripts.sparkSession).groupBy("form").agg(F.min_by("ipa", "symbol").alias("ipa"), F.min("symbol").alias("ascii"))
    index = {k: str(v) for k, v in vocab.items()}
    rows = transcripts.select("clip_id", F.posexplode(transcript_symbols(F.col("format"), F.col("content"))).alias("position", "symbol")).where(~F.col("symbol").isin(*R.NON_PHONEMES))
    rows = rows.withColumn("form", nfc(F.col("symbol"))).join(F.broadcast(spelled), "form", "left")
    direct, other = lookup(index, F.col("form")), lookup(index, F.col("ascii"))
    phoneme = F.when(direct.isNotNull(), F.col("form")).when(other.isNotNull(), F.col("ipa"))
    return rows.select("clip_id", "position", "symbol", phoneme.alias("phoneme"), F.coalesce(direct, other).cast("int").alias("vocab_idx"))


def warnings(transcripts: DataFrame, tokens: DataFrame, frames: DataFrame) -> DataFrame:
    """``clip_id, n_tokens, warnings``: what kept a transcript, or some of its positions, from being aligned; one row a transcript.

    ``tokens`` is ``transcript_tokens`` of them, ``frames`` has ``clip_id, n_frames``. First
    comes an unknown format, then each symbol without an entry in the vocabulary, in
    order, then what holds for the whole: no token at all, or more tokens than frames.
    Symbols without an entry stay as rows until they are folded into their clip's list.
    """
    lost = F.when(F.col("vocab_idx").isNull(), F.struct("position", "symbol"))
    folded = tokens.groupBy("clip_id").agg(F.count("vocab_idx").alias("n"), F.array_sort(F.collect_list(lost)).alias("lost"))
    rows = transcripts.select("clip_id", "format").join(folded, "clip_id", "left").join(frames.select("clip_id", "n_frames"), "clip_id", "left")
    rows = rows.withColumns({"n_tokens": F.coalesce("n", F.lit(0)), "known": format_of(F.col("format")).isin(*FORMATS)})
    each = F.transform("lost", lambda p: F.format_string("Phoneme /%s/ at position %d has no model vocabulary mapping; alignment skipped for this position.", p["symbol"], p["position"]))
    said = F.concat(
        F.array(F.when(~F.col("known"), F.format_string("Unknown transcript format '%s'; expected one of ipa, espeak, orthography_with_dictionary. Alignment skipped.", F.coalesce("format", F.lit(""))))),
        F.coalesce(each, F.array().cast("array<string>")),
        F.array(F.when(F.col("n_tokens") == 0, "Transcript produced no alignable tokens; alignment skipped.").when(F.col("n_tokens") > F.col("n_frames"), F.format_string("Transcript (%d phonemes) is longer than the audio (%d frames); alignment skipped.", "n_tokens", "n_frames"))),
    )
    return rows.select("clip_id", "n_tokens", F.array_compact(said).alias("warnings"))


def span_means(frames: DataFrame, spans: DataFrame) -> DataFrame:
    """Adds ``mean``: the average of ``log_probs`` over each span's frames, entry by entry.

    ``spans``: ``clip_id, span, target, start_frame, end_frame``. Frames are few per
    span, so their arrays are gathered and summed in place, without a row per entry.
    """
    at = spans.withColumn("frame_idx", F.explode(F.sequence("start_frame", F.col("end_frame") - 1)))
    rows = at.join(frames.select("clip_id", "frame_idx", "log_probs"), ["clip_id", "frame_idx"])
    return gathered_spans(rows, spans.columns)


def gathered_spans(rows: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """``keys``, ``more`` aggregates and the ``mean`` of frames (``keys, frame_idx, log_probs``) that are at hand with their spans."""
    gathered = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col("log_probs").isNotNull(), F.struct("frame_idx", "log_probs")))).alias("rows"), *more).where(F.size("rows") > 0)
    return gathered.withColumn("mean", _mean_of(F.col("rows"))).drop("rows")


def _in_order() -> Column:
    """The score arrays of a group's frames, by frame."""
    return F.array_sort(F.collect_list(F.struct("frame_idx", "log_probs")))


def _mean_of(rows: Column) -> Column:
    total = F.aggregate(F.slice(rows, 2, F.size(rows)), rows[0]["log_probs"], lambda acc, x: F.zip_with(acc, x["log_probs"], lambda a, b: a + b))
    return held(F.size(rows), lambda n: F.transform(total, lambda x: x / n))


def classify_spans(spans: DataFrame) -> DataFrame:
    """Adds ``avg_log_prob, top1, top3, match``; the average is of log probabilities, not of probabilities."""
    target = F.element_at("mean", F.col("target") + 1)
    average = F.when(target.isNotNull() & ~F.isnan(target) & (F.abs(target) != float("inf")), target).otherwise(F.lit(R.NO_LOG_PROB))
    rows = spans.withColumns({"avg_log_prob": average, "top1": argmax(F.col("mean")), "top3": F.transform(top_k(F.col("mean")), lambda p: F.struct(p["idx"].alias("idx"), F.exp(p["score"]).alias("prob")))})
    near = F.exists("top3", lambda p: (p["idx"] == F.col("target")) & (p["prob"] >= R.NEAR_MISS_MIN_PROB))
    match = F.when((F.col("top1") == F.col("target")) & (F.col("avg_log_prob") >= R.PRODUCED_MIN_LOG_PROB), "produced").when(near, "near_miss").otherwise("absent")
    return rows.withColumn("match", match)


def phoneme_summary(positions: DataFrame, by: str = "target") -> DataFrame:
    """Expected, produced, near-missed and absent counts of each target, and the strength of its evidence."""
    count = lambda kind: F.count_if(F.col("match") == kind)
    rows = positions.groupBy("clip_id", by).agg(F.count(F.lit(1)).alias("expected"), count("produced").alias("produced"), count("near_miss").alias("near_miss"), count("absent").alias("absent"))
    return rows.withColumn("evidence_strength", strength(F.col("expected"), F.col("produced"), F.col("near_miss")))


def strength(expected: Column, produced: Column, near: Column) -> Column:
    floor = lambda ratio: F.ceil(expected * ratio)
    return F.when(produced >= floor(R.STRONG_RATIO), "strong").when(produced + near >= floor(R.MODERATE_RATIO), "moderate").otherwise("weak")


def quality_of(mean: Column) -> Column:
    return F.when(mean >= R.HIGH_MIN_LOG_PROB, "high").when(mean >= R.MEDIUM_MIN_LOG_PROB, "medium").otherwise("low")


def alignment_quality(positions: DataFrame) -> DataFrame:
    """The mean of all positions as high, medium or low; the sentinel of undefined spans counts."""
    return positions.groupBy("clip_id").agg(F.avg("avg_log_prob").alias("mean_log_prob")).withColumn("alignment_quality", quality_of(F.col("mean_log_prob")))


def aligned_block(positions: DataFrame) -> DataFrame:
    """``clip_id, alignment_quality, mean_log_prob, positions, summary`` from classified spans: one row a clip.

    ``summary`` counts each target as ``phoneme_summary`` does, over the clip's own positions.
    """
    order = F.array_sort(F.collect_list(F.struct("span", "target", "avg_log_prob", "top1", "top3", "match")))
    rows = positions.groupBy("clip_id").agg(F.avg("avg_log_prob").alias("mean_log_prob"), order.alias("positions"))

    def summed(t: Column) -> Column:
        count = lambda kind: F.size(F.filter("positions", lambda p: (p["target"] == t) & ((p["match"] == kind) if kind else F.lit(True))))
        return F.struct(t.alias("target"), count(None).alias("expected"), count("produced").alias("produced"), count("near_miss").alias("near_miss"), count("absent").alias("absent"), strength(count(None), count("produced"), count("near_miss")).alias("evidence_strength"))

    summary = F.transform(F.array_distinct(F.transform("positions", lambda p: p["target"])), summed)
    return rows.select("clip_id", quality_of(F.col("mean_log_prob")).alias("alignment_quality"), "mean_log_prob", "positions", summary.alias("summary"))


def aligned_paths(frames: DataFrame, tokens: DataFrame, blank: int = 0) -> DataFrame:
    """``clip_id, frame_idx, token, log_probs, duration_s`` of the best path; clips whose targets don't fit give no rows.

    One clip is one bounded group: its frames and its targets. The scores come back
    with the path, so that ``frames`` is read once.
    """

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.sort_by("frame_idx"), right.sort_by("position")
        path = None
        if len(left) and len(right):
            scores = np.array(left["log_probs"].to_pylist(), np.float64)
            path = forced_alignment(scores, right["vocab_idx"].to_pylist(), blank)
        if path is None:
            left, path = left.slice(0, 0), np.zeros(0, np.int64)
        return pa.table({"clip_id": left["clip_id"].cast(pa.int64()), "frame_idx": left["frame_idx"].cast(pa.int32()), "token": pa.array(path.astype(np.int32)), "log_probs": left["log_probs"], "duration_s": left["duration_s"]})

    wanted = tokens.where("vocab_idx is not null").select("clip_id", "position", "vocab_idx")
    rows = frames.select("clip_id", "frame_idx", "log_probs", "duration_s")
    return rows.groupBy("clip_id").cogroup(wanted.groupBy("clip_id")).applyInArrow(run, "clip_id long, frame_idx int, token int, log_probs array<double>, duration_s double")


def align(frames: DataFrame, tokens: DataFrame, blank: int = 0) -> DataFrame:
    """Positions of a forced alignment: span, frames, times in ms (half-even), averages and match.

    ``frames`` has ``clip_id, frame_idx, log_probs, duration_s``; the runs of a clip's
    path and its targets are matched by order.
    """
    clip = Window.partitionBy("clip_id")
    paths = aligned_paths(frames, tokens, blank).withColumn("ms", F.max("duration_s").over(clip) * 1000.0 / F.count(F.lit(1)).over(clip))
    found = runs(paths, "token", rows=_in_order(), ms=F.max("ms")).where(F.col("token") != blank).withColumn("span", F.row_number().over(clip.orderBy("run")) - 1)
    targets = tokens.where("vocab_idx is not null").withColumn("span", F.row_number().over(clip.orderBy("position")) - 1)
    spans = found.join(targets, ["clip_id", "span"]).select("clip_id", "span", F.col("vocab_idx").alias("target"), "start_frame", "end_frame", "ms", _mean_of(F.col("rows")).alias("mean"))
    at = lambda c: F.rint(F.col(c) * F.col("ms")).cast("long")
    return classify_spans(spans).select("clip_id", "span", "target", at("start_frame").alias("start_ms"), at("end_frame").alias("end_ms"), "avg_log_prob", "top1", "top3", "match")
