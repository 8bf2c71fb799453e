"""Clip quality: source label, clipping, signal to noise, baseline window and notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipgrain.functions.text import for_two_places
from clipgrain.operators.decode import runs
from clipgrain.operators.prosody import f0_aggregates, f0_fields, syllable_rate
from clipgrain.sources import reference_data as R


def source_clip(purpose: Column) -> Column:
    """The caller's label if it is a known one; never inferred."""
    return F.when(purpose.isin(*R.CLIP_PURPOSES), purpose).otherwise("unspecified")


def sample_levels(samples: DataFrame, top_db: float = R.SNR_TOP_DB) -> DataFrame:
    """From ``clip_id, x`` samples with a ``voiced`` flag: clipping and SNR of each clip, with a note where there is none.

    Samples are scaled by the peak only where it is above one. One shuffle by clip
    serves both the peak and the levels; ``n`` samples and the ``voiced_fraction`` come along.
    """
    peak = F.max(F.abs("x")).over(Window.partitionBy("clip_id"))
    x = F.when(F.col("peak") > 1, F.col("x") / F.col("peak")).otherwise(F.col("x"))
    rows = samples.withColumn("peak", peak).select("clip_id", "peak", "voiced", x.alias("x"))
    agg = rows.groupBy("clip_id").agg(
        F.max("peak").alias("peak"),
        (F.avg((F.abs("x") >= R.CLIPPING_AT).cast("double")) * 100.0).alias("clipping_pct"),
        F.sqrt(F.avg(F.when(F.col("voiced"), F.col("x") * F.col("x")))).alias("signal_rms"),
        F.sqrt(F.avg(F.when(~F.col("voiced"), F.col("x") * F.col("x")))).alias("noise_rms"),
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col("voiced").cast("double")).alias("voiced_fraction"),
    )
    note = F.when(F.col("signal_rms").isNull(), "No voiced regions detected; SNR not estimable.").when(F.col("noise_rms").isNull(), "No silent regions detected; SNR not estimable.").when(F.col("signal_rms") == 0, "Signal energy is zero; SNR not estimable.")
    ratio = F.lit(20.0) * F.log10(F.try_divide("signal_rms", "noise_rms"))
    snr = F.when(note.isNull(), F.when(F.col("noise_rms") == 0, F.lit(R.SNR_MAX_DB)).otherwise(F.least(ratio, F.lit(R.SNR_MAX_DB))))
    return agg.select("clip_id", "peak", "clipping_pct", "signal_rms", "noise_rms", snr.alias("snr_db"), note.alias("snr_note"), "n", "voiced_fraction")


def voiced_intervals(samples: DataFrame, frame: int = 2048, hop: int = 512, top_db: float = R.SNR_TOP_DB) -> DataFrame:
    """``clip_id, start, end``: half-open intervals of samples whose centred frames lie within ``top_db`` of the clip's loudest.

    From ``clip_id, i, x`` with i from 0 without gaps. ``frame`` is a multiple of twice
    ``hop``, so a frame's energy is a sum over neighbouring hops: samples are summed once,
    and frames that overlap share those sums. A frame begins at every hop, the clip's end
    included. One clip is one window; it holds one row a hop.
    """
    half = frame // (2 * hop)
    clip = Window.partitionBy("clip_id")
    hops = samples.groupBy("clip_id", F.expr(f"i div {hop}").alias("h")).agg(F.sum(F.col("x") * F.col("x")).alias("e"), F.count(F.lit(1)).alias("n"))
    hops = hops.withColumns({"samples": F.sum("n").over(clip), "last": F.max("h").over(clip)})
    ends = F.when((F.col("h") == F.col("last")) & (F.col("n") == hop), F.array(F.col("h"), F.col("h") + 1)).otherwise(F.array("h"))
    rows = hops.select("clip_id", "h", "e", "samples", F.explode(ends).alias("t"))
    energy = F.sum(F.when(F.col("t") == F.col("h"), F.col("e")).otherwise(0.0)).over(clip.orderBy("t").rangeBetween(-half, half - 1)) / frame
    level = lambda e: F.lit(10.0) * F.log10(F.greatest(e, F.lit(R.SILENCE**2)))
    rows = rows.withColumn("power", energy).withColumn("loud", level(F.col("power")) - level(F.max("power").over(clip)) > -top_db)
    found = runs(rows, "loud", "t", samples=F.max("samples")).where("loud")
    return found.select("clip_id", (F.col("start_frame") * hop).alias("start"), F.least(F.col("end_frame") * hop, F.col("samples")).alias("end")).where("start < end")


def covered(samples: DataFrame, intervals: DataFrame, flag: str = "voiced") -> DataFrame:
    """Adds ``flag``: whether ``i`` lies in one of the clip's half-open intervals, which may overlap.

    A sweep: an interval counts up at its start and down at its end, so each clip is sorted once and nothing is joined by range.
    """
    mark = lambda at, d: intervals.select("clip_id", F.col(at).alias("i"), F.lit(d).alias("_d"), F.lit(False).alias("_own"))
    rows = samples.withColumns({"_d": F.lit(0), "_own": F.lit(True)}).unionByName(mark("start", 1), allowMissingColumns=True).unionByName(mark("end", -1), allowMissingColumns=True)
    open_ = F.sum("_d").over(Window.partitionBy("clip_id").orderBy("i").rangeBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(flag, open_ > 0).where("_own").drop("_d", "_own")


def audio_levels(samples: DataFrame, frame: int = 2048, hop: int = 512) -> DataFrame:
    """``sample_levels`` of ``clip_id, i, x`` with the mask that the samples' own energy gives."""
    return sample_levels(covered(samples, voiced_intervals(samples, frame, hop)))


BASELINE_NOTE = "First 5s of clip used as baseline; values for normalisation only."


def baseline_block(source: Column, f0: list[Column], syllable_rate: Column) -> list[Column]:
    """The fields of a baseline: whose clip, which window, and what it says."""
    of = {c: f for f, c in zip(f0, ("mean_hz", "min_hz", "max_hz", "std_hz", "std_semitones", "range"), strict=True)}
    window = [F.lit(0).alias("window_start_ms"), F.lit(int(R.BASELINE_S * 1000)).alias("window_end_ms")]
    return [source.alias("source_clip"), *window, of["mean_hz"].alias("f0_mean_hz"), of["std_semitones"].alias("f0_std_semitones"), syllable_rate.alias("syllable_rate_hz"), F.lit(BASELINE_NOTE).alias("notes")]


def baseline(clips: DataFrame, pitch: DataFrame, intensity: DataFrame, step: float = 0.01) -> DataFrame:
    """What a clip's first five seconds say, for normalisation: one row per clip that lasts so long.

    ``clips``: ``clip_id, duration_s, source_clip``; ``pitch``: ``clip_id, time_us, f0_hz``;
    ``intensity``: ``clip_id, idx, db`` with a frame every ``step`` seconds. Times are
    the clip's own. A measure that the window does not give is null.
    """
    long = clips.where(F.col("duration_s") >= R.BASELINE_S)
    f0 = pitch.where(F.col("time_us") < int(R.BASELINE_S * 1e6)).groupBy("clip_id").agg(*f0_aggregates(F.col("f0_hz")))
    rate = syllable_rate(intensity.where(F.col("idx") < int(round(R.BASELINE_S / step))), step=step).select("clip_id", "rate_hz")
    rows = long.join(f0, "clip_id", "left").join(rate, "clip_id", "left")
    return rows.select("clip_id", *baseline_block(F.col("source_clip"), f0_fields(), F.col("rate_hz")))


def notes(duration_s: Column, voiced_fraction: Column, clipping_pct: Column) -> Column:
    """What a listener should know about a clip, in a fixed order."""
    return F.array_compact(
        F.array(
            F.when(duration_s < 0.3, "clip is very short (<0.3s); results may be unreliable"),
            F.when(voiced_fraction < 0.05, "very little voiced audio detected; pitch may be unreliable"),
            F.when(clipping_pct >= R.CLIPPING_NOTE_PCT, F.format_string("Audio significantly affected by clipping (%.2f%%).", for_two_places(clipping_pct))),
            F.when(duration_s < R.BASELINE_S, "Clip too short (<5s) for baseline calibration."),
        )
    )
