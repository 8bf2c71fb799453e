"""Pitch, formant and syllable measures of clips from frame tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipgrain.functions.text import finite, held


def f0_aggregates(f0: Column, prefix: str = "") -> list[Column]:
    """What ``f0_fields`` needs of a group's frames (0, null and what is not finite are unvoiced)."""
    voiced = F.when(finite(f0) > 0, f0)
    st = F.lit(12.0) * F.log2(voiced / 100.0)
    found = {"voiced": F.count(voiced), "mean_hz": F.avg(voiced), "min_hz": F.min(voiced), "max_hz": F.max(voiced), "std_hz": F.stddev_pop(voiced), "std_semitones": F.stddev_pop(st), "p": F.percentile(st, [0.1, 0.9])}
    return [c.alias(prefix + name) for name, c in found.items()]


def f0_fields(prefix: str = "") -> list[Column]:
    """Level and spread in Hz and semitones; null with fewer than five voiced frames."""
    enough = lambda c: F.when(F.col(f"{prefix}voiced") >= 5, c)
    spread = F.col(f"{prefix}p")
    return [*[enough(F.col(prefix + c)).alias(c) for c in ("mean_hz", "min_hz", "max_hz", "std_hz", "std_semitones")], enough(spread[1] - spread[0]).alias("range_semitones_p10_p90")]


def f0_stats(pitch: DataFrame, keys: tuple[str, ...] = ("clip_id",)) -> DataFrame:
    """From ``keys, f0_hz`` frames (0 is unvoiced): level, spread in Hz and semitones, and the share of voiced frames.

    With fewer than five voiced frames all but that share are null.
    """
    agg = pitch.groupBy(*keys).agg(*f0_aggregates(F.col("f0_hz")), F.count(F.lit(1)).alias("frames"))
    return agg.select(*keys, *f0_fields(), (F.col("voiced") / F.col("frames")).alias("voiced_fraction"))


def f0_range(pitch: DataFrame, keys: tuple[str, ...] = ("clip_id",)) -> DataFrame:
    """``keys, range_hz_max_min``: the span of voiced pitch, null under five voiced frames."""
    return f0_stats(pitch, keys).select(*keys, (F.col("max_hz") - F.col("min_hz")).alias("range_hz_max_min"))


def formant_means(tracks: DataFrame) -> DataFrame:
    """Mean of each formant over the frames where it is defined."""
    return tracks.groupBy("clip_id").agg(*[F.avg(finite(F.col(c))).alias(f"{c}_mean_hz") for c in ("f1", "f2", "f3")])


def on_grid(track: DataFrame, clips: DataFrame, values: tuple[str, ...] = ("f1", "f2", "f3"), step_us: int = 10_000, max_gap_us: int = 50_000) -> DataFrame:
    """``clip_id, t_idx, values``: a track read off at regular times, between its points by linear interpolation.

    ``track``: ``clip_id, time_us, values``, one row a time; ``clips``: ``clip_id, duration_us``. The grid
    begins at 0 and ends before the clip's duration. A value is null before its first
    and after its last defined point, and between two that are more than ``max_gap_us``
    apart. Each value has its own points: where one is undefined the others go on. Grid
    and track lie in one window of the clip, so that nothing is joined by range.
    """
    grid = clips.where("duration_us > 0").select("clip_id", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("duration_us") - 1, F.lit(step_us).cast("long"))).alias("t_idx", "time_us"))
    own = track.select("clip_id", "time_us", *[finite(F.col(c)).alias(c) for c in values])
    rows = grid.unionByName(own, allowMissingColumns=True)
    order = Window.partitionBy("clip_id").orderBy("time_us")
    past, ahead = order.rangeBetween(Window.unboundedPreceding, 0), order.rangeBetween(0, Window.unboundedFollowing)
    point = lambda c: F.when(F.col(c).isNotNull(), F.struct("time_us", F.col(c).alias("v")))
    rows = rows.withColumns({f"_{side}_{c}": how(point(c), ignorenulls=True).over(w) for c in values for side, how, w in (("a", F.last, past), ("b", F.first, ahead))})

    def between(c: str) -> Column:
        a, b = F.col(f"_a_{c}"), F.col(f"_b_{c}")
        gap = b["time_us"] - a["time_us"]
        return F.when(gap == 0, a["v"]).when(gap <= max_gap_us, a["v"] + (b["v"] - a["v"]) * (F.col("time_us") - a["time_us"]) / gap)

    return rows.where("t_idx is not null").select("clip_id", "t_idx", *[between(c).alias(c) for c in values])


def syllable_peaks(intensity: DataFrame) -> DataFrame:
    """Frames that are strict local maxima above the clip's mean less 5 dB; the first and last frame are none."""
    w = Window.partitionBy("clip_id")
    o = w.orderBy("idx")
    rows = intensity.withColumns({"before": F.lag("db").over(o), "after": F.lead("db").over(o), "mean_db": F.avg("db").over(w)})
    return rows.where("db > before and db > after and db > mean_db - 5").select("clip_id", "idx", "db")


def syllables(levels: Column, seconds: Column, min_dip: float = 2.0) -> Column:
    """``struct<peaks, accepted, rate_hz>`` of a clip's levels in order: a peak counts if the level fell by ``min_dip`` since the last counted one.

    What is compared is the last counted peak, so this is a fold over the frames in order.
    Fewer than ten frames give a null rate, no peaks give 0.
    """

    def over(v: Column, mean: Column) -> Column:
        n, level = F.size(v), lambda i: F.element_at(v, i)
        inner = F.when(n > 2, F.sequence(F.lit(2), n - 1)).otherwise(F.array().cast("array<int>"))
        peak = lambda i: F.coalesce((level(i) > mean - 5) & (level(i) > level(i - 1)) & (level(i) > level(i + 1)), F.lit(False))
        start = F.struct(F.lit(0).alias("peaks"), F.lit(0).alias("accepted"), F.lit(0.0).cast("double").alias("last"), F.lit(float("inf")).alias("low"))

        def step(acc, i):
            counts = peak(i) & ((acc["accepted"] == 0) | (acc["last"] - acc["low"] >= min_dip))
            low = F.when(counts, level(i)).otherwise(F.least(acc["low"], level(i)))
            return F.struct((acc["peaks"] + peak(i).cast("int")).alias("peaks"), (acc["accepted"] + counts.cast("int")).alias("accepted"), F.when(counts, level(i)).otherwise(acc["last"]).alias("last"), low.alias("low"))

        rate = lambda f: F.when((n >= 10) & (seconds > 0), F.when(f["peaks"] == 0, F.lit(0.0)).otherwise(f["accepted"] / seconds))
        return held(F.aggregate(inner, start, step), lambda f: F.struct(f["peaks"].alias("peaks"), f["accepted"].alias("accepted"), rate(f).alias("rate_hz")))

    mean = lambda v: F.try_divide(F.aggregate(v, F.lit(0.0).cast("double"), lambda acc, x: acc + x), F.size(v))
    return held(levels, lambda v: held(mean(v), lambda m: over(v, m)))


def levels_in_order(idx: str = "idx", db: str = "db") -> Column:
    """A group's levels as an array, by frame."""
    return F.transform(F.array_sort(F.collect_list(F.struct(idx, db))), lambda f: f[db])


def syllable_rate(intensity: DataFrame, durations: DataFrame | None = None, min_dip: float = 2.0, step: float = 0.01) -> DataFrame:
    """``clip_id, peaks, accepted, rate_hz`` of ``clip_id, idx, db`` frames, see ``syllables``; a clip lasts ``step`` seconds a frame unless ``durations`` says otherwise."""
    rows = intensity.groupBy("clip_id").agg(levels_in_order().alias("levels"))
    if durations is not None:
        rows = rows.join(durations, "clip_id")
    seconds = F.col("duration_s") if durations is not None else F.size("levels") * step
    return rows.select("clip_id", syllables(F.col("levels"), seconds, min_dip).alias("s")).select("clip_id", "s.*")
