"""Voice onset times: nearest voiced frames after and before stops, without a range join.

Stops and voiced frames of a clip go into one ordered window; the nearest frame
is a min or max over a range of microseconds, so each clip is sorted once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipgrain.functions.text import lookup
from clipgrain.sources import reference_data as R


def stop_class(symbol: Column) -> Column:
    """The voicing class of a stop; null for other symbols."""
    return lookup({stop.symbol: stop.aspiration for stop in R.STOPS}, symbol)


def measurements(stops: DataFrame, pitch: DataFrame, forward_us: int = R.FORWARD_US, backward_us: int = R.BACKWARD_US, max_ms: float = R.VOT_MAX_MS) -> DataFrame:
    """From stops (``clip_id, stop_id, phoneme, start_us, release_us``) and frames (``clip_id, time_us, f0_hz``):

    ``clip_id, stop_id, phoneme, release_us, aspiration_class, forward_us, backward_us,
    vot_ms``. A voiced stop takes the last voiced frame up to its start, if one is
    near enough; all others, and voiced ones without, the first voiced frame from
    their release on, within bounds. Stops without either have a null vot_ms.
    """
    own = F.struct("stop_id", "phoneme", "release_us", stop_class(F.col("phoneme")).alias("aspiration_class"))
    marks = F.array(F.struct(F.col("release_us").alias("t"), F.lit(1).alias("side")), F.struct(F.col("start_us").alias("t"), F.lit(2).alias("side")))
    marks = stops.where(stop_class(F.col("phoneme")).isNotNull()).select("clip_id", own.alias("stop"), F.inline(marks))
    voiced = pitch.where("f0_hz > 0").select("clip_id", F.col("time_us").alias("t"), F.col("time_us").alias("v"))
    w = Window.partitionBy("clip_id").orderBy("t")
    merged = marks.unionByName(voiced, allowMissingColumns=True)
    seen = merged.withColumns({"ahead": F.min("v").over(w.rangeBetween(0, forward_us)), "behind": F.max("v").over(w.rangeBetween(-backward_us, 0))})
    at = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    rows = seen.where("side is not null").groupBy("clip_id", "stop").agg(at(1, "ahead").alias("forward_us"), at(2, "behind").alias("backward_us")).select("clip_id", "stop.*", "forward_us", "backward_us")
    after = (F.col("forward_us") - F.col("release_us")) / 1000.0
    vot = F.when((F.col("aspiration_class") == "voiced") & F.col("backward_us").isNotNull(), (F.col("backward_us") - F.col("release_us")) / 1000.0).when(after.between(R.VOT_MIN_MS, max_ms), after)
    return rows.select("clip_id", "stop_id", "phoneme", "release_us", "aspiration_class", "forward_us", "backward_us", vot.alias("vot_ms"))


def class_means(measured: DataFrame) -> DataFrame:
    """Mean VOT of each class per clip; other stops are measured but have no mean."""
    mean = lambda name: F.avg(F.when(F.col("aspiration_class") == name, F.col("vot_ms"))).alias(f"{name}_mean_ms")
    return measured.groupBy("clip_id").agg(F.count("vot_ms").alias("n_measured"), *[mean(n) for n in ("aspirated_voiceless", "plain_voiceless", "voiced")])
