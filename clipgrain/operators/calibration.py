"""Calibration of the spread of pitch: file names, strata, summaries, cut-offs and their verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clipgrain.functions.text import lookup, number_or_null
from clipgrain.sources import reference_data as R


def file_fields(stem: Column) -> Column:
    """The seven fields of a clip's file name, or null for other names."""
    parts = F.split(stem, "-")
    names = ("modality", "channel", "emotion", "intensity", "statement", "repetition", "actor")
    return F.when(F.size(parts) == 7, F.struct(*[F.try_element_at(parts, F.lit(i + 1)).alias(n) for i, n in enumerate(names)]))


def bucket_of(emotion: Column, intensity: Column) -> Column:
    return lookup({f"{e}-{i}": name for e, i, name in R.BUCKETS}, F.concat_ws("-", emotion, intensity))


def spoken_as(emotion: Column, intensity: Column) -> Column:
    """What a clip's codes stand for, as ``strong happy``; null where either is unknown."""
    return F.concat(lookup(R.INTENSITIES, intensity), F.lit(" "), lookup(R.EMOTIONS, emotion))


def gender_of(actor: Column) -> Column:
    return F.when(actor.cast("long") % 2 != 0, "male").otherwise("female")


def leaning(bucket: Column) -> Column:
    return lookup(R.LEANING, bucket)


def scan_clips(spark: SparkSession, path: str) -> DataFrame:
    """``path, actor, emotion, intensity, bucket, gender, spoken_as`` of the speech clips below ``path`` that belong to a bucket.

    What a clip is says its file name, in seven fields; other names, songs and clips
    outside all buckets are left out. Only the list of files is read, not their contents.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.wav").load(path)
    rows = files.select("path", file_fields(F.regexp_extract("path", r"([^/]*)\.wav$", 1)).alias("f")).where("f.channel = '01'")
    rows = rows.select("path", "f.actor", "f.emotion", "f.intensity", bucket_of(F.col("f.emotion"), F.col("f.intensity")).alias("bucket"), gender_of(F.col("f.actor")).alias("gender"), spoken_as(F.col("f.emotion"), F.col("f.intensity")).alias("spoken_as"))
    return rows.where("bucket is not null")


def stratified_sample(clips: DataFrame, per_bucket: int, seed: int, name: str = "clip_id") -> DataFrame:
    """Up to ``per_bucket`` clips of each bucket, in an order that the seed fixes."""
    order = F.row_number().over(Window.partitionBy("bucket").orderBy(F.xxhash64(F.lit(seed), F.col(name)), name))
    return clips.withColumn("draw", order).where(F.col("draw") <= per_bucket)


#: Bins of about equally many values by which one group is dealt out before any of them are ranked.
BINS = 64


def exact_percentiles(rows: DataFrame, value: str, keys: tuple[str, ...], shares: dict[str, float]) -> DataFrame:
    """``keys`` and one column per entry of ``shares``: percentiles with linear interpolation.

    A group may hold any number of rows, so none is gathered: values are counted in
    bins between approximate quantiles, whatever their spread, which says in which bins
    the wanted ranks lie, and only the rows of those bins are ranked, bin by bin. A bin
    of one value needs no ranking.
    """
    x = F.col(value)
    rows = rows.where(x.isNotNull()).select(*[F.coalesce(F.col(k).cast("string"), F.lit("")).alias(f"_{k}") for k in keys], *keys, x.alias("x"))
    names = [f"_{k}" for k in keys]
    ends = rows.groupBy(*names).agg(F.percentile_approx("x", [i / BINS for i in range(1, BINS)], 10_000).alias("edges"), F.count(F.lit(1)).alias("total"))
    # A value that is an edge itself has a bin of its own, so that a frequent one is not ranked with others.
    bin_of = F.size(F.filter("edges", lambda e: e < F.col("x"))) + F.size(F.filter("edges", lambda e: e <= F.col("x")))
    binned = rows.join(ends, names).withColumn("bin", bin_of).drop("edges")
    bins = binned.groupBy(*names, "bin", "total").agg(F.count(F.lit(1)).alias("size"), F.min("x").alias("low"), F.max("x").alias("high"))
    bins = bins.withColumn("past", F.sum("size").over(Window.partitionBy(*names).orderBy("bin")))
    asked = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(p).alias("p")) for n, p in shares.items()])
    at = (F.col("total") - 1) * F.col("ask.p")
    wanted = bins.withColumn("ask", F.explode(asked)).withColumn("rank", F.explode(F.array_distinct(F.array(F.floor(at), F.ceil(at))))).where((F.col("rank") < F.col("past")) & (F.col("rank") >= F.col("past") - F.col("size")))
    wanted = wanted.select(*names, "bin", F.col("ask.name").alias("name"), "rank", (F.col("rank") - F.floor(at)).alias("upper"), (at - F.floor(at)).alias("part"), (F.col("past") - F.col("size")).alias("before"), "low", "high")
    alike = wanted.where("low = high").select(*names, "name", "upper", "part", F.col("low").alias("v"))
    mixed = wanted.where("low < high")
    ranked = binned.join(mixed.select(*names, "bin").distinct(), [*names, "bin"]).select(*names, "bin", "x", (F.row_number().over(Window.partitionBy(*names, "bin").orderBy("x")) - 1).alias("nth"))
    found = mixed.withColumn("nth", F.col("rank") - F.col("before")).join(ranked, [*names, "bin", "nth"]).select(*names, "name", "upper", "part", F.col("x").alias("v"))
    both = alike.unionByName(found)
    at_rank = lambda n, u: F.max(F.when((F.col("name") == n) & (F.col("upper") == u), F.col("v")))
    part = lambda n: F.max(F.when(F.col("name") == n, F.col("part")))
    return both.groupBy(*names).agg(*[(at_rank(n, 0) + (F.coalesce(at_rank(n, 1), at_rank(n, 0)) - at_rank(n, 0)) * part(n)).alias(n) for n in shares])


def summary(rows: DataFrame, value: str, keys: tuple[str, ...]) -> DataFrame:
    """n, mean, median, linear percentiles, extremes and the population deviation of each group."""
    x = F.col(value)
    names = [f"_{k}" for k in keys]
    agg = rows.where(x.isNotNull()).groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max"), F.stddev_pop(x).alias("stdev"))
    named = agg.select("*", *[F.coalesce(F.col(k).cast("string"), F.lit("")).alias(f"_{k}") for k in keys])
    p = exact_percentiles(rows, value, keys, {"median": 0.5, "p10": 0.1, "p25": 0.25, "p75": 0.75, "p90": 0.9})
    return named.join(p, names).select(*keys, "n", "mean", "median", "p10", "p25", "p75", "p90", "min", "max", "stdev")


def hz_class(std: Column) -> Column:
    return F.when(std.isNull(), "n/a").when(std < R.HZ_LOW, "flat").when(std <= R.HZ_HIGH, "moderate").otherwise("expressive")


def st_class(std: Column, low: Column, high: Column) -> Column:
    low, high = F.coalesce(low, F.lit(0.0)), F.coalesce(high, F.lit(0.0))
    return F.when(std.isNull(), "n/a").when(std < low, "flat").when(std <= high, "moderate").otherwise("expressive")


def cutoffs(clips: DataFrame) -> DataFrame:
    """One row: the mean semitone spread of either leaning, to one decimal."""
    group = leaning(F.col("bucket"))
    mean = lambda g: F.round(F.avg(F.when(group == g, F.col("std_semitones"))), 1)
    return clips.agg(mean("flat-leaning").alias("low_cut"), mean("expressive-leaning").alias("high_cut"))


def reclassified(clips: DataFrame) -> DataFrame:
    """Adds both classes of every clip, and whether it changes (not where either is n/a)."""
    rows = clips.join(F.broadcast(cutoffs(clips)), F.lit(True))
    rows = rows.withColumns({"hz_class": hz_class(F.col("std_hz")), "st_class": st_class(F.col("std_semitones"), F.col("low_cut"), F.col("high_cut"))})
    changed = (F.col("hz_class") != F.col("st_class")) & (F.col("hz_class") != "n/a") & (F.col("st_class") != "n/a")
    return rows.withColumn("changed", changed)


def crosstab(rows: DataFrame) -> DataFrame:
    """Clips of each bucket by class under both schemes."""
    count = lambda scheme, c: F.count_if(F.col(f"{scheme}_class") == c).alias(f"{scheme}_{c}")
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), *[count(s, c) for s in ("hz", "st") for c in ("flat", "moderate", "expressive")])


def verdict(rows: DataFrame) -> DataFrame:
    """One row: in-target and cross-tail percentages of either leaning, and whether the cut-offs can be defended."""
    group = leaning(F.col("bucket"))
    pct = lambda g, c: F.coalesce(F.try_divide(F.count_if((group == g) & (F.col("st_class") == c)) * 100.0, F.count_if(group == g)), F.lit(0.0))
    agg = rows.agg(pct("flat-leaning", "flat").alias("flat_pct"), pct("expressive-leaning", "expressive").alias("expressive_pct"), pct("flat-leaning", "expressive").alias("flat_cross_pct"), pct("expressive-leaning", "flat").alias("expressive_cross_pct"))
    good = (F.col("flat_pct") >= 40) & (F.col("expressive_pct") >= 40) & (F.col("flat_cross_pct") < 25) & (F.col("expressive_cross_pct") < 25)
    return agg.withColumn("verdict", F.when(good, "defensible").otherwise("weak"))


def report(summaries: list, cut, table: list, judged) -> str:
    """A Markdown report from the small collected results above."""
    two = lambda x: "n/a" if x is None else f"{x:.2f}"
    lines = ["# Calibration of semitone spread", "", "| Bucket | n | mean | median | P25 | P75 |", "|---|---|---|---|---|---|"]
    lines += [f"| {r['bucket']} | {r['n']} | {two(r['mean'])} | {two(r['median'])} | {two(r['p25'])} | {two(r['p75'])} |" for r in summaries]
    lines += ["", f"Cut-offs: flat below {two(cut['low_cut'])}, expressive above {two(cut['high_cut'])}.", "", "| Bucket | n | Hz flat / moderate / expressive | ST flat / moderate / expressive |", "|---|---|---|---|"]
    lines += [f"| {r['bucket']} | {r['n']} | {r['hz_flat']} / {r['hz_moderate']} / {r['hz_expressive']} | {r['st_flat']} / {r['st_moderate']} / {r['st_expressive']} |" for r in table]
    lines += ["", f"In target: {judged['flat_pct']:.0f} % flat, {judged['expressive_pct']:.0f} % expressive. Cross-tail: {judged['flat_cross_pct']:.0f} % and {judged['expressive_cross_pct']:.0f} %. The cut-offs are {judged['verdict']}."]
    return "\n".join(lines) + "\n"


RESULT_FIELDS = "filename string, actor string, gender string, emotion string, intensity string, bucket string, duration_s string, voiced_fraction string, f0_std_hz string, f0_std_semitones string, f0_range_hz_max_min string, f0_range_semitones_p10_p90 string, phonemes_total_tokens string, notes string"
_NUMBERS = ("duration_s", "voiced_fraction", "f0_std_hz", "f0_std_semitones", "f0_range_hz_max_min", "f0_range_semitones_p10_p90")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Results of earlier runs from CSV with a header; numbers that can't be read are null, and no rows at all are an error."""
    rows = spark.read.csv(path, schema=RESULT_FIELDS, header=True)
    if rows.isEmpty():
        raise ValueError(f"no rows in {path}")
    return rows.withColumns({c: number_or_null(F.col(c)) for c in _NUMBERS} | {"phonemes_total_tokens": number_or_null(F.col("phonemes_total_tokens")).cast("long")})


def append_results(rows: DataFrame, path: str) -> None:
    """Adds rows to the CSV files of ``path``, in the order of RESULT_FIELDS; columns that ``rows`` lacks stay empty."""
    names = [f.split()[0] for f in RESULT_FIELDS.split(", ")]
    rows.select(*[(F.col(n) if n in rows.columns else F.lit(None)).cast("string").alias(n) for n in names]).write.mode("append").csv(path, header=True)
