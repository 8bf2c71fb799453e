"""Confusion smoothing: counts under IPA keys, evidence of near misses, and its wording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipgrain.functions.text import for_two_places, held, lookup
from clipgrain.sources import reference_data as R


def ipa_counts(counts: DataFrame) -> DataFrame:
    """``clip_id, symbol, n`` under canonical IPA; symbols outside the alphabet keep their own name."""
    names = {n.symbol: n.ipa for n in R.alphabet() if n.symbol != n.ipa}
    return counts.select("clip_id", F.coalesce(lookup(names, F.col("symbol")), F.col("symbol")).alias("symbol"), F.col("n").cast("long").alias("n")).groupBy("clip_id", "symbol").agg(F.sum("n").alias("n"))


def _confusions(counts: DataFrame) -> DataFrame:
    return F.broadcast(counts.sparkSession.createDataFrame(R.confusion_rows(), "target string, ord int, from_symbol string, weight double"))


def contributions(counts: DataFrame) -> DataFrame:
    """``clip_id, target, ord, from_symbol, raw_count, weight, contribution`` of every near miss that occurs; from raw IPA counts, one hop."""
    near = _confusions(counts)
    rows = counts.withColumnRenamed("symbol", "from_symbol").join(near, "from_symbol").where("n > 0")
    return rows.select("clip_id", "target", "ord", "from_symbol", F.col("n").alias("raw_count"), "weight", (F.col("weight") * F.col("n")).alias("contribution"))


def smoothed_counts(counts: DataFrame) -> DataFrame:
    """``clip_id, symbol, smoothed``: raw counts of everything, plus what near misses give the targets."""
    raw = counts.select("clip_id", "symbol", F.col("n").cast("double").alias("x"))
    added = contributions(counts).select("clip_id", F.col("target").alias("symbol"), F.col("contribution").alias("x"))
    return raw.unionByName(added).groupBy("clip_id", "symbol").agg(F.sum("x").alias("smoothed"))


def _near_misses() -> Column:
    """target -> its near misses with their weights, as one literal map."""
    by_target: dict[str, list[Column]] = {}
    for target, _, heard, weight in R.confusion_rows():
        by_target.setdefault(target, []).append(F.struct(F.lit(heard).alias("from_symbol"), F.lit(weight).alias("weight")))
    return F.create_map(*[x for target, near in by_target.items() for x in (F.lit(target), F.array(*near))])


def ipa_map(counts: Column) -> Column:
    """A clip's map of counts under canonical IPA; symbols that share one are added up."""
    names = {n.symbol: n.ipa for n in R.alphabet() if n.symbol != n.ipa}
    pairs = F.transform(F.map_entries(counts), lambda e: F.struct(F.coalesce(lookup(names, e["key"]), e["key"]).alias("symbol"), e["value"].alias("n")))
    total = lambda found, s: F.aggregate(F.filter(found, lambda p: p["symbol"] == s), F.lit(0).cast("long"), lambda acc, p: acc + p["n"])
    return held(pairs, lambda found: F.map_from_entries(F.transform(F.array_distinct(F.transform(found, lambda p: p["symbol"])), lambda s: F.struct(s, total(found, s)))))


def evidence_of(counts: Column) -> Column:
    """``array<target, raw_count, smoothed_count, evidence_from>`` of a map of IPA counts: the targets with any signal, without a row for each."""
    count = lambda s: F.coalesce(F.try_element_at(counts, s), F.lit(0).cast("long"))
    fired = lambda near: F.transform(F.filter(near, lambda e: count(e["from_symbol"]) > 0), lambda e: F.struct(e["from_symbol"].alias("from_symbol"), count(e["from_symbol"]).alias("raw_count"), e["weight"].alias("weight"), (e["weight"] * count(e["from_symbol"])).alias("contribution")))

    def judged(t: Column) -> Column:
        return held(fired(t["value"]), lambda found: F.struct(t["key"].alias("target"), count(t["key"]).alias("raw_count"), (count(t["key"]) + F.aggregate(found, F.lit(0.0), lambda acc, e: acc + e["contribution"])).alias("smoothed_count"), found.alias("evidence_from")))

    return F.filter(F.transform(F.map_entries(_near_misses()), judged), lambda e: (e["raw_count"] > 0) | (F.size(e["evidence_from"]) > 0))


def smoothed_map(counts: Column, evidence: Column) -> Column:
    """Raw IPA counts of everything, and the smoothed ones of targets with evidence."""
    own = F.transform_values(counts, lambda k, n: n.cast("double"))
    return F.map_concat(F.map_filter(own, lambda k, n: ~F.exists(evidence, lambda e: e["target"] == k)), F.map_from_entries(F.transform(evidence, lambda e: F.struct(e["target"], e["smoothed_count"]))))


def evidence(counts: DataFrame) -> DataFrame:
    """``clip_id, target, raw_count, smoothed_count, evidence_from, interpretation`` of targets with any signal."""
    direct = counts.where(F.col("symbol").isin(*{c.target for c in R.CONFUSIONS})).select("clip_id", F.col("symbol").alias("target"), F.col("n").alias("direct"), F.lit(None).cast("struct<ord:int,from_symbol:string,raw_count:bigint,weight:double,contribution:double>").alias("e"))
    indirect = contributions(counts).select("clip_id", "target", F.lit(0).cast("long").alias("direct"), F.struct("ord", "from_symbol", "raw_count", "weight", "contribution").alias("e"))
    rows = direct.where("direct > 0").unionByName(indirect).groupBy("clip_id", "target").agg(F.sum("direct").alias("raw_count"), F.array_sort(F.collect_list("e")).alias("evidence_from"))
    rows = rows.withColumn("smoothed_count", F.col("raw_count") + F.aggregate("evidence_from", F.lit(0.0), lambda acc, e: acc + e["contribution"]))
    sources = F.array_join(F.transform("evidence_from", lambda e: e["from_symbol"]), ", ")
    shown = for_two_places(F.col("smoothed_count"))
    text = (
        F.when(F.size("evidence_from") == 0, F.format_string("Direct detection: %d. No additional smoothed evidence.", "raw_count"))
        .when(F.col("raw_count") == 0, F.format_string("Direct detection: 0. Smoothed evidence: %.2f (from %s). Speaker may produce /%s/ that the model misclassifies.", shown, sources, "target"))
        .otherwise(F.format_string("Direct detection: %d. Smoothed evidence: %.2f (direct + contributions from %s).", "raw_count", shown, sources))
    )
    return rows.select("clip_id", "target", "raw_count", "smoothed_count", "evidence_from", text.alias("interpretation"))
