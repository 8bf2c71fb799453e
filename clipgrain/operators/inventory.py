"""Phoneme inventories of clips: counts, and what is scored on them.

An inventory is one row per clip: ``clip_id, counts MAP<STRING, BIGINT>,
total_tokens``. Every score is an expression over the map and a small literal, so
all of them share the one shuffle that built the inventory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipgrain.functions.text import lookup, resolved_profile, strip, symbols
from clipgrain.sources import reference_data as R


def symbol_counts(tokens: DataFrame, keys: tuple[str, ...] = ("clip_id",)) -> DataFrame:
    """``keys, symbol, n`` from one row per token; what is no phoneme is dropped."""
    return tokens.where(~F.col("symbol").isin(*R.NON_PHONEMES)).groupBy(*keys, "symbol").agg(F.count(F.lit(1)).alias("n"))


def inventories(counts: DataFrame, keys: tuple[str, ...] = ("clip_id",)) -> DataFrame:
    """One row per clip from its symbol counts; a clip has few symbols, so its map is small."""
    return counts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("symbol", "n"))).alias("counts"), F.sum("n").alias("total_tokens"))


def count_of(counts: Column, variants: Column) -> Column:
    """Occurrences of any of several symbols."""
    return F.aggregate(variants, F.lit(0).cast("long"), lambda acc, v: acc + F.coalesce(F.try_element_at(counts, v), F.lit(0).cast("long")))


def status(count: Column, present_from: int = 2) -> Column:
    return F.when(count >= present_from, "present").when(count == 1, "approximate").otherwise("absent")


def _profiles() -> Column:
    """language -> its markers, as one literal map."""
    by_language: dict[str, list[Column]] = {}
    for language, side, i, label, threshold, optional, variants in R.marker_rows():
        by_language.setdefault(language, []).append(F.struct(F.lit(side).alias("side"), F.lit(i).alias("ord"), F.lit(label).alias("label"), F.lit(threshold).alias("threshold"), F.lit(optional).alias("optional"), symbols(variants).alias("variants")))
    return F.create_map(*[x for language, markers in by_language.items() for x in (F.lit(language), F.array(*markers))])


def marker_results(inventory: DataFrame, profile: str = "profile") -> DataFrame:
    """Adds ``markers``: for each marker of the row's profile its count and whether it passed."""
    markers = F.try_element_at(_profiles(), F.col(profile))

    def judged(m: Column) -> Column:
        n = count_of(F.col("counts"), m["variants"])
        return F.struct(m["side"].alias("side"), m["ord"].alias("ord"), m["label"].alias("label"), m["optional"].alias("optional"), n.alias("count"), F.when(m["side"] == "positive", n >= m["threshold"]).otherwise(n <= m["threshold"]).alias("passed"))

    return inventory.withColumn("markers", F.transform(markers, judged))


def language_match(inventory: DataFrame, claim: str = "claimed_language") -> DataFrame:
    """Score each clip's inventory against the language it claims.

    Adds ``profile, verdict, score, positive_hits, positive_total, negative_clean,
    negative_total, notes``; all null where nothing is claimed. An optional marker
    that is missed leaves the denominator. With too few tokens the totals include
    optional markers and nothing is scored.
    """
    asked = F.col(claim).isNotNull() & (F.col(claim) != "")
    rows = inventory.withColumn("profile", resolved_profile(F.col(claim), R.profile_index()))
    rows = marker_results(rows)
    side = lambda s: F.filter("markers", lambda m: m["side"] == s)
    positive, negative = side("positive"), side("negative")
    hits = F.size(F.filter(positive, lambda m: m["passed"]))
    base = F.size(F.filter(positive, lambda m: m["passed"] | ~m["optional"]))
    clean, total = F.size(F.filter(negative, lambda m: m["passed"])), F.size(negative)
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(1.0))
    score = F.lit(R.POSITIVE_WEIGHT) * share(hits, base) + F.lit(R.NEGATIVE_WEIGHT) * share(clean, total)
    scored = F.col("profile").isNotNull() & (F.col("total_tokens") >= R.MIN_TOKENS)
    rows = rows.withColumn("score", F.when(asked & scored, score))
    verdict = F.when(F.col("profile").isNull(), "unknown_language").when(~scored, "insufficient_signal").when(F.col("score") >= R.MATCHES_AT, "matches").when(F.col("score") < R.MISMATCH_BELOW, "mismatch").otherwise("uncertain")
    labels = lambda found: F.array_join(F.slice(F.transform(found, lambda m: m["label"]), 1, 5), ", ")
    missed, violated = F.filter(positive, lambda m: ~m["passed"] & ~m["optional"]), F.filter(negative, lambda m: ~m["passed"])
    notes = (
        F.when(F.col("profile").isNull(), F.array(F.concat(F.lit("no language profile configured for '"), F.col(claim), F.lit("'"))))
        .when(~scored, F.array(F.format_string(f"clip has %d phoneme tokens; need ≥{R.MIN_TOKENS} to score", F.col("total_tokens"))))
        .otherwise(F.array_compact(F.array(F.when(F.size(missed) > 0, F.concat(F.lit("expected but missing: "), labels(missed))), F.when(F.size(violated) > 0, F.concat(F.lit("present but unexpected: "), labels(violated))))))
    )
    count = lambda when_scored, otherwise: F.when(asked, F.when(scored, when_scored).when(F.col("profile").isNotNull(), otherwise).otherwise(F.lit(0)))
    return rows.select(
        *inventory.columns,
        F.when(asked, F.coalesce("profile", F.lower(strip(F.col(claim))))).alias("profile"),
        F.when(asked, verdict).alias("verdict"),
        "score",
        count(hits, F.lit(0)).alias("positive_hits"),
        count(base, F.size(positive)).alias("positive_total"),
        count(clean, F.lit(0)).alias("negative_clean"),
        count(total, total).alias("negative_total"),
        F.when(asked, notes).alias("notes"),
    )


def all_profiles(inventory: DataFrame) -> DataFrame:
    """Each clip against every profile: one row per clip and language."""
    names = F.array(*[F.lit(language) for language, _ in R.ALIASES])
    return language_match(inventory.withColumn("claimed_language", F.explode(names)))


def _probe_sets() -> Column:
    """language -> its probes, as one literal map."""
    asked: dict[str, list] = {}
    for i, p in R.by_language(R.PROBES):
        probe = F.struct(F.lit(i).alias("ord"), F.lit(p.label).alias("label"), F.lit(p.ipa).alias("ipa"), F.lit(p.expected).alias("expected_count"), symbols(list(p.accepted)).alias("accept"), symbols(list(p.approximate)).alias("approximate"))
        asked.setdefault(p.language, []).append(probe)
    return F.create_map(*[x for language, probes in asked.items() for x in (F.lit(language), F.array(*probes))])


def probe_set(expected: Column) -> Column:
    """The probe set that a language hint names, or null."""
    return F.when(expected != "", lookup(R.PROBE_ALIASES, F.lower(strip(expected))))


def stretch_probes(counts: Column, key: Column) -> Column:
    """``array<ord, label, ipa, expected_count, count, approximate_count, status>`` of a probe set over a clip's counts; null without a set."""

    def judged(p: Column) -> Column:
        n, near = count_of(counts, p["accept"]), count_of(counts, p["approximate"])
        state = F.when(n >= p["expected_count"], "hit").when((n >= 1) | (near >= 1), "approximate").otherwise("missed")
        return F.struct(*[p[c].alias(c) for c in ("ord", "label", "ipa", "expected_count")], n.alias("count"), near.alias("approximate_count"), state.alias("status"))

    return F.transform(F.try_element_at(_probe_sets(), key), judged)


def stretch_scores(inventory: DataFrame, expected: str = "expected_language") -> DataFrame:
    """One row per clip and probe of its expected language; none where there is no probe set."""
    rows = inventory.withColumn("probe_set", probe_set(F.col(expected)))
    return rows.select("clip_id", "probe_set", F.inline(stretch_probes(F.col("counts"), F.col("probe_set"))))
