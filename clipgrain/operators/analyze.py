"""The nested response of a clip, from the blocks that were asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipgrain.functions.text import finite, lookup, two_places
from clipgrain.operators import alignment, inventory, prosody, quality, smoothing
from clipgrain.sources import reference_data as R


def response(clips: DataFrame, **blocks: DataFrame) -> DataFrame:
    """Left-joins each block (one row per clip_id) as a struct named by its keyword; absent blocks are null."""
    out = clips
    for name, block in blocks.items():
        fields = [c for c in block.columns if c != "clip_id"]
        out = out.join(block.select("clip_id", F.struct(*fields).alias(name)), "clip_id", "left")
    return out


def inventory_blocks(inventories: DataFrame) -> DataFrame:
    """``clip_id``, the blocks ``phonemes``, ``stretch`` and ``language_match``, and ``said`` (notes), all over the one map of a clip's counts.

    ``inventories``: ``clip_id, counts, total_tokens, claimed_language, expected_language``.
    """
    rows = inventory.language_match(inventories).withColumn("ipa", smoothing.ipa_map(F.col("counts"))).withColumn("evidence", smoothing.evidence_of(F.col("ipa")))
    rows = rows.withColumn("probe_set", inventory.probe_set(F.col("expected_language")))
    phonemes = F.struct("counts", "total_tokens", smoothing.smoothed_map(F.col("ipa"), F.col("evidence")).alias("smoothed_counts"), F.col("evidence").alias("confusion_evidence"))
    stretch = F.when(F.col("probe_set").isNotNull(), F.struct("probe_set", inventory.stretch_probes(F.col("counts"), F.col("probe_set")).alias("probes")))
    match = F.when(F.col("verdict").isNotNull(), F.struct("profile", "verdict", "score", "positive_hits", "positive_total", "negative_clean", "negative_total", "notes"))
    asked = (F.col("expected_language") != "") & F.col("probe_set").isNull()
    said = F.array_compact(F.array(F.when(asked, F.concat(F.lit("no stretch probe set for language='"), "expected_language", F.lit("'")))))
    return rows.select("clip_id", phonemes.alias("phonemes"), stretch.alias("stretch"), match.alias("language_match"), said.alias("said"))


def frame_blocks(frames: DataFrame, step: float) -> DataFrame:
    """``clip_id`` and the blocks ``f0, formants, syllables, baseline``, all from one pass over a clip's frames.

    ``frames``: ``clip_id, idx, f0_hz, db, f1, f2, f3, source_clip`` with a frame every ``step`` seconds.
    """
    first = F.col("idx") < int(round(R.BASELINE_S / step))
    formants = [F.avg(finite(F.col(c))).alias(f"{c}_mean_hz") for c in ("f1", "f2", "f3")]
    f0 = [*prosody.f0_aggregates(F.col("f0_hz")), *prosody.f0_aggregates(F.when(first, F.col("f0_hz")), "b_")]
    rows = frames.groupBy("clip_id").agg(*f0, *formants, prosody.levels_in_order().alias("levels"), F.count(F.lit(1)).alias("n"), F.max("source_clip").alias("source_clip"))
    head = F.slice("levels", 1, int(round(R.BASELINE_S / step)))
    rows = rows.withColumns({"syllables": prosody.syllables(F.col("levels"), F.col("n") * step), "_head": prosody.syllables(head, F.size(head) * step)})
    baseline = F.struct(*quality.baseline_block(F.col("source_clip"), prosody.f0_fields("b_"), F.col("_head.rate_hz")))
    voiced = (F.col("voiced") / F.col("n")).alias("voiced_fraction")
    return rows.select("clip_id", F.struct(*prosody.f0_fields(), voiced).alias("f0"), F.struct(*[f"{c}_mean_hz" for c in ("f1", "f2", "f3")]).alias("formants"), "syllables", F.when(F.col("n") * step >= R.BASELINE_S, baseline).alias("baseline"))


def whole(clips: DataFrame, inventories: DataFrame, frames: DataFrame, step: float, vot: DataFrame, levels: DataFrame, positions: DataFrame) -> DataFrame:
    """A clip's full response: every block that its tables give, and its notes.

    ``clips``: ``clip_id, duration_s``; ``vot`` and ``levels``: one row a clip; ``positions``: classified spans.
    Blocks that share a table come from one pass over it, so this joins five tables of one row a clip.
    """
    nested = lambda df, name: df.select("clip_id", F.struct(*[c for c in df.columns if c != "clip_id"]).alias(name))
    out = clips
    for block in (inventory_blocks(inventories), frame_blocks(frames, step), nested(vot, "vot"), nested(levels, "quality"), nested(alignment.aligned_block(positions), "aligned_phonemes")):
        out = out.join(block, "clip_id", "left")
    short = F.when(F.col("duration_s") < 0.3, "clip is very short (<0.3s); results may be unreliable")
    quiet = F.when(F.col("f0.voiced_fraction") < 0.05, "very little voiced audio detected; pitch may be unreliable")
    said = F.concat(F.array_compact(F.array(short, quiet)), F.coalesce("said", F.array().cast("array<string>")))
    return out.withColumn("notes", said).drop("said")


def flat(responses: DataFrame) -> DataFrame:
    """The fields of all blocks side by side, each under its block's name."""
    nested = [f.name for f in responses.schema.fields if f.dataType.typeName() == "struct"]
    own = [c for c in responses.columns if c not in nested]
    return responses.select(*own, *[F.col(f"{b}.{f.name}").alias(f"{b}_{f.name}") for b in nested for f in responses.schema[b].dataType.fields])


def as_json(responses: DataFrame) -> DataFrame:
    return responses.select("clip_id", F.to_json(F.struct(*[c for c in responses.columns if c != "clip_id"])).alias("response"))


def printed(blocks: DataFrame) -> DataFrame:
    """``clip_id, text``: what ``inventory_blocks`` found, in lines for a reader."""
    match, stretch = F.col("language_match"), F.col("stretch")
    mark = lambda marks, value: F.coalesce(lookup(marks, value), F.lit("[?]"))
    verdict = F.format_string("  language_match  %s  verdict=%s  score=%s", mark(R.VERDICT_MARKS, match["verdict"]), match["verdict"], two_places(match["score"]))
    found = F.format_string("                  positives: %d/%d markers found", match["positive_hits"], match["positive_total"])
    clean = F.format_string("                  negatives: %d/%d clean", match["negative_clean"], match["negative_total"])
    lines = F.concat(F.array(verdict, found, clean), F.transform(match["notes"], lambda n: F.concat(F.lit("                  - "), n)))
    probe = lambda p: F.format_string("      %s  /%s/  %s: count=%d, expected=%d, approximate_seen=%d", mark(R.STATUS_MARKS, p["status"]), p["ipa"], p["label"], p["count"], p["expected_count"], p["approximate_count"])
    probes = F.concat(F.array(F.format_string("  stretch_phonemes (%s):", stretch["probe_set"])), F.transform(stretch["probes"], probe))
    none = F.array().cast("array<string>")
    notes = F.transform("said", lambda n: F.concat(F.lit("  note: "), n))
    head = F.format_string("  phoneme_tokens=%d", F.col("phonemes.total_tokens"))
    return blocks.select("clip_id", F.array_join(F.concat(F.array(head), F.coalesce(lines, none), F.coalesce(probes, none), notes), "\n").alias("text"))
