"""One query per operator over the given tables. Doubles are rounded to six places."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipgrain.functions.text import number_or_null, resolved_profile, two_places
from clipgrain.operators import alignment, analyze, calibration, decode, guard, inventory, notation, prosody, quality, requests, smoothing, vot
from clipgrain.plans import adapters as A
from clipgrain.plans import sql
from clipgrain.sources import reference_data as R
from clipgrain.streaming.clips import batch_runs, window_counts


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _match(spark: SparkSession, d: str) -> DataFrame:
    return inventory.language_match(A.inventories(spark, d))


_SCORE = ("profile", "verdict", "score", "positive_hits", "positive_total", "negative_clean", "negative_total")


def _notes(spark: SparkSession, d: str) -> DataFrame:
    return _match(spark, d).select("clip_id", F.array_join("notes", " | ").alias("notes"))


def _claims(spark: SparkSession, d: str) -> DataFrame:
    claims = F.array(*map(F.lit, A.CLAIMS))
    rows = A.table(spark, d, "customer").select("c_custkey", F.element_at(claims, (F.col("c_custkey") % len(A.CLAIMS) + 1).cast("int")).alias("claim"))
    return rows.withColumn("profile", resolved_profile(F.col("claim"), R.profile_index()))


def _stretch(spark: SparkSession, d: str) -> DataFrame:
    return inventory.stretch_scores(A.inventories(spark, d).withColumn("expected_language", A.expected_language())).drop("ipa")


def _ipa(spark: SparkSession, d: str) -> DataFrame:
    return smoothing.ipa_counts(A.counts(spark, d))


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    return smoothing.contributions(_ipa(spark, d))


def _interpretation(spark: SparkSession, d: str) -> DataFrame:
    return smoothing.evidence(_ipa(spark, d)).select("clip_id", "target", "raw_count", "smoothed_count", F.size("evidence_from").alias("n_sources"), "interpretation")


def _status(spark: SparkSession, d: str) -> DataFrame:
    """The status of a few symbols that a clip may or may not have."""
    rows = A.inventories(spark, d).select("clip_id", "counts", F.explode(F.array(*map(F.lit, ["θ", "ʃ", "x", "z", "q", "ɾ"]))).alias("symbol"))
    return rows.select("clip_id", "symbol", inventory.status(inventory.count_of(F.col("counts"), F.array("symbol"))).alias("status"))


def _vot(spark: SparkSession, d: str) -> DataFrame:
    return vot.measurements(A.stops(spark, d), A.voicing_frames(spark, d), A.WINDOW_US, A.WINDOW_US, A.WINDOW_US / 1000)


def _spans(spark: SparkSession, d: str) -> DataFrame:
    return alignment.classify_spans(alignment.span_means(A.frames(spark, d), A.spans(spark, d)))


def _top3(spark: SparkSession, d: str) -> DataFrame:
    rows = A.frames(spark, d).select("clip_id", "frame_idx", F.posexplode(decode.top_k(F.col("log_probs"))).alias("place", "t"))
    return rows.select("clip_id", "frame_idx", "place", F.col("t.idx").alias("idx"), F.exp("t.score").alias("prob"))


def _snr(spark: SparkSession, d: str) -> DataFrame:
    return quality.sample_levels(A.samples(spark, d)).select("clip_id", "signal_rms", "noise_rms", "snr_db", "snr_note")


def _clipping(spark: SparkSession, d: str) -> DataFrame:
    return quality.sample_levels(A.samples(spark, d)).select("clip_id", "peak", "clipping_pct")


def _source_clip(spark: SparkSession, d: str) -> DataFrame:
    purposes = F.array(*map(F.lit, A.PURPOSES), F.lit(None).cast("string"))
    rows = A.table(spark, d, "customer").select("c_custkey", F.element_at(purposes, (F.col("c_custkey") % (len(A.PURPOSES) + 1) + 1).cast("int")).alias("purpose"))
    return rows.select("c_custkey", quality.source_clip(F.col("purpose")).alias("source_clip"))


def _sample(spark: SparkSession, d: str) -> DataFrame:
    rows = calibration.stratified_sample(A.clip_features(spark, d).select("clip_id", "bucket"), 60, 20260503)
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.max("draw").alias("last_draw"))


def _classes(spark: SparkSession, d: str) -> DataFrame:
    return calibration.reclassified(A.clip_features(spark, d))


def _file_fields(spark: SparkSession, d: str) -> DataFrame:
    """Clip file names made of order fields, and what can be read back from them."""
    two = lambda c: F.lpad((c + 1).cast("string"), 2, "0")
    o = A.table(spark, d, "orders").select("o_orderkey")
    k = F.col("o_orderkey")
    name = F.concat_ws("-", F.lit("03"), two(k % 2), two(k % 8), two(k % 2), F.lit("01"), F.lit("02"), two(k % 24))
    rows = o.withColumn("f", calibration.file_fields(F.when(k % 10 == 0, "readme").otherwise(name)))
    bucket = F.when(F.col("f.channel") == "01", calibration.bucket_of(F.col("f.emotion"), F.col("f.intensity")))
    return rows.select("o_orderkey", F.col("f.emotion").alias("emotion"), F.col("f.actor").alias("actor"), bucket.alias("bucket"), calibration.spoken_as(F.col("f.emotion"), F.col("f.intensity")).alias("spoken_as"), F.when(F.col("f").isNotNull(), calibration.gender_of(F.col("f.actor"))).alias("gender"))


def _numbers(spark: SparkSession, d: str) -> DataFrame:
    """Tolerant parsing and printing of decimals that were written as text."""
    value = F.when(F.col("event_id") % 7 == 0, "").when(F.col("event_id") % 11 == 0, "n/a").otherwise(F.col("value").cast("string"))
    rows = A.table(spark, d, "events").select("event_id", number_or_null(value).alias("x"))
    return rows.select("event_id", F.round("x", 6).alias("x"), two_places(F.round("x", 1)).alias("shown"))


def _drift(spark: SparkSession, d: str) -> DataFrame:
    """The notation audit of each language's own symbols, as its documents use them."""
    rows = A.counts(spark, d).select(F.col("claimed_language").alias("language"), F.concat(F.lit("/"), F.col("symbol"), F.lit("/")).alias("token")).distinct()
    return notation.drift(rows)


def _quality_notes(spark: SparkSession, d: str) -> DataFrame:
    rows = quality.sample_levels(A.samples(spark, d)).withColumn("duration_s", F.col("n") * 0.1)
    return rows.select("clip_id", F.array_join(quality.notes(F.col("duration_s"), F.col("voiced_fraction") - 0.5, F.col("clipping_pct")), " | ").alias("notes"))


def _response(spark: SparkSession, d: str) -> DataFrame:
    """The full response of each document as a clip, with tracks from events, samples from line items and scores from vectors."""
    clips = A.table(spark, d, "documents").select(F.col("doc_id").alias("clip_id"), (F.col("n_chars") / 15.0).alias("duration_s"))
    inventories = A.inventories(spark, d).withColumn("expected_language", A.expected_language())
    levels = quality.sample_levels(A.samples(spark, d)).select("clip_id", "signal_rms", "noise_rms", "snr_db", "snr_note", "peak", "clipping_pct")
    return analyze.whole(clips, inventories, A.response_frames(spark, d), A.CLIP_STEP_S, vot.class_means(_vot(spark, d)), levels, alignment.classify_spans(A.span_rows(spark, d)))


def _response_flat(spark: SparkSession, d: str) -> DataFrame:
    """The fields of all blocks side by side; of maps and arrays their sizes, sums and joined texts."""
    of = lambda block, *names: [F.col(f"{block}.{n}").alias(f"{block}_{n}") for n in names]
    state = lambda s: F.size(F.filter("stretch.probes", lambda p: p["status"] == s)).alias(f"stretch_{s}")
    sized = lambda c, name: F.when(F.col(c).isNotNull(), F.size(c)).alias(name)
    return _response(spark, d).select(
        "clip_id", "duration_s", *of("language_match", *_SCORE), F.array_join("language_match.notes", " | ").alias("language_match_notes"),
        *of("stretch", "probe_set"), *[F.when(F.col("stretch").isNotNull(), state(s)).alias(f"stretch_{s}") for s in ("hit", "approximate", "missed")],
        *of("phonemes", "total_tokens"), sized("phonemes.counts", "phonemes_symbols"), F.aggregate(F.map_values("phonemes.smoothed_counts"), F.lit(0.0), lambda acc, x: acc + x).alias("phonemes_smoothed"), sized("phonemes.confusion_evidence", "phonemes_targets"),
        *of("f0", "mean_hz", "min_hz", "max_hz", "std_hz", "std_semitones", "range_semitones_p10_p90", "voiced_fraction"), *of("formants", "f1_mean_hz", "f2_mean_hz", "f3_mean_hz"), *of("syllables", "peaks", "accepted", "rate_hz"),
        *of("vot", "n_measured", "aspirated_voiceless_mean_ms", "plain_voiceless_mean_ms", "voiced_mean_ms"), *of("quality", "signal_rms", "noise_rms", "snr_db", "snr_note", "peak", "clipping_pct"),
        *of("baseline", "source_clip", "window_start_ms", "window_end_ms", "f0_mean_hz", "f0_std_semitones", "syllable_rate_hz", "notes"),
        *of("aligned_phonemes", "alignment_quality", "mean_log_prob"), sized("aligned_phonemes.positions", "aligned_positions"), F.when(F.col("aligned_phonemes").isNotNull(), F.size(F.filter("aligned_phonemes.positions", lambda p: p["match"] == "produced"))).alias("aligned_produced"),
        F.when(F.col("aligned_phonemes").isNotNull(), F.size(F.filter("aligned_phonemes.summary", lambda t: t["evidence_strength"] == "strong"))).alias("aligned_strong"), F.array_join("notes", " | ").alias("notes"),
    )


def _baseline(spark: SparkSession, d: str) -> DataFrame:
    """The events of a user in turn as frames of a quarter of a second."""
    frames = A.clip_frames(spark, d)
    clips = frames.groupBy("clip_id").agg((F.count(F.lit(1)) * A.CLIP_STEP_S).alias("duration_s"))
    clips = clips.withColumn("source_clip", quality.source_clip(F.when(F.col("clip_id") % 2 == 0, "diagnostic").otherwise("other")))
    return quality.baseline(clips, frames, frames, A.CLIP_STEP_S)


def _transcripts(spark: SparkSession, d: str) -> DataFrame:
    tokens = alignment.transcript_tokens(A.transcripts(spark, d), A.vocab())
    return tokens.select("clip_id.*", "position", "symbol", "phoneme", "vocab_idx")


def _warnings(spark: SparkSession, d: str) -> DataFrame:
    """What keeps transcripts from being aligned, with forty frames a turn so far."""
    rows = A.transcripts(spark, d)
    frames = rows.select("clip_id", (F.col("clip_id.turn") * 40).alias("n_frames"))
    found = alignment.warnings(rows, alignment.transcript_tokens(rows, A.vocab()), frames)
    return found.select("clip_id.*", "n_tokens", F.array_join("warnings", " | ").alias("warnings"))


def _requests(spark: SparkSession, d: str) -> DataFrame:
    rows = requests.validated(A.requests(spark, d))
    own = [F.col(f"parsed.{c}").alias(c) for c in ("format", "clip_purpose", "claimed_language")]
    return rows.select("conv_id", "turn", "accepted", F.array_join("reasons", " | ").alias("reasons"), *own, F.length("parsed.transcript.content").alias("content_chars"))


def _block_errors(spark: SparkSession, d: str) -> DataFrame:
    """Responses of which some blocks fail on bad rows; each leaves the others alone and gives a note."""
    clips = A.table(spark, d, "events").select(F.col("user_id").alias("clip_id")).distinct()
    samples = A.written_samples(spark, d).withColumns({"written": F.col("x"), "x": number_or_null(F.col("x"))})
    unreadable = guard.faulty((F.col("x").isNull(), "ValueError"), (F.isnan("x"), "FloatingPointError"))
    levels = lambda rows: quality.sample_levels(rows).select("clip_id", "snr_db", "clipping_pct")
    means = lambda rows: vot.class_means(vot.measurements(rows, A.voicing_frames(spark, d), A.WINDOW_US, A.WINDOW_US, A.WINDOW_US / 1000))
    blocks = {
        "quality": guard.isolated(samples, unreadable, levels),
        "phonemes": guard.isolated(A.odd_tokens(spark, d), guard.faulty((F.col("symbol").isNull(), "KeyError")), lambda rows: rows.groupBy("clip_id").agg(F.count(F.lit(1)).alias("total_tokens"))),
        "vot": guard.isolated(A.odd_stops(spark, d), guard.faulty((F.col("release_us") < F.col("start_us"), "ValueError")), means),
    }
    rows = guard.assembled(clips, blocks)
    return rows.select("clip_id", "quality.snr_db", "quality.clipping_pct", "phonemes.total_tokens", "vot.n_measured", "vot.voiced_mean_ms", F.array_join("notes", " | ").alias("notes"))


def _grid(spark: SparkSession, d: str) -> DataFrame:
    track = A.grid_track(spark, d)
    clips = track.groupBy("clip_id").agg((F.max("time_us") + int(A.CLIP_STEP_S * 1e6)).alias("duration_us"))
    return prosody.on_grid(track, clips, step_us=A.GRID_STEP_US, max_gap_us=A.GRID_GAP_US)


def _sql_smoothed(spark: SparkSession, d: str) -> DataFrame:
    """``smoothed_counts`` by the SQL table function."""
    sql.register(spark)
    clips = _ipa(spark, d).groupBy("clip_id").agg(F.map_from_entries(F.collect_list(F.struct("symbol", "n"))).alias("counts"))
    return spark.sql("SELECT c.clip_id, s.symbol, s.smoothed FROM {clips} c, LATERAL smooth_counts(c.counts) s", clips=clips)


def _sql_match(spark: SparkSession, d: str) -> DataFrame:
    """``language_match_claimed`` by the SQL table function."""
    sql.register(spark)
    return spark.sql("SELECT * FROM score_language_match(TABLE(SELECT clip_id, claimed_language, symbol, n FROM {counts}) PARTITION BY clip_id)", counts=A.counts(spark, d))


def _descriptions(spark: SparkSession, d: str) -> DataFrame:
    """The symbols that the documents use, bare and with marks, tones and other glyphs behind them, in words."""
    rows = A.counts(spark, d).select("symbol").distinct().select(F.explode(F.transform(F.array(*map(F.lit, A.SYMBOL_ENDS)), lambda e: F.concat("symbol", e))).alias("symbol")).distinct()
    rows = rows.withColumn("ipa", notation.to_ipa(F.col("symbol")))
    return rows.select("symbol", "ipa", notation.described(F.col("symbol"), F.col("ipa")).alias("description"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    q: dict[str, Callable[[SparkSession, str], DataFrame]] = {
        "symbol_counts": lambda s, d: A.counts(s, d).select("clip_id", "symbol", "n"),
        "language_match_claimed": lambda s, d: _match(s, d).select("clip_id", *_SCORE),
        "language_match_all_profiles": lambda s, d: inventory.all_profiles(A.inventories(s, d)).select("clip_id", *_SCORE),
        "language_match_notes": _notes,
        "resolve_profile": _claims,
        "stretch_scores": _stretch,
        "ipa_normalised_counts": _ipa,
        "smoothed_counts": lambda s, d: smoothing.smoothed_counts(_ipa(s, d)),
        "confusion_evidence": _evidence,
        "confusion_interpretation": _interpretation,
        "inventory_status": _status,
        "f0_stats": lambda s, d: prosody.f0_stats(A.pitch_frames(s, d)),
        "f0_semitone_spread": lambda s, d: prosody.f0_stats(A.pitch_frames(s, d), ("clip_id", "event_type")).select("clip_id", "event_type", "std_semitones", "range_semitones_p10_p90"),
        "formant_means": lambda s, d: prosody.formant_means(A.formant_frames(s, d)),
        "syllable_peaks": lambda s, d: prosody.syllable_peaks(A.intensity_frames(s, d)),
        "syllable_rate": lambda s, d: prosody.syllable_rate(A.intensity_frames(s, d)),
        "vot_forward": lambda s, d: _vot(s, d).select("clip_id", "stop_id", ((F.col("forward_us") - F.col("release_us")) / 1000.0).alias("forward_ms")),
        "vot_backward": lambda s, d: _vot(s, d).select("clip_id", "stop_id", ((F.col("backward_us") - F.col("release_us")) / 1000.0).alias("backward_ms")),
        "vot_measurements": lambda s, d: _vot(s, d).where("vot_ms is not null").select("clip_id", "stop_id", "phoneme", "aspiration_class", "vot_ms"),
        "vot_class_means": lambda s, d: vot.class_means(_vot(s, d)),
        "frame_argmax": lambda s, d: A.frames(s, d).select("clip_id", "frame_idx", decode.argmax(F.col("log_probs")).alias("token")),
        "frame_log_softmax": lambda s, d: A.frames(s, d).select("clip_id", "frame_idx", F.posexplode("log_probs").alias("v", "log_prob")),
        "frame_top3": _top3,
        "ctc_occurrences": lambda s, d: decode.occurrences(A.frames(s, d), A.VOCAB),
        "event_type_runs": lambda s, d: decode.runs(A.token_frames(s, d), "event_type"),
        "span_classification": lambda s, d: _spans(s, d).select("clip_id", "span", "target", "avg_log_prob", "top1", "match"),
        "phoneme_summary": lambda s, d: alignment.phoneme_summary(_spans(s, d)),
        "alignment_quality": lambda s, d: alignment.alignment_quality(_spans(s, d)),
        "forced_alignment": lambda s, d: alignment.align(A.frames(s, d), A.targets(s, d)).drop("top3"),
        "transcript_tokens": _transcripts,
        "clipping_pct": _clipping,
        "snr_rms": _snr,
        "source_clip": _source_clip,
        "stratified_sample_counts": _sample,
        "bucket_summary": lambda s, d: calibration.summary(A.clip_features(s, d), "std_semitones", ("bucket",)),
        "gender_summary": lambda s, d: calibration.summary(A.clip_features(s, d).withColumn("leaning", calibration.leaning(F.col("bucket"))), "std_semitones", ("leaning", "gender")),
        "st_cutoffs": lambda s, d: calibration.cutoffs(A.clip_features(s, d)),
        "reclassified": lambda s, d: _classes(s, d).select("clip_id", "bucket", "hz_class", "st_class", "changed"),
        "class_crosstab": lambda s, d: calibration.crosstab(_classes(s, d)),
        "calibration_verdict": lambda s, d: calibration.verdict(_classes(s, d)),
        "clip_file_fields": _file_fields,
        "tolerant_numbers": _numbers,
        "drift_summary": lambda s, d: notation.by_category(_drift(s, d)),
        "drift_detail": lambda s, d: _drift(s, d).select("language", "token", "category", F.array_join("matches", ", ").alias("matches")),
        "drift_gaps": lambda s, d: notation.languages_of(_drift(s, d), "phonological"),
        "quality_notes": _quality_notes,
        "match_summary": lambda s, d: analyze.printed(analyze.inventory_blocks(A.inventories(s, d).withColumn("expected_language", A.expected_language()))),
        "analyze_response": _response_flat,
        "analyze_response_json": lambda s, d: analyze.as_json(_response(s, d)),
        "baseline_window": _baseline,
        "f0_range": lambda s, d: prosody.f0_range(A.pitch_frames(s, d)),
        "symbols_per_clip": lambda s, d: notation.symbols_of(A.tokens(s, d)).select("clip_id", F.array_join("symbols", " ").alias("symbols"), "n_symbols"),
        "sql_smooth_counts": _sql_smoothed,
        "sql_language_match": _sql_match,
        "symbol_descriptions": _descriptions,
        "clip_runs": lambda s, d: batch_runs(A.table(s, d, "events")),
        "voiced_intervals": lambda s, d: quality.voiced_intervals(A.audio(s, d), A.AUDIO_FRAME, A.AUDIO_HOP),
        "snr_voiced": lambda s, d: quality.audio_levels(A.audio(s, d), A.AUDIO_FRAME, A.AUDIO_HOP).select("clip_id", "signal_rms", "noise_rms", "snr_db", "snr_note", "voiced_fraction"),
        "request_validation": _requests,
        "formant_grid": _grid,
        "formant_grid_means": lambda s, d: prosody.formant_means(_grid(s, d)),
        "response_block_errors": _block_errors,
        "alignment_warnings": _warnings,
        "event_windows": lambda s, d: window_counts(A.table(s, d, "events")).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss")),
    }
    return {name: (lambda s, d, f=f: rounded(f(s, d))) for name, f in q.items()}
