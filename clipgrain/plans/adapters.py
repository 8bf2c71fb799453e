"""The given tables as clip-level tables.

These mappings only serve to run the operators on the tables at hand; they say
nothing about speech.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clipgrain.operators import alignment, inventory
from clipgrain.operators.decode import log_softmax
from clipgrain.operators.prosody import f0_stats
from clipgrain.sources import reference_data as R

#: Spellings that stand for a symbol, by language, applied in turn to lower-cased text.
REWRITES: dict[str, list[tuple[str, str]]] = {
    "en": [("th", "θ"), ("sh", "ʃ"), ("ed", "ð"), ("r", "ɹ"), ("e", "ə")],
    "es": [("ñ", "ɲ"), ("r", "ɾ"), ("j", "x"), ("b", "β"), ("v", "β")],
    "fr": [("r", "ʁ"), ("u", "y"), ("é", "ø"), ("on", "õ")],
    "de": [("ch", "ç"), ("r", "ʁ"), ("ü", "y"), ("ö", "ø"), ("k", "x")],
}
BUCKET_OF_EVENT = {"click": "neutral", "view": "calm-normal", "purchase": "happy-strong", "signup": "angry-strong"}
STOP_OF_EVENT = {"signup": "pʰ", "purchase": "b", "click": "t"}
WINDOW_US = 6 * 3600 * 1_000_000
FRAMES_PER_CLIP, LOGITS, SCALE, FRAME_S = 50, 64, 12.0, 0.02
#: Symbols of the alphabet in order behind the blank; the last ids have none.
VOCAB = ["<pad>", *(n.symbol for n in R.alphabet())][: LOGITS - 4]
CLAIMS = ["English", " EN ", "en_GB", "Mandarin Chinese", "Chinese Mandarin", "Mandarin (Beijing)", "Brazilian Portuguese", "Portuguese (Brazil)", "Hindi (India)", "es-MX", "castilian", "klingon", "", "french", "Standard Arabic", "zh_CN", "(unknown)", "de-AT german", "  ", "korean_"]
PURPOSES = ["diagnostic", "stretch", "counting", "free_speech", "other", "", "garbage"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``clip_id, claimed_language, symbol``: one row per character of a document, white space left out."""
    docs = table(spark, sf_dir, "documents")
    text = F.regexp_replace(F.lower("text"), "[ \\t\\n\\x0B\\f\\r]+", "")
    rewritten = text
    for lang, rules in REWRITES.items():
        own = text
        for a, b in rules:
            own = F.replace(own, F.lit(a), F.lit(b))
        rewritten = F.when(F.col("lang") == lang, own).otherwise(rewritten)
    return docs.select(F.col("doc_id").alias("clip_id"), F.col("lang").alias("claimed_language"), F.explode(F.split(rewritten, "")).alias("symbol"))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.symbol_counts(tokens(spark, sf_dir), ("clip_id", "claimed_language"))


def inventories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.inventories(counts(spark, sf_dir), ("clip_id", "claimed_language"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value").withColumn("idx", F.row_number().over(order) - 1)


def pitch_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select(F.col("user_id").alias("clip_id"), "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("time_us"), F.when(F.col("event_type") == "error", F.lit(0.0)).otherwise(F.col("value")).alias("f0_hz"))


def intensity_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select(F.col("user_id").alias("clip_id"), "idx", F.col("value").alias("db"))


#: Seconds from one event of a user to the next, as frames of a clip.
CLIP_STEP_S = 0.25


def clip_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``clip_id, idx, time_us, f0_hz, db``: events in turn as frames at times of the clip's own."""
    rows = _events(spark, sf_dir)
    return rows.select(F.col("user_id").alias("clip_id"), "idx", (F.col("idx") * int(CLIP_STEP_S * 1e6)).cast("long").alias("time_us"), F.when(F.col("event_type") == "error", F.lit(0.0)).otherwise(F.col("value")).alias("f0_hz"), F.col("value").alias("db"))


def token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select(F.col("user_id").alias("clip_id"), F.col("idx").alias("frame_idx"), "event_type")


def formant_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tracks, each undefined where the event is of another kind."""
    of = lambda *kinds: F.when(F.col("event_type").isin(*kinds), F.col("value"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("clip_id"), of("click").alias("f1"), of("view", "click").alias("f2"), of("purchase").alias("f3"))


#: A stop begins so long before its release.
STOP_LEAD_US = 45 * 60 * 1_000_000


def stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = pitch_frames(spark, sf_dir)
    phoneme = F.create_map(*[F.lit(x) for p in STOP_OF_EVENT.items() for x in p])
    rows = frames.where(F.col("event_type").isin(*STOP_OF_EVENT))
    return rows.select("clip_id", F.col("event_id").alias("stop_id"), F.try_element_at(phoneme, F.col("event_type")).alias("phoneme"), (F.col("time_us") - STOP_LEAD_US).alias("start_us"), F.col("time_us").alias("release_us"))


def voicing_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that are no stops."""
    return pitch_frames(spark, sf_dir).where(~F.col("event_type").isin(*STOP_OF_EVENT))


def clip_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One clip per user and kind of event, in the bucket of that kind."""
    buckets = F.create_map(*[F.lit(x) for p in BUCKET_OF_EVENT.items() for x in p])
    stats = f0_stats(pitch_frames(spark, sf_dir), ("clip_id", "event_type"))
    rows = stats.withColumn("bucket", F.try_element_at(buckets, F.col("event_type"))).where("bucket is not null")
    return rows.withColumn("gender", F.when(F.col("clip_id") % 2 != 0, "male").otherwise("female"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``clip_id, frame_idx, log_probs, duration_s``: each component of an embedding as the score of a symbol."""
    rows = table(spark, sf_dir, "embeddings").where("embedding is not null")
    logits = F.transform("embedding", lambda x: x.cast("double") * SCALE)
    rows = rows.select(F.floor(F.col("vec_id") / FRAMES_PER_CLIP).alias("clip_id"), (F.col("vec_id") % FRAMES_PER_CLIP).cast("int").alias("frame_idx"), log_softmax(logits).alias("log_probs"))
    return rows.withColumn("duration_s", F.lit(FRAMES_PER_CLIP * FRAME_S))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of five frames, each with a target that follows from the vectors' labels."""
    rows = table(spark, sf_dir, "embeddings").where("vec_id % 5 = 0")
    clip, frame = F.floor(F.col("vec_id") / FRAMES_PER_CLIP), (F.col("vec_id") % FRAMES_PER_CLIP).cast("int")
    return rows.select(clip.alias("clip_id"), (frame / 5).cast("int").alias("span"), (F.col("label") % (LOGITS - 1) + 1).cast("int").alias("target"), frame.alias("start_frame"), (frame + 5).alias("end_frame"))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(spark, sf_dir).select("clip_id", F.col("span").alias("position"), F.col("target").alias("vocab_idx"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("clip_id"), (F.col("l_discount") * 10).alias("x"), (F.col("l_quantity") > 10).alias("voiced"))


#: Frames of a few samples, as the given clips have few.
AUDIO_FRAME, AUDIO_HOP = 16, 4


def audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``clip_id, i, x``: the events of a user in turn as samples, some kinds much quieter than others."""
    quiet = F.when(F.col("event_type").isin("view", "error"), F.lit(0.001)).otherwise(1.0)
    return _events(spark, sf_dir).select(F.col("user_id").alias("clip_id"), F.col("idx").cast("long").alias("i"), (F.col("value") / 1000.0 * quiet).alias("x"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conv_id, turn, request``: every turn as a request in JSON, each of a dozen kinds, most of them faulty."""
    rows = table(spark, sf_dir, "conversations")
    k = (F.col("conv_id") * 8 + F.col("turn")) % 12
    script = F.to_json(F.struct(F.lit("ipa").alias("format"), F.coalesce("text", F.lit("")).alias("content")))
    whole = F.concat(F.lit('{"audio_base64": "UklGRg==", "format": "wav", "clip_purpose": "counting", "transcript": '), script, F.lit("}"))
    cases = {
        1: F.lit('{"audio_base64": ""}'),
        2: F.expr("substring({0}, 1, length({0}) div 2)".format("_whole")),
        3: F.lit('{"format": "wav"}'),
        4: F.lit('{"audio_base64": "AA==", "clip_purpose": "ad-hoc-monologue"}'),
        5: F.lit('{"audio_base64": "AA==", "transcript": {"format": 5}}'),
        6: F.lit('{"audio_base64": "AA==", "transcript": "plain words"}'),
        7: F.lit('{"audio_base64": null, "format": null}'),
        8: F.lit("[1, 2]"),
        9: F.lit(None).cast("string"),
        10: F.lit('{"audio_base64": "AA==", "claimed_language": "English", "clip_purpose": null, "transcript": null, "other": [1]}'),
        11: F.lit('{"audio_base64": "AA==", "expected_language": 7, "clip_purpose": true}'),
    }
    request = F.col("_whole")
    for at, text in cases.items():
        request = F.when(k == at, text).otherwise(request)
    return rows.withColumn("_whole", whole).select("conv_id", "turn", request.alias("request"))


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of a conversation as a transcript of its own, in formats of which one is unknown."""
    rows = table(spark, sf_dir, "conversations").where("text is not null")
    place = F.col("conv_id") + F.col("turn")
    kind = F.when(place % 11 == 5, "x-sampa").when(F.col("conv_id") % 3 == 0, "espeak").when(F.col("turn") % 2 == 1, " IPA ").otherwise("ipa")
    content = F.when((F.col("conv_id") * 8 + F.col("turn")) % 17 == 13, " ").otherwise(F.lower("text"))
    return rows.select(F.struct("conv_id", "turn").alias("clip_id"), kind.alias("format"), content.alias("content"))


#: What symbols are followed by where they are described.
SYMBOL_ENDS = ["", "ː", "ʰ", "1", "ɜ", "\u0303" + "51", "ɪ", "\u0325" + "ʲ" + "\u030a", "t", ":"]


def vocab() -> dict[str, int]:
    return {n.symbol: i for i, n in enumerate(R.alphabet())}


def grid_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``clip_id, time_us, f1, f2, f3``: events in turn as points of a track, each kind defining some of the values."""
    of = lambda *kinds: F.when(F.col("event_type").isin(*kinds), F.col("value"))
    return _events(spark, sf_dir).select(F.col("user_id").alias("clip_id"), (F.col("idx") * int(CLIP_STEP_S * 1e6)).cast("long").alias("time_us"), of("click").alias("f1"), of("view", "click").alias("f2"), of("purchase", "error", "signup").alias("f3"))


#: Microseconds between the grid's times, and between two points that a value is drawn through at most.
GRID_STEP_US, GRID_GAP_US = 100_000, 1_000_000


def written_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as samples that were written as text, some of them unreadable."""
    x = F.when(F.col("event_id") % 499 == 5, "n/a").when(F.col("event_id") % 701 == 7, "NaN").otherwise(F.col("value").cast("string"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("clip_id"), x.alias("x"), (F.col("event_type") != "error").alias("voiced"))


def odd_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stops that begin before their release, but for a few that end before they begin."""
    lead = F.when(F.col("stop_id") % 397 == 3, -STOP_LEAD_US).otherwise(STOP_LEAD_US)
    return stops(spark, sf_dir).withColumn("start_us", F.col("release_us") - lead)


def odd_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as decoded tokens, some without a symbol."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("clip_id"), F.when(F.col("event_id") % 557 != 2, F.col("event_type")).alias("symbol"))


def response_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``clip_id, idx, f0_hz, db, f1, f2, f3, source_clip``: events in turn as frames that carry every track."""
    of = lambda *kinds: F.when(F.col("event_type").isin(*kinds), F.col("value"))
    source = F.when(F.col("user_id") % 2 == 0, "diagnostic").otherwise("unspecified")
    f0 = F.when(F.col("event_type") == "error", F.lit(0.0)).otherwise(F.col("value"))
    return _events(spark, sf_dir).select(F.col("user_id").alias("clip_id"), "idx", f0.alias("f0_hz"), F.col("value").alias("db"), of("click").alias("f1"), of("view", "click").alias("f2"), of("purchase").alias("f3"), source.alias("source_clip"))


def span_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``clip_id, span, target, mean``: spans of five frames with their targets, from one read of the vectors."""
    rows = table(spark, sf_dir, "embeddings")
    logits = F.transform("embedding", lambda x: x.cast("double") * SCALE)
    frame = F.col("vec_id") % FRAMES_PER_CLIP
    rows = rows.select(F.floor(F.col("vec_id") / FRAMES_PER_CLIP).alias("clip_id"), F.floor(frame / 5).cast("int").alias("span"), frame.cast("int").alias("frame_idx"), F.when(F.col("vec_id") % 5 == 0, F.col("label") % (LOGITS - 1) + 1).cast("int").alias("target"), log_softmax(logits).alias("log_probs"))
    return alignment.gathered_spans(rows, ["clip_id", "span"], F.max("target").alias("target")).where("target is not null")


def expected_language(clip: str = "clip_id") -> Column:
    """The language that a clip was asked to be in: one of a few spellings, of which one is unknown."""
    return F.element_at(F.array(*map(F.lit, ["arabic", " ZH ", "msa", "klingon"])), (F.col(clip) % 4 + 1).cast("int"))
