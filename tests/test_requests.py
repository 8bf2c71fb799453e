"""Requests, blocks that fail, voiced intervals, grids and literal blocks on small cases."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipgrain.operators import alignment, guard, notation, prosody, quality, requests

CASES = {
    '{"audio_base64": "AA=="}': [],
    '{"audio_base64": "AA==", "clip_purpose": "ad-hoc-monologue"}': ["clip_purpose: literal_error"],
    "{}": ["audio_base64: missing"],
    '{"audio_base64": null}': ["audio_base64: string_type"],
    '{"audio_base64": "x", "transcript": {}}': ["transcript.format: missing", "transcript.content: missing"],
    '{"audio_base64": "x", "transcript": {"format": "ipa", "content": ["a"], "expected_language": 3}}': ["transcript.content: string_type", "transcript.expected_language: string_type"],
    '{"audio_base64": "x", "transcript": []}': ["transcript: model_type"],
    '{"audio_base64": 1, "format": {}, "expected_language": true, "claimed_language": 2.5, "clip_purpose": 1}': ["audio_base64: string_type", "format: string_type", "expected_language: string_type", "claimed_language: string_type", "clip_purpose: literal_error"],
    '{"audio_base64": "x"': ["request: json_invalid"],
    "": ["request: json_invalid"],
    '"words"': ["request: model_type"],
    "[]": ["request: model_type"],
}


def test_every_request_is_accepted_or_rejected_with_all_reasons(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*CASES, None])], "id long, request string")
    rows = requests.validated(df)
    got = {r["request"]: r["reasons"] for r in rows.collect()}
    assert got == CASES | {None: ["request: json_invalid"]}
    good, bad = requests.accepted(rows), requests.rejected(rows)
    assert sorted([r["id"] for r in good.collect()] + [r["id"] for r in bad.collect()]) == list(range(len(CASES) + 1))
    assert good.first()["format"] == "webm" and "request" in bad.columns
    whole = {"audio_base64": "é", "format": "wav", "clip_purpose": "other", "transcript": {"format": "ipa", "content": "θ\n\"x\""}}
    row = requests.accepted(requests.validated(spark.createDataFrame([(json.dumps(whole),)], "request string"))).first()
    assert row["transcript"]["content"] == "θ\n\"x\"" and row["clip_purpose"] == "other" and row["audio_base64"] == "é"


def test_one_failing_block_leaves_the_others(spark):
    clips = spark.createDataFrame([(1, ["short"]), (2, []), (3, [])], "clip_id long, notes array<string>")
    rows = spark.createDataFrame([(1, 1.0), (1, None), (2, 4.0), (2, 6.0)], "clip_id long, x double")
    error = guard.faulty((F.col("x").isNull(), "ValueError"), (F.col("x") > 100, "OverflowError"))
    total = lambda df: df.groupBy("clip_id").agg(F.sum("x").alias("sum"), F.max(F.raise_error(F.when(F.col("x").isNull(), F.lit("seen")))).alias("never")) if False else df.groupBy("clip_id").agg(F.sum("x").alias("sum"))
    whole = lambda df: df.groupBy("clip_id").agg(F.count(F.lit(1)).alias("n"))
    out = guard.assembled(clips, {"quality": guard.isolated(rows, error, total), "vot": guard.isolated(rows, guard.faulty((F.col("x") < 0, "ValueError")), whole)})
    got = {r["clip_id"]: r for r in out.collect()}
    assert got[1]["quality"] is None and got[1]["vot"]["n"] == 2 and got[1]["notes"] == ["short", "quality measurement unavailable: ValueError"]
    assert got[2]["quality"]["sum"] == 10.0 and got[2]["notes"] == [] and got[3]["quality"] is None and got[3]["vot"] is None


def mask_of(x, frame, hop, top_db=30.0):
    padded = np.concatenate([np.zeros(frame // 2), x, np.zeros(frame // 2)])
    power = np.array([max((padded[t * hop : t * hop + frame] ** 2).sum() / frame, 1e-10) for t in range(1 + len(x) // hop)])
    loud = 10 * np.log10(power) - 10 * np.log10(power.max()) > -top_db
    mask = np.zeros(len(x), bool)
    for t in np.flatnonzero(loud):
        mask[t * hop : (t + 1) * hop] = True
    return mask


def test_voiced_intervals(spark):
    r = np.random.default_rng(3)
    clips = {i: r.normal(size=n) * np.repeat(r.choice([1.0, 0.001, 0.0], n // 8 + 1), 8)[:n] for i, n in enumerate([1, 3, 4, 8, 64, 101, 400])}
    clips[9] = np.zeros(20)
    df = spark.createDataFrame([(c, i, float(v)) for c, x in clips.items() for i, v in enumerate(x)], "clip_id long, i long, x double").repartition(3)
    got = {}
    for row in quality.covered(df, quality.voiced_intervals(df, 16, 4)).collect():
        got.setdefault(row["clip_id"], {})[row["i"]] = row["voiced"]
    assert all([got[c][i] for i in range(len(x))] == mask_of(x, 16, 4).tolist() for c, x in clips.items())
    marks = spark.createDataFrame([(4, 5, 9), (4, 7, 12), (4, 20, 20)], "clip_id long, start long, end long")
    inside = sorted(r["i"] for r in quality.covered(df, marks).where("voiced").collect())
    assert inside == list(range(5, 12))
    levels = {r["clip_id"]: r for r in quality.audio_levels(df, 16, 4).collect()}
    assert levels[9]["snr_note"].startswith("No silent") and levels[6]["n"] == 400


def test_grid(spark):
    track = spark.createDataFrame([(1, 0, 10.0, None), (1, 30_000, 40.0, 1.0), (1, 200_000, 50.0, float("nan")), (1, 235_000, 60.0, 3.0), (2, 5_000, 7.0, None)], "clip_id long, time_us long, f1 double, f2 double")
    clips = spark.createDataFrame([(1, 250_000), (2, 20_000), (3, 10_000), (4, 0)], "clip_id long, duration_us long")
    got = {(r["clip_id"], r["t_idx"]): (r["f1"], r["f2"]) for r in prosody.on_grid(track, clips, ("f1", "f2")).collect()}
    assert len(got) == 25 + 2 + 1 and got[1, 0] == (10.0, None) and got[1, 1] == (20.0, None) and got[1, 3] == (40.0, 1.0)
    assert got[1, 10] == (None, None) and got[1, 22][0] == pytest.approx(50 + 10 * 20 / 35) and got[1, 24] == (None, None)
    assert got[2, 0] == got[2, 1] == (None, None)


def test_alignment_warnings(spark):
    vocab = {"θ": 0, "s": 1, "S": 2}
    texts = [(1, "ipa", "θ q s"), (2, "X-SAMPA", "abc"), (3, " IPA ", ""), (4, "ipa", "s s s s"), (5, None, "s"), (6, "espeak", "S ʃ"), (7, "orthography_with_dictionary", "words")]
    df = spark.createDataFrame(texts, "clip_id long, format string, content string")
    frames = spark.createDataFrame([(i, 3) for i in range(1, 8)], "clip_id long, n_frames int")
    got = {r["clip_id"]: (r["n_tokens"], r["warnings"]) for r in alignment.warnings(df, alignment.transcript_tokens(df, vocab), frames).collect()}
    none = "Transcript produced no alignable tokens; alignment skipped."
    assert got[1] == (2, ["Phoneme /q/ at position 1 has no model vocabulary mapping; alignment skipped for this position."])
    assert got[2] == (0, ["Unknown transcript format 'X-SAMPA'; expected one of ipa, espeak, orthography_with_dictionary. Alignment skipped.", none])
    assert got[3] == (0, [none]) and got[4] == (4, ["Transcript (4 phonemes) is longer than the audio (3 frames); alignment skipped."])
    assert got[5][1][0].startswith("Unknown transcript format ''") and got[6] == (2, []) and got[7] == (0, [none])


def test_blocks_are_found_whatever_the_split(spark, tmp_path):
    r = random.Random(1)
    lines = ["// before", 'aa: ["/x/"],', "const L1_PHONEMES: Record = {"]
    for i in range(60):
        lines += [f'  lang_{chr(97 + i % 26)}: ["/{i}/", "{i}b"],  // note', "" if r.random() < 0.3 else "  // só "]
    lines += ["const L1_PHONEMES again", '  lang_a: ["/last/"],', "};", 'lang_b: ["/after/"],', "};"]
    path = tmp_path / "lists.ts"
    path.write_text("\n".join(lines), encoding="utf-8")
    want = {f"lang_{chr(97 + i % 26)}": [f"/{i}/", f"{i}b"] for i in range(60)} | {"lang_a": ["/last/"]}
    for split in (7, 64, 1000, 1 << 20):
        got = {}
        for row in notation.read_phoneme_lists(spark, str(path), split_bytes=split).orderBy("language", "ord").collect():
            got.setdefault(row["language"], []).append(row["token"])
        assert got == want, split


def test_descriptions(spark):
    want = {
        ("tʃ", "tʃ"): "Affricate",
        ("aɪ", "aɪ"): "Diphthong/triphthong (a + ɪ)",
        ("pʰ", "pʰ"): "Voiceless bilabial stop (aspirated)",
        ("i1", "i1"): "Close front unrounded vowel (tone 1 (high level))",
        ("ɜ", "ɜ"): "Uncategorised symbol ('ɜ') (tone 3 (eSpeak ɜ marker))",
        ("1", "1"): "Bare Mandarin tone-1 marker (tone 1 (high level))",
        ("??", "ʔx"): "Glottal stop + x",
        ("kw", "kwʷʰː"): "Voiceless velar stop + w (labialised, aspirated, long)",
        ("%", "%"): "Uncategorised symbol ('%')",
        ("n", "n̥̊52"): "Voiced alveolar nasal" and "Alveolar nasal (voiceless) (tone 5 (neutral), tone 2 (rising))",
    }
    df = spark.createDataFrame([(*k,) for k in want], "s string, ipa string")
    got = {(r["s"], r["ipa"]): r["d"] for r in df.select("s", "ipa", notation.described(F.col("s"), F.col("ipa")).alias("d")).collect()}
    assert got == want and math.isfinite(len(got))
