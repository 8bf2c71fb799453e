import base64
import io
import math
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipgrain.functions import kernels as K
from clipgrain.functions.tokens import ipa_symbols, nfc
from clipgrain.operators import alignment, calibration, decode, prosody, quality, vot
from clipgrain.sources import audio

VOCAB = ["<pad>", "θ", "s", "f", "ð", "d", "a", "b", "T", "S"]


def planned(spark, plan, boost=8.0, seconds=0.02, clip=1):
    """Frames whose scores favour a planned symbol, as log-softmax of zeros with a boost."""
    rows = []
    for i, symbol in enumerate(plan):
        logits = np.zeros(len(VOCAB))
        if symbol:
            logits[VOCAB.index(symbol)] = boost
        rows.append((clip, i, (logits - math.log(np.exp(logits).sum())).tolist(), len(plan) * seconds))
    return spark.createDataFrame(rows, "clip_id long, frame_idx int, log_probs array<double>, duration_s double")


def aligned(spark, plan, transcript, **k):
    texts = spark.createDataFrame([(1, "ipa", transcript)], "clip_id long, format string, content string")
    tokens = alignment.transcript_tokens(texts, {v: i for i, v in enumerate(VOCAB)})
    return alignment.align(planned(spark, plan, **k), tokens).orderBy("span")


def test_alignment_golden(spark):
    rows = aligned(spark, ["θ", "θ", "<pad>", "s", "s", "<pad>", "f", "f"], "θ s f").collect()
    assert [r["match"] for r in rows] == ["produced"] * 3
    assert [(r["start_ms"], r["end_ms"]) for r in rows] == [(0, 40), (60, 100), (120, 160)]
    assert all(r["avg_log_prob"] == pytest.approx(-0.003015, abs=1e-6) for r in rows)
    assert {r["evidence_strength"] for r in alignment.phoneme_summary(aligned(spark, ["θ", "<pad>", "θ", "<pad>", "θ"], "θ θ θ")).collect()} == {"strong"}


def test_alignment_without_evidence(spark):
    flat = aligned(spark, [None] * 10, "θ s f")
    assert [r["match"] for r in flat.collect()] == ["absent"] * 3
    assert alignment.alignment_quality(flat).first()["alignment_quality"] == "medium"
    assert aligned(spark, ["θ"], "θ s f a b").collect() == []
    assert aligned(spark, ["θ", "<pad>", "s"], "").collect() == []
    assert len(aligned(spark, ["θ", "<pad>", "s"], "θ q s").collect()) == 2


def test_forced_alignment_against_all_paths():
    import itertools

    rng = np.random.default_rng(3)
    for _ in range(30):
        scores = rng.normal(size=(5, 3))
        targets = rng.integers(1, 3, rng.integers(1, 4)).tolist()
        best = -math.inf
        for path in itertools.product(range(3), repeat=5):
            collapsed = [a for a, b in zip(path, (None, *path), strict=False) if a != b and a != 0]
            if collapsed == targets:
                best = max(best, sum(scores[t, a] for t, a in enumerate(path)))
        got = K.forced_alignment(scores, targets)
        assert (got is None) == (best == -math.inf)
        if got is not None:
            assert sum(scores[t, a] for t, a in enumerate(got)) == pytest.approx(best)


def test_greedy_decoding(spark):
    got = decode.occurrences(planned(spark, ["θ", "θ", "<pad>", "θ", "s", "s"]), VOCAB).orderBy("seq").collect()
    assert [(r["phoneme"], round(r["start_s"], 3), round(r["end_s"], 3)) for r in got] == [("θ", 0.0, 0.04), ("θ", 0.06, 0.08), ("s", 0.08, 0.12)]


def symbols_one_by_one(text):
    import unicodedata

    held, joining, stops = set("ːˑʰʷʲˤˠ\u032a\u0325\u0329\u0361"), set("ʃʒɕʑɲŋɭʈɖʂʐ"), set("tdʈɖ")
    text = unicodedata.normalize("NFC", text).translate({ord("/"): " ", ord("."): " ", ord("ˈ"): None, ord("ˌ"): None})
    found, fresh = [], True
    for ch in text:
        if ch.isspace():
            fresh = True
            continue
        if not fresh and (ch in held or unicodedata.category(ch)[0] == "M" or (ch in joining and found[-1] in stops)):
            found[-1] += ch
        else:
            found.append(ch)
        fresh = False
    return found


def test_ipa_symbols(spark):
    import random

    known = {"t͡ʃ": ["t͡", "ʃ"], "aɪ": ["a", "ɪ"], "ts": ["t", "s"], "tʃʰ aː": ["tʃʰ", "aː"], "/ˈθɪŋ/": ["θ", "ɪ", "ŋ"], "tŋ": ["tŋ"], "": []}
    r = random.Random(4)
    texts = [*known, *("".join(r.choice("tdʈɖʃʒŋsaɪ ː\u0361\u0303\u0329ʰ/.ˈ\n\u00a0e\u0301é") for _ in range(r.randint(1, 14))) for _ in range(300))]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r["t"]: r["s"] for r in df.select("t", ipa_symbols(nfc(F.col("t"))).alias("s")).collect()}
    assert all(got[t] == symbols_one_by_one(t) for t in texts) and all(got[t] == s for t, s in known.items())


def test_log_softmax_is_linear(spark):
    """The sum over a frame's scores is made once a frame: eight times the entries may not take eight times eight as long."""
    import time

    def seconds(v):
        df = spark.range(64).select(F.transform(F.sequence(F.lit(1), F.lit(v)), lambda x: F.sin(x.cast("double") + F.col("id"))).alias("z")).select(decode.log_softmax(F.col("z")).alias("p"))
        took = []
        for _ in range(3):
            began = time.perf_counter()
            rows = df.collect()
            took.append(time.perf_counter() - began)
        assert all(sum(math.exp(x) for x in r["p"]) == pytest.approx(1) for r in rows)
        return min(took)

    seconds(8)
    assert seconds(2048) < 16 * max(seconds(256), 0.05)
    nothing = spark.createDataFrame([(None,), ([],)], "z array<double>")
    assert [r["p"] for r in nothing.select(decode.log_softmax(F.col("z")).alias("p")).collect()] == [None, []]


def test_pitch_statistics(spark):
    frames = spark.createDataFrame([(1, f) for f in (0.0, 100.0, 200.0, 200.0, 400.0, 100.0)] + [(2, 0.0), (2, 100.0), (3, float("nan"))], "clip_id long, f0_hz double")
    got = {r["clip_id"]: r for r in prosody.f0_stats(frames).collect()}
    st = 12 * np.log2(np.array([100, 200, 200, 400, 100]) / 100)
    assert got[1]["std_semitones"] == pytest.approx(st.std()) and got[1]["range_semitones_p10_p90"] == pytest.approx(np.percentile(st, 90) - np.percentile(st, 10))
    assert got[1]["voiced_fraction"] == pytest.approx(5 / 6)
    assert got[2]["mean_hz"] is None and got[2]["voiced_fraction"] == 0.5 and got[3]["voiced_fraction"] == 0.0


def test_syllable_rate_is_greedy(spark):
    def reference(v):
        t = np.mean(v) - 5
        peaks = [i for i in range(1, len(v) - 1) if v[i] > t and v[i] > v[i - 1] and v[i] > v[i + 1]]
        kept = peaks[:1]
        for p in peaks[1:]:
            if v[kept[-1]] - min(v[kept[-1] : p]) >= 2:
                kept.append(p)
        return len(peaks), len(kept)

    rng = np.random.default_rng(1)
    clips = {i: rng.normal(60, s, n).tolist() for i, (s, n) in enumerate([(1, 40), (3, 60), (6, 25), (1, 5), (0, 12)])}
    df = spark.createDataFrame([(c, i, float(x)) for c, v in clips.items() for i, x in enumerate(v)], "clip_id long, idx int, db double")
    got = {r["clip_id"]: r for r in prosody.syllable_rate(df).collect()}
    for c, v in clips.items():
        assert (got[c]["peaks"], got[c]["accepted"]) == reference(v)
    assert got[3]["rate_hz"] is None and got[4]["rate_hz"] == 0.0


def test_voice_onset(spark):
    stops = spark.createDataFrame([(1, 1, "pʰ", 50_000, 100_000), (1, 2, "b", 400_000, 420_000), (1, 3, "k", 600_000, 700_000), (1, 4, "m", 0, 1), (1, 5, "d", 5_000_000, 5_100_000)], "clip_id long, stop_id long, phoneme string, start_us long, release_us long")
    frames = spark.createDataFrame([(1, 180_000, 120.0), (1, 300_000, 110.0), (1, 390_000, 115.0), (1, 410_000, 0.0), (1, 960_000, 100.0), (1, 5_350_000, 90.0)], "clip_id long, time_us long, f0_hz double")
    got = {r["stop_id"]: r["vot_ms"] for r in vot.measurements(stops, frames).collect()}
    assert got == {1: 80.0, 2: -30.0, 3: None, 5: 250.0}


def test_clip_quality(spark):
    df = spark.createDataFrame([(1, 0.5, True), (1, 0.05, False), (2, 1.0, True), (2, 1.0, True), (3, 2.0, True), (3, 1.0, False)], "clip_id long, x double, voiced boolean")
    got = {r["clip_id"]: r for r in quality.sample_levels(df).collect()}
    assert got[1]["snr_db"] == pytest.approx(20.0) and got[1]["clipping_pct"] == 0.0
    assert got[2]["clipping_pct"] == 100.0 and got[2]["snr_note"].startswith("No silent regions")
    assert got[3]["peak"] == 2.0 and got[3]["clipping_pct"] == 50.0


def test_calibration_report(spark):
    rows = [(i, b, g, s, h) for i, (b, g, s, h) in enumerate([("neutral", "male", 2.0, 10.0), ("calm-normal", "female", 3.0, 30.0), ("happy-strong", "male", 4.0, 60.0), ("angry-strong", "female", 5.0, 40.0), ("neutral", "male", None, None)])]
    clips = spark.createDataFrame(rows, "clip_id long, bucket string, gender string, std_semitones double, std_hz double")
    cut = calibration.cutoffs(clips).first()
    assert (cut["low_cut"], cut["high_cut"]) == (2.5, 4.5)
    classes = calibration.reclassified(clips)
    assert [r["st_class"] for r in classes.orderBy("clip_id").collect()] == ["flat", "moderate", "moderate", "expressive", "n/a"]
    judged = calibration.verdict(classes).first()
    text = calibration.report(calibration.summary(clips, "std_semitones", ("bucket",)).orderBy("bucket").collect(), cut, calibration.crosstab(classes).orderBy("bucket").collect(), judged)
    assert "flat below 2.50, expressive above 4.50" in text and judged["flat_pct"] == pytest.approx(100 / 3)


def tone(hz, seconds=1.0, rate=16_000):
    return (0.5 * np.sin(2 * np.pi * hz * np.arange(int(seconds * rate)) / rate)).astype(np.float32)


def wav(x, rate=16_000):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((x * 32767).astype("<i2").tobytes())
    return out.getvalue()


@pytest.mark.parametrize(("hz", "within"), [(200, 5), (320, 10), (120, 5)])
def test_pitch_kernel(hz, within):
    _, f0 = K.pitch(tone(hz), 16_000)
    assert abs(np.median(f0[f0 > 0]) - hz) < within and (f0 > 0).mean() > 0.8
    assert (K.pitch(np.zeros(16_000, np.float32), 16_000)[1] > 0).mean() < 0.05


def test_audio_source(spark):
    payload = base64.b64encode(wav(tone(200))).decode()
    df = spark.createDataFrame([("good", payload), ("bad", base64.b64encode(b"not audio").decode()), ("empty", "")], "clip_id string, audio_base64 string")
    measured = audio.measure(audio.decode_payloads(df)).cache()
    got = {r["path"]: r for r in measured.collect()}
    assert got["good"]["duration_s"] == pytest.approx(1.0) and got["good"]["error"] is None
    assert got["bad"]["error"] and got["empty"]["error"]
    stats = prosody.f0_stats(audio.pitch_frames(measured)).where("clip_id = 'good'").first()
    assert abs(stats["mean_hz"] - 200) < 5 and stats["std_semitones"] < 0.5


def test_exact_percentiles(spark, monkeypatch):
    monkeypatch.setattr(calibration, "BINS", 7)
    rng = np.random.default_rng(0)
    groups = {"a": rng.normal(size=501).round(2).tolist(), "b": [3.0] * 40, "c": [1.0], "d": [1.0, 2.0], None: rng.exponential(size=60).tolist()}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs] + [("a", None)], "g string, v double").repartition(4)
    got = {r["g"]: r for r in calibration.summary(df, "v", ("g",)).collect()}
    for g, vs in groups.items():
        for name, p in (("p10", 10), ("p25", 25), ("median", 50), ("p75", 75), ("p90", 90)):
            assert got[g][name] == pytest.approx(np.percentile(vs, p)), (g, name)
