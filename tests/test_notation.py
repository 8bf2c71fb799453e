"""Notation and calibration files, the baseline window, and labels outside the vocabulary."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipgrain.operators import calibration, decode, notation, prosody, quality
from clipgrain.sources import reference_data as R


def test_notation_rules(spark):
    pairs = {"tS": "tʃ", "ts.": "tʂ", "tSh": "tʃh", "a:": "aː", "dZː": "dʒː", "ɬ": "ɬ", "i.ː": "ɨː", "kh:": "kʰː", "q": "q"}
    df = spark.createDataFrame(list(pairs.items()), "s string, want string")
    assert [r["got"] for r in df.select(notation.to_ipa(F.col("s")).alias("got")).collect()] == list(pairs.values())
    others = {r["symbol"]: r["ipa_alternates"] for r in notation.alphabet(spark).collect()}
    assert others["ts."] == ["/tʂ/", "t͡ʂ", "/t͡ʂ/", "ʈʂ", "/ʈʂ/"] and others["tsh"] == ["/tsʰ/", "t͡sʰ"] and others["b"] == ["/b/"]
    assert len(others) == len(R.alphabet()) and {r["version"] for r in notation.alphabet(spark).collect()} == {"1.0.0"}


def test_drift_and_artefacts(spark, tmp_path):
    tokens = spark.createDataFrame([("aa", "/b/"), ("aa", "/ʃ/"), ("bb", "ʘ"), ("aa", "ʘ"), ("bb", "/t͡ʂ/")], "language string, token string")
    got = {(r["language"], r["token"]): (r["category"], r["matches"]) for r in notation.drift(tokens).collect()}
    assert got[("aa", "/b/")] == ("direct", ["b"]) and got[("bb", "ʘ")] == ("phonological", None) and got[("bb", "/t͡ʂ/")] == ("notation-only", ["ts."])
    notation.write_artefacts(spark, str(tmp_path), tokens)
    assert spark.read.json(f"{tmp_path}/alphabet").count() == len(R.alphabet())
    assert [tuple(r) for r in spark.read.json(f"{tmp_path}/gaps").select("token", "languages").collect()] == [("ʘ", "aa, bb")]
    assert not notation.stale(notation.alphabet(spark), notation.alphabet(spark)) and notation.stale(notation.alphabet(spark), notation.alphabet(spark).limit(3))


def test_vocab_with_fallback(spark, tmp_path):
    (tmp_path / "vocab.json").write_text('{"<pad>": 0, "θ": 1}')
    assert {tuple(r) for r in notation.read_vocab(spark, str(tmp_path / "vocab.json")).collect()} == {("<pad>", 0), ("θ", 1)}
    assert {tuple(r) for r in notation.read_vocab(spark, str(tmp_path / "none.json"), ["x", "y"]).collect()} == {("x", 0), ("y", 1)}


def test_results_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a.wav", "01", 1.5, 7), ("b, c.wav", "02", None, None)], "filename string, actor string, duration_s double, phonemes_total_tokens long")
    for _ in range(2):
        calibration.append_results(rows, str(tmp_path / "out"))
    got = calibration.read_results(spark, str(tmp_path / "out"))
    assert sorted((r["filename"], r["duration_s"] or 0, r["phonemes_total_tokens"] or 0) for r in got.collect()) == [("a.wav", 1.5, 7)] * 2 + [("b, c.wav", 0, 0)] * 2
    (tmp_path / "empty.csv").write_text("filename,actor\n")
    with pytest.raises(ValueError, match="no rows"):
        calibration.read_results(spark, str(tmp_path / "empty.csv"))


def test_percentiles_with_outliers_and_ties(spark):
    r = np.random.default_rng(2)
    values = {"a": [*r.normal(size=3000), 1e12, -1e12], "b": [5.0] * 900 + [7.0] * 100 + [1e9], "c": [3.0]}
    df = spark.createDataFrame([(k, float(x)) for k, v in values.items() for x in v], "g string, x double")
    shares = {"median": 0.5, "p10": 0.1, "p90": 0.9, "p99": 0.99}
    got = {r["_g"]: r for r in calibration.exact_percentiles(df, "x", ("g",), shares).collect()}
    for k, v in values.items():
        assert all(got[k][n] == pytest.approx(np.percentile(v, 100 * p)) for n, p in shares.items())


def test_baseline_window(spark):
    pitch = [(1, i * 10_000, 100.0 + (50.0 if i >= 500 else i % 3)) for i in range(700)] + [(2, 0, 100.0)]
    level = [(1, i, 60.0 + 10 * (i % 20 == 10)) for i in range(700)] + [(2, 0, 60.0)]
    clips = spark.createDataFrame([(1, 7.0, "diagnostic"), (2, 4.9, "diagnostic"), (3, 5.0, "unspecified")], "clip_id long, duration_s double, source_clip string")
    got = {r["clip_id"]: r for r in quality.baseline(clips, spark.createDataFrame(pitch, "clip_id long, time_us long, f0_hz double"), spark.createDataFrame(level, "clip_id long, idx int, db double")).collect()}
    assert set(got) == {1, 3} and got[3]["f0_mean_hz"] is None and got[3]["syllable_rate_hz"] is None
    assert got[1]["f0_mean_hz"] == pytest.approx(np.mean([100 + i % 3 for i in range(500)])) and got[1]["syllable_rate_hz"] == pytest.approx(25 / 5.0) and got[1]["window_end_ms"] == 5000


def test_ids_outside_the_vocabulary(spark):
    frames = spark.createDataFrame([(1, 0, [0.0, -9.0, -9.0], 0.04), (1, 1, [-9.0, -9.0, 0.0], 0.04)], "clip_id long, frame_idx int, log_probs array<double>, duration_s double")
    assert [r["phoneme"] for r in decode.occurrences(frames, ["<pad>", "θ"]).collect()] == ["<vocab:2>"]
    assert prosody.f0_range(spark.createDataFrame([(1, float(f)) for f in (100, 120, 150, 110, 130, 0)], "clip_id long, f0_hz double")).first()["range_hz_max_min"] == 50.0


def test_two_places_as_printf(spark):
    import random

    from clipgrain.functions.text import two_places

    r = random.Random(1)
    values = [0.825, 0.125, 0.375, 2.675, 1.005, -0.825, 0.005, 0.015, 100.125, 0.0, 12345.675] + [r.randint(-99999, 99999) / 1000 for _ in range(3000)] + [r.uniform(-50, 50) for _ in range(300)] + [i / 8 for i in range(-40, 40)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "x double")
    for row in df.select("x", two_places(F.col("x")).alias("s")).collect():
        want = "n/a" if row["x"] is None or row["x"] != row["x"] else f"{row['x']:.2f}"
        assert row["s"] in (want, want.replace("-0.00", "0.00")), row


def test_scan_of_clip_files(spark, tmp_path):
    names = ["03-01-01-01-01-01-01.wav", "a/03-01-05-02-01-01-02.wav", "a/b/03-02-01-01-01-01-03.wav", "a/03-01-04-01-01-01-04.wav", "readme.wav", "03-01-01-01-01-01-05.mp3", "a/03-01-03-02-02-02-24.wav"]
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    got = {r["path"].rsplit("/", 1)[1]: (r["bucket"], r["gender"], r["spoken_as"]) for r in calibration.scan_clips(spark, str(tmp_path)).collect()}
    assert got == {"03-01-01-01-01-01-01.wav": ("neutral", "male", "normal neutral"), "03-01-05-02-01-01-02.wav": ("angry-strong", "female", "strong angry"), "03-01-03-02-02-02-24.wav": ("happy-strong", "female", "strong happy")}
