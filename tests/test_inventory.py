import pytest
from pyspark.sql import functions as F

from clipgrain.functions.text import resolved_profile
from clipgrain.operators import inventory, smoothing
from clipgrain.sources import reference_data as R


def inventories(spark, rows, columns="clip_id long, counts map<string,bigint>, claimed_language string"):
    df = spark.createDataFrame(rows, columns)
    return df.withColumn("total_tokens", F.aggregate(F.map_values("counts"), F.lit(0).cast("long"), lambda a, x: a + x))


OBSERVED = {"θ": 2, "ð": 2, "ɹ": 3, "ə": 5, "s": 20, "t": 21, "n": 20}


def test_language_match_verdicts(spark):
    rows = [(1, OBSERVED, "english"), (2, OBSERVED, "arabic"), (3, {"a": 7}, "english"), (4, OBSERVED, "klingon"), (5, OBSERVED, None), (6, OBSERVED, "")]
    got = {r["clip_id"]: r for r in inventory.language_match(inventories(spark, rows)).collect()}
    one = got[1]
    assert (one["positive_hits"], one["positive_total"], one["negative_clean"], one["negative_total"], one["verdict"]) == (4, 5, 9, 9, "matches")
    assert one["score"] == pytest.approx(0.86)
    assert one["notes"] == ["expected but missing: labio_velar_approximant"]
    assert got[2]["verdict"] == "mismatch"
    assert got[3]["verdict"] == "insufficient_signal" and got[3]["score"] is None and got[3]["positive_total"] == 5
    assert got[4]["verdict"] == "unknown_language" and got[4]["profile"] == "klingon"
    assert got[5]["verdict"] is None and got[6]["verdict"] is None


def test_optional_markers_leave_the_denominator(spark):
    hindi = {"pʰ": 2, "ʈ": 2, "ɽ": 1, "a": 20}
    row = inventory.language_match(inventories(spark, [(1, hindi, "hi")])).first()
    assert (row["positive_hits"], row["positive_total"], row["verdict"]) == (3, 3, "matches")


@pytest.mark.parametrize(
    ("claim", "profile"),
    [("Mandarin Chinese", "mandarin"), ("Chinese Mandarin", "mandarin"), ("Mandarin (Beijing)", "mandarin"), ("Brazilian Portuguese", "portuguese"), ("Hindi (India)", "hindi"), (" EN ", "english"), ("en_GB", "english"), ("es-MX", "spanish"), ("castilian", "spanish"), ("klingon", None), ("  ", None), ("", None)],
)
def test_profile_names(spark, claim, profile):
    df = spark.createDataFrame([(claim,)], "c string")
    assert df.select(resolved_profile(F.col("c"), R.profile_index()).alias("p")).first()["p"] == profile


def test_smoothing_golden(spark):
    counts = spark.createDataFrame([(1, "s", 18), (1, "f", 12), (1, "d", 24), (2, "S", 4), (2, "ʃ", 6), (3, "m", 7), (3, "a", 3)], "clip_id long, symbol string, n long")
    ipa = smoothing.ipa_counts(counts)
    got = {(r["clip_id"], r["symbol"]): r["smoothed"] for r in smoothing.smoothed_counts(ipa).collect()}
    expected = {"θ": 10.8, "ð": 9.6, "dʒ": 4.8, "ts": 4.5, "tsʰ": 3.6, "ʂ": 2.7, "ɖ": 7.2, "sˤ": 7.2, "dˤ": 9.6, "ɾ": 3.6, "s": 18.0}
    assert all(got[1, k] == pytest.approx(v) for k, v in expected.items())
    assert got[2, "tʃ"] == pytest.approx(3.0) and got[2, "tɕ"] == pytest.approx(2.0) and got[2, "ʂ"] == pytest.approx(3.5)
    assert got[3, "m"] == 7.0 and got[3, "æ"] == pytest.approx(0.6)
    said = {(r["clip_id"], r["target"]): r for r in smoothing.evidence(ipa).collect()}
    assert said[1, "θ"]["interpretation"].startswith("Direct detection: 0. Smoothed evidence: 10.80 (from s, f).")
    assert (3, "m") not in said


def test_stretch_statuses(spark):
    rows = [(1, {"x": 2, "ħ": 2, "ʕ": 1, "tˤ": 2, "r": 1}, "arabic"), (2, {"h": 4, "ʔ": 1, "t": 2, "ɹ": 1, "a": 8}, "arabic"), (3, {"q": 1}, "MSA"), (4, {"tʃ": 1}, "zh"), (5, {"x": 1}, "french")]
    df = inventories(spark, rows, "clip_id long, counts map<string,bigint>, expected_language string")
    got: dict = {}
    for r in inventory.stretch_scores(df).collect():
        got.setdefault(r["clip_id"], set()).add(r["status"])
    assert got == {1: {"hit"}, 2: {"approximate"}, 3: {"missed"}, 4: {"approximate"}}


def test_fixed_tables():
    assert len({c.target for c in R.CONFUSIONS}) == 38 and len(R.confusion_rows()) == 75
    rows = R.marker_rows()
    assert sum(r[1] == "positive" for r in rows) == 45 and sum(r[1] == "negative" for r in rows) == 74 and sum(r[5] for r in rows) == 5
    assert sum(len(r[6]) for r in rows if r[1] == "positive") == 98 and sum(len(r[6]) for r in rows if r[1] == "negative") == 154
