import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from helpers import SCHEMA, WORD, documents
from pyspark.sql import functions as F

from clipgrain.llm import quality
from clipgrain.llm.textops import bytes_of

MARKS = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def plain_statistics(text):
    """The labellers' statistics, letter by letter."""
    text = text or ""
    raw, words = text.encode(), WORD.findall(text)
    letters = [c for c in text if c.isascii() and c.isalpha() or ord(c) >= 0x80]
    capitals = [c for c in letters if "A" <= c <= "Z" or "À" <= c <= "Þ" or "Ά" <= c <= "Ϋ" or "А" <= c <= "Я" or "Ѐ" <= c <= "Џ"]
    symbols = [c for c in text if c in MARKS and c not in ",;:'\"()-.!?"]
    lines = (text.removesuffix("\n")).split("\n") if text else []
    n = max(len(words), 1)
    runs = list(zip(words, words[1:], words[2:], strict=False))
    chars = sum(1 for c in text if 33 <= ord(c) < 127 and not c.isdigit() or ord(c) >= 0x80)
    wide = sum(1 for c in text if ord(c) >= 0x800)
    stats = [
        len(capitals) / max(len(letters), 1),
        len(symbols) / max(len(raw), 1),
        sum(len(w.encode()) >= 2 and w[-1] in MARKS and w.encode()[-1] == w.encode()[-2] for w in words) / n,
        sum(all(c in MARKS for c in w) for w in words) / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        1 - len(set(runs)) / len(runs) if runs else 0,
        max(Counter(words).values(), default=0) / n,
        chars / n,
        (len(lines) - len(set(lines))) / max(len(lines), 1),
        sum(text.count(c) for c in ".!?。।") / n,
    ]
    return stats, 0 if wide > quality.UNSPACED * chars and wide else len(words)


def plain_model(votes, rounds):
    """Expectation-maximisation text by text."""
    good, cries = quality.PRIOR_GOOD, [list(quality.PRIOR_CRIES) for _ in quality.LABELLERS]
    for _ in range(rounds):
        post = []
        for v in votes:
            odds = [1 - good, good]
            for c in (0, 1):
                for j, x in enumerate(v):
                    odds[c] *= 1 if x == 0 else cries[j][c] if x == 1 else 1 - cries[j][c]
            post.append(odds[1] / sum(odds))
        for j in range(len(cries)):
            for c in (0, 1):
                w = [p if c else 1 - p for p in post]
                bad = sum(x for x, v in zip(w, votes, strict=True) if v[j] == 1)
                cries[j][c] = (bad + quality.PRIOR_WEIGHT * quality.PRIOR_CRIES[c]) / (sum(x for x, v in zip(w, votes, strict=True) if v[j]) + quality.PRIOR_WEIGHT)
        good = (sum(post) + quality.PRIOR_WEIGHT * quality.PRIOR_GOOD) / (len(post) + quality.PRIOR_WEIGHT)
    return good, cries


TEXTS = ["", None, " \n", "one", "ALL CAPS HERE!! NOW!!", "ÀÉ ΑΒΓ АБВ ѐ", "a | b | c | d", "x## y$$ z.. w", "go go go go go go go go go", "line\nline\nline\nother\n", "\n\n", "。一二三 四五六。", "ends. here! ok? yes.", "tab\tsep\x0bwords\x0c 7 77"]


def test_statistics_letter_by_letter():
    texts = TEXTS + [t for _, t, *_ in documents(4, 40)]
    got, words = quality.statistics(*bytes_of(pa.array(texts)))
    want = [plain_statistics(t) for t in texts]
    assert words.tolist() == [w for _, w in want]
    assert np.allclose(got, np.array([s for s, _ in want]), atol=1e-12)


def test_posteriors_against_plain_estimation(spark, monkeypatch):
    fit = quality.LabelModel.fit.__func__
    monkeypatch.setattr(quality.LabelModel, "fit", classmethod(lambda cls, p, c: fit(cls, p, c, rounds=15)))
    rows = documents(5, 60) + [(2000 + i, t, "en", "s", 0) for i, t in enumerate(TEXTS * 2)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    for name in ("h", "score", "kept", "pattern", "weak_label"):
        df = df.withColumn(name, df["source"])
    votes = [quality.votes(*map(np.array, zip(*[plain_statistics(t)], strict=True)))[0].tolist() for _, t, *_ in rows]
    good, cries = plain_model(votes, 15)
    got = {r["doc_id"]: r for r in quality.classify(df).collect()}
    assert len(got) == len(rows)
    for (i, *_), v in zip(rows, votes, strict=True):
        gap = math.log(good / (1 - good)) + sum(math.log(c[1] / c[0]) if x == 1 else math.log((1 - c[1]) / (1 - c[0])) for x, c in zip(v, cries, strict=True) if x)
        assert abs(got[i]["weak_label"] - 1 / (1 + math.exp(-gap))) < 1e-9
        assert got[i]["kept"] == (got[i]["score"] >= quality.THRESHOLD)


def test_label_model_finds_accuracies_and_beats_a_count():
    """Overlapping labellers, hit rates 0.2 to 0.95, false alarms 0.01 to 0.25, some votes missing."""
    r = np.random.default_rng(0)
    n, hits = 100_000, np.linspace(0.2, 0.95, len(quality.LABELLERS))
    alarms = np.array([0.01, 0.05, 0.1, 0.25, 0.02, 0.15, 0.2, 0.03, 0.08, 0.12])
    good = r.random(n) < 0.7
    votes = np.where(r.random((n, len(hits))) < np.where(good[:, None], alarms, hits), 1, 2)
    shown = np.where(r.random(votes.shape) < 0.2, 0, votes)
    for v in (votes, shown):
        patterns, counts = np.unique(v @ quality._POWERS, return_counts=True)
        model = quality.LabelModel.fit(patterns, counts.astype(float))
        assert abs(model.good - 0.7) < 0.02 and np.abs(model.cries[0] - hits).max() < 0.05 and np.abs(model.cries[1] - alarms).max() < 0.05
        right = ((model.posterior(v) > 0.5) == good).mean()
        assert right > max((((v == 1).sum(axis=1) < k) == good).mean() for k in range(1, 8)) + 0.005


def test_sample_is_bounded_and_rows_are_judged_alone(spark):
    rows = documents(6, 30)
    rows += [(None, rows[0][1], "en", None, 1), (rows[1][0], "NO!! GO!! " * 60, "en", "s", 1), (rows[1][0], rows[1][1], "en", "s", 1), (8000, "| - ** " * 200_000, "en", "s", 1)] * 2
    df = spark.createDataFrame(rows, SCHEMA).withColumn("_stays", F.lit("clash")).repartition(3)
    sizes = []
    fit = quality.fit_scorer
    quality.fit_scorer = lambda x, p: sizes.append(len(p)) or fit(x, p)
    try:
        got = quality.classify(df, train_rows=20).collect()
        kept = quality.keep_good(df, train_rows=20)
        assert kept.columns == df.columns
        left = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    finally:
        quality.fit_scorer = fit
    assert sizes and max(sizes) <= 20 and len(got) == len(rows)
    assert sum(left.values()) == sum(r["kept"] for r in got)
    assert all(left[k] in (0, n) for k, n in Counter((r[0], r[1]) for r in rows).items())
    none = df.where("doc_id < -1")
    assert quality.classify(none).collect() == [] and quality.keep_good(none).collect() == []




def test_word_pattern_matches_the_kernel():
    assert re.findall(WORD, "a\x1cb c") == ["a\x1cb", "c"]
