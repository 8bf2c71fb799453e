"""Phrase collocations against plain counting."""

import re
from collections import Counter, defaultdict

import pytest
from helpers import SCHEMA, documents
from pyspark.sql import functions as F

from clipgrain.llm import collocations as C


def expected(rows, longest=3, least=10, top=2000, covered=50):
    found, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate({c: c + 32 for c in range(65, 91)})):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                found[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in found.items():
        kept = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = {p[i:j] for p, a in kept.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * a >= covered * f[p[i:j]]}
        rows = []
        for p, a in kept.items():
            if p not in gone:
                score, cut = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), f[p[:cut]], f[p[cut:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def rows_of(df, **k):
    return sorted(tuple(r) for r in C.collocations(df, **k).collect())


ODD = [(1, "a b  ", None), (2, "A b \u0085c", "und"), (3, "  a b\ta  b,a b;\n", None), (4, "\x00 a b", ""), (5, " , ;\n\n", "en"), (6, "x y z x y z x y z", "en"), (7, "é É e é É e", "fr"), (8, "a b\x0ba b\x0ca b\ra b", "fr")]


@pytest.mark.parametrize(("longest", "least", "top", "covered"), [(3, 10, 2000, 50), (3, 2, 5, 50), (2, 1, 7, 50), (4, 2, 2000, 70)])
def test_counting(spark, longest, least, top, covered):
    rows = documents(6, 40) + [(i, t, g, "s", 1) for i, t, g in ODD * 2]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for name in ("w", "w1", "w2", "words", "a", "l", "r", "n", "total", "piece", "_part", "_nth", "rank"):
        df = df.withColumn(name, F.lit("x"))
    assert rows_of(df, longest=longest, least=least, top=top, covered=covered) == expected([(r[2], r[1]) for r in rows], longest, least, top, covered)


def test_empty_tables_and_long_texts(spark):
    df = spark.createDataFrame(documents(6, 3), SCHEMA)
    assert rows_of(df.where("doc_id < 0")) == [] and rows_of(spark.createDataFrame([(1, None, None, None, None)], SCHEMA)) == []
    long = [(1, "one two " * 300_000, "en", "s", 1), (2, "THREE four. " * 50_000, "en", "s", 1)]
    assert rows_of(spark.createDataFrame(long, SCHEMA)) == expected([("en", t) for _, t, *_ in long])


def test_products_beyond_64_bits(spark):
    cases = [(3 * 10**15, 3 * 10**15, 3 * 10**15), (4_000_000_007, 5_000_000_029, 9_000_000_011), (10, 10**15, 10**15), (1, 1, 1), (10, 3, 7)]
    df = spark.createDataFrame(cases, "a long, l long, r long").select("a", "l", "r", C._score(F.col("a"), F.col("l"), F.col("r")).alias("s"))
    assert all(r["s"] == 10**6 * r["a"] ** 2 // (r["l"] * r["r"]) for r in df.collect())


def counted(texts, langs, longest=3, buckets=5, **k):
    """What the blocks of some texts hold: kind -> {(lang, words): n}."""
    import pyarrow as pa

    found = {}
    for _, kind, block in C._count(pa.array(langs), pa.array(texts, pa.string()), longest, buckets, **k):
        entries, columns, n = C._decode(block)
        entries = [b"\n", *entries.to_pylist()]
        for *ids, m in zip(*columns, n, strict=True):
            words = tuple(entries[i].split(b"\n")[0].decode() for i in ids)
            found.setdefault(kind, Counter())[(entries[ids[0]].split(b"\n", 1)[1].decode(), words)] += int(m)
    return found


def test_only_longest_windows_are_counted():
    assert counted(["a b c d. e"], ["en"]) == {C.WINDOWS: {("en", w): 1 for w in (("a", "b", "c"), ("b", "c", "d"), ("c", "d", ""), ("d", "", ""), ("e", "", ""))}}
    assert counted([None, "", " ; "], ["en"] * 3) == {}


def test_heads_are_spread_within_a_chunk():
    texts = [f"in the x{i}" for i in range(40)] + ["on a hill"]
    got = counted(texts, ["en"] * 41, hot=(4, 10))
    assert got[C.SUMS] == {("en", ("in", "the")): 40} and len(got[C.SPREAD]) == 40 and ("en", ("on", "a", "hill")) in got[C.WINDOWS]


@pytest.mark.parametrize("windows", [0, 8, 10**9])
def test_heads_that_are_spread_or_not(spark, monkeypatch, windows):
    monkeypatch.setattr(C, "HOT_WINDOWS", windows)
    monkeypatch.setattr(C, "CHUNK_BYTES", 2000)
    rows = [(i, f"in the x{i % 90} in the y{i % 7} of it. in the z", g, "s", 1) for i in range(900) for g in ("en", None)]
    assert rows_of(spark.createDataFrame(rows, SCHEMA).repartition(3), least=5) == expected([(r[2], r[1]) for r in rows], least=5)


def test_words_that_hash_alike(monkeypatch):
    import numpy as np

    texts, langs = ["a b a b c", None, "b a. c", "a"], ["x", "x", "y", "x\ny"]
    whole = counted(texts, langs)
    monkeypatch.setattr(C, "span_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    assert counted(texts, langs) == whole and whole[C.WINDOWS]["x\ny", ("a", "", "")] == 1


def test_many_distinct_words():
    import numpy as np

    r = np.random.default_rng(1)
    columns, n = [r.integers(0, 9, 300) for _ in range(4)], r.integers(1, 5, 300)
    small, large = C._summed(columns, n, 9), C._summed(columns, n, 1 << 20)
    assert all((a == b).all() for a, b in zip(small[0], large[0], strict=True)) and (small[1] == large[1]).all() and small[1].sum() == n.sum()
    import pyarrow as pa

    words, again, m = C._decode(C._encode(pa.array([b"", *(str(i).encode() for i in range(8))]), small[0], small[1]))
    words = words.to_pylist()
    assert (m == small[1]).all() and all([words[i - 1] if i else b"" for i in a] == [str(i - 1).encode() if i else b"" for i in b] for a, b in zip(again, small[0], strict=True))
