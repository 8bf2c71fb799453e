"""Merkle manifests against plain Python."""

import hashlib
import zlib

import pytest
from helpers import SCHEMA, documents
from pyspark.sql import functions as F

from clipgrain.llm import merkle_manifest as M
from clipgrain.llm.numbering import ranked

COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*["-" if row[n] is None else f"{len(str(row[n]).encode())}:{row[n]}" for n in M.FIELDS])


def tree(nodes):
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, i in zip(paths, at, strict=True):
            run = nodes[i // 8 * 8 : i // 8 * 8 + 8]
            path.append((run[: i % 8], run[i % 8 + 1 :]))
        nodes, at = [H(*nodes[a : a + 8]) for a in range(0, len(nodes), 8)], [i // 8 for i in at]
    return nodes[0], paths


def expected(rows):
    langs = {}
    for r in rows:
        langs.setdefault(r["lang"], []).append(r)
    order = sorted(langs, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        langs[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[g] = tree([leaf(r) for r in langs[g]])
    if not order:
        return []
    root, tops = tree([trees[g][0] for g in order])
    out = []
    for g, top in zip(order, tops, strict=True):
        for r, path in zip(langs[g], trees[g][1], strict=True):
            path, later = path + top, dict(r)
            if r["doc_id"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0:
                later["text"] = r["text"].translate({c: c + 32 for c in range(65, 91)})
            now = leaf(later)
            for before, after in path:
                now = H(*before, now, *after)
            out.append((r["doc_id"], leaf(r), trees[g][0], root, H(*[x for b, a in path for x in b + a]), now, now == root))
    return out


def made(df):
    return [tuple(r) for r in M.proofs(df, M.lowered_text()).select(*COLUMNS).collect()]


def same(df):
    key = lambda r: tuple(map(str, r))
    got, want = sorted(made(df), key=key), sorted(expected([r.asDict() for r in df.select(*M.FIELDS).collect()]), key=key)
    assert got == want
    return got


def test_awkward_rows(spark):
    rows = documents(3, 40) + [(None, "No ID", "en", None, 1), (None, "No ID", "en", None, 1), (7, "Twice", "", "s", 5), (7, "Twice", "", "s", 5), (7, "Other", "", "s", 5), (8, "A", "ß", "s", 1), (9, "B", "Z", "s", 1), (-4, "C", None, "s", 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for name in ("r", "h", "p", "path", "kids", "b", "n", "claimed", "at"):
        df = df.withColumn(name, F.lit("x"))
    got = same(df)
    assert {r[-1] for r in got} == {True, False} and len(got) == len(rows)


@pytest.mark.parametrize("digits", [1, 3])
def test_heights_and_stages(spark, monkeypatch, digits):
    monkeypatch.setattr(M, "DIGITS", digits)
    sizes = {None: 1, "a": 8, "b": 9, "c": 64, "d": 65, "e": 513, "f": 2, "g": 1, "h": 7, "i": 1, "j": 520}
    rows = [(1000 * k + i, f"Text {i}", g, "s", i) for k, (g, n) in enumerate(sizes.items()) for i in range(n)]
    same(spark.createDataFrame(rows, SCHEMA).repartition(4))


@pytest.mark.parametrize("sizes", [(0,), (1,), (3,), (600,), (1, 1)])
def test_few_languages(spark, sizes):
    rows = [(10_000 * k + i, "x", f"l{k}", "s", 1) for k, n in enumerate(sizes) for i in range(n)]
    got = same(spark.createDataFrame(rows, SCHEMA).coalesce(2))
    if sizes == (1,):
        assert got[0][1] == got[0][2] == got[0][3] and got[0][4] == H()


def test_ranks_of_a_hot_group(spark):
    rows = [("hot", 5)] * 3000 + [("hot", i % 7) for i in range(500)] + [(None, 1)] * 20 + [(f"g{i}", None) for i in range(40)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = ranked(spark.createDataFrame(rows[::-1], "g string, v int"), ["g"], ["v"], "place")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    by = {}
    for g, v, place in found.collect():
        by.setdefault(g, []).append((place, -1 if v is None else v))
    assert all(sorted(p for p, _ in x) == list(range(len(x))) and [v for _, v in sorted(x)] == sorted(v for _, v in x) for x in by.values())
    assert max(r["n"] for r in found.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()) < 0.6 * len(rows)
