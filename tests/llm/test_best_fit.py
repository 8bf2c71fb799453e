"""Best-fit packing: round trips, capacities, and a packer that takes one piece at a time."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import SCHEMA, documents

from clipgrain.llm import best_fit as B
from clipgrain.llm.queries import tokenizer_path


def pieces(rows, sequence):
    from tokenizers import Tokenizer

    tokenizer, out = Tokenizer.from_file(tokenizer_path()), Counter()
    for doc_id, text, *_ in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for start in range(0, len(ids), sequence):
            own = ids[start : start + sequence]
            out[doc_id, start // sequence, start, len(own), zlib.crc32(own.tobytes())] += 1
    return out


def bins_of(rows):
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    return bins


def gapless(bins):
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
    return True


@pytest.mark.parametrize("capacity", [B.Capacity(), B.Capacity(64, 3, 3000), B.Capacity(100, 100, 10**4, (1.0, 2.0, 0.5))])
def test_round_trip_and_capacities(spark, capacity):
    rows = documents(4, 50) + [(None, "No id", "en", "s", 1), (None, "No id", "en", "s", 1), (3, "", "en", "s", 0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumn("length", F_lit("x")).withColumn("part", F_lit("y")).withColumn("rank", F_lit("z"))
    got = B.pack(df, tokenizer_path(), capacity).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == pieces(rows, capacity.tokens)
    bins = bins_of(got)
    assert gapless(bins) and sorted(bins) == list(range(len(bins)))
    for held in bins.values():
        lengths = [n for _, n in held]
        assert len(held) == 1 or (sum(lengths) <= capacity.tokens and len(held) <= capacity.documents and sum(n * n for n in lengths) <= capacity.attention)


def F_lit(x):
    from pyspark.sql import functions as F

    return F.lit(x)


def test_ids_come_back(spark):
    rows = documents(5, 10)
    got = B.pack(spark.createDataFrame(rows, SCHEMA), tokenizer_path(), B.Capacity(50, 50, 2500), keep_ids=True).collect()
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"] for r in got)


def test_empty_tables_and_partitions(spark):
    df = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")
    assert B.pack(df.where("doc_id > 5"), tokenizer_path()).collect() == []
    got = B.pack(df.repartition(9, "doc_id"), tokenizer_path()).collect()
    assert {(r["doc_id"], r["length"], r["sequence_id"]) for r in got} == {(1, 3, 0), (2, 1, 0)}


def one_by_one(lengths, capacity):
    bins, whole, weights = [], np.array(capacity[:3], float), np.array(capacity.weights)
    for n in sorted(lengths, reverse=True):
        asks = np.array([n, 1, n * n], float)
        fits = [b for b in bins if (b >= asks).all()]
        if fits:
            at = min(fits, key=lambda b: round(float(np.sqrt((weights * ((b - asks) / whole) ** 2).sum())), 12))
            at -= asks
        else:
            bins.append(whole - asks)
    return len(bins)


@pytest.mark.parametrize("seed", range(6))
def test_against_one_piece_at_a_time(seed):
    r = random.Random(seed)
    capacity = [B.Capacity(100, 100, 10**4), B.Capacity(100, 4, 10**4), B.Capacity(100, 100, 4000)][seed % 3]
    lengths = [min(100, 1 + int(r.expovariate(1 / 25))) for _ in range(400)]
    lengths = [n for n in lengths if n * n <= capacity.attention]
    runs, bins = B.best_fit(Counter(lengths), capacity, "norm")
    assert bins == one_by_one(lengths, capacity)
    for rule in B.RULES:
        runs, bins = B.best_fit(Counter(lengths), capacity, rule)
        assert bins >= -(-sum(lengths) // capacity.tokens) and B.plan(Counter(lengths), capacity)[1] <= bins
        assert {n: sum(1 for x in runs if x.length == n) > 0 for n in set(lengths)} == dict.fromkeys(set(lengths), True)


def test_work_does_not_grow_with_the_pieces():
    r = random.Random(1)
    counts = {n: r.randint(1, 10**10) for n in range(1, 2049)}
    runs, bins = B.plan(counts, B.Capacity())
    assert len(runs) < 10_000 and bins < 1.02 * sum(n * m for n, m in counts.items()) / 2048
