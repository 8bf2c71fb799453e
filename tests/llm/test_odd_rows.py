"""Rows that repeat, have no id, or hold very large numbers, where earlier versions lost or lumped them."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from helpers import SCHEMA, repeats_removed

from clipgrain.llm import mixing, suffix_dedup, topk


def test_every_row_of_a_repeated_id_is_judged(spark):
    r = random.Random(5)
    passage = "".join(r.choice("abcdefgh ") for _ in range(300))
    texts = [(1, "a" * 250), (1, "b" * 250), (2, "c" + passage), (2, passage + "d"), (2, passage + "d"), (3, passage), (3, None), (4, ""), (4, "")]
    rows = [*texts, *((5, passage[:200] + str(k % 3)) for k in range(9))]
    got = Counter(tuple(x) for x in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 100).collect())
    order = sorted(((i, hashlib.md5((t or "").encode()).hexdigest(), t or "") for i, t in rows), key=lambda x: x[:2])
    want = repeats_removed([(k, t) for k, (_, _, t) in enumerate(order)], 100)
    assert got == Counter((order[k][0], *v) for k, v in want.items()) and sum(got.values()) == len(rows)


def test_the_last_pass_parts_equal_rows(spark):
    rows = [(None, "", "en", "s", 0)] * 3000 + [(7, "same words here", "en", "t", 0)] * 400 + [(i, "w " * 50, "en", "big", 0) for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    drawn = mixing.mix(df, budget=5000)
    got = drawn.collect()
    tokens = Counter()
    for x in got:
        tokens[x["source"]] += x["tokens"]
    have, budget = {"s": 3000, "t": 1200, "big": 10_000}, 5000
    quotas = {s: int(n / sum(have.values()) * budget) for s, n in have.items()}
    # A pass ends within a row's cost of its source's share, though its rows are equal in all they have.
    assert all(quotas[s] - (50 if s == "big" else 3) <= tokens[s] <= quotas[s] for s in have)
    blocks = Counter(x["block"] for x in mixing.mix(df, max_repetition=1.0).where("doc_id is null").collect())
    assert len(blocks) > 90 and max(blocks.values()) < 0.05 * 3000


@pytest.mark.parametrize("scale", [2.0**24, 2.0**27, 2.0**40])
def test_sums_beyond_exact_doubles(spark, scale):
    r = np.random.default_rng(3)
    vectors = np.floor(r.normal(size=(300, 6)) * scale) / 64
    vectors[5] = vectors[6]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for x in topk.top_k(df, (df["vec_id"] % 20 == 0), 7).orderBy("query_id", "rank").collect():
        got.setdefault(x["query_id"], []).append((x["vec_id"], x["score"]))
    whole = [[int(y) for y in np.floor(64 * v)] for v in vectors]
    held = lambda s: max(-(2**63), min(2**63 - 1, s))
    for q in range(0, 300, 20):
        scores = sorted((-held(sum(a * b for a, b in zip(whole[q], c, strict=True))), i) for i, c in enumerate(whole) if i != q)[:7]
        assert got[q] == [(i, -s) for s, i in scores]


def test_bounds_rule_rows_out_beyond_exact_doubles(monkeypatch):
    r = np.random.default_rng(4)
    vectors = np.floor(r.normal(size=(4000, 16)) * 2.0**30)
    scored, plain = [], topk._long_scores
    monkeypatch.setattr(topk, "_long_scores", lambda v, q: scored.append(len(v)) or plain(v, q))
    list(topk.best_in_block(np.arange(4000), vectors, np.arange(8), vectors[:8], 10))
    assert len(scored) == 8 and sum(scored) < 0.2 * 8 * 4000
