"""Prefix rows go on only where the other side may have their token."""

from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from clipgrain.llm import ngram_join
from clipgrain.llm.textops import mix64

NAMES = ["a", "b", "c", "h", "n", "tokens", "sketch"]


def members(r, cluster, first, count, of):
    """Rows of members whose differences are 40 tokens of their own and ``of``."""
    out = []
    for i in range(count):
        tokens = np.concatenate([r.integers(1, 1 << 62, 40, dtype=np.uint64), np.array(of, np.uint64)])
        tokens = tokens[np.argsort(mix64(tokens))]  # all differences have their tokens in one order
        out.append((cluster, first + i, first + i, len(tokens), 400, tokens.tobytes(), ngram_join._sketch(tokens)))
    return out


def batch(rows, names=NAMES):
    return pa.RecordBatch.from_pylist([{k: v for k, v in zip(NAMES, x, strict=True) if k in names} for x in rows])


def made(rows, *args):
    """The rows of ``_roles`` as tuples."""
    return [x for out in ngram_join._roles(80, 100, ngram_join.FOLDED, *args)(iter([batch(rows)])) for x in zip(*out.to_pydict().values(), strict=True)]


def sieve_of(tasks, what="once", size=16):
    """What the sieve of the members of some tasks is."""
    bits = np.zeros(1 << size - 6, np.uint64)
    blocks = pa.concat_tables([pa.Table.from_batches(ngram_join._sieved(80, 100, size)(iter([batch(rows, ["a", "c", "n", "tokens"])]))) for rows in tasks])
    for block in set(blocks["block"].to_pylist()):
        one = ngram_join._overlaid(blocks.filter(pc.equal(blocks["block"], block)))
        bits.reshape(-1, ngram_join.SIEVE_BLOCK)[block] = np.frombuffer(one[what][0].as_py(), np.uint64)
    return SimpleNamespace(value=bits)


def test_no_shared_token_is_lost():
    r = np.random.default_rng(3)
    alone, main = members(r, 7, 1, 3, [11, 12]), members(r, 7, 100, 200, [12, 13]) + members(r, 8, 400, 200, [11, 12])
    sieve = sieve_of([alone[:1], alone[1:]])
    every, left = made(main), made(main, False, sieve)
    theirs = {x[0] for x in made(alone)}
    assert [x for x in every if x[0] in theirs] == [x for x in left if x[0] in theirs]  # with their places and sketches
    assert set(left) <= set(every) and len({x[0] for x in left} & theirs) == 1
    assert len(left) < len(every) / 20  # 200 of 16,800 rows have a shared token


def test_tokens_of_one_member_stay_behind():
    """Of members that meet each other, only tokens go on that two have, in the same task or in two."""
    r = np.random.default_rng(6)
    tasks = [members(r, 7, 1, 30, []) + members(r, 7, 50, 2, [5]), members(r, 7, 100, 30, []) + members(r, 8, 150, 1, [6]), members(r, 8, 200, 1, [6])]
    rows = [x for task in tasks for x in task]
    every, left = made(rows), made(rows, False, sieve_of(tasks, "twice"))
    of = Counter(x[0] for x in every)
    assert sum(n > 1 for n in of.values()) == 2
    assert {x for x in every if of[x[0]] > 1} <= set(left) <= set(every) and len(left) < len(every) / 20


def test_tokens_of_one_component_stay_behind(monkeypatch):
    """Members of one component share tokens, which do not go on unless another component has them, however few are held at once."""
    r = np.random.default_rng(7)
    near = [(a, b, 50, *rest) for a, b, _, *rest in members(r, 7, 50, 20, range(1, 31))]
    rows = near + members(r, 7, 100, 2, [5])
    of = {x[0]: {y[3] for y in made(rows) if y[0] == x[0]} for x in made(rows)}
    left = made(rows, False, sieve_of([rows], "twice"))
    assert {k for k, c in of.items() if len(c) > 1} <= {x[0] for x in left} and len(left) < 60
    monkeypatch.setattr(ngram_join, "ROLES_AT_ONCE", 100)
    assert {x for x in made(rows) if len(of[x[0]]) > 1} <= set(made(rows, False, sieve_of([rows], "twice")))


def test_only_the_first_tokens():
    rows = members(np.random.default_rng(4), 7, 1, 20, [])
    every = made(rows)
    assert made(rows, True) == [x for x in every if x[1]]
    assert made(rows, True, SimpleNamespace(value=np.zeros(1 << 10, np.uint64))) == []


def test_meeting_is_the_same_with_a_sieve(spark, monkeypatch):
    r = np.random.default_rng(5)
    # Members have 80 differences from the pivot at most and 40 in common, of which they differ by so few that they may be linked.
    alone, main = (members(r, 7, first, 4, range(1, 41)) for first in (1, 100))
    main = [(a, b, 7, *rest) for a, b, _, *rest in main] + [(a, b, 7, *rest) for a, b, _, *rest in members(r, 7, 200, 30, [])]
    one, two = (spark.createDataFrame(x, "a long, b long, c long, h int, n int, tokens binary, sketch array<bigint>") for x in (alone, main))
    join = ngram_join._Join(None, None, 1, 0, 80, 100, None)
    every = spark.createDataFrame(alone + main, one.schema)
    assert join.sieve(one, two) is None  # not worth it
    whole = {(x["a"], x["b"]) for x in join.meeting(every, every).collect()}
    monkeypatch.setattr(ngram_join, "SIEVE_FROM", 0)
    sieve = join.sieve(one, two)
    assert sieve.value.any() and join.sieve(every, every).value.any()
    assert whole == {(x["a"], x["b"]) for x in join.meeting(every, every).collect()} and len(whole) == 22
    got = [{(x["a"], x["b"]) for x in pairs.collect()} for pairs in (join.meeting(one, two), join.meeting(one, two, (None, sieve)), join.meeting(two, one), join.meeting(two, one, (sieve, None)))]
    assert got[0] == got[1] and got[2] == got[3]
    assert got[0] | got[2] == {(x[1], y[1]) for x in alone for y in main[:4]}
