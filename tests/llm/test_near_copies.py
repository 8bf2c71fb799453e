import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import SCHEMA, documents, shingles, similar_components, thue_morse

from clipgrain.llm import ngram_join


def by_id(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_words_that_hash_alike(spark):
    rows = [(i, t) for i, t in enumerate([*thue_morse(1024), *(f"{w} tail" for w in thue_morse(1024))])]
    got = by_id(ngram_join.components(spark.createDataFrame(rows, "doc_id long, text string"), 3, (90, 100)))
    assert got == {i: (1, i) for i in range(4)}


def changed(r, words, k):
    w = list(words)
    for i in r.sample(range(len(w)), k):
        w[i] = f"x{r.randrange(10**6)}"
    return w


@pytest.mark.parametrize("entries", [1 << 20, 500])
def test_large_groups_that_meet(spark, monkeypatch, entries):
    """Two groups of near copies with a passage in common, and members at every distance between."""
    monkeypatch.setattr(ngram_join, "PARTNERS", 50)
    monkeypatch.setattr(ngram_join, "ENTRIES_AT_ONCE", entries)
    r = random.Random(3)
    base = [f"w{i}" for i in range(90)]
    other = base[:70] + [f"v{i}" for i in range(20)]
    rows = []
    for i in range(400):
        words = base if i % 3 else other
        rows.append((i, " ".join(changed(r, words, r.choice([0, 1, 1, 2, 3, 4, 5, 6, 8])))))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert by_id(ngram_join.components(df, 2, (80, 100))) == similar_components(rows, 2, 80, 100)


def test_thousands_of_copies_and_an_outlier(spark):
    """The pairs that are compared grow with the group, not with its square."""
    r = random.Random(8)
    base = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(changed(r, base, 2))) for i in range(3000)] + [(9000 + i, " ".join(changed(r, base, 17))) for i in range(3)]
    seen = []
    compared = ngram_join._Join.compared
    ngram_join._Join.compared = lambda self, pairs: seen.append(pairs.count()) or compared(self, pairs)
    try:
        got = by_id(ngram_join.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 1, (80, 100)))
    finally:
        ngram_join._Join.compared = compared
    assert {c for i, (_, c) in got.items() if i < 9000} == {0} and sum(seen) < 4 * len(rows)


def test_one_link_for_each_member_and_task(spark, monkeypatch):
    """Members share many lists, of which each has another smallest member; few links connect them."""
    r = random.Random(5)
    base = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(changed(r, base, r.choice([5, 30, 60])))) for i in range(300)]
    links, met = [], ngram_join.connected_components
    monkeypatch.setattr(ngram_join, "connected_components", lambda edges: links.append(edges.distinct().count()) or met(edges))
    got = by_id(ngram_join.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 1, (80, 100)))
    assert got == similar_components(rows, 1, 80, 100) and links[0] < 2 * len(rows)


def test_links_are_those_of_a_connected_graph():
    r = np.random.default_rng(2)
    for n in (1, 2, 8, 50):
        for m in (0, 1, n, 2 * n):
            a, b = r.integers(-n, n, m), r.integers(-n, n, m)
            least = {x: x for x in [*a.tolist(), *b.tolist()]}
            for _ in range(2 * n):
                for x, y in zip(a.tolist(), b.tolist(), strict=True):
                    least[x] = least[y] = min(least[x], least[y])
            nodes, named = ngram_join._joined(a, b)
            assert dict(zip(nodes.tolist(), named.tolist(), strict=True)) == least
            assert {(x, y) for x, y in zip(*(z.tolist() for z in ngram_join._stars(a, b)), strict=True)} == {(x, y) for y, x in least.items() if x != y}


def test_lists_longer_than_what_is_joined_at_once(monkeypatch):
    """Links that were given out, and those that are still held, connect the nodes of a list that goes over several batches."""
    monkeypatch.setattr(ngram_join, "ENTRIES_AT_ONCE", 8)
    batch = lambda key, nodes, star=False: pa.RecordBatch.from_arrays([pa.array([key] * len(nodes)), pa.array(nodes), pa.array([star] * len(nodes))], ["key", "node", "star"])
    batches = [batch(-5, list(range(10, 30))), batch(-5, list(range(30, 40))), batch(7, [12, 50]), batch(50, [51, 52], True), batch(9, [60]), batch(9, [60])]
    got = [x for out in ngram_join._scan(batches) for x in zip(*out.to_pydict().values(), strict=True)]
    parent = {x: x for x in [*range(10, 40), 50, 51, 52, 60]}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in got:
        parent[find(y)] = find(x)
    assert len({find(x) for x in parent if x != 60}) == 1 and find(60) == 60 and len(got) < 2 * len(parent)
    assert list(ngram_join._scan([])) == [] and list(ngram_join._scan([batch(9, [60])])) == []


def test_members_of_one_component_do_not_meet(spark):
    """Of twelve members of a cluster that are all alike, only those of different components are paired."""
    tokens, sketch = np.arange(1, 9, dtype=np.uint64).tobytes(), [0] * 16
    rows = [(1, 10 + i, 10 + i // 11, 8, 40, tokens, sketch) for i in range(12)]
    members = spark.createDataFrame(rows, "a long, b long, c long, h int, n int, tokens binary, sketch array<bigint>")
    got = {(r["a"], r["b"]) for r in ngram_join._Join(None, None, 1, 0, 80, 100, None).meeting(members, members).collect()}
    assert got == {(10 + i, 21) for i in range(11)}


def kept(rows, words, num, den):
    """One row of each component stays, links being judged on rows."""
    sets = [shingles(t, words) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if None not in (rows[a][0], rows[b][0]) and sets[a] and sets[b] and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    groups: dict = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    return [[rows[i] for i in g] for g in groups.values()]


@pytest.mark.parametrize("seed", [1, 2])
def test_one_row_of_each_component_stays(spark, seed):
    rows = documents(seed, 40)
    text = rows[1][1]
    rows += [(rows[0][0], *rows[5][1:]), (7000, text, "en", "a", 1), (7000, "some other words here", "en", "a", 1), (None, text, "en", "b", 2), (None, text, "en", "b", 2), (7001, "lone", "x", "y", 0), (7001, "lone", "x", "y", 0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for name in ("doc", "mark", "_doc", "c", "first", "node"):
        df = df.withColumn(name, df["source"])
    out = ngram_join.keep_one(df, 3, (80, 100))
    assert out.columns == df.columns
    left = [(r["doc_id"], r["text"]) for r in out.collect()]
    want = []
    for group in kept(rows, 3, 80, 100):
        least = min((r[0] for r in group if r[0] is not None), default=None)
        stays = [x for x in left if x in [(r[0], r[1]) for r in group]]
        want.append(stays)
        assert all(x[0] == least for x in stays) and stays
    # Of rows that repeat both doc_id and text one stays; rows without a doc_id all stay.
    assert len(left) == len({(i, t) for i, t in left if i is not None}) + 2
    assert ngram_join.keep_one(df.limit(0)).collect() == [] and ngram_join.keep_one(df.where("doc_id < -1")).collect() == []
