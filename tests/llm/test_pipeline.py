"""The pipeline stage by stage against plain Python, on awkward rows."""

import re
from collections import Counter

import pytest
from helpers import SCHEMA, documents, similar_components

import corpus_pipeline
from clipgrain.llm import mixing, quality
from clipgrain.llm.queries import MAX_REPETITION, tokenizer_path


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("docs")
    junk = [(3000 + i, "LOUD!! NOISE!! HERE!! " * (20 + i), "en", "src0", 1) for i in range(12)]
    spark.createDataFrame(documents(9, 70) + junk, SCHEMA).repartition(4).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_stages_and_run(spark, folder):
    from tokenizers import Tokenizer

    docs, steps = spark.read.parquet(f"{folder}/documents.parquet"), []
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES:
        rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
        out = stage(spark, docs, folder)
        steps.append((rows, out.collect()))
        docs = spark.createDataFrame(steps[-1][1], out.schema).repartition(3)
    ids = lambda rows: sorted(r["doc_id"] for r in rows)
    assert all(list(out[0].asDict()) == columns for _, out in steps[:-1])

    (rows, out), scored = steps[0], quality.classify(spark.read.parquet(f"{folder}/documents.parquet")).collect()
    assert ids(out) == sorted(r["doc_id"] for r in scored if r["score"] >= quality.THRESHOLD)

    rows, out = steps[1]
    least: dict = {}
    for i, t, _ in rows:
        key = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        least[key] = min(i, least.get(key, i))
    assert ids(out) == sorted(least.values())

    rows, out = steps[2]
    groups = similar_components([(i, t) for i, t, _ in rows], 5, 80, 100)
    assert ids(out) == sorted({c for _, c in groups.values()})

    rows, out = steps[3]
    drawn = Counter(r["doc_id"] for r in out)
    tokens: Counter = Counter()
    for i, t, s in rows:
        tokens[s] += max(1, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")))
    assert set(drawn) == {i for i, *_ in rows}
    big = max(tokens, key=tokens.get)
    for s in tokens:
        times = [drawn[i] for i, _, own in rows if own == s]
        assert max(times) <= (1 if s == big else 2) and min(times) >= 1 and max(times) <= MAX_REPETITION + 1

    rows, out = steps[4]
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _ in rows)
    assert sum(r["length"] for r in out) == want and sum(r["start"] == 0 for r in out) == len(rows)

    whole = corpus_pipeline.run(spark, folder).collect()
    key = lambda r: (r["doc_id"], r["start"], r["doc_tokens"])
    assert Counter((r["doc_id"], r["doc_tokens"]) for r in whole if r["start"] == 0) == Counter((r["doc_id"], r["doc_tokens"]) for r in out if r["start"] == 0) and all(key(r) for r in whole)


def test_stages_on_empty_tables_and_repeated_ids(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    none = docs.where("doc_id < -1")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).collect() == []
    text, other = documents(9, 70)[3][1], documents(9, 70)[4][1]
    rows = [(1, text, "en", "a", 1), (2, text, "en", "b", 1), (2, other, "en", "b", 1), (2, other, "en", "b", 1), (None, other, "en", None, 1), (None, text, None, None, 1), (None, None, None, None, None), (5, None, "en", "a", 0)]
    odd = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for name in ("_stays", "_id", "_draws", "_rows", "_nth", "_copies", "_copy", "key", "row", "copies", "epoch"):
        odd = odd.withColumn(name, odd["source"])
    left = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())
    _, distinct = corpus_pipeline.STAGES[1]
    assert left(distinct(spark, odd, folder)) == Counter([(1, text), (2, other), (5, None)])
    _, dissimilar = corpus_pipeline.STAGES[2]
    assert left(dissimilar(spark, odd, folder)) == Counter([(1, text), (2, other), (None, other), (None, text), (None, None), (5, None)])
    _, mixed = corpus_pipeline.STAGES[3]
    got, want = left(mixed(spark, odd, folder)), left(odd)
    assert set(got) == set(want) and all(want[k] <= n <= 2 * want[k] for k, n in got.items())
    assert mixed(spark, odd, folder).columns == odd.columns


def test_rows_without_ids_are_spread(spark):
    rows = [(None, f"text {i}", "en", "s", 1) for i in range(3000)] + [(i, "w", "en", f"s{i % 3}", 1) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    drawn = mixing.mix(df, max_repetition=1.0)
    blocks = Counter(r["block"] for r in drawn.where("doc_id is null").collect())
    assert len(blocks) > 90 and max(blocks.values()) < 0.1 * sum(blocks.values())
