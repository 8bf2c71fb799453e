import random

import pytest
from helpers import repeats_removed, thue_morse

from clipgrain.llm import suffix_dedup


@pytest.mark.parametrize("large", [300, 20_000])
def test_phrases_of_large_anchors_are_parted_without_loss(spark, monkeypatch, large):
    monkeypatch.setattr(suffix_dedup, "LARGE_ANCHOR", large)
    r = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz "
    some = lambda n: "".join(r.choice(letters) for _ in range(n))
    line, tails = "this notice must stay in all copies of the work", [some(70) for _ in range(12)]
    rows = [(i, some(80) + line + (r.choice(tails) if i % 3 else some(70)) + some(r.randint(0, 60))) for i in range(250)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 100, shard_bytes=4000)
    assert {x["doc_id"]: tuple(x)[1:5] for x in got.collect()} == repeats_removed(rows, 100)


def test_passages_that_hash_alike_by_sums(spark):
    a, b = thue_morse(1024)
    rows = [(1, a), (2, b), (3, "x" + a + "y"), (4, b + a)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 1024)
    assert {x["doc_id"]: tuple(x)[1:5] for x in got.collect()} == repeats_removed(rows, 1024)
