import zlib

import numpy as np
import pytest
from helpers import SCHEMA, documents, thue_morse

from clipgrain.llm import packing
from clipgrain.llm.queries import tokenizer_path


def whole(text):
    from tokenizers import Tokenizer

    ids = [*Tokenizer.from_file(tokenizer_path()).encode(text or "", add_special_tokens=False).ids, 1]
    return len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())


def test_empty_partitions(spark, tmp_path):
    rows = [(1, "one two"), (2, "three")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.where("doc_id < 0").write.parquet(str(tmp_path / "none"))
    assert packing.pack(spark.read.parquet(str(tmp_path / "none")), tokenizer_path()).collect() == []
    assert packing.pack(df.repartition(3, "doc_id").where("doc_id < 0"), tokenizer_path()).collect() == []
    for parts in (df.repartition(7, "doc_id"), df.coalesce(1).union(df.where("doc_id < 0")), df.where("doc_id < 0").union(df)):
        got = sorted(packing.pack(parts, tokenizer_path(), 4096).collect(), key=lambda r: r["offset"])
        assert sorted(r["doc_id"] for r in got) == [1, 2] and [r["offset"] for r in got] == [0, got[0]["length"]]
        assert {(r["doc_id"], r["length"], r["ids_crc32"]) for r in got} == {(i, *whole(t)) for i, t in rows}


def test_words_that_hash_alike(spark, monkeypatch):
    texts = [*thue_morse(1024), "a b", "b a", None, "x" * 70 + " " + "x" * 69 + "y"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    want = {(i, *whole(t)) for i, t in enumerate(texts)}
    assert {(r["doc_id"], r["doc_tokens"], r["ids_crc32"]) for r in packing.pack(df, tokenizer_path(), 1 << 20).collect()} == want
    import pyarrow as pa

    from clipgrain.llm.textops import bytes_of

    monkeypatch.setattr(packing, "_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    encoder = packing.WordEncoder(tokenizer_path())
    for _ in range(2):
        ids, first = encoder.ids(*bytes_of(pa.array(texts)))
        assert [(i, int(b - a + 1), zlib.crc32(np.append(ids[a:b], 1).astype("<u4"))) for i, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True))] == [w for w in sorted(want)]


@pytest.mark.parametrize("sequence", [1, 8, 100])
def test_last_sequence_is_padded_but_at_powers_of_two(spark, sequence):
    df = spark.createDataFrame(documents(2, 20), SCHEMA).repartition(3)
    rows = packing.pack(df, tokenizer_path(), sequence).collect()
    last = max(r["sequence_id"] for r in rows)
    filled = sum(r["length"] for r in rows if r["sequence_id"] == last)
    assert {r["padded_length"] for r in rows if r["sequence_id"] == last} == {packing.padded(filled, sequence)}
    assert {r["padded_length"] for r in rows if r["sequence_id"] < last} <= {sequence}


def test_words_that_differ_by_case_or_punctuation_are_learnt_once(monkeypatch):
    import pyarrow as pa

    from clipgrain.llm.textops import bytes_of

    learnt = []
    learn = packing.WordEncoder._learn
    monkeypatch.setattr(packing.WordEncoder, "_learn", lambda self, hashes, words: learnt.extend(words) or learn(self, hashes, words))
    encoder = packing.WordEncoder(tokenizer_path())
    encoder.ids(*bytes_of(pa.array(["Word word, WORD. word", None, "wOrd! word."])))
    assert sorted(learnt) == [b"!", b",", b".", b"word"]
    odd = ["H\u0331 h\u0331 A\u030a", "a\u03a3.b a\u03a3. \u03a3a. A\u03a3, \u03a3", "it's. IT'S! 's. '. x'S, we'll?!", "\u00c9., e\u0301. E\u0301.", "a.\u0301 a,b. .a .. , a.. 7. 7a. a7. \u0130I.", "", None, "END", "X" * 80 + ".", "a" * 64 + ",", "<|endoftext|>. a<|endoftext|>."]
    ids, first = encoder.ids(*bytes_of(pa.array(odd)))
    assert [(int(b - a + 1), zlib.crc32(np.append(ids[a:b], 1).astype("<u4"))) for a, b in zip(first[:-1], first[1:], strict=True)] == [whole(t) for t in odd]
