"""Workers are used again by the steps after; what an operator keeps in one is let go there."""

import pyarrow as pa

from clipgrain.llm import ngram_join, packing
from clipgrain.llm.queries import tokenizer_path


def test_ngram_join_lets_the_tokenizer_go():
    docs = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["one two three", None]})
    before = [b["ids"].to_pylist() for b in packing._tokenise(tokenizer_path())(iter([docs]))]
    assert packing._encoders
    assert [len(s) for _, s in ngram_join._sets(docs, 3)] == [1, 0]
    assert not packing._encoders
    assert [b["ids"].to_pylist() for b in packing._tokenise(tokenizer_path())(iter([docs]))] == before
