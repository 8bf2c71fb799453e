"""Members that share many tokens of their prefixes meet by the first of them."""

import numpy as np

from clipgrain.llm import ngram_join
from clipgrain.llm.textops import U64, mix64


def test_sketches_of_what_is_left():
    r = np.random.default_rng(1)
    tokens = r.integers(1, 1 << 63, 90, dtype=np.uint64)
    got = ngram_join._sketches_from(np.array(ngram_join._sketch(tokens), np.int64), tokens[:40], ngram_join.FOLDED)
    for i in range(40):
        whole = np.array(ngram_join._sketch(tokens[i:]), np.int64)
        assert (got[i] == np.bitwise_xor.reduce(whole.reshape(-1, ngram_join.FOLDED))).all()


def test_pairs_meet_by_their_first_shared_token():
    """With 8 differences allowed, sets that differ by 8 meet once although they share 30 tokens, and those that differ by 9 never."""
    num, den, n = 80, 100, 36
    most = ngram_join._most(n, num, den)
    common = mix64(np.arange(1, 31, dtype=np.uint64) ^ U64(77))

    def met(own):
        sets = [np.concatenate([common, np.arange(own, dtype=np.uint64) + U64(start)]) for start in (1000, 2000)]
        rows = [(ngram_join._sketches_from(np.array(ngram_join._sketch(s), np.int64), s[: most + 1], ngram_join.FOLDED)) for s in sets]
        bits = lambda x: int(np.bitwise_count(x).sum())
        return [i + i + bits(rows[0][i] ^ rows[1][i]) for i in range(most + 1)]

    near = met(4)
    assert near[0] <= 8 and all(b - a == 2 for a, b in zip(near, near[1:], strict=False))
