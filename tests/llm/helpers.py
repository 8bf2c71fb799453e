"""Awkward documents, and brute-force versions to hold results against."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(seed=1, n=60):
    """Copies, near copies, shared passages, nulls, empty and very long texts, ties, odd bytes."""
    r = random.Random(seed)
    vocabulary = ["alpha", "Beta", "gämma", "delta,", "eps", "zeta.", "éta", "θ", "iota", "kap\u00a0pa", "lambda", "MU"]
    sentence = lambda k: " ".join(r.choice(vocabulary) + str(r.randint(0, 30)) for _ in range(k))
    bases = [sentence(r.randint(5, 120)) for _ in range(8)]
    passage = sentence(60)
    rows = []
    for i in range(n):
        text, kind = r.choice(bases), r.random()
        if kind < 0.3:
            words = text.split(" ")
            words[r.randrange(len(words))] = "changed"
            text = " ".join(words)
        elif kind < 0.5:
            text = sentence(40) + "\n" + passage + "\t" + sentence(20)
        elif kind < 0.6:
            text = text.replace(" ", "  \n")
        elif kind < 0.7:
            text = sentence(r.randint(1, 400))
        rows.append((i * 3 + 1, text, "en", f"src{i % 3}", len(text)))
    rows += [(900, None, "en", "src0", None), (901, "", "en", "src0", 0), (902, " \n\t ", None, None, 4), (903, "one", "en", "src1", 3), (904, "ONE", "en", "src1", 3), (905, "x" * 5000, "en", "src1", 5000), (906, sentence(20_000), "en", "src2", 0), (907, "a\x00b \u2028 c", "fr", "src2", 7), (908, "two words", "fr", "src2", 9), (909, "two words", "fr", "src2", 9)]
    return rows


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(text, n):
    w = words(text)
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)]) if w else frozenset()


def similar_components(rows, n, num, den):
    """doc_id -> (set size, smallest doc_id reachable), by comparing all pairs."""
    sets = {i: shingles(t, n) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def repeats_removed(rows, length):
    """doc_id -> (bytes, removed, runs, sha256 of the rest), window by window."""
    import hashlib

    seen, out = set(), {}
    for i, text in sorted(rows):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for at in range(len(raw) - length + 1):
            window = raw[at : at + length]
            if window in seen:
                gone[at : at + length] = b"\1" * length
            else:
                seen.add(window)
        runs = sum(1 for at in range(len(raw)) if gone[at] and (at == 0 or not gone[at - 1]))
        out[i] = (len(raw), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest())
    return out


def thue_morse(n):
    """Two different words of one length on which sums of powers modulo 2**64 agree, from 1024 letters on."""
    a = "".join("ab"[bin(i).count("1") & 1] for i in range(n))
    return a, a.translate(str.maketrans("ab", "ba"))
