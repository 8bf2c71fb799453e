import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from helpers import SCHEMA, documents, repeats_removed, similar_components
from pyspark.sql import functions as F

from clipgrain.llm import exact_dedup, licenses, mixing, ngram_join, packing, quality, suffix_dedup, topk, url_filter, warc
from clipgrain.llm.graph import connected_components
from clipgrain.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def rows():
    return documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With columns whose names clash with those the operators use."""
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return df.withColumns({c: F.lit("clash") for c in ("id", "key", "fp", "tokens", "size", "anchor", "kept", "h1", "n", "node", "spans", "host", "path")})


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def odd(spark, rows):
    """Rows that repeat a doc_id, and rows without one."""
    return spark.createDataFrame([*rows[:12], rows[0], (None, rows[1][1], "en", "src0", 1), (None, "no id", "en", None, 1), (None, None, None, None, None)], SCHEMA)


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


# 1. Quality


def test_quality_on_labels(spark, small):
    labels = spark.read.parquet(f"{small.replace('0.001', '0.01')}/labels.parquet")
    docs = spark.read.parquet(f"{small.replace('0.001', '0.01')}/documents.parquet")
    got = quality.classify(docs).join(labels, "doc_id").collect()
    right = sum(r["kept"] == bool(r["quality"]) for r in got) / len(got)
    clean_kept = sum(r["kept"] for r in got if r["quality"]) / sum(r["quality"] for r in got)
    assert right > 0.97 and clean_kept > 0.98


# 2. WARC


def test_warc_round_trip(spark, tmp_path):
    pages = [(i, f"http://h/{i}", f"<p>é{i}</p>\r\n" * i) for i in range(5)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    texts = df.select(warc.record_text(F.col("page_id"), F.col("url"), F.col("html")).alias("t")).collect()
    (tmp_path / "a.warc").write_bytes("".join(r["t"] for r in texts).encode())
    got = warc.read_warc(spark, str(tmp_path)).orderBy("offset").collect()
    assert [(r["record_id"], r["uri"], bytes(r["payload"]).decode()) for r in got] == [(f"urn:page:{i}", u, h) for i, u, h in pages]


def test_warc_audit(spark):
    pages = [(i, f"http://h/{i}", f"page {i} " * (i % 7 + 1)) for i in range(3000)] + [(None, None, None), (5000, None, None), (5000, None, None)]
    other = [(i, u, "X" + h[1:] if i == 7 else h[:-1] if i == 2100 else h) for i, u, h in pages if i != 1500] + [(9000, "http://h/9000", "extra")]
    schema = "page_id long, url string, html string"
    first, second = (warc.records(spark.createDataFrame(p, schema)) for p in (pages, other))
    got = {r["record_id"]: r["kind"] for r in warc.audit(first, second).collect()}
    assert got == {7: "payload", 2100: "length", 1500: "missing", 9000: "extra"}
    assert warc.audit(first, first).collect() == [] and warc.audit(first.limit(0), second.limit(0)).collect() == []


# 3. N-gram join


@pytest.mark.parametrize(("n", "num", "den"), [(3, 90, 100), (5, 80, 100), (1, 60, 100)])
def test_ngram_join_against_all_pairs(docs, rows, n, num, den):
    got = by_id(ngram_join.components(docs, n, (num, den)), "n_shingles", "component_id")
    small = {k: v for k, v in similar_components([(r[0], r[1]) for r in rows], n, num, den).items()}
    assert {k: (v[0], v[1]) for k, v in got.items()} == small


def test_ngram_join_with_heavy_shingles_and_stars(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HEAVY_AT", 3)
    monkeypatch.setattr(ngram_join, "REPORT_FROM", 2)
    monkeypatch.setattr(ngram_join, "PARTNERS", 3)
    r = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(70):
        w = list(base)
        for _ in range(r.randint(0, 9)):
            w[r.randrange(60)] = f"x{r.randrange(40)}"
        rows.append((i, " ".join(w)))
    got = by_id(ngram_join.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), 2, (80, 100)), "n_shingles", "component_id")
    assert got == similar_components(rows, 2, 80, 100)


def test_ngram_join_cases(none, odd):
    assert ngram_join.components(none).collect() == []
    got = ngram_join.components(odd).collect()
    assert len(got) == 16 and sum(r["component_id"] is None for r in got) == 3
    assert ngram_join.keep_one(odd).columns == odd.columns


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(100, 200 + i) for i in range(50)] + [(None, 3), (5, 5)]
    got = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent: dict = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in list(parent)}


# 4. Repeated passages


def test_repeats_against_all_windows(docs, rows):
    got = by_id(suffix_dedup.remove_repeats(docs, 100), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == repeats_removed([(r[0], r[1]) for r in rows], 100)


@pytest.mark.parametrize(("length", "letters", "shard"), [(12, "ab", 1 << 20), (12, "abc", 200), (20, "abé \n", 500)])
def test_repeats_in_repetitive_texts(spark, length, letters, shard):
    r = random.Random(5)
    bases = ["".join(r.choice(letters) for _ in range(r.randint(0, 500))) for _ in range(10)]
    rows = []
    for i in range(90):
        t, kind = r.choice(bases), r.random()
        if kind < 0.3:
            k = r.randint(0, len(t))
            t = t[:k] + "".join(r.choice(letters) for _ in range(5)) + t[k:]
        elif kind < 0.4:
            t = "a" * r.randint(0, 300)
        rows.append((i * 2, t))
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), length, shard_bytes=shard)
    assert by_id(got, "n_bytes", "n_removed", "n_spans", "kept_sha256") == repeats_removed(rows, length)


def test_repeats_cases(none, odd):
    assert suffix_dedup.remove_repeats(none).collect() == []
    got = suffix_dedup.remove_repeats(odd, with_text=True).collect()
    assert len(got) == 12 + 1 + 3 and all(hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"] for r in got)


def test_run_length_index():
    index = suffix_dedup.RunLengthIndex([b"abracadabra", b"abracad"], 8)
    assert sorted(index.repeats()) == []
    index = suffix_dedup.RunLengthIndex([b"0123456789", b"x12345678x"], 8)
    assert index.repeats().tolist() == [12]
    assert index.matches([b"zz01234567zz12345678", b"9876"]).nonzero()[1].tolist() == [2, 12]


# 5. Licences


def dice(a, b):
    pairs = lambda t: {p for w in [re.sub(r"[\W_]+", " ", t.lower()).split()] for p in zip(w, w[1:], strict=False)}
    a, b = pairs(a), pairs(b)
    return 2 * len(a & b) / (len(a) + len(b)) if a and b else 0.0


def test_license_scan_against_all_templates(spark):
    r = random.Random(2)
    texts = [None, "", "All", "All rights reserved.", "nothing here", "Intro line\n  ALL RIGHTS   RESERVED!\nend", "Licensed under the Apache License, Version 2.0.\n" * 3]
    for _, t in licenses.TEMPLATES:
        w = t.split()
        for drop in (0, 1, 2, len(w) // 8, len(w) // 3):
            keep = [x for i, x in enumerate(w) if i not in set(r.sample(range(len(w)), min(drop, len(w) - 1)))]
            texts.append("before\n" + " ".join(keep) + "\nafter words here")
            texts.append(" ".join(keep))
    want = {}
    for i, t in enumerate(texts):
        for line, unit in enumerate([t or "", *(t or "").split("\n")]):
            best = max(((dice(unit, body), -k) for k, (_, body) in enumerate(licenses.TEMPLATES)), default=(0, 0))
            if best[0] >= licenses.THRESHOLD:
                want[i, line] = (-best[1], round(best[0], 6))
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {(r["doc_id"], r["line"]): (r["template"], r["dice"]) for r in got.collect()} == want


def test_license_cases(docs, none, odd):
    assert licenses.scan(none).collect() == [] and licenses.scan(docs, templates=[]).collect() == []
    assert licenses.scan(odd).collect() == []
    assert [tuple(r) for r in licenses.scan(docs, [("X", "two words")]).orderBy("doc_id", "line").collect()] == [(d, n, "X", 0, 1.0) for d in (908, 909) for n in (0, 1)]


# 6. Exact dedup


def test_exact_dedup_against_grouping(docs, rows):
    normal = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t, *_ in rows}
    groups: dict = {}
    for i, t in normal.items():
        groups.setdefault(t, []).append(i)
    want = {i: (min(groups[t]), len(groups[t]), i == min(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in normal.items()}
    assert by_id(exact_dedup.group_exact(docs), "keep_id", "group_size", "kept", "text_sha256") == want


def test_exact_dedup_cases(none, odd, docs):
    assert exact_dedup.group_exact(none).collect() == []
    got = exact_dedup.group_exact(odd).collect()
    assert len(got) == 16 and sum(r["kept"] for r in got if r["doc_id"] is None) == 2
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns and sum(r["doc_id"] == 1 for r in kept.collect()) <= 1


@pytest.mark.parametrize("bits", [8, 20])
def test_quotient_filters_merge_without_loss(bits):
    r = np.random.default_rng(0)
    fp = r.integers(0, 1 << (64 - bits), 5000, dtype=np.uint64) >> np.uint64(r.integers(0, 30))
    parts = np.array_split(np.concatenate([fp, fp[:700], fp[:30], fp[:1].repeat(400)]), 5)
    filters = []
    for p in parts:
        v, c = np.unique(p, return_counts=True)
        filters.append(exact_dedup.QuotientFilter.unpack(exact_dedup.QuotientFilter.of(v, c, 64 - bits - exact_dedup.SLOT_BITS).pack()))
    total = exact_dedup.QuotientFilter.merged(filters)
    v, c = np.unique(np.concatenate(parts), return_counts=True)
    assert (total.fingerprints() == v).all() and (total.counts == c).all()


def test_repeated_fingerprints_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BLOCK_ROWS", 1)
    monkeypatch.setattr(exact_dedup, "HELD", 50)
    values = [(v * 7919 - 4000,) for v in range(500)] * 2 + [(5,), (-(2**63),), (2**63 - 1,), (2**63 - 1,)]
    df = spark.createDataFrame(values, "fp long").repartition(3)
    got = {r["fp"]: r["copies"] for r in exact_dedup.repeated_fingerprints(df).collect()}
    assert got == {v * 7919 - 4000: 2 for v in range(500)} | {2**63 - 1: 2}


def test_fingerprint_collisions_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a ")], "doc_id long, text string")
    got = by_id(exact_dedup.group_exact(df.union(spark.createDataFrame([(4, "a")], df.schema))), "keep_id", "group_size")
    assert got == {1: (1, 2), 2: (2, 1), 3: (3, 1), 4: (1, 2)}


# 7. URL filters

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("www.example.com", "/en/x", "block"), ("net", "/es/", "block"), ("a.b.net", "/", "allow"), ("net", "/es/deep/er", "allow"), ("example.com", "", "block")]


def judge(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest)[0]
    path = re.split(r"[?#]", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best[2] if best else None, best[3] if best else "allow"


@pytest.mark.parametrize("per_sweep", [200_000, 2])
def test_url_filter_against_all_rules(spark, per_sweep):
    r = random.Random(1)
    hosts = ["example.com", "WWW.Example.com", "x.www.example.com", "badexample.com", "com", "a.b.net", "c.a.b.net", "b.net", "net", "ünï.org", "", "a..net", "example.com."]
    urls = [f"{r.choice(['http', 'https', 'x'])}://{r.choice(hosts)}{r.choice(['', '/', '/en/', '/en/x1', '/EN/', '/es/deep/er/1', '/es/'])}{r.choice(['', '?a=://b/en/', '#top', '?q'])}" for _ in range(400)]
    urls += [None, "", "no scheme", "http:/one", "://", "a://b://c/en/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("key", F.lit(1)).repartition(7)
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = url_filter.filter_urls(pages, rules, rules_per_sweep=per_sweep)
    assert {r["page_id"]: tuple(r)[1:] for r in got.collect()} == {i: judge(u, RULES) for i, u in enumerate(urls)}


def test_url_filter_cases(spark):
    pages = spark.createDataFrame([(1, "http://a.com/"), (1, "http://a.com/"), (None, None)], "page_id long, url string")
    rules = spark.createDataFrame([("com", "/", "allow"), ("com", "/", "block"), (None, "/", "block")], "host string, path string, verdict string")
    assert sorted(r["verdict"] for r in url_filter.filter_urls(pages, rules).collect()) == ["allow", "block", "block"]
    assert url_filter.filter_urls(pages.limit(0), rules).collect() == []
    many = rules.crossJoin(spark.range(12)).drop("id")
    assert sorted(r["verdict"] for r in url_filter.filter_urls(pages, many, rules_per_sweep=2).collect()) == ["allow", "block", "block"]
    assert {r["verdict"] for r in url_filter.filter_urls(pages, rules.limit(0)).collect()} == {"allow"}


# 8. Packing


@pytest.mark.parametrize("sequence", [2048, 37])
def test_packing_round_trip(docs, rows, sequence):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t, *_ in rows}
    pieces = packing.pack(docs, tokenizer_path(), sequence, keep_ids=True).collect()
    found: dict = {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["start"] == len(found.setdefault(p["doc_id"], [])) and p["length"] == len(p["ids"]) and p["doc_tokens"] == len(want[p["doc_id"]])
        assert p["ids_crc32"] == zlib.crc32(np.array(p["ids"], "<u4").tobytes())
        found[p["doc_id"]] += p["ids"]
    assert found == want
    fill: dict = {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == fill.get(p["sequence_id"], 0)
        fill[p["sequence_id"]] = p["offset"] + p["length"]
    assert [v for k, v in sorted(fill.items())][:-1] == [sequence] * (len(fill) - 1) and sorted(fill) == list(range(len(fill)))


def test_packing_cases(none, odd):
    assert packing.pack(none, tokenizer_path()).collect() == []
    got = packing.pack(odd, tokenizer_path()).collect()
    assert sum(r["start"] == 0 for r in got) == 16
    assert packing.padded(1024, 2048) == 1024 and packing.padded(1025, 2048) == 2048


def test_word_encoder_forgets(monkeypatch):
    from tokenizers import Tokenizer

    from clipgrain.llm.textops import bytes_of

    monkeypatch.setattr(packing, "KNOWN_WORDS", 20)
    import pyarrow as pa

    texts = [t or "" for _, t, *_ in documents(3, 20)] + ["7 a7b 77", "<|endoftext|>x <|startoftext|>"]
    encoder, plain = packing.WordEncoder(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    for t in texts:
        ids, first = encoder.ids(*bytes_of(pa.array([t])))
        assert ids[first[0] : first[1]].tolist() == plain.encode(t, add_special_tokens=False).ids


# 9. Top-k


def test_top_k_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES_PER_BLOCK", 100)
    r = np.random.default_rng(2)
    vectors = [(i, [float(x) for x in np.round(r.normal(size=6), 1)]) for i in range(400)] + [(i, [1.0] * 6) for i in range(400, 430)]
    bad = [(500, None), (501, []), (502, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (503, [float("nan")] * 6), (504, [float("inf")] + [0.0] * 5), (None, [1.0] * 6), (505, [2.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in vectors + bad], "vec_id long, embedding array<double>, score string").repartition(5)
    good = {i: np.floor(64 * np.array(v + [0.0] * (6 - len(v)))) for i, v in [*vectors, (505, [2.0])]}
    got: dict = {}
    for row in topk.top_k(df, F.col("vec_id") % 20 == 0, 9).collect():
        got.setdefault(row["query_id"], []).append((row["rank"], row["vec_id"], row["score"]))
    for q in (i for i in good if i % 20 == 0):
        best = sorted((-int(good[q] @ good[c]), c) for c in good if c != q)[:9]
        assert sorted(got[q]) == [(k + 1, c, -s) for k, (s, c) in enumerate(best)]
    assert set(got) == {i for i in good if i % 20 == 0}


def test_top_k_cases(spark):
    schema = "vec_id long, embedding array<double>"
    big = spark.createDataFrame([(0, [1e17, 1.0]), (1, [1.0, 1.0]), (2, [2.0, 3.0]), (2, [2.0, 3.0])], schema)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(big, F.col("vec_id") == 0).collect()}
    top = 2**63 - 1  # all three are beyond 64 bits
    assert got == {(0, 1): (1, top), (0, 2): (2, top), (0, 3): (2, top)}
    assert topk.top_k(big.limit(0), F.col("vec_id") == 0).collect() == []
    assert topk.top_k(big, F.lit(False)).collect() == []


# 10. Mixing


def test_mixing_weights(spark):
    r = random.Random(0)
    rows = [(i, f"s{min(9, int(r.expovariate(0.5)))}", " ".join(["w"] * r.randint(1, 40))) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    have = {r["source"]: r["t"] for r in df.groupBy("source").agg(F.sum(mixing.words(F.col("text"))).alias("t")).collect()}
    total = sum(have.values())
    for options in ({"target_entropy": 0.97}, {"max_repetition": 2.0}):
        drawn = mixing.mix(df, budget=2 * total, **options)
        a = mixing.temperature(df.groupBy("source").agg((F.sum(mixing.words(F.col("text"))) / total).alias("share")), **options)
        z = sum((t / total) ** a for t in have.values())
        weights = {s: (t / total) ** a / z for s, t in have.items()}
        got = {r["source"]: r["t"] for r in drawn.groupBy("source").agg(F.sum("tokens").alias("t")).collect()}
        assert all(0 <= weights[s] * 2 * total - got.get(s, 0) <= 42 for s in have)
        if "target_entropy" in options:
            assert abs(-sum(w * np.log(w) for w in weights.values()) / np.log(len(weights)) - 0.97) < 1e-4
        else:
            times = {s: weights[s] * 2 * total / have[s] for s in have}
            assert max(times.values()) / min(times.values()) == pytest.approx(2.0, abs=1e-3)
        block = {(r["block"], r["source"]): r["t"] for r in drawn.groupBy("block", "source").agg(F.sum("tokens").alias("t")).collect()}
        big = max(have, key=have.get)
        assert len({b for b, _ in block}) > 90 and np.std([v for (b, s), v in block.items() if s == big]) < np.mean([v for (b, s), v in block.items() if s == big])


def test_mixing_uses_every_document_and_whole_passes(docs, rows):
    drawn = mixing.mix(docs, max_repetition=1.5).collect()
    epochs: dict = {}
    for r in drawn:
        epochs.setdefault(r["doc_id"], []).append(r["epoch"])
    assert set(epochs) == {r[0] for r in rows} and all(sorted(e) == list(range(len(e))) and len(e) <= 2 for e in epochs.values())


def test_mixing_cases(none, odd, docs):
    assert mixing.mix(none, max_repetition=2.0).collect() == [] and mixing.mix(none, target_entropy=0.9).collect() == []
    assert mixing.mix(odd).count() >= 16
    for df in (odd, docs):
        out = mixing.mixed_documents(df, max_repetition=1.5)
        assert out.columns == df.columns and out.count() == mixing.mix(df, max_repetition=1.5).count()
    with_small_buckets = mixing.BUCKET_ROWS
    try:
        mixing.BUCKET_ROWS = 2
        small = sorted(map(tuple, mixing.mix(docs, max_repetition=1.5).collect()))
    finally:
        mixing.BUCKET_ROWS = with_small_buckets
    assert small == sorted(map(tuple, mixing.mix(docs, max_repetition=1.5).collect()))
