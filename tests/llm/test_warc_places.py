from collections import Counter

from clipgrain.llm import warc

SCHEMA = "page_id long, url string, html string"


def audited(spark, pages, other):
    got = warc.audit(*(warc.records(spark.createDataFrame(p, SCHEMA)) for p in (pages, other))).collect()
    return sorted((r["record_id"], r["kind"]) for r in got)


def test_null_ids_and_copies_keep_to_their_places(spark):
    pages = [(None, f"http://n/{i}", f"null {i}") for i in range(10_000)]
    pages += [(i, f"http://h/{i}", f"page {i} copy {k}") for i in range(2500) for k in range(5)]
    pages += [(None, None, None)] * 300
    other = [p for p in pages if p != (7, "http://h/7", "page 7 copy 2")]
    other = [(i, u, "X" + h[1:] if h in ("null 77", "page 1100 copy 3") else h) for i, u, h in other]
    other += [(-5, "http://e/5", "extra"), (2100, "http://e/6", "extra")] + [(None, "http://e/7", f"extra {k}") for k in range(3000)]
    found = audited(spark, pages, other)
    # The damaged record without id is paired with one of 3001 that have no id either; the others are extra.
    assert Counter(k if k == "extra" else "paired" for i, k in found if i == -1) == {"extra": 3000, "paired": 1}
    assert [x for x in found if x[0] != -1] == [(-5, "extra"), (7, "missing"), (1100, "payload"), (2100, "extra")]
    assert audited(spark, pages, pages) == []


def damaged(pages, other, per_archive=warc.ARCHIVE_RECORDS // 4):
    """Brute force: per archive and record id the records without an equal, with their places, paired in order of digest; extras are what is left."""
    import hashlib

    def record(page):
        i, url, html = page
        body = html or ""
        head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{'' if i is None else i}>\r\nWARC-Target-URI: {url or ''}\r\nContent-Length: {len(body.encode())}\r\n\r\n"
        raw = (head + body + "\r\n\r\n").encode()
        return hashlib.sha256(raw).hexdigest(), len(raw)

    archives, theirs, out = {}, {}, []
    key = lambda page: -1 if page[0] is None else page[0]
    for page in pages:
        archives.setdefault(max(key(page) // per_archive, 0), []).append((key(page), *record(page)))
    for page in other:
        theirs.setdefault(key(page), []).append(record(page))
    mine = {}
    for archive, held in archives.items():
        at = 0
        for ordinal, (i, digest, length) in enumerate(sorted(held)):
            mine.setdefault(i, []).append((digest, length, archive, ordinal, at))
            at += length
    for i in set(mine) | set(theirs):
        both = Counter(theirs.get(i, []))
        left = []
        for x in mine.get(i, []):
            if both[x[:2]]:
                both[x[:2]] -= 1
            else:
                left.append(x)
        right = sorted(both.elements())
        for k in range(max(len(left), len(right))):
            x, y = left[k] if k < len(left) else None, right[k] if k < len(right) else None
            kind = "missing" if y is None else "extra" if x is None else "payload" if x[1] == y[1] else "length"
            out.append((x[2] if x else max(i // per_archive, 0), x and x[3], x and x[4], x and x[1], i, kind, x and x[0], y and y[0]))
    return sorted(out, key=str)


def test_against_brute_force_and_only_below_differences(spark, monkeypatch):
    pages = [(i, f"http://h/{i}", f"page {i}") for i in range(-5000, 3000)] + [(None, None, None), (None, "u", "v" * 100_000)]
    pages += [(77, "http://h/77", f"copy {k}") for k in range(4)] + [(88, None, "same")] * 3 + [(2**40, None, "far"), (-(2**40), None, "far below")]
    gone = {("page -8",), ("page 2999",)}
    other = [(i, u, "X" + h[1:] if h in ("page -4999", "copy 2") else h and h + "!" if h == "page 1023" else h) for i, u, h in pages if (h,) not in gone]
    other += [(77, "http://h/77", f"more {k}") for k in range(5000)] + [(88, None, "same"), (-9000, None, None)]
    read, children = [], warc._children
    monkeypatch.setattr(warc, "_children", lambda level, differ, *a: read.append((children(level, differ, *a).count(), differ.count())) or children(level, differ, *a))
    clash = lambda rows: spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS archive", "2 AS leaf", "3 AS digest", "4 AS `offset`")
    first, second = warc.records(clash(pages)), warc.records(clash(other))
    columns = ("archive", "ordinal", "offset", "length", "record_id", "kind", "digest_first", "digest_second")
    audit = lambda a, b: sorted((tuple(r[c] for c in columns) for r in warc.audit(a.selectExpr("*", "1 AS up"), b.selectExpr("*", "2 AS at")).collect()), key=str)
    assert audit(first, second) == damaged(pages, other)
    # Of either replica no more than the children of nodes that differ, and these are few.
    assert read and all(n <= 2 * warc.FAN_OUT * k for n, k in read) and sum(n for n, _ in read) < 1500
    read.clear()
    assert audit(first, first) == [] and sum(n for n, _ in read) == 0
    for one, two in ((first, first.limit(0)), (first.limit(0), first)):
        assert len(audit(one, two)) == len(pages)


def test_copies_of_one_id_are_placed_and_paired(spark):
    pages = [(5, None, f"copy {k % 40}") for k in range(200)] + [(6, None, "x")]
    other = [(5, None, f"copy {k % 40}") for k in range(120)] + [(5, None, "new")] * 3 + [(6, None, "x")]
    got = warc.audit(*(warc.records(spark.createDataFrame(p, SCHEMA)) for p in (pages, other))).collect()
    columns = ("archive", "ordinal", "offset", "length", "record_id", "kind", "digest_first", "digest_second")
    assert sorted((tuple(r[c] for c in columns) for r in got), key=str) == damaged(pages, other)


def test_only_the_rows_of_differing_ids_meet_one_by_one(spark):
    pages = [(i, None, f"page {i}") for i in range(20_000)]
    other = [(i, u, "y" if i in (3, 19_000) else h) for i, u, h in pages]
    side = lambda rows, k: warc.records(spark.createDataFrame(rows, SCHEMA)).selectExpr(f"{k} AS side", "archive", "record_id", "length", "unhex(digest) AS digest")
    rows = side(pages, 0).union(side(other, 1))
    found = sorted(tuple(r)[:3] for r in warc.descend(rows).collect())
    assert found == [(0, 3, 3), (18, 19_000, 19_000 - 18 * 1024)]
    inner, outer = warc.tree(rows)
    top = {r["side"]: r for r in outer[-1].collect()}
    assert [top[k]["n"] for k in (0, 1)] == [20_000, 20_000] and top[0]["bytes"] - top[1]["bytes"] == 15  # both payloads are one byte now, and one length has a digit less
    most = [level.groupBy("side", *(["archive"] if "archive" in level.columns else [])).count().agg({"count": "max"}).first()[0] for level in (*inner, *outer)]
    assert most[-1] == 1
