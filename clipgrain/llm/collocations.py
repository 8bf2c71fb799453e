"""Phrase collocations by marginalising the longest windows.

Every word begins one window of ``longest`` words, padded where its piece ends, so an
occurrence of a shorter phrase is a window's prefix. Windows are lead columns of a
chunk's words (ids, shifted by one place each), and only they are counted. All counts
of shorter phrases are sums of window counts: those of heads (all but a window's last
word) are made where a head's windows meet, and Spark's ROLLUP sums what each task
finds for shorter prefixes down to words and the language's total.

A task counts the windows of a chunk of texts, puts them in order and sends them in
compressed blocks, one for each bucket of heads, as most windows occur once and a row
each would be many times larger. A head that holds a large share of a chunk's windows
sends only its sum to its bucket, and its windows to buckets of their own. The bucket
then passes on what other chunks sent it of that head, and both meet in a last sum, so
that no bucket gets more than a bounded share of any chunk for one head.

What can't be part of a phrase that occurs often enough is left out after the sums;
the parts of a phrase occur at least as often as the phrase itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipgrain.llm.common import checkpoint, written
from clipgrain.llm.textops import _LOWER, bytes_of, equal_spans, mix64, slices, span_hashes, word_bounds

LONGEST = 3
LEAST = 10
TOP = 2000
#: A phrase goes if one that holds it occurs at least this share of its times, in percent.
COVERED = 50
SCALE = 1_000_000
#: Bytes of text whose windows are counted together, or one longer text.
CHUNK_BYTES = 6 << 20
#: Windows of a bucket that are summed at once.
SUMMED_AT_ONCE = 1 << 18
#: A head is spread that has over one in so many of a chunk's windows, and over HOT_WINDOWS.
HOT_SHARE, HOT_WINDOWS = 4096, 256
#: First picks of the top rows are made in so many parts of a language.
PARTS = 64
OUT_ROWS = 1 << 16
#: What a block holds: windows by head, sums of spread heads, windows of spread heads.
WINDOWS, SUMS, SPREAD = 0, 1, 2
#: What a row of the counts is, besides the number of a phrase's words.
_SHORTER, _SPREAD = -1, -2

_ENDS = np.zeros(256, bool)
_ENDS[list(b".,;:!?\n\x0b\f\r")] = True
_PARTING = _ENDS.copy()
_PARTING[list(b" \t")] = True


def _names(longest: int) -> list[str]:
    return [f"w{i}" for i in range(1, longest + 1)]


def _word_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, langs: np.ndarray, salts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An id from 1 for each word's language and bytes, the first word of each id, and a hash of each id's content.

    ``salts`` has a hash of each language. Words are found by hash and compared by their bytes.
    """
    hashes = span_hashes(data, starts, ends) ^ salts[langs]
    _, at, ids = np.unique(hashes, return_index=True, return_inverse=True)
    if not ((langs[at][ids] == langs).all() and equal_spans(data, starts, ends, data, starts[at][ids], ends[at][ids]).all()):
        raw, known = data.tobytes(), {}  # different words hash alike
        ids = np.array([known.setdefault((lang, raw[a:b]), len(known)) for lang, a, b in zip(langs.tolist(), starts.tolist(), ends.tolist(), strict=True)], np.int64)
        _, at = np.unique(ids, return_index=True)
    return ids + 1, at, hashes[at]


def _summed(columns: list[np.ndarray], n: np.ndarray, base: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of columns of ids below ``base``, in order, and the sum of ``n`` over each."""
    if not len(n):
        return columns, n
    if base ** len(columns) < 2**63:
        key = reduce(lambda k, c: k * base + c, columns)
        order = np.argsort(key, kind="stable")
        rows, key = [c[order] for c in columns], key[order]
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
    else:
        order = np.lexsort(columns[::-1])
        rows = [c[order] for c in columns]
        fresh = np.concatenate(([True], np.any([c[1:] != c[:-1] for c in rows], axis=0)))
    first = np.flatnonzero(fresh)
    return [c[first] for c in rows], np.add.reduceat(n[order], first)


def _runs_of(columns: list[np.ndarray]) -> np.ndarray:
    """Where a new row begins in sorted columns."""
    return np.flatnonzero(np.concatenate(([True], np.any([c[1:] != c[:-1] for c in columns], axis=0)))) if len(columns[0]) else np.zeros(0, np.int64)


def _encode(words: pa.Array, columns: list[np.ndarray], n: np.ndarray) -> bytes:
    """Rows of ids (0 is the pad) as a block with the words they use; words and rows in order compress best."""
    used = np.unique(np.concatenate(columns))
    used = used[used > 0]
    local = [np.where(c > 0, np.searchsorted(used, c) + 1, 0) for c in columns]
    texts, off = bytes_of(words.take(pa.array(used)))
    numbers = np.concatenate([np.diff(local[0], prepend=0).astype("<i4").view("<u4"), *(c.astype("<u4") for c in local[1:])])
    planes = lambda x, size: np.ascontiguousarray(x.view(np.uint8).reshape(-1, size).T).tobytes()
    head = np.array([len(used), len(columns), len(n), len(texts)], "<u4").tobytes()
    return zstandard.compress(b"".join([head, planes(np.diff(off).astype("<u4"), 4), texts.tobytes(), planes(numbers, 4), planes(n.astype("<u8"), 8)]))


def _decode(block: bytes | pa.Buffer) -> tuple[pa.Array, list[np.ndarray], np.ndarray]:
    raw = zstandard.decompress(block)
    own, width, rows, size = np.frombuffer(raw, "<u4", 4).tolist()
    planes = lambda wide, many, start: np.ascontiguousarray(np.frombuffer(raw, np.uint8, wide * many, start).reshape(wide, many).T).reshape(-1)
    at = 16 + 4 * own
    off = np.concatenate(([0], np.cumsum(planes(4, own, 16).view("<u4")))).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), own, [None, pa.py_buffer(off), pa.py_buffer(raw[at : at + size])])
    numbers = planes(4, width * rows, at + size).view("<u4").reshape(width, rows)
    columns = [np.cumsum(numbers[0].view("<i4"), dtype=np.int32), *(c.astype(np.int32) for c in numbers[1:])]
    return words, columns, planes(8, rows, at + size + 4 * width * rows).view("<i8")


def _count(langs: pa.Array, texts: pa.Array, longest: int, buckets: int, hot: tuple[int, int] = (HOT_SHARE, HOT_WINDOWS)):
    """``bucket, kind, block`` of the counted windows of some texts; ``hot`` says when a head is spread. A word's entry in a block is its bytes, a line end and its language."""
    data, off = bytes_of(texts)
    data = _LOWER[data]
    starts, ends, first = word_bounds(data, off, _PARTING)
    if not len(starts):
        return
    codes = langs.dictionary_encode()
    names = [x.encode() for x in codes.dictionary.to_pylist()]
    salts = np.array([int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little") for x in names], np.uint64)
    texts_of = np.repeat(np.arange(len(off) - 1), np.diff(first))
    lang = codes.indices.to_numpy(zero_copy_only=False)[texts_of]
    ids, at, hashes = _word_ids(data, starts, ends, lang, salts)
    passed = np.concatenate(([0], np.cumsum(_ENDS[data], dtype=np.int32)))
    goes_on = np.append((texts_of[1:] == texts_of[:-1]) & (passed[starts[1:]] == passed[ends[:-1]]), False)
    columns, live = [ids], np.ones(len(ids), bool)
    for i in range(1, longest):
        live = live & np.append(goes_on[i - 1 :], np.zeros(i - 1, bool))
        columns.append(np.where(live, np.append(ids[i:], np.zeros(i, ids.dtype)), 0))
    raw = data.tobytes()
    words = [raw[a:b] + b"\n" + names[k] for a, b, k in zip(starts[at].tolist(), ends[at].tolist(), lang[at].tolist(), strict=True)]
    order = np.argsort(np.array(words, object))
    place = np.zeros(len(words) + 1, np.int64)
    place[order + 1] = np.arange(1, len(words) + 1)
    columns = [place[c] for c in columns]
    words, hashes = pa.array([b"", *(words[i] for i in order.tolist())], pa.binary()), hashes[order]
    columns, n = _summed(columns, np.ones(len(ids), np.int64), len(words))
    hashes = np.concatenate((np.zeros(1, np.uint64), hashes))
    fold = lambda part: reduce(lambda h, c: mix64(h * np.uint64(0xD6E8FEB86659FD93) + hashes[c]), part, np.zeros(len(part[0]), np.uint64)) % np.uint64(buckets)
    fresh = _runs_of(columns[:-1])
    held = np.diff(np.append(fresh, len(n)))
    spread = np.repeat((held * hot[0] > len(n)) & (held > hot[1]), held)
    sums, many = _summed([c[spread] for c in columns[:-1]], n[spread], len(words))
    for kind, part, counts in ((WINDOWS, [c[~spread] for c in columns], n[~spread]), (SUMS, sums, many), (SPREAD, [c[spread] for c in columns], n[spread])):
        if not len(counts):
            continue
        bucket = fold(part[:-1] if kind == WINDOWS else part)
        order = np.argsort(bucket, kind="stable")
        cuts = np.append(np.flatnonzero(np.concatenate(([True], np.diff(bucket[order]) > 0))), len(order))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            rows = order[a:b]
            yield int(bucket[rows[0]]), kind, _encode(words, [c[rows] for c in part], counts[rows])


def blocks(docs: DataFrame, longest: int = LONGEST) -> DataFrame:
    """``bucket, kind, block``: the padded windows of each chunk of texts with their counts, as many buckets as shuffles have partitions."""
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot, limit = (HOT_SHARE, HOT_WINDOWS), CHUNK_BYTES

    def run(batches):
        def sent(held):
            for bucket, kind, block in _count(*(pa.concat_arrays(c) for c in zip(*held, strict=True)), longest, buckets, hot):
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([kind], pa.int32()), pa.array([block], pa.binary())], ["bucket", "kind", "block"])

        held, size = [], 0
        for batch in batches:
            _, off = bytes_of(batch["text"])
            for a, b in slices(off, limit):
                if held and size + off[b] - off[a] > limit:
                    yield from sent(held)
                    held, size = [], 0
                held.append((batch["lang"].slice(a, b - a), batch["text"].slice(a, b - a)))
                size += off[b] - off[a]
        if held:
            yield from sent(held)

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    return rows.mapInArrow(run, "bucket int, kind int, block binary")


def _merge(longest: int, least: int):
    """The rows of a bucket's blocks: frequent windows and heads, sums of shorter prefixes, and all windows of spread heads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, parts, at = [], {WINDOWS: [], SUMS: [], SPREAD: []}, 0
        for batch in batches:
            for kind, block in zip(batch["kind"].to_pylist(), batch["block"], strict=True):
                words, columns, n = _decode(block.as_buffer())
                parts[kind].append((at, columns, n))
                entries.append(words)
                at += len(words)
        found = pa.chunked_array(entries).combine_chunks().dictionary_encode()
        entries.clear()
        known = np.concatenate(([0], found.indices.to_numpy() + 1)).astype(np.int32)
        base = len(found.dictionary) + 1
        whole = {}
        for kind, held in parts.items():
            width = longest - (kind == SUMS)
            columns = [np.concatenate([known[np.where(c[i] > 0, c[i] + start, 0)] for start, c, _ in held]) if held else np.zeros(0, np.int32) for i in range(width)]
            whole[kind] = columns, np.concatenate([n for *_, n in held]) if held else np.zeros(0, np.int64)
            held.clear()
        turns = -(-sum(len(n) for _, n in whole.values()) // SUMMED_AT_ONCE)
        for turn in range(turns):  # all rows of a head have their turn together
            own = {}
            for kind, (columns, n) in whole.items():
                now = reduce(lambda h, c: (h * 31 + c) % 1_000_003, columns[: longest - 1], np.zeros(len(n), np.int64)) % turns == turn
                own[kind] = _summed([c[now].astype(np.int64) for c in columns], n[now], base)
            for words, columns, counts in _sums(own, longest, least, base):
                for a in range(0, len(counts), OUT_ROWS):
                    yield _rows(found.dictionary, words, [c[a : a + OUT_ROWS] for c in columns], counts[a : a + OUT_ROWS], longest)

    return run


def _sums(own: dict, longest: int, least: int, base: int):
    """(kind of row, columns, sums) of some heads, with all their windows and sums."""
    (windows, n), (sums, many), (spread, spread_n) = (own[k] for k in (WINDOWS, SUMS, SPREAD))
    both, none, some = [np.concatenate(c) for c in zip(windows[:-1], sums, strict=True)], np.zeros, np.ones
    heads, total = _summed(both, np.concatenate((n, many)), base)
    _, held = _summed(both, np.concatenate((some(len(n), np.int64), none(len(many), np.int64))), base)
    _, marks = _summed(both, np.concatenate((none(len(n), np.int64), some(len(many), np.int64))), base)
    passed_on = np.repeat(marks > 0, held)  # other chunks spread their windows
    often, frequent = ~passed_on & (n >= least) & (windows[-1] > 0), (total >= least) & (heads[-1] > 0)
    yield longest, [c[often] for c in windows], n[often]
    yield longest - 1, [c[frequent] for c in heads], total[frequent]
    yield _SHORTER, *_summed(heads[: max(1, longest - 2)], total, base)
    yield _SPREAD, [c[passed_on] for c in windows], n[passed_on]
    yield _SPREAD, spread, spread_n


def _rows(entries: pa.Array, words: int, columns: list[np.ndarray], n: np.ndarray, longest: int) -> pa.RecordBatch:
    """Rows ``words, lang, w1 .. wN, n`` of ids over a dictionary of entries; columns that are left out are null."""
    used = np.unique(np.concatenate(columns))
    used = used[used > 0]
    pairs = [x.as_py().split(b"\n", 1) for x in entries.take(pa.array(used - 1))]
    texts, langs = pa.array([b"", *(w for w, _ in pairs)]).cast(pa.string()), pa.array([b"", *(g for _, g in pairs)]).cast(pa.string())
    local = [pa.array(np.where(c > 0, np.searchsorted(used, c) + 1, 0)) for c in columns]
    own = [texts.take(c) for c in local] + [pa.nulls(len(n), pa.string())] * (longest - len(columns))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), words, np.int32)), langs.take(local[0]), *own, pa.array(n)], ["words", "lang", *_names(longest), "n"])


def prefix_counts(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """``lang, words, w1 .. wN, n``: occurrences of all phrases of up to ``longest`` words that occur ``least`` times, and (words 0) of all words of a language. Kept."""
    names = _names(longest)
    schema = f"words int, lang string, {', '.join(f'{c} string' for c in names)}, n long"
    with written(blocks(docs, longest).groupBy("bucket").applyInArrow(_merge(longest, least), schema)) as rows:
        long = rows.where(F.col("words") >= longest - 1)
        spread = rows.where(F.col("words") == _SPREAD).groupBy("lang", *names).agg(F.sum("n").alias("n")).where((F.col("n") >= least) & (F.col(names[-1]) != ""))
        shorter = names[: longest - 2]
        rolled = rows.where(F.col("words") == _SHORTER).rollup("lang", *shorter).agg(F.sum("n").alias("n"), F.grouping_id().alias("g"))
        # The grouping id has a bit set for each column summed away: 2**k - 1 for a prefix that lacks k words.
        words = reduce(lambda rest, k: rest.when(F.col("g") == 2 ** (longest - 2 - k) - 1, k), range(1, longest - 1), F.when(F.col("g") == 2 ** (longest - 2) - 1, 0))
        rolled = rolled.withColumn("words", words)
        for k, name in enumerate(shorter, 1):
            rolled = rolled.where(~F.col("words").eqNullSafe(k) | (F.col(name) != ""))
        rolled = rolled.where((F.col("words") == 0) | ((F.col("words") > 0) & (F.col("n") >= least)))
        found = [long, spread.withColumn("words", F.lit(longest)), rolled.drop("g")]
        return checkpoint(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found).select("lang", "words", *names, "n"))


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(SCALE * a * a / (left * right)) in decimals of 38 digits, which hold for counts up to 3 * 10**15."""
    big = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", (big(a) * big(a)).cast("decimal(31,0)") * F.lit(SCALE).cast("decimal(7,0)"), big(left) * big(right))


def _part(names: list[str], length: int, name: str, table: DataFrame) -> DataFrame:
    """Counts of phrases of a length under other names, to be joined to longer ones by ``lang, names``."""
    return table.where(F.col("words") == length).select("lang", *[F.col(f"w{i + 1}").alias(c) for i, c in enumerate(names)], F.col("n").alias(name))


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, covered: int = COVERED) -> DataFrame:
    """The best phrases of two to ``longest`` words of each language: ``lang, rank, phrase, a, l, r, n, score``.

    ``a`` is how often the phrase occurs, ``l`` and ``r`` its parts at the weakest cut,
    ``n`` the language's words. A phrase that lies in a longer one which occurs
    ``covered`` percent of its times goes. Ranks are by score, then a, then phrase.

    Defined cases: null and empty texts have no words; a null language is ``und``, like
    one of that name; repeated rows count again; a text of any length is gone through
    whole; ties are broken by the phrase's bytes; an empty table gives no rows; other
    columns are ignored.
    """
    names = _names(longest)
    table = prefix_counts(docs, longest, least)
    total = table.where("words = 0").select("lang", F.col("n").alias("total"))
    scored = []
    for k in range(2, longest + 1):
        own = names[:k]
        rows = _part(own, k, "a", table)
        for cut in range(1, k):
            rows = rows.join(_part(own[:cut], cut, f"l{cut}", table), ["lang", *own[:cut]]).join(_part(own[cut:], k - cut, f"r{cut}", table), ["lang", *own[cut:]])
        cuts = F.array(*[F.struct(_score(F.col("a"), F.col(f"l{c}"), F.col(f"r{c}")).alias("score"), F.lit(c).alias("cut"), F.col(f"l{c}").alias("l"), F.col(f"r{c}").alias("r")) for c in range(1, k)])
        rows = rows.select("lang", *own, "a", F.array_min(cuts).alias("x"))
        inside = [table.where(F.col("words") == m).select("lang", *[F.col(f"w{at + i}").alias(c) for i, c in enumerate(own)], "n") for m in range(k + 1, longest + 1) for at in range(1, m - k + 2)]
        if inside:
            most = reduce(DataFrame.unionByName, inside).groupBy("lang", *own).agg(F.max("n").alias("most"))
            rows = rows.join(most, ["lang", *own], "left").where(F.col("most").isNull() | (100 * F.col("most") < covered * F.col("a")))
        scored.append(rows.select("lang", F.concat_ws(" ", *own).alias("phrase"), "a", F.col("x.l").alias("l"), F.col("x.r").alias("r"), F.col("x.score").alias("score")))
    found = reduce(DataFrame.unionByName, scored)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    first = F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))
    few = found.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).withColumn("_nth", first).where(F.col("_nth") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
