"""Repeated-passage removal with run-length indexes.

A byte goes if a string of ``length`` bytes that covers it also starts earlier in
the corpus. The corpus is parsed as for prefix-free parsing: in every window of
``length`` bytes the least hashed k-gram is its anchor, and the windows in a row
that share an anchor form one phrase. Equal windows have equal anchors, so only
phrases with the same anchor can hold them.

1. Phrases are shuffled by anchor, once per distinct phrase and slice of input. Of
   equal phrases all but the first go whole; an anchor with one phrase is done. The
   phrases of a large anchor are parted by further least k-grams of their windows,
   which equal windows share too.
2. Anchors with several phrases are indexed in shards: the first phrase of each
   anchor goes into a Burrows-Wheeler transform kept as runs, with text positions
   sampled at both ends of every run. All other phrases stream matching statistics
   through it from right to left; windows that match ``length`` bytes are marked.
3. What is left of those phrases gets an index of its own, in which windows fall
   into intervals of equal rows, and all but the earliest of an interval are marked.

Marked spans meet their text once more, to cut it and hash the rest.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipgrain.llm.numbering import ranked
from clipgrain.llm.common import checkpoint, small
from clipgrain.llm.textops import _BYTE_VALUE, _RATIO, _RATIO_INV, U64, block_hashes, bytes_of, mix64, powers, slices

#: Bytes of phrases that one index holds, about.
SHARD_BYTES = 900_000
#: Bytes of phrases beyond which those of one anchor are parted.
LARGE_ANCHOR = 450_000
#: Bytes that are parsed at once; small enough for the caches.
PARSE_BYTES = 1 << 18
_PLACE_BITS = 16


def _grams(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k bytes in a row."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[data] * powers(_RATIO, n), out=sums[1:])
    return mix64((sums[k:] - sums[:-k]) * powers(_RATIO_INV, n + 1)[: n - k + 1])


def _parted(data: np.ndarray, anchor: int, length: int, k: int, level: int):
    """(anchor, start, windows) of the parts of a phrase whose windows agree in their ``level`` least k-grams, which name them."""
    least = np.sort(np.lib.stride_tricks.sliding_window_view(_grams(data, k), length - k + 1), axis=1)[:, :level]
    name = np.full(len(least), np.int64(anchor).view(np.uint64))
    for column in least.T:
        name = mix64(name + column)
    first = np.flatnonzero(np.concatenate(([True], name[1:] != name[:-1])))
    return zip(name[first].view(np.int64).tolist(), first.tolist(), np.diff(np.append(first, len(name))).tolist(), strict=True)


def phrases(data: np.ndarray, offsets: np.ndarray, length: int, k: int):
    """(text, start, windows, anchor, phrase) arrays of all phrases of a slice.

    Anchors only say where equal windows meet. Phrases of an anchor are told apart by
    64 bits of a non-linear hash of all their bytes.
    """
    n, w = len(data), length - k + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    grams = _grams(data, k)
    least = (grams & U64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while span * 2 <= w:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[: n - length + 1], least[w - span : w - span + n - length + 1])
    at = (least & U64(0xFFFFFFFF)).astype(np.int64)
    ends = np.repeat(offsets[1:] - length, np.diff(offsets))[: len(at)]
    starts = np.flatnonzero(np.arange(len(at)) <= ends)
    if not len(starts):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    at = at[starts]
    # Starts of two texts are never next to each other, as the last ones of a text begin no window.
    first = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1))))
    count = np.diff(np.append(first, len(starts)))
    low, at = starts[first], at[first]
    text = np.searchsorted(offsets, low, side="right") - 1
    high = low + count - 1 + length
    phrase = block_hashes(data, low, high)
    return text, low - offsets[text], count, grams[at], phrase


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted, disjoint, non-touching spans with the same union."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], starts[1:] > ends[:-1])) if len(starts) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return starts[first], ends[np.append(first[1:], len(starts)) - 1] if len(first) else ends


class RunLengthIndex:
    """The run-compressed Burrows-Wheeler transform of some texts, each with an end of its own.

    Symbols are bytes plus one; 0 ends a text. ``positions`` of rows are kept for the
    ends of runs only, once the intervals have been taken.
    """

    def __init__(self, texts: list[bytes], length: int):
        self.length = length
        joined = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        stops = np.cumsum(sizes) - 1
        self.text = joined.astype(np.uint16) + np.uint16(1)
        self.text[stops] = 0
        self._sort(stops, sizes)

    def _sort(self, stops: np.ndarray, sizes: np.ndarray) -> None:
        """Rows by prefix doubling from four symbols on."""
        n = len(self.text)
        owner = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
        left = stops[owner] - np.arange(n)  # symbols before the end
        key, h = np.zeros(n, np.uint64), 4
        padded = np.concatenate([self.text, np.zeros(h, np.uint16)]).astype(np.uint64)
        for j in range(h):
            key = (key << U64(9)) | np.where(left >= j, padded[j : n + j], 0)
        rows, rank = self._ranked(key)
        half, have = rank, h  # ranks by the first `have` symbols, the most within `length`
        longest = int(left.max(initial=0)) + 1
        while True:
            # From its own end on a text compares by its number, so that rows are fully ordered.
            beyond = np.where(left >= h, rank[np.minimum(np.arange(n) + h, n - 1)] + len(sizes), owner)
            rows, rank = self._ranked((rank.astype(np.uint64) << U64(int(n + len(sizes)).bit_length())) | beyond.astype(np.uint64))
            if h > longest:
                break
            h *= 2
            if h <= self.length:
                half, have = rank, h
        self._half, self._have, self._left, self._rows = half, have, left, rows
        last = self.text[rows - 1]  # row 0 wraps round to an end
        begin = np.flatnonzero(np.concatenate(([True], last[1:] != last[:-1])))
        self.run_start, self.run_symbol = begin, last[begin].astype(np.int64)
        ends = np.append(begin[1:], n)
        self.run_end = ends - 1
        self.at_start, self.at_end = rows[begin], rows[ends - 1]
        by_symbol = np.argsort(self.run_symbol, kind="stable")
        lengths = (ends - begin)[by_symbol]
        # LF(row) = row + shift of its run: rows that follow one symbol keep their order.
        self.shift = np.zeros(len(begin), np.int64)
        self.shift[by_symbol] = np.cumsum(lengths) - lengths
        self.shift -= begin
        self.order, self.keys = by_symbol, self.run_symbol[by_symbol] * len(begin) + by_symbol
        self.padded = np.concatenate([self.text, np.zeros(self.length + 1, np.uint16)])

    @staticmethod
    def _ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows in key order (ties by position), and each position's rank; equal keys share one."""
        n = len(key)
        bits = n.bit_length()
        if not n or int(key.max()).bit_length() + bits <= 64:  # the position fits behind the key: a plain sort, which is the quicker
            ordered = np.sort((key << U64(bits)) | np.arange(n, dtype=np.uint64))
            rows = (ordered & U64((1 << bits) - 1)).astype(np.int64)
            ordered >>= U64(bits)
        else:
            rows = np.argsort(key, kind="stable")
            ordered = key[rows]
        rank = np.empty(n, np.int64)
        rank[rows] = np.cumsum(np.concatenate(([0], ordered[1:] != ordered[:-1])))
        return rows, rank

    def repeats(self) -> np.ndarray:
        """Positions whose next ``length`` symbols also start at an earlier position."""
        rows = self._rows
        rows = rows[self._left[rows] >= self.length]
        if not len(rows):
            return rows
        a, b = self._half[rows], self._half[rows + self.length - self._have]
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        first = np.minimum.reduceat(rows, np.flatnonzero(new))
        return rows[rows > first[np.cumsum(new) - 1]]

    def forget_rows(self) -> None:
        self._rows = self._half = self._left = None

    def matches(self, patterns: list[bytes]) -> np.ndarray:
        """A mask (pattern, start) of starts whose next ``length`` symbols occur in the texts.

        Matching statistics, capped at ``length``: all patterns move one symbol to the
        left at a time. A row whose preceding symbol differs jumps to the nearest run of
        the wanted symbol above or below, whichever matches longer there.
        """
        sizes = np.fromiter(map(len, patterns), np.int64, len(patterns))
        order = np.argsort(-sizes, kind="stable")
        sizes = sizes[order]
        width, runs = int(sizes.max(initial=0)), len(self.run_start)
        run_of = np.repeat(np.arange(runs, dtype=np.int32), np.diff(np.append(self.run_start, len(self.text))))
        # Symbols of the patterns from the right end on: column j is the j-th last.
        grid = np.zeros((width + self.length + 1, len(order)), np.uint16)
        joined = np.frombuffer(b"".join([patterns[p][::-1] for p in order.tolist()]), np.uint8)
        column = np.repeat(np.arange(len(order)), sizes)
        grid[np.arange(len(joined)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + self.length + 1, column] = joined.astype(np.uint16) + 1
        row, size, hit = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64), np.zeros((width, len(order)), bool)
        cols = np.arange(self.length)
        for step in range(1, width + 1):
            live = int(np.searchsorted(-sizes, -step, side="right"))
            want = grid[step + self.length, :live].astype(np.int64)
            run = run_of[row[:live]].astype(np.int64)
            off = np.flatnonzero(self.run_symbol[run] != want)
            if len(off):
                spot = np.searchsorted(self.keys, want[off] * runs + run[off])
                best, where = np.full(len(off), -1), np.zeros(len(off), np.int64)
                long = size[off] > 0  # what has matched so far; else any run will do
                for shift, sample, at_row in ((0, self.at_start, self.run_start), (-1, self.at_end, self.run_end)):
                    at = spot + shift
                    ok = np.flatnonzero((at >= 0) & (at < runs))
                    r = self.order[at[ok]]
                    fits = self.run_symbol[r] == want[off[ok]]
                    ok, r = ok[fits], r[fits]
                    common = np.zeros(len(ok), np.int64)
                    deep = np.flatnonzero(long[ok])
                    if len(deep):
                        ahead = grid[(step - 1 + self.length - cols)[None, :], off[ok[deep]][:, None]]
                        same = self.padded[sample[r[deep]][:, None] + cols] == ahead
                        common[deep] = np.minimum(np.where(same.all(axis=1), self.length, same.argmin(axis=1)), size[off[ok[deep]]])
                    better = common > best[ok]
                    best[ok[better]], where[ok[better]] = common[better], at_row[r[better]]
                row[off] = where
                size[off] = best  # -1: the symbol doesn't occur
                run[off] = run_of[where]
            row[:live] = np.where(size[:live] >= 0, row[:live] + self.shift[run], 0)
            size[:live] = np.minimum(size[:live] + 1, self.length)
            hit[step - 1, :live] = size[:live] >= self.length
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        steps = np.arange(width)[None, :]
        out = np.zeros((len(order), width), bool)
        at = sizes[back][:, None] - 1 - steps
        inside = at >= 0
        out[inside] = hit[at[inside], np.broadcast_to(back[:, None], at.shape)[inside]]
        return out


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, past) of the runs of true cells in each row of a mask."""
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, first = np.nonzero(edge == 1)
    return row, first, np.nonzero(edge == -1)[1]


class Shard:
    """Phrases of some anchors, in corpus order within each anchor; gives the spans to remove."""

    def __init__(self, length: int):
        self.length = length
        self.earlier: list[RunLengthIndex] = []  # of an anchor too large for one shard

    def resolve(self, anchors: list[int], docs: list[int], starts: list[int], texts: list[bytes], goes_on: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(doc, first, past) of windows that occur earlier. ``goes_on``: the one anchor has further phrases."""
        out: list[tuple[np.ndarray, ...]] = []
        anchor, doc, start = (np.array(x, np.int64) for x in (anchors, docs, starts))
        phrase = np.arange(len(texts))

        def mark(which: np.ndarray, first: np.ndarray, past: np.ndarray, doc, start) -> None:
            out.append((doc[which], start[which] + first, start[which] + past - 1 + self.length))

        def stream(index: RunLengthIndex, todo):
            """Mark what the index holds; the rest, as shorter phrases."""
            anchor, doc, start, phrase, texts = todo
            got = index.matches(texts)
            mark(*_runs(got), doc, start)
            last = np.fromiter(map(len, texts), np.int64, len(texts)) - self.length
            which, first, past = _runs(~got & (np.arange(got.shape[1]) <= last[:, None]))
            cut = [texts[i][a : b - 1 + self.length] for i, a, b in zip(which.tolist(), first.tolist(), past.tolist(), strict=True)]
            return anchor[which], doc[which], start[which] + first, phrase[which], cut

        def pick(todo, rows: np.ndarray):
            return (*(x[rows] for x in todo[:4]), [todo[4][i] for i in rows.tolist()])

        todo = (anchor, doc, start, phrase, texts)
        leads = pick(todo, np.zeros(0, np.int64))
        if self.earlier:  # all of one anchor: what came before is indexed already
            for index in self.earlier:
                todo = stream(index, todo) if len(todo[0]) else todo
        else:
            lead = np.concatenate(([True], anchor[1:] != anchor[:-1]))
            leads, todo = pick(todo, np.flatnonzero(lead)), pick(todo, np.flatnonzero(~lead))
            if len(todo[0]):
                todo = stream(RunLengthIndex(leads[4], self.length), todo)
        # Windows left over can only repeat those of another phrase of their anchor.
        pairs = np.unique(np.column_stack((todo[0], todo[3])), axis=0)
        names, count = np.unique(pairs[:, 0], return_counts=True)
        rest = pick(todo, np.flatnonzero(np.isin(todo[0], names[count > 1])))
        if len(rest[0]):
            index = RunLengthIndex(rest[4], self.length)
            begin = np.cumsum([0] + [len(t) + 1 for t in rest[4]])
            again = np.sort(index.repeats())
            if len(again):
                owner = np.searchsorted(begin, again, side="right") - 1
                cut = np.flatnonzero((np.diff(again) != 1) | (np.diff(owner) != 0))
                first, past = again[np.concatenate(([0], cut + 1))], again[np.append(cut, len(again) - 1)] + 1
                which = owner[np.concatenate(([0], cut + 1))]
                mark(which, first - begin[which], past - begin[which], rest[1], rest[2])
        if goes_on:
            kept = leads[4] + todo[4]
            if kept:
                self.earlier.append(RunLengthIndex(kept, self.length))
                self.earlier[-1].forget_rows()
        else:
            self.earlier = []
        return tuple(np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i in range(3))


_ROWS = "anchor long, phrase long, doc_id long, place long"


def _rows(anchor, phrase, doc, place, spans=None) -> pa.RecordBatch:
    """Phrases, and spans as rows without an anchor: phrase holds the span's end, place its start."""
    arrays = [np.asarray(anchor).view(np.int64), np.asarray(phrase).view(np.int64), np.asarray(doc, np.int64), np.asarray(place, np.int64)]
    valid = np.ones(len(arrays[0]), bool)
    if spans is not None:
        d, s, e = (np.asarray(x, np.int64) for x in spans)
        arrays = [np.concatenate(p) for p in zip(arrays, (np.zeros(len(d), np.int64), e, d, s), strict=True)]
        valid = np.concatenate([valid, np.zeros(len(d), bool)])
    columns = [pa.array(a) for a in arrays]
    columns[0] = pa.array(arrays[0], mask=~valid)
    return pa.RecordBatch.from_arrays(columns, ["anchor", "phrase", "doc_id", "place"])


def _parse(length: int, k: int):
    """Phrases of each slice, once each; what repeats a phrase of its slice is a span at once."""

    def run(batches):
        for batch in batches:
            ids = batch["doc_id"].to_numpy(zero_copy_only=False).astype(np.int64)
            data, off = bytes_of(batch["text"])
            for a, b in slices(off, PARSE_BYTES):
                text, start, count, anchor, phrase = phrases(data[off[a] : off[b]], off[a : b + 1] - off[a], length, k)
                doc = ids[a:b][text]
                order = np.lexsort((start, doc, phrase, anchor))
                text, start, count, anchor, phrase, doc = (x[order] for x in (text, start, count, anchor, phrase, doc))
                first = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (phrase[1:] != phrase[:-1]))) if len(doc) else np.zeros(0, bool)
                again = np.flatnonzero(~first)
                spans = [[], [], []]
                by_doc = again[np.argsort(doc[again], kind="stable")]
                cut = np.flatnonzero(np.diff(doc[by_doc])) + 1
                for part in np.split(by_doc, cut) if len(by_doc) else []:
                    s, e = merged(start[part], start[part] + count[part] - 1 + length)
                    spans[0].append(np.full(len(s), doc[part[0]]))
                    spans[1].append(s)
                    spans[2].append(e)
                spans = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in spans]
                yield _rows(anchor[first], phrase[first], doc[first], (start[first] << _PLACE_BITS) | count[first], spans)

    return run


def _compare_phrases(length: int):
    """Rows sorted by (anchor, phrase, doc_id, place): repeats become spans, anchors with several phrases give the first of each."""

    def run(batches):
        before, pending, several = (None, None), None, False
        for batch in batches:
            a, p, d, s = (batch[c].to_numpy(zero_copy_only=False) for c in ("anchor", "phrase", "doc_id", "place"))
            if not len(a):
                continue
            new_anchor = np.concatenate(([before[0] is None or a[0] != before[0]], a[1:] != a[:-1]))
            new_phrase = new_anchor | np.concatenate(([before[1] is None or p[0] != before[1]], p[1:] != p[:-1]))
            again = ~new_phrase
            spans = (d[again], s[again] >> _PLACE_BITS, (s[again] >> _PLACE_BITS) + (s[again] & 0xFFFF) - 1 + length)
            group = np.cumsum(new_anchor)
            first = np.flatnonzero(new_phrase)
            size = np.bincount(group[first], minlength=group[-1] + 1)
            keep = size[group[first]] > 1
            if size[0]:  # the anchor of the last batch goes on with another phrase
                keep |= group[first] == 0
            out = [x[first[keep]] for x in (a, p, d, s)]
            if size[0] and pending is not None:
                out = [np.concatenate(([v], x)) for v, x in zip(pending, out, strict=True)]
            if group[-1] > 0 or size[0]:
                several = bool(group[-1] == 0 or size[-1] > 1)
                pending = None if several else tuple(x[first[-1]] for x in (a, p, d, s))
            before = (a[-1], p[-1])
            yield _rows(*out, spans)

    return run


def _phrase_texts(length: int, k: int):
    """The bytes of each wanted phrase; those of a large anchor in parts, see ``_parted``."""

    def run(batches):
        for batch in batches:
            data, off = bytes_of(batch["text"])
            out = []
            for doc, wanted, begin in zip(batch["doc_id"].to_pylist(), batch["wanted"].to_pylist(), off[:-1].tolist(), strict=True):
                for w in wanted:
                    start, windows = w["place"] >> _PLACE_BITS, w["place"] & 0xFFFF
                    text = data[begin + start : begin + start + windows - 1 + length]
                    parts = _parted(text, w["anchor"], length, k, w["level"]) if w["level"] else [(w["anchor"], 0, windows)]
                    out += [(anchor, doc, start + a, text[a : a + n - 1 + length].tobytes()) for anchor, a, n in parts]
            cols = zip(*out, strict=True) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["anchor", "doc_id", "start", "bytes"])

    return run


def _index_shards(length: int, shard_bytes: int):
    """Rows sorted by (anchor, doc_id, start); shards end between anchors unless one anchor alone is too large."""

    def run(batches):
        shard, rows, size = Shard(length), [], 0

        def resolve(part, goes_on):
            spans = shard.resolve(*(list(c) for c in zip(*part, strict=True)), goes_on)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in spans], ["doc_id", "first", "past"])

        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("anchor", "doc_id", "start", "bytes")), strict=True):
                if rows and size >= shard_bytes:
                    if row[0] != rows[-1][0]:
                        yield resolve(rows, False)
                        rows, size = [], 0
                    else:
                        own = next(i for i, r in enumerate(rows) if r[0] == row[0])
                        if own:  # other anchors first; the large one starts a shard of its own
                            yield resolve(rows[:own], False)
                            rows = rows[own:]
                            size = sum(len(r[3]) for r in rows)
                        if size >= shard_bytes:
                            yield resolve(rows, True)
                            rows, size = [], 0
                elif not rows and shard.earlier and row[0] != last:
                    shard.earlier = []
                rows.append(row)
                last = row[0]
                size += len(row[3])
        if rows:
            yield resolve(rows, False)

    return run


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut(with_text: bool):
    def run(batches):
        for batch in batches:
            data, off = bytes_of(batch["text"])
            out = []
            for doc, spans, begin, end in zip(batch["doc_id"].to_pylist(), batch["spans"].to_pylist(), off[:-1].tolist(), off[1:].tolist(), strict=True):
                text = data[begin:end]
                first, past = np.array([x["first"] for x in spans or []], np.int64), np.array([x["past"] for x in spans or []], np.int64)
                first, past = merged(first, past)
                edges = np.concatenate(([0], np.ravel(np.column_stack((first, past))), [len(text)]))
                kept = b"".join(text[a:b].tobytes() for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))
                out.append((doc, len(text), int((past - first).sum()), len(first), hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            cols = list(zip(*out, strict=True)) or [()] * 6
            arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays(arrays[: 5 + with_text], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + with_text])

    return run


def repeated_spans(texts: DataFrame, length: int, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``doc_id, first, past`` spans (they may overlap) of bytes to remove; ``texts`` has distinct non-null doc_id."""
    if not 8 <= length <= 1 << 14:
        raise ValueError("length must be from 8 to 16384 bytes")
    k = min(32, max(4, length // 3))
    parsed = texts.mapInArrow(_parse(length, k), _ROWS)
    keyed = parsed.repartition(F.coalesce("anchor", F.xxhash64("doc_id", "place"))).sortWithinPartitions("anchor", "phrase", "doc_id", "place")
    compared = checkpoint(_split(keyed, length))
    spans = compared.where("anchor is null").select("doc_id", F.col("place").alias("first"), F.col("phrase").alias("past"))
    several = compared.where("anchor is not null")
    size = F.sum(F.col("place").bitwiseAND(0xFFFF) + length - 1)
    # The larger an anchor, the more further grams part its phrases, so that no task gets them all.
    level = F.least(F.lit(1) + F.ceil(F.log(4.0, F.col("size") / LARGE_ANCHOR)), F.lit(8)).cast("int")
    large = checkpoint(several.groupBy("anchor").agg(size.alias("size")).where(F.col("size") > LARGE_ANCHOR).select("anchor", level.alias("level")))
    several = several.join(small(large), "anchor", "left")
    wanted = several.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "place", F.coalesce("level", F.lit(0)).alias("level"))).alias("wanted"))
    bodies = texts.join(wanted, "doc_id").select("doc_id", "text", "wanted").mapInArrow(_phrase_texts(length, k), "anchor long, doc_id long, start long, bytes binary")
    sharded = bodies.repartition("anchor").sortWithinPartitions("anchor", "doc_id", "start")
    return spans.unionByName(sharded.mapInArrow(_index_shards(length, shard_bytes), "doc_id long, first long, past long"))


def _split(keyed: DataFrame, length: int) -> DataFrame:
    """Spans found while parsing pass through; phrases are compared."""

    def run(batches):
        def phrases_only():
            for batch in batches:
                isnull = batch["anchor"].is_null()
                if isnull.true_count:
                    ready.append(batch.filter(isnull))
                yield batch.filter(batch["anchor"].is_valid())

        ready: list[pa.RecordBatch] = []
        for out in _compare_phrases(length)(phrases_only()):
            yield out
            while ready:
                yield ready.pop()
        yield from ready

    return keyed.mapInArrow(run, _ROWS)


def remove_repeats(docs: DataFrame, length: int = 100, with_text: bool = False, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Remove each byte covered by a ``length``-byte string that also starts earlier.

    Earlier is a smaller doc_id, or the same text further left; strings are judged on
    the input and never cross texts. ``docs`` has doc_id and text.

    Returns ``doc_id, n_bytes, n_removed, n_spans`` (maximal removed runs),
    ``kept_sha256`` and, with ``with_text``, the remaining bytes as ``kept``. Defined
    cases: a null text counts as empty; a text of any length is read whole, and one under
    ``length`` bytes stays so; a
    row with a null doc_id takes no part and stays whole; rows that repeat a doc_id are
    each judged, in order of their texts' MD5, as if they were documents one behind the
    other; an empty table gives no rows; other columns are ignored. ``length`` is from 8
    to 16,384 bytes, anything else is an error.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = rows.where("doc_id is not null").select("doc_id", "text", F.col("doc_id").alias("own"))
    if not texts.groupBy("doc_id").count().where("count > 1").isEmpty():
        texts = _told_apart(texts)
    spans = repeated_spans(texts.select("doc_id", "text"), length, shard_bytes).groupBy("doc_id").agg(F.collect_list(F.struct("first", "past")).alias("spans"))
    schema = _RESULT + (", kept binary" if with_text else "")
    nobody = rows.where("doc_id is null").select("doc_id", "text", F.array().cast("array<struct<first:bigint,past:bigint>>").alias("spans"))
    found = texts.join(spans, "doc_id", "left").select(F.col("own").alias("doc_id"), "text", "spans")
    return found.mapInArrow(_cut(with_text), schema).unionByName(nobody.mapInArrow(_cut(with_text), schema))


def _told_apart(texts: DataFrame) -> DataFrame:
    """``texts`` with numbers of their own as doc_id, in order of doc_id and the text's MD5; equal rows get one each."""
    sets = checkpoint(texts.groupBy("own", F.md5("text").alias("mark")).agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies")))
    places = ranked(checkpoint(sets.select("own", "mark", "copies")), [], ["own", "mark"], "nth", "copies")
    rows = sets.join(places.select("own", "mark", "before"), ["own", "mark"])
    rows = rows.select(F.explode(F.expr("sequence(before, before + copies - 1)")).alias("doc_id"), "text", "own")
    return checkpoint(rows.repartition("doc_id"))
