"""Packing by concatenate and cut.

Every text is tokenised once and its ids are checkpointed, which also fixes the
rows of each partition for good. Pass one sums the tokens of each partition;
prefix sums of those totals (one number a partition) give each partition the
global offset of its first token. Pass two walks its partition from that offset
and cuts at every multiple of the sequence length. A text that crosses a cut
gives one boundary record on either side. Nothing is shuffled, and all sequences
but the last are full.
"""

from __future__ import annotations

import json
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipgrain.llm.common import checkpoint
from clipgrain.llm.textops import KEPT, bytes_of, equal_spans, slices, span_hashes, word_bounds

SEQUENCE = 2048
END_ID = 1
#: Words, and their bytes, that a worker's memory of encodings holds before it starts afresh; those of the slice at hand are always held.
KNOWN_WORDS, KNOWN_BYTES = 500_000, 16 << 20

ID_TYPES = {True: np.dtype("<u2"), False: np.dtype("<u4")}

#: A digit is a piece of its own, so it can part words that don't hold it.
MARK = "7"

#: A rule by which a run of letters and a run of punctuation are pieces of their own, and the bytes that may then be parted from a word's end.
PARTING_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LETTER, _STOP = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_STOP[list(b".,;:!?")] = True

_encoders: dict[str, WordEncoder] = {}
KEPT.append(_encoders)
_hashes = span_hashes


class WordEncoder:
    """Ids of texts, from the encodings of their distinct white-space-separated words.

    For tokenizers whose pieces never hold white space the ids of a text are those
    of its words in turn, so each distinct word is encoded once. Words are found by
    their hashes and then compared by their bytes. Where the tokenizer's rules
    allow it, words that differ by A-Z or by punctuation at their ends are one.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids[0]
        self.small = self.tokenizer.get_vocab_size() <= 1 << 16
        rules = [json.loads(x.__getstate__()) if x else {} for x in (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer)]
        self.lowers = "Lowercase" in [x["type"] for x in rules[0].get("normalizers", [rules[0]]) if x]
        self.parts = [x["pattern"] for x in rules[1].get("pretokenizers", [rules[1]])[:1] if x.get("type") == "Split"] == [{"Regex": PARTING_RULE}]
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.first, self.count, self.flat = _Grown(np.int32), _Grown(np.int32), _Grown(np.uint32)
        self.begin, self.text = _Grown(np.int32), _Grown(np.uint8)  # the words themselves

    def _learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        ids, first, counts = self._encode(words)
        self.slots, self.hashes = (np.insert(x, np.searchsorted(self.hashes, hashes), y) for x, y in ((self.slots, self.first.size + np.arange(len(words))), (self.hashes, hashes)))
        self.first.extend(self.flat.size + first)
        self.count.extend(counts)
        self.flat.extend(ids)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.begin.extend(self.text.size + np.cumsum(sizes) - sizes)
        self.text.extend(np.frombuffer(b"".join(words), np.uint8))

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words, and where those of each begin and how many they are."""
        texts = [w.decode("utf-8") for w in words]
        plain = np.array([MARK not in w for w in texts], bool)
        ids, count = self._encode_plain([w for w in texts if MARK not in w])
        rest = [e.ids for e in self.tokenizer.encode_batch_fast([w for w in texts if MARK in w], add_special_tokens=False)]
        counts, first = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        counts[plain], counts[~plain] = count, list(map(len, rest))
        first[plain], first[~plain] = np.cumsum(count) - count, len(ids) + np.cumsum(counts[~plain]) - counts[~plain]
        return np.concatenate([ids, np.array([i for x in rest for i in x], np.uint32)]), first, counts

    def _encode_plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words without MARK, and how many each has: many words go in one call, with MARK between them."""
        if not words:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        texts = [f" {MARK} ".join([*words[i : i + 256], ""]) for i in range(0, len(words), 256)]
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
        mark = ids == self.mark
        ends = np.flatnonzero(mark)
        return ids[~mark], np.diff(ends, prepend=-1) - 1

    def _words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of a slice with those made equal that the tokenizer does not tell apart, and starts, ends and first word of each text in them."""
        starts, ends, first = word_bounds(data, offsets)
        if self.parts and len(starts):
            core = ends.copy()
            live = np.flatnonzero(_STOP[data[core - 1]])
            while len(live):
                core[live] -= 1
                live = live[core[live] > starts[live]]
                live = live[_STOP[data[core[live] - 1]]]
            cuts = core[(core > starts) & (core < ends) & _LETTER[data[np.maximum(core, 1) - 1]]]
            starts, ends = (np.sort(np.concatenate([x, cuts]), kind="stable") for x in (starts, ends))
            first = np.searchsorted(starts, offsets)
        if self.lowers and len(data):
            # A mark after a letter may make one character with it, but not with the letter of the other case.
            upper = (data >= 65) & (data <= 90)
            upper[:-1] &= data[1:] < 128
            data = data + upper.astype(np.uint8) * np.uint8(32)
        return data, starts, ends, first

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in turn, and where each text's ids begin (one more at the end)."""
        data, starts, ends, first = self._words(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        distinct, at, inverse = np.unique(_hashes(data, starts, ends), return_index=True, return_inverse=True)
        raw = data.tobytes()
        new = ~np.isin(distinct, self.hashes, assume_unique=True)
        if len(self.hashes) + new.sum() > KNOWN_WORDS or self.text.size > KNOWN_BYTES:
            self._forget()
            new[:] = True
        if new.any():
            self._learn(distinct[new], [raw[a:b] for a, b in zip(starts[at[new]].tolist(), ends[at[new]].tolist(), strict=True)])
        slot = self.slots[np.searchsorted(self.hashes, distinct)][inverse]
        begin = self.begin.values[slot]
        past = np.append(self.begin.values[: self.begin.size], self.text.size)[slot + 1]
        if equal_spans(data, starts, ends, self.text.values[: self.text.size], begin, past).all():
            flat, begins, n = self.flat.values, self.first.values[slot], self.count.values[slot]
        else:  # different words hash alike: encode every word of the slice by itself
            flat, begins, n = self._encode([raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
        total = np.concatenate(([0], np.cumsum(n)))
        where = np.repeat(begins - total[:-1], n) + np.arange(total[-1])
        return flat[where], total[first]


class _Grown:
    """An array that grows at its end; ``values`` has room to spare."""

    def __init__(self, kind):
        self.values, self.size = np.zeros(1024, kind), 0

    def extend(self, more: np.ndarray) -> None:
        if self.size + len(more) > len(self.values):
            self.values = np.concatenate([self.values[: self.size], np.zeros(self.size // 2 + len(more), self.values.dtype)])
        self.values[self.size : self.size + len(more)] = more
        self.size += len(more)


def _encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _tokenise(path: str):
    def run(batches):
        encoder = _encoder(path)
        for batch in batches:
            data, off = bytes_of(batch["text"])
            for a, b in slices(off):
                flat, first = encoder.ids(data[off[a] : off[b]], off[a : b + 1] - off[a])
                # Two bytes an id where all fit, which all vocabularies below 65,536 do.
                raw = flat.astype(ID_TYPES[encoder.small])
                width = raw.itemsize
                column = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(np.ascontiguousarray(first * width)), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a), column.cast(pa.binary()), pa.array(np.diff(first))], ["doc_id", "ids", "tokens"])

    return run


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_length long"


def padded(length: int, sequence: int) -> int:
    """Sequences are padded to the full length, except at a power of two."""
    return length if length & (length - 1) == 0 else sequence


def _cut(shared, sequence: int, keep_ids: bool):
    def run(batches):
        begins, end = shared.value
        offset = begins.get(TaskContext.get().partitionId(), end)  # a partition without rows has none to place
        last = padded(end % sequence, sequence)
        for batch in batches:
            rows = []
            for doc_id, raw, tokens in zip(*(batch[c].to_pylist() for c in ("doc_id", "ids", "tokens")), strict=True):
                ids = np.append(np.frombuffer(raw, ID_TYPES[len(raw) == 2 * tokens]), END_ID).astype("<u4")
                start = 0
                while start < len(ids):
                    part = ids[start : start + sequence - offset % sequence]
                    whole = sequence if offset // sequence < end // sequence else last
                    rows.append((doc_id, start, len(part), zlib.crc32(part), len(ids), offset // sequence, offset % sequence, whole, part.tolist() if keep_ids else None))
                    start += len(part)
                    offset += len(part)
            cols = list(zip(*rows, strict=True)) or [[]] * 9
            out = {n: pa.array(c, pa.int64()) for n, c in zip(PIECE.replace(" long", "").split(", "), cols, strict=False)}
            yield pa.RecordBatch.from_pydict(out | ({"ids": pa.array(cols[8], pa.list_(pa.int32()))} if keep_ids else {}))

    return run


def pack(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, keep_ids: bool = False) -> DataFrame:
    """Pack all rows of ``docs`` (doc_id, text) into sequences of ``sequence`` tokens.

    Returns one row per piece: ``doc_id, start`` (tokens of its text before it),
    ``length, ids_crc32, doc_tokens, sequence_id, offset, padded_length`` and, with
    ``keep_ids``, the ids. Every text ends with id 1.

    Defined cases: a null or empty text is the one id 1; a null doc_id stays null;
    repeated rows are each packed; a text longer than a sequence spans several; an
    empty table gives no rows, and partitions may be empty; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    encoded = checkpoint(rows.mapInArrow(_tokenise(tokenizer), "doc_id long, ids binary, tokens long"))
    by_partition = encoded.groupBy(F.spark_partition_id().alias("p")).agg(F.sum(F.col("tokens") + 1).alias("n"))
    begins, end = {}, 0
    for p, n in sorted(map(tuple, by_partition.collect())):  # one number a partition that has rows
        begins[p] = end
        end += n
    shared = docs.sparkSession.sparkContext.broadcast((begins, end))
    return encoded.mapInArrow(_cut(shared, sequence, keep_ids), PIECE + (", ids array<int>" if keep_ids else ""))
