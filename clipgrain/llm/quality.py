"""Quality classifier from weak labels.

Ten heuristic labellers vote good, bad or nothing on every text. The counts of
vote patterns, of which there are at most 3**10, are all that expectation-
maximisation needs to estimate each labeller's accuracy and the share of good
texts, without any true labels. Posteriors of a bounded sample of texts then
train a linear scorer over hashed byte pairs, which judges every text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipgrain.llm.textops import U64, bytes_of, mix64, slices, span_hashes, word_bounds

#: Texts that train the scorer: those with the smallest hashes of their doc_id.
TRAIN_ROWS = 4096
#: Buckets of hashed features.
BUCKETS = 4096
#: A text stays when its score reaches this.
THRESHOLD = 0.5
#: Texts that are judged at once: bytes, and rows, each of which has a row of features.
SLICE_BYTES, SLICE_ROWS = 1 << 18, 256
#: Before any vote the label model expects this much, with the weight of so many texts: the share of good texts, and each labeller's votes for bad on bad and on good texts.
PRIOR_GOOD, PRIOR_CRIES, PRIOR_WEIGHT = 0.8, (0.5, 0.05), 2.0
#: Texts under this length show less of what they are, and weigh less.
SHORT_BYTES = 100

#: (statistic, good from, good to, bad below, bad above, words needed), see ``statistics``. Between good and bad there is no vote.
LABELLERS = (
    ("capitals", 0.0, 0.1, -1.0, 0.3, 1),
    ("symbols", 0.0, 0.005, -1.0, 0.02, 1),
    ("doubled_marks", 0.0, 0.01, -1.0, 0.05, 1),
    ("wordless", 0.0, 0.02, -1.0, 0.1, 1),
    ("stutters", 0.0, 0.04, -1.0, 0.1, 8),
    ("repeated_runs", 0.0, 0.15, -1.0, 0.3, 20),
    ("commonest_word", 0.0, 0.15, -1.0, 0.3, 20),
    ("word_length", 3.5, 7.0, 3.0, 10.0, 20),
    ("repeated_lines", 0.0, 0.1, -1.0, 0.3, 8),
    ("sentence_ends", 0.03, 0.34, 0.015, 0.6, 30),
)
_CLASS = np.zeros(256, np.int64)  # 1 small letters, 2 capitals, 3 marks within sentences, 4 ends of sentences, 5 other symbols, 6 first bytes of other characters
_CLASS[33:127] = 5
_CLASS[48:58] = 0
_CLASS[97:123] = 1
_CLASS[65:91] = 2
_CLASS[[ord(c) for c in ",;:'\"()-"]] = 3
_CLASS[[ord(c) for c in ".!?"]] = 4
_CLASS[0xC2:0xF5] = 6
_MARK = np.isin(_CLASS, (3, 4, 5))
#: Capitals of two bytes: (first byte, second from, to) of Latin, Greek and Cyrillic; ends of sentences of three bytes (ideographic, danda).
_CAPITALS = ((0xC3, 0x80, 0x9E), (0xCE, 0x86, 0xAB), (0xD0, 0x80, 0xAF))
_ENDS = ((0xE3, 0x80, 0x82), (0xE0, 0xA5, 0xA4))
#: Scripts of three bytes a character often have no spaces; beyond this share of them, words say nothing.
UNSPACED = 0.2


def _distinct(owner: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How many different hashes each of ``n`` owners has, and how often its commonest one occurs."""
    bits = max(1, n.bit_length())
    key = np.sort((owner.astype(np.uint64) << U64(64 - bits)) | (h >> U64(bits)))
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    whose, most = (key[first] >> U64(64 - bits)).astype(np.int64), np.zeros(n, np.int64)
    np.maximum.at(most, whose, np.diff(np.append(first, len(key))))
    return np.bincount(whose, minlength=n), most


def statistics(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One row per text and column per labeller, and each text's number of words.

    Shares of capitals among letters, of symbols among bytes, of words that end in a
    doubled mark, that have no letter or digit, that repeat the word before; of runs of three
    words that repeat another; of the commonest word; characters a word; shares of lines that repeat another, and
    ends of sentences a word.
    """
    sizes, count = np.diff(offsets), len(offsets) - 1
    of_byte = np.repeat(np.arange(count), sizes)
    kinds = np.bincount(of_byte * 8 + _CLASS[data], minlength=8 * count).reshape(count, 8)
    at = lambda found: np.bincount(of_byte[found], minlength=count)
    capitals, ends_of = kinds[:, 2].copy(), kinds[:, 4].copy()
    wide = np.flatnonzero(data >= 0xC2)
    if len(wide):
        lead, second = data[wide], data[np.minimum(wide + 1, len(data) - 1)]
        for a, low, high in _CAPITALS:
            capitals += at(wide[(lead == a) & (second >= low) & (second <= high)])
        for a, b, c in _ENDS:
            ends_of += at(wide[(lead == a) & (second == b) & (data[np.minimum(wide + 2, len(data) - 1)] == c)])
    starts, ends, first = word_bounds(data, offsets)
    words = np.diff(first)
    h, owner = span_hashes(data, starts, ends), np.repeat(np.arange(count), words)
    by_word = lambda x: np.bincount(owner, x, minlength=count)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    doubled = (ends - starts >= 2) & (data[ends - 1] == data[np.maximum(ends - 2, 0)]) & _MARK[data[ends - 1]]
    runs = np.flatnonzero(owner[2:] == owner[:-2])  # of three words
    names = mix64(mix64(h[runs] + mix64(h[runs + 1])) + h[runs + 2])
    of_runs = owner[runs]
    repeated = 1 - _distinct(of_runs, names, count)[0] / np.maximum(np.bincount(of_runs, minlength=count), 1)
    marks = np.concatenate(([0], np.cumsum(_MARK[data])))
    line_start = np.unique(np.concatenate([offsets[:-1][sizes > 0], np.flatnonzero(data[:-1] == 10) + 1]))
    line_owner = np.searchsorted(offsets, line_start, side="right") - 1
    line_end = np.append(line_start[1:], len(data))
    line_end = line_end - (data[line_end - 1] == 10)  # the last line of a text has no line feed
    lines = np.bincount(line_owner, minlength=count)
    different, most = _distinct(line_owner, span_hashes(data, line_start, line_end), count)[0], _distinct(owner, h, count)[1]
    n, chars = np.maximum(words, 1), kinds[:, 1:7].sum(axis=1)
    stats = np.column_stack([capitals / np.maximum(kinds[:, 1] + kinds[:, 2] + kinds[:, 6], 1), kinds[:, 5] / np.maximum(sizes, 1), by_word(doubled) / n, by_word(marks[ends] - marks[starts] == ends - starts) / n, by_word(again) / n, np.where(words >= 3, repeated, 0), most / n, chars / n, (lines - different) / np.maximum(lines, 1), ends_of / n])
    return stats, np.where(at(wide[lead >= 0xE0]) > UNSPACED * chars, 0, words) if len(wide) else words


def votes(stats: np.ndarray, words: np.ndarray) -> np.ndarray:
    """2 good, 1 bad, 0 nothing; one column per labeller."""
    out = np.zeros(stats.shape, np.int8)
    for j, (_, low, high, under, over, need) in enumerate(LABELLERS):
        x, enough = stats[:, j], words >= need
        out[enough & (x >= low) & (x <= high), j] = 2
        out[enough & ((x < under) | (x > over)), j] = 1
    return out


_POWERS = 3 ** np.arange(len(LABELLERS))


@dataclass
class LabelModel:
    """The share of good texts, and each labeller's chance to vote bad on a bad and on a good one, if it votes."""

    good: float
    cries: np.ndarray  # (bad or good text, labeller)

    @classmethod
    def fit(cls, patterns: np.ndarray, counts: np.ndarray, rounds: int = 2000) -> LabelModel:
        """Expectation-maximisation over vote patterns; the prior has a fixed weight and no estimate is bounded.

        Labellers are taken to err independently. Texts a labeller doesn't vote on say
        nothing of it.
        """
        vote = (np.asarray(patterns)[:, None] // _POWERS) % 3
        start = np.repeat(np.array(PRIOR_CRIES)[:, None], vote.shape[1], axis=1)
        bad, voted = (vote == 1).astype(float), (vote > 0).astype(float)
        model = cls(PRIOR_GOOD, start)
        for _ in range(rounds):
            p, before = model.posterior(vote), model.cries
            weights = np.stack([counts * (1 - p), counts * p])
            cries = (weights @ bad + PRIOR_WEIGHT * start) / (weights @ voted + PRIOR_WEIGHT)
            model = cls(float((counts @ p + PRIOR_WEIGHT * PRIOR_GOOD) / (counts.sum() + PRIOR_WEIGHT)), cries)
            if np.abs(cries - before).max() < 1e-9:
                break
        return model

    def posterior(self, vote: np.ndarray) -> np.ndarray:
        """The chance that a text with these votes is good."""
        on_bad, on_good = np.log(self.cries[1] / self.cries[0]), np.log((1 - self.cries[1]) / (1 - self.cries[0]))
        gap = (vote == 1) @ on_bad + (vote == 2) @ on_good + np.log(self.good / (1 - self.good))
        return 1 / (1 + np.exp(-np.clip(gap, -500, 500)))


def features(data: np.ndarray, offsets: np.ndarray, stats: np.ndarray) -> np.ndarray:
    """Hashed byte pairs and binned statistics, with a constant at the end; rows of about unit length, less for short texts."""
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    pair = (data[:-1].astype(np.uint32) << np.uint32(8)) | data[1:] if len(data) else np.zeros(0, np.uint32)
    inside = owner[1:] == owner[:-1]
    bucket = ((pair * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)
    flat = np.bincount(owner[:-1][inside] * BUCKETS + bucket[inside], minlength=n * BUCKETS) if len(data) else np.zeros(n * BUCKETS)
    x = np.sqrt(flat.reshape(n, BUCKETS)).astype(np.float32)
    x /= np.sqrt(np.maximum(np.diff(offsets), SHORT_BYTES))[:, None].astype(np.float32)
    for j in range(stats.shape[1]):
        bins = np.minimum((stats[:, j] * 16).astype(np.int64), 127)
        name = mix64(U64(j * 131) + bins.astype(np.uint64)) % U64(BUCKETS)
        x[np.arange(n), name.astype(np.int64)] += 0.5
    return np.hstack([x, np.ones((n, 1), np.float32)])


def fit_scorer(x: np.ndarray, p: np.ndarray, rounds: int = 200, rate: float = 10.0, decay: float = 1e-4) -> np.ndarray:
    """Weights of a logistic scorer for soft labels ``p``, by gradient descent with momentum."""
    w = np.zeros(x.shape[1], np.float32)
    if not len(p):
        w[-1] = 1.0
        return w
    used = np.flatnonzero(x.any(axis=0))
    x, p = np.ascontiguousarray(x[:, used]), p.astype(np.float32)
    part, speed = np.zeros(len(used), np.float32), np.zeros(len(used), np.float32)
    for _ in range(rounds):
        gap = (1 / (1 + np.exp(-(x @ part))) - p) / len(p)
        speed = np.float32(0.8) * speed - np.float32(rate / 2) * (gap @ x + np.float32(decay) * part)
        part += speed
    w[used] = part
    return w


def _parts(batch):
    data, off = bytes_of(batch["text"])
    for low, high in slices(off, SLICE_BYTES):
        for a in range(low, high, SLICE_ROWS):
            b = min(high, a + SLICE_ROWS)
            yield a, b, data[off[a] : off[b]], off[a : b + 1] - off[a]


def _patterns(batches):
    total = np.zeros(3 ** len(LABELLERS), np.int64)
    for batch in batches:
        for _, _, data, off in _parts(batch):
            total += np.bincount(votes(*statistics(data, off)) @ _POWERS, minlength=len(total))
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["pattern", "n"])


def _training(batches):
    for batch in batches:
        for _, _, data, off in _parts(batch):
            stats, words = statistics(data, off)
            x = features(data, off, stats)
            rows = [(np.flatnonzero(r).astype("<u2"), r) for r in x]
            yield pa.RecordBatch.from_arrays([pa.array(votes(stats, words) @ _POWERS), pa.array([i.tobytes() for i, _ in rows], pa.binary()), pa.array([r[i].astype("<f4").tobytes() for i, r in rows], pa.binary())], ["pattern", "index", "value"])


def _scores(data: np.ndarray, off: np.ndarray, stats: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-(features(data, off, stats) @ w).astype(np.float64)))


def _scored(shared):
    def run(batches):
        model, w = shared.value
        for batch in batches:
            for a, b, data, off in _parts(batch):
                stats, words = statistics(data, off)
                score = _scores(data, off, stats, w)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a), pa.array(model.posterior(votes(stats, words))), pa.array(score), pa.array(score >= THRESHOLD)], ["doc_id", "weak_label", "score", "kept"])

    return run


def _models(docs: DataFrame, train_rows: int) -> tuple[LabelModel, np.ndarray]:
    """The label model of all rows, and the scorer's weights from at most ``train_rows`` of them."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("h", F.xxhash64("doc_id", "text"))
    counts = rows.select("text").mapInArrow(_patterns, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).toPandas()
    model = LabelModel.fit(counts["pattern"].to_numpy(np.int64), counts["n"].to_numpy(np.float64))
    # Rows of the same hash repeat both doc_id and text, so it doesn't matter which of them are taken.
    last = rows.select("h").orderBy("h").limit(train_rows).agg(F.max("h")).first()[0]
    sample = rows.where(F.col("h") <= F.lit(0 if last is None else last)).limit(train_rows).select("text").mapInArrow(_training, "pattern long, index binary, value binary").toPandas()
    x = np.zeros((len(sample), BUCKETS + 1), np.float32)
    for i, (index, value) in enumerate(zip(sample["index"], sample["value"], strict=True)):
        x[i, np.frombuffer(index, "<u2")] = np.frombuffer(value, "<f4")
    p = model.posterior((sample["pattern"].to_numpy(np.int64)[:, None] // _POWERS) % 3)
    return model, fit_scorer(x, p)


def classify(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Judge every row of ``docs`` (doc_id, text).

    Returns ``doc_id, weak_label`` (posterior of the labellers), ``score`` (of the
    linear scorer, 0 to 1) and ``kept``. Label accuracies come from all rows; the
    scorer trains on at most ``train_rows`` of them, those of the smallest hashes.
    Defined cases: a null text is judged as an empty one, on which only the heuristics
    that need no words vote; a text of any length is judged whole; a score of just
    THRESHOLD is kept; a null doc_id is kept as it is; repeated rows get the same score
    each; an empty table gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_models(docs, train_rows))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_scored(shared), "doc_id long, weak_label double, score double, kept boolean")


def keep_good(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, all columns; each row is judged by its own text."""
    shared = docs.sparkSession.sparkContext.broadcast(_models(docs, train_rows))

    def run(batches):
        _, w = shared.value
        for batch in batches:
            for a, b, data, off in _parts(batch):
                yield batch.slice(a, b - a).filter(pa.array(_scores(data, off, *statistics(data, off)[:1], w) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
