"""N-gram Jaccard join by a size-aware heavy-light split.

Texts become sets of hashed word shingles; equal sets are one class. For a pair
of sizes s and t the similarity asks for an overlap of c(s, t). Small sets
enumerate their subsets of those fixed sizes, and two small sets are linked
through an equal subset. Large sets go into inverted lists: the hash space is cut
into m segments, and with at most k differing shingles at least m - k segments of
a linked pair are equal, so each list holds the sets that are equal within one
segment. Where small ends and large begins is chosen by the cost of either way
on the sizes at hand.

Shingles that very many sets share (found by counting all of them) must not make
long lists: a segment of nothing but such shingles is left out, unless a set has
more of those than the margin in m allows. Both sets of a linked pair then agree
on which to list, so no link is lost.

Scanning lists connects the sets of each, first within each task and then across
tasks. What a task's lists connect is linked to the smallest set among it, so a long
list is one entry a task, and a set has one link a task however many lists it shares
with others, each of which may have another smallest set. That gives clusters, within
which all linked pairs lie. Every member of a cluster is compared with one pivot.
Two members differ exactly by the symmetric difference of their differences from
the pivot. If those are small enough together, the two are linked for sure, and one
member, that with the least difference, stands for all such pairs. Members that are
still by themselves go through lists, clusters and pivots of their own, with their
differences as sets: by prefix filter, with shingles that the pivot lacks coming
first, as hardly any two members share them. Each level strips what its pivot has, and
so a passage that many texts share. Members by themselves that may still be linked to
one of the pivot's component meet it in a join of those prefixes.

Members of one component need not meet. So after the first level, members that agree in
some least shingles of a few parts of the hash space are compared with one of them. That
finds most components at a cost in proportion to the members, and decides nothing else:
the joins of prefixes then look for every link between different components, and only by
shingles that two components share. Links are decided on the shingles of both texts.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clipgrain.llm.common import checkpoint, drop, few, scratch, small, stored, without
from clipgrain.llm.graph import connected_components
from clipgrain.llm.textops import U64, bytes_of, let_go, mix64, shingle_sets, slices

#: Shingles in so many sets (as far as tasks counted them) are heavy; of more than so many, the heaviest are.
HEAVY_AT, MOST_HEAVY = 3, 1 << 19
#: Shingles a task counts at once, and from how many sets on it reports one.
COUNT_AT_ONCE, REPORT_FROM = 500_000, 2
#: Sizes that may be small, and the cost of a list entry relative to that of a subset (it may have to be compared).
LARGEST_SMALL, LIST_COST = 40, 4
#: Class hashes a task remembers, to list a class once for all its copies there, and list entries it joins at once.
SEEN, ENTRIES_AT_ONCE = 1 << 17, 1 << 17
#: Prefix rows that a task hands on at once.
ROLES_AT_ONCE = 1 << 14
#: Bits of a sieve for each token on it, the least and most it has (as powers of two), words of its blocks, and tokens for which one is worth its jobs.
SIEVE_BITS, LEAST_SIEVE, MOST_SIEVE, SIEVE_BLOCK, SIEVE_FROM = 16, 16, 25, 512, 100_000
#: Partners that one copy of a pivot is compared with.
PARTNERS = 1000
#: Levels of clusters within clusters at least, and the share of members that must find a partner for a further one; then those by themselves are joined with each other.
LEVELS, WORTH = 2, 0.25
#: Words of a folded sketch: 512 bits tell sets apart that differ by up to some 250 shingles, as many as texts of a thousand words may.
FOLDED = 8
#: Bands that members are first met by, and the least shingles that make a band.
BANDS, BAND = 12, 3
_SALT = U64(0x5851F42D4C957F2D)
_K = (U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9))


def overlap(s: int, t: int, num: int, den: int) -> int:
    """The least intersection of sizes s and t whose Jaccard similarity is num/den or more."""
    return -(-num * (s + t) // (num + den))


def partners(s: int, num: int, den: int) -> range:
    """Sizes that a set linked with one of size s may have."""
    return range(-(-num * s // den), den * s // num + 1)


@dataclass
class Plan:
    """How sets of each size are listed. ``small``: sizes below it enumerate subsets."""

    num: int
    den: int
    small: int
    starts: list[int] = field(default_factory=list)
    shapes: list[tuple[int, int]] = field(default_factory=list)  # segments and margin of each size range
    edges: dict[int, np.ndarray] = field(default_factory=dict)

    def range_of(self, size: int) -> int:
        """The size range that holds ``size``; ranges grow by a quarter and are made as asked for."""
        if not self.starts:
            self.starts.append(self.small)
        while self.starts[-1] <= size:
            low = self.starts[-1]
            high = max(low + 1, low * 5 // 4)
            differ = 2 * (self.den - self.num) * (high - 1) // (self.den + self.num)
            margin = 0
            for _ in range(4):  # room for the segments that stay empty by chance
                m = differ + 1 + margin
                empty = m * math.exp(-low / m)
                margin = math.ceil(empty + 4 * math.sqrt(empty)) if empty > 0.01 else 0
            self.shapes.append((differ + 1 + margin, margin))
            self.starts.append(high)
        return int(np.searchsorted(self.starts, size, side="right")) - 1

    def ranges(self, size: int) -> range:
        """Ranges in which a set of ``size`` meets partners as large or larger than itself."""
        most = self.den * size // self.num
        if most < self.small:
            return range(0)
        return range(self.range_of(max(size, self.small)), self.range_of(most) + 1)

    def segment_edges(self, m: int) -> np.ndarray:
        if m not in self.edges:
            self.edges[m] = np.array([-(-(j << 32) // m) << 32 for j in range(1, m)], np.uint64)
        return self.edges[m]

    def subset_sizes(self, size: int) -> set[int]:
        return {overlap(size, t, self.num, self.den) for t in partners(size, self.num, self.den) if t < self.small}


def keys_of(a: np.ndarray, plan: Plan, heavy: np.ndarray) -> np.ndarray:
    """All list keys of a set given as sorted hashes."""
    size, out = len(a), []
    if not size:
        return np.zeros(0, np.uint64)
    mixed = mix64(a ^ _SALT)
    if size < plan.small:
        total = mixed.sum(dtype=np.uint64)
        for c in sorted(plan.subset_sizes(size)):
            left_out = np.array(list(itertools.combinations(range(size), size - c)), np.int64).reshape(math.comb(size, c), size - c)
            out.append(mix64(total - mixed[left_out].sum(axis=1, dtype=np.uint64) + mix64(np.array([c], np.uint64))))
    in_ranges = plan.ranges(size)
    if len(in_ranges):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed)))
        light = np.ones(size, bool)
        if len(heavy):
            light = heavy[np.minimum(np.searchsorted(heavy, a), len(heavy) - 1)] != a
        lights = np.concatenate(([0], np.cumsum(light)))
        for i in in_ranges:
            m, margin = plan.shapes[i]
            bounds = np.concatenate(([0], np.searchsorted(a, plan.segment_edges(m)), [size]))
            filled, without_light = np.diff(bounds) > 0, np.diff(lights[bounds]) == 0
            key = mix64(sums[bounds[1:]] - sums[bounds[:-1]] + np.arange(m, dtype=np.uint64) * _K[0] + mix64(np.array([i + 1], np.uint64)))
            if without_light.sum() <= margin:
                key = key[~without_light]
            elif (~filled).sum() <= margin:
                key = key[filled]
            out.append(key)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def choose_boundary(sizes: dict[int, int], num: int, den: int) -> int:
    """The boundary with the least total cost, for counts of sets by size (up to LARGEST_SMALL)."""
    best = (math.inf, 1)
    for x in range(1, LARGEST_SMALL + 2):
        plan = Plan(num, den, x)
        cost = 0.0
        for s, n in sizes.items():
            if s < x:
                cost += n * sum(math.comb(s, c) for c in plan.subset_sizes(s))
            cost += n * LIST_COST * sum(plan.shapes[i][0] for i in plan.ranges(s))
        best = min(best, (cost, x))
    return best[1]


def _sets(batch: pa.RecordBatch, words: int):
    """(row, set) of each text of a batch."""
    let_go()
    data, off = bytes_of(batch["text"])
    for a, b in slices(off):
        yield from enumerate(shingle_sets(data[off[a] : off[b]], off[a : b + 1] - off[a], words), a)


def _class_hash(s: np.ndarray, seed: int) -> tuple[int, int]:
    """128 bits that name a set; the first 64 of them are its node."""
    one, two = mix64(s + _K[1] * U64(2 * seed + 1)).sum(dtype=np.uint64), np.bitwise_xor.reduce(mix64(s ^ _K[2])) if len(s) else U64(0)
    return int(mix64(np.array([one]))[0].astype(np.int64)), int(U64(two).astype(np.int64))


def _classes(words: int, seed: int):
    """Per text its class and size (kind 0); per often-met shingle of this task its count (kind 1)."""
    names = ["kind", "doc_id", "mark", "h1", "h2", "n"]

    def run(batches):
        seen: set[tuple[int, int]] = set()
        held: list[np.ndarray] = []
        amount = 0

        def counted():
            values, counts = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            held.clear()
            often = counts >= REPORT_FROM
            n = int(often.sum())
            zero = pa.array(np.zeros(n, np.int64))
            return pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int32)), zero, zero, pa.array(values[often].view(np.int64)), zero, pa.array(counts[often].astype(np.int64))], names)

        for batch in batches:
            rows = []
            for _, s in _sets(batch, words):
                h = _class_hash(s, seed)
                rows.append((*h, len(s)))
                if h not in seen:
                    if len(seen) < SEEN:
                        seen.add(h)
                    held.append(s)
                    amount += len(s)
                    if amount >= COUNT_AT_ONCE:
                        yield counted()
                        amount = 0
            h1, h2, n = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(rows), np.int32)), batch["doc_id"], batch["mark"], pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(n, pa.int64())], names)
        yield counted()

    return run


def _joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links (a, b), sorted, and the smallest node that each is connected with."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y, least = ends[: len(a)], ends[len(a) :], np.arange(len(nodes))
    while len(x):
        low, high = np.minimum(least[x], least[y]), np.maximum(least[x], least[y])
        apart = low != high
        np.minimum.at(least, high[apart], low[apart])
        while (least[least] != least).any():
            least = least[least]
        x, y = x[apart], y[apart]
    return nodes, nodes[least]


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the links (a, b) do: of each node with the smallest it is connected with."""
    nodes, least = _joined(a, b)
    return least[nodes != least], nodes[nodes != least]


_ENTRY = "key long, node long, star boolean"


def _entries(keys: np.ndarray, nodes: np.ndarray) -> pa.RecordBatch:
    """List entries, one a key, with the smallest node that these lists connect its nodes with; other nodes become stars (key: that smallest node, node: the other)."""
    order = np.argsort(keys, kind="stable")
    k, v = keys[order], nodes[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
    one = np.repeat(v[first], np.diff(np.append(first, len(k))))
    named, least = _joined(one[one != v], v[one != v])
    at = np.sort(order[first])  # in the order of the sets, which compresses better
    hubs = nodes[at]
    if len(named):
        place = np.minimum(np.searchsorted(named, hubs), len(named) - 1)
        hubs = np.where(named[place] == hubs, least[place], hubs)
    others = named != least
    star = np.zeros(len(at) + others.sum(), bool)
    star[len(at) :] = True
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([keys[at], least[others]])), pa.array(np.concatenate([hubs, named[others]])), pa.array(star)], ["key", "node", "star"])


def _gathered(parts):
    """Entries of (keys, node) pairs, so many at once."""
    keys, nodes, size = [], [], 0
    for k, node in parts:
        keys.append(k.view(np.int64))
        nodes.append(np.full(len(k), node, np.int64))
        size += len(k)
        if size >= ENTRIES_AT_ONCE:
            yield _entries(np.concatenate(keys), np.concatenate(nodes))
            keys, nodes, size = [], [], 0
    if size:
        yield _entries(np.concatenate(keys), np.concatenate(nodes))


def _listed(words: int, seed: int, plan: Plan, heavy):
    """List entries of each class that the task meets."""

    def parts(batches):
        (often, _), seen = heavy.value, set()
        for batch in batches:
            known = batch["doc_id"].is_valid().to_pylist()
            for row, s in _sets(batch, words):
                h = _class_hash(s, seed)
                if known[row] and h not in seen:
                    if len(seen) < SEEN:
                        seen.add(h)
                    yield keys_of(s, plan, often), h[0]

    return lambda batches: _gathered(parts(batches))


def _difference_lists(num: int, den: int):
    """List entries of differences, for members of clusters: a cluster and a token are a key."""

    def parts(batches):
        for batch in batches:
            for p, b, n, raw in zip(*(batch[c].to_pylist() for c in ("a", "b", "n", "tokens")), strict=True):
                tokens = np.frombuffer(raw, np.uint64)[: _most(n, num, den) + 1]
                yield mix64(tokens + mix64(np.array([p], np.int64).view(np.uint64))), b

    return lambda batches: _gathered(parts(batches))


def _scan(batches):
    """Rows sorted by (key, node): links that connect the nodes of each key, and those of each star; of so many at once, one a node."""
    key = hub = None
    held, size = [], 0
    links = lambda: pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["a", "b"])
    for batch in batches:
        k, v, star = (batch[c].to_numpy(zero_copy_only=False) for c in ("key", "node", "star"))
        a, b, k, v = k[star], v[star], k[~star], v[~star]
        if len(k):
            new = np.concatenate(([key is None or k[0] != key], k[1:] != k[:-1]))
            hubs = np.concatenate(([0 if hub is None else hub], v[new]))[np.cumsum(new)]
            key, hub = k[-1], hubs[-1]
            a, b = np.concatenate([a, hubs[hubs != v]]), np.concatenate([b, v[hubs != v]])
        held.append((a, b))
        size += len(a)
        if size >= ENTRIES_AT_ONCE:
            held = [_stars(*map(np.concatenate, zip(*held, strict=True)))]
            size = len(held[0][0])
            if size >= ENTRIES_AT_ONCE // 2:
                yield links()
                held, size = [], 0
    if size:
        held = [_stars(*map(np.concatenate, zip(*held, strict=True)))]
        yield links()


def _clusters(entries: DataFrame) -> DataFrame:
    """``a, b``: the members b of each cluster that the lists connect, but for its smallest, a."""
    dealt = entries.repartition(F.when(F.col("star"), F.col("node")).otherwise(F.col("key"))).sortWithinPartitions("key", "node")
    met = connected_components(dealt.mapInArrow(_scan, "a long, b long"))
    return stored(met.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b")).distinct())


def _most(n: int, num: int, den: int) -> int:
    """By how many shingles any partner of a set of ``n`` may differ from it."""
    return (den - num) * (n + den * n // num) // (den + num)


def _difference(pivot: np.ndarray, member: np.ndarray, heavy: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The shingles by which a member differs from its pivot: what the pivot lacks, what it has, then those that many sets share, the most shared last."""
    at = np.minimum(np.searchsorted(pivot, member), len(pivot) - 1)
    added = member[pivot[at] != member]
    at = np.minimum(np.searchsorted(member, pivot), len(member) - 1)
    tokens = np.concatenate([added, pivot[member[at] != pivot]])
    if len(heavy):
        place = np.minimum(np.searchsorted(heavy, tokens), len(heavy) - 1)
        often = heavy[place] == tokens
        tokens = np.concatenate([tokens[~often], tokens[often][np.lexsort((tokens[often], counts[place[often]]))]])
    return tokens


def _placed_sets(words: int, seed: int):
    """The set of each class that is compared; a pivot's comes once per copy, with b null."""
    names = ["a", "salt", "b", "crowd", "shingles"]

    def run(batches):
        for batch in batches:
            rows = []
            places = list(zip(*(batch[c].to_pylist() for c in ("a", "salt", "b", "copies", "crowd")), strict=True))
            for row, s in _sets(batch, words):
                a, salt, b, copies, crowd = places[row]
                if _class_hash(s, seed)[0] == (a if b is None else b):  # rows that share a doc_id may hold other texts
                    rows += [(a, i, b, crowd, s.tobytes()) for i in (range(copies) if b is None else (salt,))]
            cols = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.binary()), strict=True)], names)

    return run


def _sketch(s: np.ndarray) -> list[int]:
    """1024 bits, each the parity of the shingles that fall on it: two sets differ by at least as many shingles as their sketches by bits."""
    falls = np.bincount((mix64(s ^ _SALT) >> U64(54)).astype(np.int64), minlength=1024)
    return np.packbits((falls & 1).astype(np.uint8)).view(np.int64).tolist()


_BAND_EDGES = np.array([-(-(j << 32) // (BANDS * BAND)) << 32 for j in range(1, BANDS * BAND)], np.uint64)


def _bands(s: np.ndarray) -> list[int]:
    """Keys of which similar sets are likely to share one: the least shingles of a few parts of the hash space each."""
    bounds = np.concatenate(([0], np.searchsorted(s, _BAND_EDGES), [len(s)]))
    filled = bounds[1:] > bounds[:-1]
    least = np.where(filled, s[np.minimum(bounds[:-1], len(s) - 1)], U64(0))
    keys = mix64(mix64(least + np.arange(len(least), dtype=np.uint64) * _K[0]).reshape(BANDS, BAND).sum(axis=1, dtype=np.uint64))
    return keys[filled.reshape(BANDS, BAND).any(axis=1)].view(np.int64).tolist()


_COMPARED = "a long, b long, linked boolean, h int, n int, pivot_n int, crowd boolean, tokens binary, sketch array<bigint>, bands array<bigint>"


def _compared(num: int, den: int, shared):
    """Rows sorted by (a, salt, b): the pivot's own set first (b null), then its partners.

    Tells of each partner whether it is linked, by how many shingles it differs and,
    where the pivot has others (``crowd``), the first of these that matter.
    """
    kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
    names = [c.split()[0] for c in _COMPARED.split(", ")]

    def run(batches):
        name, pivot, last = None, None, None
        heavy, counts = shared.value
        for batch in batches:
            out = []
            for a, salt, b, crowd, raw in zip(*(batch[c].to_pylist() for c in ("a", "salt", "b", "crowd", "shingles")), strict=True):
                s = np.frombuffer(raw, np.uint64)
                if b is None:
                    name, pivot, last = (a, salt), s, None
                elif name == (a, salt) and b != last:  # rows that repeat both doc_id and text bring a set twice
                    last = b
                    tokens = _difference(pivot, s, heavy, counts)
                    h, total = len(tokens), len(s) + len(pivot)
                    linked = h * (den + num) <= total * (den - num)
                    out.append((a, b, linked, h, len(s), len(pivot), crowd, tokens[: _most(len(s), num, den) + 1].tobytes() if crowd else b"", _sketch(tokens) if crowd else [], _bands(s) if crowd else []))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 10, kinds, strict=True)], names)

    return run


@dataclass
class _Join:
    """What the steps of one join share."""

    texts: DataFrame
    reps: DataFrame  # node, rep: the smallest doc_id of each class
    words: int
    seed: int
    num: int
    den: int
    heavy: object
    tell: bool = True  # whether compared pairs come with their differences

    def compared(self, pairs: DataFrame) -> DataFrame:
        """Compares the pairs (a, b), see ``_compared``. A pivot with many partners is compared in several copies."""
        rows = pairs.count()
        fan = stored(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("partners")).select("a", F.ceil(F.col("partners") / PARTNERS).cast("int").alias("copies"), (F.lit(self.tell) & (F.col("partners") > 1)).alias("crowd")), rows)
        members = pairs.join(small(fan), "a").select("a", F.pmod(F.xxhash64("b"), F.col("copies")).cast("int").alias("salt"), "b", F.lit(None).cast("int").alias("copies"), "crowd", F.col("b").alias("node"))
        pivots = fan.select("a", F.lit(0).alias("salt"), F.lit(None).cast("long").alias("b"), "copies", "crowd", F.col("a").alias("node"))
        places = stored(few(members.unionByName(pivots), 2 * rows).join(self.reps, "node").drop("node"), 2 * rows)
        sets = self.texts.join(small(places), self.texts["doc_id"] == places["rep"]).drop("rep", "doc_id", "mark").mapInArrow(_placed_sets(self.words, self.seed), "a long, salt int, b long, crowd boolean, shingles binary")
        dealt = sets.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
        return stored(dealt.mapInArrow(_compared(self.num, self.den, self.heavy), _COMPARED), 10 * rows)  # each takes ten times as long as a row of a few numbers

    def starred(self, compared: DataFrame) -> DataFrame:
        """Adds ``c``, the component so far, and ``apart``: whether the cluster has a member out of the pivot's component.

        With u = (den + num) h - (den - num) n, members x and y are linked for sure if
        u(x) + u(y) <= 0. All such pairs are linked with the member of least u, and it
        with the pivot, so they are one component.
        """
        u = F.col("h") * (self.den + self.num) - F.col("n") * (self.den - self.num)
        least = compared.where("crowd").groupBy("a").agg(F.least(F.min(u), F.min(-F.col("pivot_n") * (self.den - self.num))).alias("least"), F.max(u).alias("most"))
        joined = compared.join(small(stored(least, compared.count())), "a", "left")
        sure = F.coalesce(u + F.col("least") <= 0, F.col("linked"))
        return stored(joined.withColumns({"c": F.when(sure, F.col("a")).otherwise(F.col("b")), "apart": F.coalesce(F.col("most") + F.col("least") > 0, F.lit(False))}).drop("least", "most", "linked", "pivot_n"))

    def linked(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are linked."""
        return stored(replace(self, tell=False).compared(stored(pairs)).where("linked").select("a", "b"))

    def near(self, pairs: DataFrame, members: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) of members of a cluster that are of different components and, by their sizes and sketches, may be linked."""
        known = stored(members.select("b", "c", "n", "sketch").dropDuplicates(["b"]), members.count())
        side = lambda name, i: small(known).select(F.col("b").alias(name), *[F.col(x).alias(f"{x}{i}") for x in ("c", "n", "sketch")])
        apart = F.aggregate(F.zip_with("sketch1", "sketch2", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
        close = apart * (self.den + self.num) <= (F.col("n1") + F.col("n2")) * (self.den - self.num)
        return pairs.join(side("a", 1), "a").join(side("b", 2), "b").where((F.col("c1") != F.col("c2")) & self._sizes() & close).select("a", "b")

    def _sizes(self):
        return (F.col("n1") * self.den >= F.col("n2") * self.num) & (F.col("n2") * self.den >= F.col("n1") * self.num)

    def banded(self, placed: DataFrame) -> tuple[DataFrame, DataFrame]:
        """``placed`` with components by what members that share a band are linked with, and those links.

        The members of each band are compared with the smallest of them.
        """
        members = placed.where("apart")
        rows = members.select("a", "b", F.explode("bands").alias("band"))
        hubs = rows.groupBy("a", "band").agg(F.min("b").alias("hub"), F.max("b").alias("last")).where("hub < last").drop("last")
        pairs = stored(rows.join(hubs, ["a", "band"]).where("b <> hub").select(F.col("hub").alias("a"), "b").distinct(), BANDS * members.count())
        links = self.linked(self.near(pairs, members))
        # A cluster is named by its smallest node, and so is the component of its pivot.
        met = stored(connected_components(links.union(members.where("c <> b").select(F.col("c").alias("a"), "b"))).withColumnRenamed("node", "b"))
        return stored(placed.join(small(met), "b", "left").withColumn("c", F.coalesce("component", "c")).drop("component")), links

    def labelled(self, placed: DataFrame, labels: DataFrame) -> DataFrame:
        """``placed`` with the components ``labels`` (b, c) of an earlier level."""
        labels = stored(labels)
        known = small(labels).select("b", F.col("c").alias("label"))
        own = stored(placed.join(known, "b", "left").withColumn("label", F.coalesce("label", "b")))
        pivots = own.select("a").distinct().join(known.withColumnRenamed("b", "a"), "a")
        main = stored(own.where("c = a").select("a", "label").union(pivots).distinct().withColumn("main", F.lit(True)), 2 * placed.count())
        return stored(own.join(small(main), ["a", "label"], "left").withColumn("c", F.when(F.col("main") | (F.col("c") == F.col("a")), F.col("a")).otherwise(F.col("label"))).drop("label", "main"))

    def sieve(self, members: DataFrame, passing: DataFrame) -> object:
        """Bits, shared with all tasks, on which tokens of the members' prefixes fall, for those of ``passing``; null if these are few.

        What misses them is in none of those prefixes. If both are the same members, bits
        on which tokens of two components fall (or two of one, where it is dealt out): what
        misses them is in prefixes of one component only.
        """
        count = lambda x: x.agg(F.sum(F.octet_length("tokens") / 8)).first()[0] or 0
        tokens = count(passing)
        if tokens < SIEVE_FROM:
            return None
        tokens = tokens if passing is members else count(members)
        size = min(max(math.ceil(math.log2(SIEVE_BITS * tokens + 1)), LEAST_SIEVE), MOST_SIEVE)
        kind = "block int, once binary, twice binary"
        by_component = members.select("a", "c", "n", "tokens").repartition("c").sortWithinPartitions("c")
        blocks = by_component.mapInArrow(_sieved(self.num, self.den, size), kind).groupBy("block").applyInArrow(_overlaid, kind)
        bits = np.zeros(1 << size - 6, np.uint64)
        for block, raw in blocks.select("block", "twice" if passing is members else "once").collect():  # bounded by MOST_SIEVE
            bits[block * SIEVE_BLOCK : (block + 1) * SIEVE_BLOCK] = np.frombuffer(raw, np.uint64)
        return members.sparkSession.sparkContext.broadcast(bits)

    def meeting(self, fewer: DataFrame, more: DataFrame, sieves: tuple = (None, None)) -> DataFrame:
        """Pairs ``a, b`` of members of one cluster and different components whose prefixes meet, the first with no larger difference than the second.

        ``sieves``: for the tokens of ``fewer`` and of ``more`` the sieve of the other, where there is one.
        """
        if fewer is more:
            sieves = (self.sieve(fewer, fewer),)
        sides = [x.select("a", "b", "c", "h", "n", "tokens", "sketch") for x in ([fewer] if fewer is more else [fewer, more])]
        roles = lambda i, folded: sides[i].mapInArrow(_roles(self.num, self.den, folded, len(sides) == 2 and i == 0, sieves[i]), _role(folded))
        light = [roles(i, 0).select("token", "c", "few") for i in range(len(sides))]
        shared = stored(reduce(DataFrame.union, light).groupBy("token").agg(F.min("c").alias("one"), F.max("c").alias("two"), F.max("few").alias("few")).where("one < two and few").select("token"))
        shared = small(shared)
        rows = lambda i: roles(i, FOLDED).join(shared, "token", "left_semi")
        names = [f"s{i}" for i in range(FOLDED)]
        one = rows(0).where("few").select("token", *[F.col(x).alias(f"{x}1") for x in ("b", "c", "h", "n", "at", *names)])
        two = rows(len(sides) - 1).select("token", *[F.col(x).alias(f"{x}2") for x in ("b", "c", "h", "n", "at", *names)])
        least = reduce(lambda x, y: x + y, [F.col("at1") + F.col("at2"), *[F.bit_count(F.col(f"{x}1").bitwiseXOR(F.col(f"{x}2"))) for x in names]])
        close = least * (self.den + self.num) <= (F.col("n1") + F.col("n2")) * (self.den - self.num)
        near = (F.col("h2") - F.col("h1")) * (self.den + self.num) <= (F.col("n1") + F.col("n2")) * (self.den - self.num)
        ordered = (F.col("h1") < F.col("h2")) | ((F.col("h1") == F.col("h2")) & (F.col("b1") != F.col("b2")))
        joined = one.join(two, "token").where((F.col("c1") != F.col("c2")) & ordered & near & self._sizes() & close)
        pairs = stored(joined.select(F.least("b1", "b2").alias("a"), F.greatest("b1", "b2").alias("b")).distinct())
        # Whole sketches rule out most of what their folded ones let through.
        return self.near(pairs, reduce(DataFrame.union, sides))

    def bordering(self, placed: DataFrame) -> list[DataFrame]:
        """Links ``a, b`` between members by themselves and those of the pivot's component.

        Differences of linked members have sizes that differ by no more than the members
        may, which leaves few of those by themselves. They are first compared with the
        member closest to the pivot, which is linked to nearly all that any other is.
        """
        low = F.col("h") * (self.den + self.num) - F.col("n") * (self.den - self.num)
        high = F.col("h") * (self.den + self.num) + F.col("n") * (self.den - self.num)
        main = placed.where("apart and c = a")
        rows = placed.count()
        reach = stored(main.groupBy("a").agg(F.max(high).alias("reach"), F.min(F.struct("h", "b"))["b"].alias("closest")), rows)
        alone = stored(placed.where("apart and c <> a").join(small(reach), "a").where(low <= F.col("reach")))
        if alone.isEmpty():
            return []
        links = [self.linked(alone.select(F.col("closest").alias("a"), "b"))]
        found = stored(alone.join(small(links[0]).select("b"), "b").select("c").distinct(), rows)
        alone = stored(alone.join(small(found), "c", "left_anti"))
        if alone.isEmpty():
            return links
        least = stored(alone.groupBy("a").agg(F.min(low).alias("least")), rows)
        main = stored(main.join(small(least), "a").where(high >= F.col("least")))
        sieve = self.sieve(alone, main)
        pairs = self.meeting(alone, main, (None, sieve)).union(self.meeting(main, alone, (sieve, None))).distinct()
        return [*links, self.linked(pairs)]

    def components(self, entries: DataFrame) -> DataFrame:
        """``node, component`` of the classes that have a link."""
        links: list[DataFrame] = []
        placed = alone = None
        for level in itertools.count(1):
            with scratch() as keep:
                now = self.starred(self.compared(_clusters(entries)))
                if placed is None:
                    now, found = self.banded(now)
                    links.append(keep(found))
                else:
                    now = self.labelled(now, alone.select("b", "c"))
                links.append(keep(stored(keep(now).where("c <> b").select(F.col("c").alias("a"), "b"))))
                links += [keep(found) for found in self.bordering(now)]
            if placed is not None:
                drop(placed)  # its differences have been listed
            placed = now
            alone = placed.where("apart and c <> a").select("a", "b", "c", "h", "n", "tokens", "sketch")
            members, found = placed.agg(F.count(F.lit(1)), F.count_if(F.expr("c = a"))).first()
            with scratch() as keep:
                several = keep(stored(alone.groupBy("a").agg((F.min("c") < F.max("c")).alias("several")).where("several").select("a"), members))
            alone = alone.join(small(several), "a", "left_semi")
            if several.isEmpty():
                break
            if level >= LEVELS and found < WORTH * members:
                with scratch() as keep:
                    links.append(keep(self.linked(self.meeting(alone, alone))))
                break
            entries = alone.select("a", "b", "n", "tokens").mapInArrow(_difference_lists(self.num, self.den), _ENTRY)
        return connected_components(reduce(DataFrame.union, links))


def _role(folded: int) -> str:
    return "token long, few boolean, b long, c long, h int, n int, at int" + "".join(f", s{i} long" for i in range(folded))


def _sketches_from(sketch: np.ndarray, tokens: np.ndarray, folded: int) -> np.ndarray:
    """Per token the folded sketch of the set without the tokens before it."""
    falls = (mix64(tokens ^ _SALT) >> U64(54)).astype(np.int64)
    changes = np.zeros((len(tokens), 8 * folded), np.uint8)
    changes[:1] = np.bitwise_xor.reduce(sketch.reshape(-1, folded)).view(np.uint8)
    before = np.arange(1, len(tokens))
    changes[before, falls[:-1] // 8 % (8 * folded)] = 0x80 >> falls[:-1] % 8
    return np.bitwise_xor.accumulate(changes).view(np.int64)


def _token_keys(cluster: int, tokens: np.ndarray) -> np.ndarray:
    """Tokens of a cluster, told apart from those of others."""
    return mix64(tokens + mix64(np.array([cluster], np.int64).view(np.uint64)))


def _falls(keys: np.ndarray, size: int) -> list[np.ndarray]:
    """The two of 2**size bits that each key falls on."""
    return [(k >> U64(64 - size)).astype(np.int64) for k in (keys, keys * _K[0])]


def _sieved(num: int, den: int, size: int):
    """Blocks of a sieve of 2**size bits: those that a token of the task's prefixes falls on, and those that two do."""

    def run(batches):
        once, twice = np.zeros((2, 1 << size - 6), np.uint64)
        for keys in _by_component(batches, num, den):
            at, tokens = np.unique(np.concatenate(_falls(keys, size)), return_counts=True)
            word, bit = at >> 6, U64(1) << (at & 63).astype(np.uint64)
            again = (tokens > 1) | (once[word] & bit > 0)
            np.bitwise_or.at(once, word, bit)
            np.bitwise_or.at(twice, word[again], bit[again])
        blocks = np.flatnonzero(once.reshape(-1, SIEVE_BLOCK).any(axis=1))
        cut = lambda bits: pa.array([x.tobytes() for x in bits.reshape(-1, SIEVE_BLOCK)[blocks]], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), cut(once), cut(twice)], ["block", "once", "twice"])

    return run


def _by_component(batches, num: int, den: int):
    """Keys of the tokens of rows sorted by component, each once a component, ROLES_AT_ONCE or so at once."""
    whole, own, last, size = [], [], None, 0
    distinct = lambda: [np.unique(np.concatenate(own))] if own else []
    for batch in batches:
        for p, c, n, raw in zip(*(batch[x].to_pylist() for x in ("a", "c", "n", "tokens")), strict=True):
            if c != last or size >= ROLES_AT_ONCE:  # a component may be larger than what is held
                whole, own, last = whole + distinct(), [], c
                if size >= ROLES_AT_ONCE:
                    yield np.concatenate(whole)
                    whole, size = [], 0
            own.append(_token_keys(p, np.frombuffer(raw, np.uint64)[: _most(n, num, den) + 1]))
            size += len(own[-1])
    if size:
        yield np.concatenate(whole + distinct())


def _overlaid(blocks: pa.Table) -> pa.Table:
    """One block of those that tasks have made of the same place."""
    once, twice = (np.frombuffer(b"".join(blocks[x].to_pylist()), np.uint64).reshape(-1, SIEVE_BLOCK) for x in ("once", "twice"))
    seen, again = np.zeros(SIEVE_BLOCK, np.uint64), np.bitwise_or.reduce(twice)
    for bits in once:
        again |= seen & bits
        seen |= bits
    return pa.table({"block": blocks["block"][:1], "once": pa.array([seen.tobytes()], pa.binary()), "twice": pa.array([again.tobytes()], pa.binary())})


def _through(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which keys may be among those of a sieve; those that are always may."""
    falls = _falls(keys, len(bits).bit_length() + 5)
    return np.logical_and.reduce([bits[at >> 6] >> (at & 63).astype(np.uint64) & U64(1) > 0 for at in falls])


def _roles(num: int, den: int, folded: int, only_few: bool = False, sieve=None):
    """Prefixes of differences as rows of tokens, each told apart by cluster, with its place and, in so many words, the sketch of the difference from there on.

    ``only_few``: no more than the tokens marked ``few``; ``sieve``: only tokens that it lets through, see ``_Join.sieve``.

    For members A and B with h(A) <= h(B) that differ in at most k shingles, and
    h(A) + h(B) > k, the first k // 2 + 1 of A's difference (``few``) and the first
    k + 1 of B's share one. All differences of a cluster have their tokens in one order,
    so of what lies before the first that A and B share, at places i and j, nothing is
    in both: they differ by i + j and what the sketches of the rest tell. That holds for
    a later one that they share only if they differ by much less than k.
    """
    names = [c.split()[0] for c in _role(folded).split(", ")]
    kinds = (np.int64, np.bool_, np.int64, np.int64, np.int32, np.int32, np.int32, *[np.int64] * folded)

    def rows(out):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[i] for o in out]).astype(k) if out else np.zeros(0, k)) for i, k in enumerate(kinds)], names)

    def run(batches):
        out, size = [], 0
        for batch in batches:
            for p, b, c, h, n, raw, sketch in zip(*(batch[x].to_pylist() for x in ("a", "b", "c", "h", "n", "tokens", "sketch")), strict=True):
                most = _most(n, num, den)
                tokens = np.frombuffer(raw, np.uint64)[: (most // 2 if only_few else most) + 1]
                key = _token_keys(p, tokens)
                at = np.arange(len(key)) if sieve is None else np.flatnonzero(_through(key, sieve.value))
                if not len(at):
                    continue
                words = _sketches_from(np.array(sketch, np.int64), tokens, folded)[at].T if folded else ()
                m = len(at)
                out.append((key[at].view(np.int64), at <= most // 2, *(np.full(m, x) for x in (b, c, h, n)), at, *words))
                size += m
                if size >= ROLES_AT_ONCE:  # a batch of long texts has very many
                    yield rows(out)
                    out, size = [], 0
        if size:
            yield rows(out)

    return run


def _judged(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Per row ``doc_id, mark`` (a hash of its text), ``n, c`` (its component, null if it links with nothing) and ``component_id``."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark"))
    for seed in range(16):
        met = checkpoint(texts.mapInArrow(_classes(words, seed), "kind int, doc_id long, mark long, h1 long, h2 long, n long"))
        classes = met.where("kind = 0").select("doc_id", "mark", F.col("h1").alias("node"), "h2", "n")
        reps = checkpoint(classes.where("doc_id is not null and n > 0").groupBy("node", "h2", "n").agg(F.min("doc_id").alias("rep")))
        if reps.groupBy("node").count().where("count > 1").isEmpty():
            break  # else two classes share a node, and another seed tells them apart
    reps = reps.select("node", "rep")
    heavy = met.where("kind = 1").groupBy("h1").agg(F.sum("n").alias("n")).where(F.col("n") >= HEAVY_AT).orderBy(F.desc("n"), "h1").limit(MOST_HEAVY).toPandas()
    values, counts = heavy["h1"].to_numpy(np.int64).view(np.uint64), heavy["n"].to_numpy(np.int64)
    order = np.argsort(values)
    often = docs.sparkSession.sparkContext.broadcast((values[order], counts[order]))
    sizes = {r["n"]: r["count"] for r in classes.where(F.col("n").between(1, LARGEST_SMALL)).groupBy("n").count().collect()}
    plan = Plan(num, den, choose_boundary(sizes, num, den))
    join = _Join(texts, reps, words, seed, num, den, often)
    with scratch() as keep:
        linked = stored(join.components(texts.mapInArrow(_listed(words, seed, plan, often), _ENTRY)).join(reps, "node"))
        least = stored(linked.groupBy("component").agg(F.min("rep").alias("least")))
        linked = keep(checkpoint(linked.join(small(least), "component").select("node", "component", "least")))
    named = reps.join(linked, "node", "left").select("node", F.coalesce("component", "node").alias("c"), F.coalesce("least", "rep").alias("least"))
    has = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    return classes.join(named, "node", "left").select("doc_id", "mark", "n", F.when(has, F.col("c")).alias("c"), F.when(has, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def components(docs: DataFrame, words: int = 5, similarity: tuple[int, int] = (80, 100)) -> DataFrame:
    """Connected components of texts whose shingle sets are similar.

    ``similarity`` (num, den): two texts link when den * |intersection| >= num * |union|
    of their sets of ``words``-word shingles, A-Z lower-cased; a shorter text's whole
    word sequence is its one shingle. ``docs`` has doc_id and text.

    Returns ``doc_id, n_shingles, component_id`` (the smallest doc_id reachable by
    links, its own included) for every row. Defined cases: a null text, or one
    without words, has no shingles and links with nothing; a null doc_id gets its
    n_shingles and no component_id, and links nothing; rows that repeat a doc_id are
    each judged by their own text; a text of any length is judged whole; a similarity
    of just num/den links; an empty table gives no rows; other columns are ignored.
    Shingles are compared by 64-bit hashes, classes by 128 bits.
    """
    return _judged(docs, words, *similarity).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, words: int = 5, similarity: tuple[int, int] = (80, 100)) -> DataFrame:
    """The rows of ``docs`` that stay, all columns: of each component the row with the smallest doc_id.

    Rows without a doc_id, and those without words, stay. Of rows that repeat both
    doc_id and text one stays; of different texts of a component that share the
    smallest doc_id, the one of least hash.
    """
    with scratch() as keep:
        judged = keep(checkpoint(_judged(docs, words, *similarity).where("doc_id is not null")))
    groups = judged.where("c is not null").groupBy("c").agg(F.min(F.struct("doc_id", "mark")).alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1").select("c", "first")
    gone = judged.join(small(checkpoint(groups)), "c").where(F.struct("doc_id", "mark") != F.col("first"))
    repeats = not judged.groupBy("doc_id", "mark").count().where("count > 1").isEmpty()
    return without(docs, F.xxhash64("text"), gone.select("doc_id", "mark"), repeats)
