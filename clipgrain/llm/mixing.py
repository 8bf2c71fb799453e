"""Mixing sources to target weights, by temperature.

Source token shares are raised to a power and normalised. The power is found by
bisection (sixteen sections at a time, each round one small aggregation) as the
largest that still meets a target entropy, or the smallest that keeps within a
repetition limit. The weights are then realised as block permutations: each
source is read in whole passes, every pass in an order of its own, and the last
pass stops at the source's budget. All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipgrain.llm.common import SPACES, checkpoint, small

SEED = 7
#: Draws are spread over this many blocks, each of which holds every source by its weight.
BLOCKS = 100
#: Rows of one source that one window may hold, about.
BUCKET_ROWS = 20_000
_SECTIONS, _ROUNDS = 16, 10


def words(text: Column) -> Column:
    """Words of a text between the six white-space bytes, one at least so that every text has a cost."""
    return F.greatest(F.size(F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")), F.lit(1)).cast("long")


def temperature(shares: DataFrame, target_entropy: float | None = None, max_repetition: float | None = None) -> float:
    """The exponent in [0, 1] for ``shares`` (share), to six decimals.

    ``target_entropy`` is a fraction of the largest entropy (all sources alike): the
    largest exponent that reaches it. ``max_repetition`` bounds how many times as often
    the most repeated source is read as the least repeated one: the largest exponent
    isn't needed then, but the smallest within the bound. Both: the larger exponent.
    """

    def met(grid: list[float]):
        power = F.pow(F.col("share"), F.col("a"))
        each = shares.select("share", F.explode(F.array(*map(F.lit, grid))).alias("a"))
        sums = each.groupBy("a").agg(F.sum(power).alias("z"), F.sum(power * F.ln(power)).alias("l"), F.max(F.pow("share", F.col("a") - 1)).alias("hi"), F.min(F.pow("share", F.col("a") - 1)).alias("lo"), F.count(F.lit(1)).alias("n"))
        return sums.select("a", (F.ln("z") - F.col("l") / F.col("z")).alias("entropy"), F.ln("n").alias("most"), (F.col("hi") / F.col("lo")).alias("repetition")).orderBy("a").collect()

    def bisect(holds, rising: bool) -> float:
        """The boundary of a condition that holds above (rising) or below it."""
        low, high = 0.0, 1.0
        ends = met([low, high])
        if not ends:
            return 1.0
        if holds(ends[0 if rising else 1]):
            return 0.0 if rising else 1.0
        for _ in range(_ROUNDS):
            rows = met([low + (high - low) * i / _SECTIONS for i in range(1, _SECTIONS)])
            fits = [r["a"] for r in rows if holds(r)]
            fails = [r["a"] for r in rows if not holds(r)]
            low, high = (max([low, *fails]), min([high, *fits])) if rising else (max([low, *fits]), min([high, *fails]))
        return high if rising else low

    found = []
    if target_entropy is not None:
        found.append(bisect(lambda r: r["entropy"] >= target_entropy * r["most"], rising=False))
    if max_repetition is not None:
        found.append(bisect(lambda r: r["repetition"] <= max_repetition, rising=True))
    return round(int(max(found, default=1.0) * 1e6 + 1e-3) / 1e6, 6)


def _placed(docs: DataFrame, tokens: Column | None) -> list[Column]:
    """``key`` of a row's source, its ``tokens``, the ``name`` that orders it (its doc_id, or a hash of its text and its position) and its position ``at``."""
    at = F.monotonically_increasing_id()
    cost = words(F.col("text")) if tokens is None else F.greatest(tokens.cast("long"), F.lit(1))
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null"), F.md5(F.coalesce("text", F.lit(""))), F.lit(":"), at.cast("string")))
    return [F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("key"), cost.alias("tokens"), name.alias("name"), at.alias("at")]


def _order(seed: int, epoch: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.col("name")))


def _plan(rows: DataFrame, target_entropy: float | None, max_repetition: float | None, budget: int | None, seed: int) -> DataFrame:
    """Per source ``key``: how many whole ``passes``, how often it is read (``times``), and the last row of its last pass (``cut``)."""
    sums = checkpoint(rows.groupBy("key").agg(F.sum("tokens").alias("have"), F.count(F.lit(1)).alias("n")))
    total, largest = sums.agg(F.sum("have"), F.max("n")).first()
    exponent = temperature(sums.select((F.col("have") / F.lit(total)).alias("share")), target_entropy, max_repetition) if total else 1.0
    powered = sums.select("key", "have", F.pow(F.col("have") / F.lit(total), F.lit(exponent)).alias("power"))
    z, least = powered.agg(F.sum("power"), F.max(F.col("have") / F.col("power"))).first() if total else (1.0, 1.0)
    share = F.col("power") / F.lit(z)
    quota = F.floor(share * F.lit(budget)) if budget is not None else F.greatest(F.col("have"), F.round(F.col("power") * F.lit(least)).cast("long"))
    plan = checkpoint(powered.select("key", "have", quota.alias("quota")).select("key", F.expr("quota div have").alias("passes"), F.expr("quota % have").alias("rest"), (F.col("quota") / F.col("have")).alias("times")))

    # Hex digits of the permutation key that part a source into buckets of about BUCKET_ROWS.
    digits = 1
    while (largest or 0) > BUCKET_ROWS * 16**digits:
        digits += 1
    planned = rows.join(small(plan.where("rest > 0")), "key").withColumn("order", _order(seed, F.col("passes"))).withColumn("bucket", F.substring("order", 1, digits))
    # Prefix sums of the last pass in two levels: over the buckets of a source, then within the bucket where the budget ends.
    sizes = planned.groupBy("key", "bucket").agg(F.sum("tokens").alias("size"), F.max(F.struct("order", "name", "tokens", "at")).alias("last"), F.first("rest").alias("rest"))
    upto = F.sum("size").over(Window.partitionBy("key").orderBy("bucket"))
    buckets = checkpoint(sizes.withColumn("upto", upto))
    edge = buckets.where("rest < upto and rest > upto - size").select("key", "bucket", (F.col("upto") - F.col("size")).alias("before"))
    within = F.col("before") + F.sum("tokens").over(Window.partitionBy("key", "bucket").orderBy("order", "name", "tokens", "at"))
    inside = planned.join(small(checkpoint(edge)), ["key", "bucket"]).withColumn("upto", within).where("upto <= rest").select("key", F.struct("order", "name", "tokens", "at").alias("last"))
    ends = buckets.where("upto <= rest").select("key", "last").union(inside).groupBy("key").agg(F.max("last").alias("cut"))
    return checkpoint(plan.join(ends, "key", "left").select("key", "passes", "times", "cut"))


def _drawn(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """``rows`` once per draw, with its ``epoch`` and the ``times`` of its source."""
    last = F.coalesce(F.struct(_order(seed, F.col("passes")).alias("order"), "name", "tokens", "at") <= F.col("cut"), F.lit(False)).cast("long")
    copies = rows.join(small(plan), "key").withColumn("copies", F.col("passes") + last).where("copies > 0")
    return copies.withColumn("epoch", F.explode(F.expr("sequence(0L, copies - 1)")))


def mix(docs: DataFrame, target_entropy: float | None = None, max_repetition: float | None = None, budget: int | None = None, tokens: Column | None = None, seed: int = SEED, blocks: int = BLOCKS) -> DataFrame:
    """Draw rows of ``docs`` (doc_id, source, text) so that sources have temperature weights.

    ``budget`` counts tokens; by default it is the smallest that uses every document
    at least once. ``tokens`` is the cost of a row (default: its words).

    Returns one row per draw: ``doc_id, source, tokens, epoch`` (which pass over its
    source) and ``block`` (where in the mix). Defined cases: a null source is a source
    of its own; a null or empty text costs one token; a text of any length is counted
    whole; a null doc_id is drawn like any other, in an order set by its text and position;
    rows that repeat are drawn each, and the end of the last pass parts them by position;
    those that repeat a doc_id share a block; an empty table gives no rows; other columns
    are ignored.
    """
    rows = checkpoint(docs.select("doc_id", "source", *_placed(docs, tokens)))
    draws = _drawn(rows, _plan(rows, target_entropy, max_repetition, budget, seed), seed)
    progress = (F.col("epoch") + F.conv(F.substring(_order(seed, F.col("epoch")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)) / F.col("times")
    return draws.select("doc_id", "source", "tokens", F.col("epoch").cast("int").alias("epoch"), F.least(F.floor(progress * blocks), F.lit(blocks - 1)).cast("int").alias("block"))


def mixed_documents(docs: DataFrame, target_entropy: float | None = None, max_repetition: float | None = None, budget: int | None = None, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` once per draw, all columns; options and defined cases as for ``mix``.

    ``docs`` is read twice and must give its rows in one order, as a stored table does.
    """
    plan = _plan(checkpoint(docs.select(*_placed(docs, None))), target_entropy, max_repetition, budget, seed)
    return _drawn(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *_placed(docs, None)), plan, seed).select("row.*")
