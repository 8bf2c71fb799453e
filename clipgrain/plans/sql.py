"""Table functions for SQL: ``register`` makes them known to a session.

    SELECT c.clip_id, s.* FROM inventories c, LATERAL smooth_counts(c.counts) s
    SELECT * FROM score_language_match(TABLE(SELECT clip_id, claimed_language, symbol, n FROM counts) PARTITION BY clip_id)

``smooth_counts`` is a SQL function over a clip's map of IPA counts, so it stays in the
JVM and adds no shuffle. ``score_language_match`` takes a clip's counts as rows, which
PARTITION BY brings together, and gives the verdict as one row.
"""

from __future__ import annotations

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from clipgrain.sources import reference_data as R


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def smooth_counts_sql() -> str:
    edges: dict[str, list[str]] = {}
    for target, _, heard, weight in R.confusion_rows():
        edges.setdefault(target, []).append(f"named_struct('heard', {_text(heard)}, 'weight', {weight}D)")
    near = "map(" + ", ".join(f"{_text(t)}, array({', '.join(e)})" for t, e in edges.items()) + ")"
    added = f"aggregate(coalesce(try_element_at({near}, s), array()), 0D, (acc, e) -> acc + e.weight * coalesce(try_element_at(counts, e.heard), 0L))"
    all_ = f"transform(array_union(map_keys(counts), map_keys({near})), s -> named_struct('symbol', s, 'smoothed', coalesce(try_element_at(counts, s), 0L) + {added}))"
    kept = f"filter({all_}, x -> x.smoothed > 0 OR map_contains_key(counts, x.symbol))"
    return f"""CREATE OR REPLACE TEMPORARY FUNCTION smooth_counts(counts MAP<STRING, BIGINT>) RETURNS TABLE(symbol STRING, smoothed DOUBLE)
        RETURN SELECT x.symbol, x.smoothed FROM (SELECT explode({kept}) AS x)"""


class ScoreLanguageMatch:
    """Adds up a clip's symbols and scores them when the clip is through; see ``inventory.language_match``."""

    def __init__(self):
        self.clip, self.claim, self.counts = None, None, {}
        self.index, self.markers = R.profile_index(), R.marker_rows()

    def eval(self, row: Row):
        self.clip, self.claim = row["clip_id"], row["claimed_language"]
        self.counts[row["symbol"]] = self.counts.get(row["symbol"], 0) + row["n"]

    def _profile(self) -> str | None:
        key = self.claim.strip().lower()
        words = key.replace("-", " ").replace("_", " ").split()
        names = [key, key.split("(")[0].strip() if "(" in key else None, *(words[:1] or [None]), *(words[-1:] or [None])]
        return next((self.index[n] for n in names if n in self.index), None)

    def terminate(self):
        if not self.claim:
            return
        profile = self._profile()
        passed, total = {}, sum(self.counts.values())
        for language, side, _, _, threshold, optional, variants in self.markers:
            if language == profile:
                n = sum(self.counts.get(v, 0) for v in variants)
                passed.setdefault(side, []).append((n >= threshold if side == "positive" else n <= threshold, optional))
        positive, negative = passed.get("positive", []), passed.get("negative", [])
        hits, clean = sum(p for p, _ in positive), sum(p for p, _ in negative)
        base = sum(p or not o for p, o in positive)
        if profile is None:
            yield self.clip, self.claim.strip().lower(), "unknown_language", None, 0, 0, 0, 0
        elif total < R.MIN_TOKENS:
            yield self.clip, profile, "insufficient_signal", None, 0, len(positive), 0, len(negative)
        else:
            score = R.POSITIVE_WEIGHT * (hits / base if base else 1.0) + R.NEGATIVE_WEIGHT * (clean / len(negative) if negative else 1.0)
            verdict = "matches" if score >= R.MATCHES_AT else "mismatch" if score < R.MISMATCH_BELOW else "uncertain"
            yield self.clip, profile, verdict, score, hits, base, clean, len(negative)


SCORE = "clip_id long, profile string, verdict string, score double, positive_hits int, positive_total int, negative_clean int, negative_total int"


def register(spark: SparkSession) -> None:
    spark.sql(smooth_counts_sql())
    spark.udtf.register("score_language_match", udtf(ScoreLanguageMatch, returnType=SCORE))
