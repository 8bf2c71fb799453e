"""How far a run has come: counts that are observed as rows pass by, and their rate."""

from __future__ import annotations

import time
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


class Progress(NamedTuple):
    done: int
    failed: int
    rate: float
    eta_s: float

    def text(self, total: int) -> str:
        return f"[{self.done}/{total}] ok={self.done - self.failed} fail={self.failed}  rate={self.rate:.2f}/s  eta={self.eta_s:.0f}s"


def progress(done: int, failed: int, total: int, seconds: float) -> Progress:
    """Rates are 0 where no time has passed, and what is left takes no time where nothing moves."""
    rate = done / seconds if seconds > 0 else 0.0
    return Progress(done, failed, rate, (total - done) / rate if rate > 0 else 0.0)


def observed(df: DataFrame, failed: Column, name: str = "progress") -> tuple[DataFrame, Observation]:
    """``df`` and an observation of its rows and failed rows, which is there once any action has run over it; no action of its own."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("done"), F.count_if(failed).alias("failed")), seen


class ProgressListener(StreamingQueryListener):
    """Adds up the observed counts of a stream's batches: ``progress`` is that of all batches so far."""

    def __init__(self, total: int, name: str = "progress"):
        self.total, self.name, self.began = total, name, time.monotonic()
        self.done = self.failed = self.batches = 0

    def onQueryStarted(self, event) -> None:
        self.began = time.monotonic()

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get(self.name)
        if seen is not None:
            self.done, self.failed, self.batches = self.done + seen.done, self.failed + seen.failed, self.batches + 1

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    @property
    def progress(self) -> Progress:
        return progress(self.done, self.failed, self.total, time.monotonic() - self.began)
