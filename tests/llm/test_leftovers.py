"""Nothing is left in the shared folder once results are gone."""

import gc
import os
import time

import pytest

import __spark_entry__
from clipgrain.llm.common import checkpoint, drop, scratch, shared_folder, written

NAMES = sorted(n for n in __spark_entry__.queries() if n.startswith("op") and n[2].isdigit())


def left(spark):
    """Folders of checkpoints and written tables."""
    top = shared_folder(spark).removeprefix("file:")
    return {os.path.join(d, x) for d, folders, _ in os.walk(top) for x in folders if x.startswith(("rdd-", "written-", "corpus-pipeline-"))}


def settle(spark, before):
    for _ in range(60):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.25)
        if not left(spark) - before:
            break
    return left(spark) - before


@pytest.mark.parametrize("name", [*NAMES, "pipeline"])
def test_queries_leave_nothing(spark, small, name):
    before = left(spark)
    df = __spark_entry__.queries()[name](spark, small)
    assert df.count() >= 0
    del df
    after = settle(spark, before)
    assert not after if name != "pipeline" else len(after) == 1 and "corpus-pipeline-" in after.pop()


def test_scratch(spark):
    before = left(spark)
    with scratch() as outer:
        with scratch() as keep:
            one, two = checkpoint(spark.range(5)), keep(checkpoint(spark.range(7)))
        assert len(left(spark) - before) == 1 and two.count() == 7
        three = outer(checkpoint(spark.range(3)))
        with pytest.raises(ZeroDivisionError), scratch():
            checkpoint(spark.range(9))
            raise ZeroDivisionError
    assert len(left(spark) - before) == 1 and three.count() == 3 and one is not None
    drop(three)
    with written(spark.range(4)) as rows:
        assert rows.count() == 4 and len(left(spark) - before) == 1
    assert left(spark) == before
