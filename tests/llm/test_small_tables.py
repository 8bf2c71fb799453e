"""Tables of few rows are not worth a task for each shuffle partition."""

import os

import pytest

from clipgrain.llm.common import scratch, shared_folder, stored
from clipgrain.llm.graph import connected_components


@pytest.fixture
def many_partitions(spark):
    names = {"spark.sql.shuffle.partitions": "211", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def test_components_of_few_edges_take_few_tasks(many_partitions):
    spark = many_partitions
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(40)], "a long, b long")
    context, tasks = spark.sparkContext, 0
    context.setJobGroup("few edges", "few edges")
    try:
        with scratch():
            got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    for job in tracker.getJobIdsForGroup("few edges"):
        for stage in tracker.getJobInfo(job).stageIds:
            info = tracker.getStageInfo(stage)
            tasks += info.numCompletedTasks if info else 0
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in (100, *range(200, 240))}
    assert tasks < 2000  # with a task for each partition: several thousand


def test_stored_tables_go_with_their_step(spark):
    top = shared_folder(spark).removeprefix("file:")
    folders = lambda: {x for x in os.listdir(top) if x.startswith("written-")}
    before = folders()
    with scratch() as outer:
        with scratch() as keep:
            one, two = stored(spark.range(5)), keep(stored(spark.range(700), 700))
            assert one.count() == 5
        assert len(folders() - before) == 1 and two.count() == 700 and outer
    assert folders() == before
