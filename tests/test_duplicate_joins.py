"""Joins of duplicates that send no table through the driver."""

import pytest

from weftlake.operators import dedupe, dupindex
from weftlake.store import stored


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def classes(spark):
    return stored(spark.createDataFrame([(i, 7 * i, i << 5, 1) for i in range(1, 40)], "rep long, hi long, lo long, copies long"))


def test_near_pairs_send_no_table_through_the_driver(classes):
    assert "Broadcast" not in plan(dedupe.near_pairs(classes))


def test_leaders_send_no_table_through_the_driver(classes):
    frames = []

    def store(df):
        frames.append(plan(df))
        return stored(df)

    led = dedupe.leaders(classes, dedupe.near_pairs(classes), store)
    assert len(frames) >= 6 and not any("Broadcast" in x for x in [*frames, plan(led)])
    assert led.count() == 39


def test_an_index_sends_no_table_through_the_driver(spark, classes, tmp_path):
    prints = classes.select(classes.rep.alias("doc_id"), "hi", "lo")
    for batch in (0, 1):
        out = dupindex.check_and_add(prints.filter(f"doc_id % 2 = {batch}"), f"{tmp_path}/index", batch)
        assert "Broadcast" not in plan(out)
