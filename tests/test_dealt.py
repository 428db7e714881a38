"""Rows that cost much are dealt over the cores; YAML by either loader."""

import pytest

from weftlake.plans import queries
from weftlake.sources import handlers


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["yaml_blobs", "microdata_items", "selector_replay", "html_tables", "learned_specs", "page_outlines"])
def test_rows_that_cost_much_are_dealt_over_the_cores(spark, name):
    said = plan(queries.QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert f", {4 * spark.sparkContext.defaultParallelism}), REPARTITION_BY_NUM" in said


@pytest.mark.parametrize("text", ["a: 1", "- x\n- {y: [1, 2.5, ~]}", "d: 2024-01-02", "s: 'it''s'", "a: &k {b: 1}\nc: *k", "x: yes", "é: “”", "", "a: |\n  b\n  c\n", "n: 0x1F\nm: 1_000\no: 017"])
def test_both_yaml_loaders_agree(text):
    import json

    import yaml

    assert next(handlers.read_yaml(text)) == (json.dumps(yaml.safe_load(text), default=str, ensure_ascii=False),)
