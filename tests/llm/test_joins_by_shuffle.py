"""Joins of tables that grow with the input send none of them through the driver."""

from weftlake.llm import common, graph, tilelinks


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_near_duplicate_vectors(spark, monkeypatch):
    stored = {}

    def materialize(df, name):
        stored.setdefault(name, []).append(plan(df))
        return common.materialize(df, name)

    monkeypatch.setattr(tilelinks, "materialize", materialize)
    monkeypatch.setattr(graph, "materialize", materialize)
    vectors = spark.createDataFrame([(k, [float(k % 3 == 0), float(k % 3 == 1), k * 0.001]) for k in range(12)], "vec_id long, embedding array<double>")
    out = tilelinks.near_duplicates(vectors)
    assert stored.keys() == {"rows", "classes", "found", "edges", "labels", "named"}
    assert "Broadcast" not in plan(out) and not any("Broadcast" in x for name, plans in stored.items() if name != "found" for x in plans)
    assert {(r.n_links, r.component_id) for r in out.collect()} == {(3, 0), (3, 1), (3, 2)}


def test_salted_joins(spark):
    one = common.materialize(spark.createDataFrame([(k, f"v{k}") for k in range(5)], "k long, v string"), "one")
    many = common.materialize(spark.createDataFrame([(k, 0 if k < 9 else k % 5) for k in range(20)], "n long, k long"), "many")
    joined = common.salted_join(many, one, "k", salt="n", grows=True)
    assert "Broadcast" not in plan(joined)
    for df in (joined, common.salted_join(many, one, "k", salt="n")):
        assert sorted((r.n, r.v) for r in df.collect()) == [(n, "v0" if n < 9 else f"v{n % 5}") for n in range(20)]
