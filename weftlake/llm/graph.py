"""Connected components of an edge table, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, meet, salted_join


def components(edges: DataFrame, grows: bool = False) -> DataFrame:
    """``edges(a, b)`` -> ``(node, comp)``: the smallest node reachable.

    Every round a node takes the smallest label among its neighbours' and then
    its label's label (pointer jumping), so paths shrink by halves; labels only
    fall, so the rounds end when none has changed.  Each round is stored;
    nothing is collected but whether a label changed.  A node with very many
    neighbours is spread over salts wherever it is a join key.  ``grows``, as
    in ``salted_join``: labels never pass through the driver.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b")
    both = materialize(both.distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("comp")), "labels")
    while True:
        near = salted_join(both, labels.select(F.col("node").alias("b"), F.col("comp").alias("_c")), "b", salt="a", grows=grows).groupBy(F.col("a").alias("node")).agg(F.min("_c").alias("_near"))
        hooked = (meet if grows else DataFrame.join)(labels, near, "node").select("node", F.col("comp").alias("_old"), F.least("comp", "_near").alias("comp"))
        up = labels.select(F.col("node").alias("comp"), F.col("comp").alias("_up"))
        fresh = salted_join(hooked, up, "comp", "left", salt="node", grows=grows).select("node", "_old", F.least("comp", F.coalesce("_up", "comp")).alias("comp"))
        fresh = materialize(fresh, "labels")
        changed = fresh.filter("comp <> _old").limit(1).count()
        labels = fresh.select("node", "comp")
        if not changed:
            return labels
