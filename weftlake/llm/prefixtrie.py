"""Prefix trie of conversations, rolled up by centroid decomposition.

Turns of a conversation are numbered in order (null turn first; equal turns by
the MD5 of role, a zero and text), by ranges of the sorted table, so a
conversation with a third of all turns is numbered by many tasks; what decides
the ranges is short however long the texts are.  A prefix is named by the SHA-256 of sums: the
digest of each of its turns with its place, in eight parts, is added up over the
turns, which many tasks can do for one conversation, too.  Equal sums mean equal
turns at equal places.  A node is then a group of (conversation, depth) rows;
``(smallest member, depth)`` is its id, and the row of a conversation at a depth
(its *place*) names the node there, so the ancestor of a node at any depth is
looked up in the smallest member's places.

Totals of subtrees, for leaves and saved tokens, are rolled up over the forest
of parent edges.  A component of it weighs as many places as pass through its
nodes; for each node the weight below it comes with the grouping.  In a round,
in every component at once:

1. the centroid is the deepest node with more than half of the weight below;
2. what lies below it in the component is totalled, by one aggregation, and
3. added to every node on the way from the centroid to the component's top;
4. the way's weights fall by the centroid's, the centroid is done and leaves,
   and its children are the tops of components of their own.

No part keeps more than half of the weight, so the rounds are as many as halvings, however
deep the forest is, and a pair of a node and a descendant is added exactly once:
when a centroid first parts them or is one of them.  Components of at most ``LOCAL`` places
go on by the same steps inside one task each, many to a task.

``ends_sha256`` hashes a list in order, which no method can do in parts: ids are
put into chunks by ranges, and the chunks of a node pass one hash in a stream.

Defined results: rows with a null conv_id take no part; equal turns of one
conversation are turns each; a null role or text is empty; a conversation is
there if it has a row; other columns are not read; an empty table gives the
empty result (no root).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, salted_join

#: Conversations whose ids differ only in this modulus share the first turns of the first of them.
FAMILY = 20
#: At most this many less one turns are taken from there.
HEADS = 4
#: Turns of a conversation whose sums one task adds up.
STRETCH = 4096
#: Places of a component that is finished in one task.
LOCAL = 4096
#: Ids of a node that are put into one chunk.
CHUNK = 4096
PARTS = 8

RESULT = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, rank (from 1), role, text, words; stored.

    Sorted into ranges first; a row's rank is its number within its range's
    share of the conversation, plus the counts of the ranges before.
    """
    clean = turns.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    clean = clean.withColumn("tie", F.md5(F.concat("role", F.lit("\0"), "text"))).withColumn("row", F.monotonically_increasing_id())
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("tie"), F.col("row")]
    ranged = materialize(clean.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    within = Window.partitionBy("conv_id", "part").orderBy(*order[1:])
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    later = counts.filter("before > 0").select("conv_id", "part", "before")
    rows = ranged.withColumn("rank", F.row_number().over(within)).join(later, ["conv_id", "part"], "left")
    words = F.regexp_count("text", F.lit(WORD)).cast("long")
    return materialize(rows.select("conv_id", (F.col("rank") + F.coalesce("before", F.lit(0))).cast("long").alias("rank"), "role", "text", words.alias("words")), "numbered")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored convs(conv_id, length) and rows(conv_id, depth, words, p0 to p7): rebuilt conversations, turns as digests."""
    ranked = numbered(turns)
    own = ranked.groupBy("conv_id").agg(F.max("rank").alias("n"))
    heads = own.withColumn("head", F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)
    heads = heads.join(own.select(F.col("conv_id").alias("base"), F.col("n").alias("there")), "base", "left")
    heads = heads.withColumn("taken", F.least("head", F.coalesce("there", F.lit(0))))
    heads = materialize(heads.select("conv_id", "base", "head", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("head"), F.lit(0))).alias("length")), "heads")
    tail = salted_join(ranked, heads.select("conv_id", "head", "taken"), "conv_id", salt="rank").filter("rank > head")
    tail = tail.select("conv_id", (F.col("taken") + F.col("rank") - F.col("head")).alias("depth"), "role", "text", "words")
    first = ranked.filter(F.col("rank") < HEADS).withColumnRenamed("conv_id", "base").join(heads.select("conv_id", "base", "taken"), "base").filter("rank <= taken")
    both = tail.unionByName(first.select("conv_id", F.col("rank").alias("depth"), "role", "text", "words"))
    digest = F.sha2(F.concat(F.col("depth").cast("string"), F.lit(":"), F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    both = both.withColumn("digest", digest)
    parts = [F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("long").alias(f"p{k}") for k in range(PARTS)]
    return heads.select("conv_id", "length"), materialize(both.select("conv_id", "depth", "words", *parts), "turns")


def _named(*parts):
    return F.sha2(F.concat_ws(",", *[p.cast("string") for p in parts]), 256)


def places(turns: DataFrame) -> DataFrame:
    """conv_id, depth (from 0), key, parent (key), words, length: the prefixes of each rebuilt conversation; stored."""
    convs, rows = rebuilt(turns)
    rows = rows.withColumn("stretch", F.floor((F.col("depth") - 1) / STRETCH))
    names = [f"p{k}" for k in range(PARTS)]
    upto = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    whole = rows.groupBy("conv_id", "stretch").agg(*[F.sum(c).alias(c) for c in names])
    earlier = whole.select("conv_id", "stretch", *[F.sum(c).over(upto).alias(f"e{c}") for c in names]).filter("ep0 is not null")
    within = Window.partitionBy("conv_id", "stretch").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("conv_id", "stretch", "depth", "words", *names, *[F.sum(c).over(within).alias(f"s{c}") for c in names])
    rows = rows.join(earlier, ["conv_id", "stretch"], "left")
    total = [F.col(f"s{c}") + F.coalesce(f"e{c}", F.lit(0)) for c in names]
    above = _named(*[t - F.col(c) for t, c in zip(total, names)])
    named = rows.select("conv_id", "depth", _named(*total).alias("key"), F.when(F.col("depth") > 1, above).otherwise(F.lit("")).alias("parent"), "words")
    named = salted_join(named, convs, "conv_id", salt="depth")
    top = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit("").alias("key"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("words"), "length")
    return materialize(named.unionByName(top), "places")


def trie(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored nodes and paths.

    nodes: key, rep (smallest member), depth, up (the parent's rep), n_convs, n_children, below (places in the subtree), saved.
    paths(conv_id, depth, rep, child): the node of each place by its rep, and the rep of the next one.
    """
    at = places(turns)
    found = at.groupBy("key", "depth").agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("n_convs"), F.first("parent").alias("parent"), F.first("words").alias("words"), F.sum(F.col("length") - F.col("depth") + 1).alias("below"))
    found = materialize(found, "prefixes")
    children = found.filter("parent is not null").groupBy("parent").agg(F.count(F.lit(1)).alias("n_children")).withColumnRenamed("parent", "key")
    ups = found.select(F.col("key").alias("parent"), F.col("rep").alias("up"))
    nodes = salted_join(found.join(children, "key", "left"), ups, "parent", "left", salt="key")
    nodes = nodes.select("key", "rep", "depth", "up", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "below", ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    reps = materialize(salted_join(at.select("conv_id", "depth", "key"), found.select("key", "rep"), "key", salt="conv_id").select("conv_id", "depth", "rep"), "reps")
    following = reps.select("conv_id", (F.col("depth") - 1).alias("depth"), F.col("rep").alias("child"))
    return materialize(nodes, "nodes"), materialize(reps.join(following, ["conv_id", "depth"], "left"), "paths")


_ID = "concat_ws(':', {}, {})"
_ROWS = ["rep", "depth", "up", "comp", "below", "leaf", "saved", "leaves", "tokens"]


def _round(rows: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parts every component of ``rows`` at its centroid: (rows of the parts, finished centroids)."""
    weights = rows.filter(F.expr(_ID.format("rep", "depth")) == F.col("comp")).select("comp", F.col("below").alias("all"))
    heavy = salted_join(rows, weights, "comp", salt="depth").filter("2 * below > all")
    centres = heavy.groupBy("comp").agg(F.max(F.struct("depth", "rep", "below")).alias("c")).select("comp", F.col("c.rep").alias("c_rep"), F.col("c.depth").alias("c_depth"), F.col("c.below").alias("c_below"))
    met = materialize(salted_join(rows, materialize(centres, "centres"), "comp"), "met")
    # below the centroid: the smallest member's path goes through it; the next node there is the part's top
    asked = met.filter("depth >= c_depth").select("rep", "comp", "c_rep", "c_depth").distinct()
    through = asked.join(paths.select(F.col("conv_id").alias("rep"), F.col("depth").alias("c_depth"), F.col("rep").alias("at"), "child"), ["rep", "c_depth"]).filter("at = c_rep")
    through = through.select("rep", "comp", F.col("child").alias("top"), F.lit(True).alias("inside"))
    # above it: nodes of the centroid's own path, one at each depth
    above = met.filter("depth <= c_depth").select("comp", F.col("c_rep").alias("conv_id"), "depth").distinct()
    above = above.join(paths.select("conv_id", "depth", "rep"), ["conv_id", "depth"]).select("comp", "depth", "rep", F.lit(True).alias("way"))
    pair = F.struct("rep", "comp")
    met = salted_join(met.withColumn("pair", pair), through.select(pair.alias("pair"), "top", "inside"), "pair", "left", salt="depth").drop("pair")
    met = met.join(above, ["comp", "depth", "rep"], "left").withColumn("inside", F.col("inside").isNotNull() & (F.col("depth") >= F.col("c_depth")))
    met = materialize(met, "parted")
    sums = met.filter("inside").groupBy("comp").agg(F.sum("leaf").alias("d_leaves"), F.sum("saved").alias("d_tokens"))
    done = salted_join(met, materialize(sums, "sums"), "comp", salt="depth")
    way = F.col("way").isNotNull()
    add = lambda x, y: F.col(x) + F.when(way, F.col(y)).otherwise(F.lit(0))
    centre = (F.col("rep") == F.col("c_rep")) & (F.col("depth") == F.col("c_depth"))
    done = done.withColumn("leaves", add("leaves", "d_leaves")).withColumn("tokens", add("tokens", "d_tokens")).withColumn("centre", centre)
    done = done.withColumn("below", F.col("below") - F.when(way & ~F.col("centre"), F.col("c_below")).otherwise(F.lit(0)))
    done = done.withColumn("comp", F.when(F.col("inside") & ~F.col("centre"), F.expr(_ID.format("top", "c_depth + 1"))).otherwise(F.col("comp")))
    done = materialize(done.select(*_ROWS, "centre"), "round")
    return done.filter("not centre").drop("centre"), done.filter("centre").select("rep", "depth", "leaves", "tokens")


def _local_totals(comp: np.ndarray, rep: np.ndarray, depth: np.ndarray, up: np.ndarray, below: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Subtree totals of ``own`` (rows, kinds) inside whole components, by centroids, all components at once."""
    order = np.lexsort((rep, depth, comp))
    comp, rep, depth, up, below, own = comp[order], rep[order], depth[order], up[order], below[order].copy(), own[order]
    n = len(comp)
    at = {k: i for i, k in enumerate(zip(comp.tolist(), rep.tolist(), depth.tolist()))}
    parent = np.array([at.get((c, u, d - 1), -1) for c, u, d in zip(comp.tolist(), up.tolist(), depth.tolist())], np.int64)
    size, above = [1] * n, parent.tolist()
    for i in range(n - 1, -1, -1):  # children come after their parents
        if above[i] >= 0:
            size[above[i]] += size[i]
    enter, free, root = [0] * n, [0] * n, 0
    for i in range(n):
        if above[i] < 0:
            enter[i], root = root, root + size[i]
        else:
            enter[i] = free[above[i]]
            free[above[i]] += size[i]
        free[i] = enter[i] + 1
    enter, leave = np.array(enter), np.array(enter) + np.array(size)
    total, part = np.zeros_like(own), np.arange(n)
    part = np.maximum.accumulate(np.where(parent < 0, part, 0))  # a part is known by its top, the first row of a component
    live = np.arange(n)
    while len(live):
        p = part[live]
        heavy = live[2 * below[live] > below[p]]
        centre = np.zeros(n, np.int64)
        centre[part[heavy]] = heavy  # rows are in order of depth, so the deepest stays
        c = centre[p]
        inside = (enter[c] <= enter[live]) & (enter[live] < leave[c])
        way = (enter[live] <= enter[c]) & (enter[c] < leave[live])
        under = np.zeros_like(own)
        np.add.at(under, p[inside], own[live[inside]])
        total[live[way]] += under[p[way]]
        weight = below[c]
        below[live[way & (live != c)]] -= weight[way & (live != c)]
        stay = live != c
        live, c, inside = live[stay], c[stay], inside[stay]
        # the part of a row below a centroid: the last of the centroid's children that is entered not after it
        top = live[parent[live] == c]
        key = lambda of, e: of.astype(np.int64) * (root + 1) + e
        mine = part[live]
        tops = np.sort(key(part[top], enter[top]))
        named = top[np.argsort(key(part[top], enter[top]), kind="stable")]
        where = np.searchsorted(tops, key(mine[inside], enter[live[inside]]), "right") - 1
        part[live[inside]] = named[where]
    back = np.empty_like(total)
    back[order] = total
    return back


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by component, whole components to a task: rep, depth and totals; as many components at once as a batch has."""
    kept = None
    for batch in batches:
        rows = pa.Table.from_batches([batch]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([batch])])
        comp = rows.column("comp").combine_chunks().to_numpy(zero_copy_only=False)
        start = int(np.flatnonzero(comp == comp[-1])[0]) if len(comp) else 0
        kept = rows.slice(start)
        if start:
            yield _totals(rows.slice(0, start))
    if kept is not None and len(kept):
        yield _totals(kept)


def _totals(rows: pa.Table) -> pa.RecordBatch:
    rows = rows.combine_chunks()
    get = lambda c: rows.column(c).to_numpy()
    _, comp = np.unique(rows.column("comp").to_numpy().astype(str), return_inverse=True)
    up = rows.column("up").fill_null(0).to_numpy()
    total = _local_totals(comp, get("rep"), get("depth"), np.where(get("depth") > 0, up, 0), get("below"), np.stack([get("leaf"), get("saved")], 1))
    return pa.RecordBatch.from_arrays([pa.array(get("rep")), pa.array(get("depth")), pa.array(get("leaves") + total[:, 0]), pa.array(get("tokens") + total[:, 1])], names=["rep", "depth", "leaves", "tokens"])


def rolled_up(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """rep, depth, leaves, tokens: totals of every node's subtree."""
    zero = F.lit(0).cast("long")
    rows = nodes.select("rep", "depth", "up", F.lit("0").alias("comp"), "below", (F.col("n_children") == 0).cast("long").alias("leaf"), "saved", zero.alias("leaves"), zero.alias("tokens"))
    top = nodes.filter("depth = 0").select(F.expr(_ID.format("rep", "depth")).alias("comp"))
    rows = rows.drop("comp").join(F.broadcast(top)).select(*_ROWS)  # the one root names the first component
    small, finished = [], []
    while True:
        weights = rows.filter(F.expr(_ID.format("rep", "depth")) == F.col("comp")).select("comp", (F.col("below") > LOCAL).alias("large"))
        weighed = materialize(salted_join(rows, weights, "comp"), "weighed")
        small.append(weighed.filter("not large").select(*_ROWS))
        rows = weighed.filter("large").select(*_ROWS)
        if not rows.limit(1).count():
            break
        rows, done = _round(rows, paths)
        finished.append(done)
    rest = small[0]
    for s in small[1:]:
        rest = rest.unionByName(s)
    out = rest.repartition("comp").sortWithinPartitions("comp").mapInArrow(_finish, "rep long, depth long, leaves long, tokens long")
    for f in finished:
        out = out.unionByName(f)
    return out


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (node, conv_id) -> node, first id, ids as text, at most CHUNK in one."""
    for batch in batches:
        node, ids = batch.column(0), batch.column(1).to_numpy()
        code = node.to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, np.int64)
        cuts = np.concatenate([np.arange(a, b, CHUNK) for a, b in zip(starts, np.append(starts[1:], len(ids)))]) if len(starts) else starts
        texts = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(cuts, np.append(cuts[1:], len(ids)))]
        yield pa.RecordBatch.from_arrays([node.take(pa.array(cuts)), pa.array(ids[cuts], pa.int64()), pa.array(texts, pa.string())], names=["key", "first", "ids"])


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks sorted by node and first id -> node, SHA-256 of the joined ids; one state at a time."""
    now, state = None, None
    for batch in batches:
        keys, out = [], []
        for key, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if key == now:
                state.update(b",")
            else:
                if now is not None:
                    keys.append(now)
                    out.append(state.hexdigest())
                now, state = key, hashlib.sha256()
            state.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(out, pa.string())], names=["key", "ends_sha256"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.string()), pa.array([state.hexdigest()], pa.string())], names=["key", "ends_sha256"])


def ends(paths: DataFrame) -> DataFrame:
    """rep, depth, ends_sha256 of the nodes at which conversations end."""
    last = paths.filter("child is null").select(F.expr(_ID.format("rep", "depth")).alias("key"), "conv_id")
    ranged = last.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    chunks = ranged.mapInArrow(_chunks, "key string, first long, ids string")
    hashed = chunks.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_hashes, "key string, ends_sha256 string")
    part = lambda k: F.split("key", ":")[k].cast("long")
    return hashed.select(part(0).alias("rep"), part(1).alias("depth"), "ends_sha256")


def prefix_nodes(turns: DataFrame) -> DataFrame:
    """One row per node of the trie, with its subtree's totals (columns of RESULT)."""
    nodes, paths = trie(turns)
    if not nodes.limit(1).count():
        return nodes.sparkSession.createDataFrame([], RESULT)
    totals = materialize(rolled_up(nodes, paths), "totals")
    out = nodes.join(totals, ["rep", "depth"]).join(ends(paths), ["rep", "depth"], "left")
    return out.select(
        F.col("rep").alias("conv_id"), "depth", F.col("up").alias("parent_conv_id"), "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("tokens").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


#: One step of the recursion takes one bit of the decimal id into the CRC-32 (polynomial 3988292384).
ORACLE = f"""
WITH RECURSIVE t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(coalesce(role, '') || chr(0) || coalesce(text, ''))) AS rank
  FROM conversations WHERE conv_id IS NOT NULL
), crc(conv_id, k, c) AS (
  SELECT conv_id, 0::BIGINT, 4294967295::BIGINT FROM (SELECT DISTINCT conv_id FROM t)
  UNION ALL
  SELECT conv_id, k + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END
  FROM (SELECT conv_id, k, CASE WHEN k % 8 = 0 THEN xor(c, ascii(substr(conv_id::VARCHAR, (k // 8 + 1)::INT, 1))::BIGINT) ELSE c END AS x FROM crc WHERE k < 8 * length(conv_id::VARCHAR))
), heads AS (
  SELECT conv_id, conv_id - conv_id % {FAMILY} AS base, xor(c, 4294967295::BIGINT) % {HEADS} AS h FROM crc WHERE k = 8 * length(conv_id::VARCHAR)
), taken AS (
  SELECT h.conv_id, h.base, h.h, least(h.h, (SELECT count(*) FROM t WHERE t.conv_id = h.base)) AS k FROM heads h
), rows AS (
  SELECT x.conv_id, t.rank AS depth, t.role, t.text FROM taken x JOIN t ON t.conv_id = x.base AND t.rank <= x.k
  UNION ALL
  SELECT x.conv_id, x.k + t.rank - x.h, t.role, t.text FROM taken x JOIN t ON t.conv_id = x.conv_id AND t.rank > x.h
), p AS (
  SELECT conv_id, depth, text, md5(string_agg(length(role)::VARCHAR || ':' || role || length(text)::VARCHAR || ':' || text, '' ORDER BY depth) OVER (PARTITION BY conv_id ORDER BY depth)) AS key FROM rows
  UNION ALL SELECT conv_id, 0, '', '' FROM taken
), q AS (
  SELECT *, lag(key) OVER (PARTITION BY conv_id ORDER BY depth) AS up, lead(key) OVER (PARTITION BY conv_id ORDER BY depth) IS NULL AS last FROM p
), n AS (
  SELECT key, depth, min(conv_id) AS conv_id, any_value(up) AS up, count(*) AS n_convs, (count(*) - 1) * len(regexp_extract_all(any_value(text), '{WORD}')) AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256
  FROM q GROUP BY key, depth
), c AS (SELECT up AS key, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY up),
s AS (
  SELECT a.key, a.depth, sum(CASE WHEN c.key IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum(n.saved)::BIGINT AS saved_tokens
  FROM n LEFT JOIN c ON c.key = n.key JOIN p a ON a.conv_id = n.conv_id AND a.depth <= n.depth GROUP BY a.key, a.depth
)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM n JOIN s ON s.key = n.key AND s.depth = n.depth LEFT JOIN c ON c.key = n.key LEFT JOIN n u ON u.key = n.up
"""
