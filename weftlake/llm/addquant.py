"""Approximate nearest neighbours by additive quantisation.

A unit vector is the sum of one full-dimensional codeword from each of
``BOOKS`` codebooks.  Codebooks start as residual k-means and are refitted
together by least squares; a vector is encoded by beam search over the books
(the ``BEAM`` best partial sums are kept), and the norm of its reconstruction is
stored beside the codes.  Beside the norm the projection of the vector on its reconstruction is kept.

A query makes one look-up table of products with all codewords; a candidate's
score is the sum of its codes' entries over the norm, times its projection.
What that leaves out is at most the length of the rest of the vector, and its
part along a query is far less: ``REACH`` of the nearest pairs of ``PROBES``
vectors of the sample lie within some multiple of it, which is measured.  First
each query ranks the codes of the sample by score and reranks the best few
exactly, in tasks over the queries: what it must reach at least.  Then all codes
are scanned; every candidate whose score plus that multiple reaches the query's
best exact ones so far is reranked by the exact cosine in double precision, so
the shortlist is as long as codes are coarse.  Answers come from that scan alone.

Codes lie beside their vectors and are scanned in place; ``PASS`` queries with
their thresholds go to the tasks at once, which hold ``CHUNK`` rows of the index
against one block of ``QUERY_BLOCK`` queries after another and return each
query's best few.  Equal vectors are searched once: each class is represented by
its smallest id and expanded to its ``k + 1`` smallest, so a third of all rows
may be one vector.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components take no part; vectors of each length are searched among themselves;
a null id takes no part; rows with one id are one, the smallest of its vectors;
fewer candidates give fewer rows; an empty table gives an empty result.  Other
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import materialize

BOOKS, WORDS, BEAM = 16, 256, 4
#: Vectors that the codebooks are fitted on at most.
SAMPLE = 16_384
#: Of which so many measure how far scores fall short.
PROBES = 512
#: Queries that a pass over the index answers at most, and those that meet a chunk of it at once.
PASS, QUERY_BLOCK = 32_768, 2048
#: Rows of the index that a task holds, and codes scored at once.
CHUNK, CODE_BLOCK = 32_768, 2048
#: Share of the nearest pairs of the probes that the allowance for a score covers.
REACH = 0.99
#: Candidates of the sample that a query reranks for its threshold, times what it is asked for.
SEEDS = 4
#: Scores closer than this are ties until the exact cosine tells them apart.
SLACK = 1e-9


def usable(v: Column) -> Column:
    """Whether a vector takes part: finite throughout and not zero."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        a = (x @ c.T - (c * c).sum(1) / 2).argmax(1)
        n = np.bincount(a, minlength=k)
        of = np.zeros((k, len(x)), np.float32)
        of[a, np.arange(len(x))] = 1
        sums = of @ x
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes (one byte a book) of vectors by beam search."""
    n, m = len(x), len(books)
    rest, cost = x[:, None, :], np.zeros((n, 1), np.float32)
    codes = np.zeros((n, 1, m), np.uint8)
    for b, c in enumerate(books):
        # cost of each partial sum with each codeword, less the squared vector
        new = cost[:, :, None] - 2 * (rest @ c.T) + (c * c).sum(1)
        flat = new.reshape(n, -1)
        keep = min(beam, flat.shape[1])
        best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
        from_, word = best // len(c), best % len(c)
        rows = np.arange(n)[:, None]
        codes = codes[rows, from_]
        codes[:, :, b] = word
        cost, rest = flat[rows, best], rest[rows, from_] - c[word]
    return codes[np.arange(n), cost.argmin(1)]


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    out = np.zeros((len(codes), books.shape[2]), np.float32)
    for b in range(len(books)):
        out += books[b][codes[:, b]]
    return out


def train(x: np.ndarray, books: int = BOOKS, words: int = WORDS, seed: int = 11) -> np.ndarray:
    """Codebooks (books, words, dimension) from a sample of unit vectors."""
    rng, rest, found = np.random.default_rng(seed), x.astype(np.float32), []
    for _ in range(books):
        c = _kmeans(rest, words, rng)
        found.append(c)
        rest = rest - c[(rest @ c.T - (c * c).sum(1) / 2).argmax(1)]
    out = np.stack(found).astype(np.float32)
    # least squares for all codewords at once, given the codes; a ridge holds unused ones in place
    at = encode(x.astype(np.float32), out).astype(np.int64) + words * np.arange(books)
    size = books * words
    gram = np.bincount((at[:, :, None] * size + at[:, None, :]).ravel(), minlength=size * size).reshape(size, size).astype(np.float64)
    right = np.zeros((size, x.shape[1]))
    np.add.at(right, at.ravel(), np.repeat(x, books, axis=0))
    old, ridge = out.reshape(size, -1), 4.0
    return np.linalg.solve(gram + ridge * np.eye(size), right + ridge * old).reshape(out.shape).astype(np.float32)


def described(x: np.ndarray, codes: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of unit vectors: the norms of their reconstructions and their projections on them."""
    y = decode(codes, books)
    norm = np.maximum(np.sqrt((y * y).sum(1)), np.float32(1e-12))
    return norm, np.einsum("ij,ij->i", x.astype(np.float32), y) / norm


def look_up(q: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Products of queries with all codewords: book, query, word."""
    return np.einsum("qd,bwd->bqw", q.astype(np.float32), books, optimize=True)


def scores(table: np.ndarray, codes: np.ndarray, norm: np.ndarray, fit: np.ndarray) -> np.ndarray:
    """Estimated cosines of queries (rows) with codes, by look-up tables."""
    s = np.take(table[0], codes[:, 0], axis=1)
    for b in range(1, len(table)):
        s += np.take(table[b], codes[:, b], axis=1)
    return s * (fit / norm)


def rest(fit: np.ndarray) -> np.ndarray:
    """The length of the part of a unit vector beside its reconstruction."""
    return np.sqrt(np.maximum(0, 1 - fit * fit))


def calibrate(x: np.ndarray, codes: np.ndarray, norm: np.ndarray, fit: np.ndarray, books: np.ndarray, k: int) -> float:
    """How much of its rest a near pair's score falls short, for REACH of the ``k`` nearest pairs of PROBES rows of the sample."""
    over = [np.zeros(1)]
    for at in range(0, min(PROBES, len(x)), 128):
        own = np.arange(at, min(at + 128, PROBES, len(x)))
        exact = x[own] @ x.T
        exact[np.arange(len(own)), own] = -np.inf
        m = min(k, len(x) - 1)
        if m < 1:
            break
        top = np.argpartition(-exact, m - 1, axis=1)[:, :m]
        near = np.take_along_axis(exact, top, 1)
        guess = np.take_along_axis(scores(look_up(x[own], books), codes, norm, fit), top, 1)
        over.append(((near - guess) / np.maximum(rest(fit)[top], 1e-3)).ravel())
    return float(np.clip(np.quantile(np.concatenate(over), REACH, method="higher"), 0, 1))


def thresholds(q: np.ndarray, own: np.ndarray, x: np.ndarray, ids: np.ndarray, codes: np.ndarray, norm: np.ndarray, fit: np.ndarray, books: np.ndarray, k: int) -> np.ndarray:
    """Of each query (id ``own``) the k-th best exact cosine among the candidates that scores rank first; -inf for fewer."""
    out = np.full(len(q), -np.inf)
    m = min(SEEDS * k, len(x))
    for at in range(0, len(q), 256):
        rows = slice(at, at + 256)
        guess = scores(look_up(q[rows], books), codes, norm, fit)
        guess[own[rows][:, None] == ids[None, :]] = -np.inf
        top = np.argpartition(-guess, m - 1, axis=1)[:, :m]
        exact = np.einsum("id,ijd->ij", q[rows], x[top])
        exact[own[rows][:, None] == ids[top]] = -np.inf
        if m >= k:
            out[rows] = -np.partition(-exact, k - 1, axis=1)[:, k - 1] - 1e-6
    return out


class Best:
    """The best few exact scores of each query so far."""

    def __init__(self, least: np.ndarray, k: int) -> None:
        self.least, self.k = least.copy(), k
        self.query, self.id, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, query: np.ndarray, id_: np.ndarray, score: np.ndarray) -> None:
        q, i, s = (np.concatenate(x) for x in ((self.query, query), (self.id, id_), (self.score, score)))
        order = np.lexsort((i, -s, q))
        q, i, s = q[order], i[order], s[order]
        nth = np.arange(len(q)) - np.searchsorted(q, q)
        last = nth == self.k - 1
        self.least[q[last]] = np.maximum(self.least[q[last]], s[last])
        keep = nth < self.k
        self.query, self.id, self.score = q[keep], i[keep], s[keep]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, which changes no cosine and keeps squares in range."""
    _, e = np.frexp(np.abs(x).max(1, keepdims=True))
    return np.ldexp(x, -e)


@F.pandas_udf(DoubleType())
def cosine(a: pd.Series, b: pd.Series) -> pd.Series:
    """The cosine in double precision."""
    if not len(a):
        return pd.Series([], dtype=float)
    x, y = (scaled(np.stack([np.asarray(v, np.float64) for v in s])) for s in (a, b))
    dots = [np.einsum("ij,ij->i", u, v) for u, v in ((x, y), (x, x), (y, y))]
    return pd.Series(dots[0] / np.sqrt(dots[1]) / np.sqrt(dots[2]))


def scan(q: np.ndarray, least: np.ndarray, books: np.ndarray, allowed: float, k: int, chunks: Iterator[tuple], reranked: list[int] | None = None) -> list[Best]:
    """The best exact scores of queries, a ``Best`` for each block of them, over chunks (ids, unit vectors, codes, norm, fit) of an index.

    ``reranked`` gathers how many candidates were compared exactly.
    """
    blocks = [slice(at, at + QUERY_BLOCK) for at in range(0, len(q), QUERY_BLOCK)]
    found = [Best(least[b], k) for b in blocks]
    for ids, x, codes, norm, fit in chunks:
        for block, best in zip(blocks, found):
            table, asked = look_up(q[block], books), q[block]
            for at in range(0, len(ids), CODE_BLOCK):
                part = slice(at, at + CODE_BLOCK)
                near = scores(table, codes[part], norm[part], fit[part]) + np.float32(allowed) * rest(fit[part])
                of, at_x = np.nonzero(near >= (best.least - SLACK)[:, None])
                if reranked is not None:
                    reranked.append(len(of))
                for a in range(0, len(of), 1 << 15):
                    i, j = of[a : a + (1 << 15)], at_x[a : a + (1 << 15)] + at
                    exact = np.einsum("ij,ij->i", asked[i], x[j])
                    good = exact >= best.least[i] - SLACK
                    best.add(i[good], ids[j[good]], exact[good])
    return found


def _searched(rows: DataFrame, k: int, every: int) -> DataFrame:
    """query_id, rank, vec_id, score among rows(vec_id, v) of one length."""
    # a class of equal vectors: its smallest id stands for it, its k + 1 smallest are enough
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("r") <= k + 1)
    ranked = materialize(ranked.withColumn("rep", F.min("vec_id").over(Window.partitionBy("v"))), "classes")
    reps = ranked.filter("r = 1").select("vec_id", "v")
    sample = reps.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()  # SAMPLE vectors at most
    sample_ids, sample = sample.column(0).to_numpy(), _unit(_matrix(sample.column(1).combine_chunks()))
    books = train(sample)
    sample_codes = encode(sample.astype(np.float32), books)
    sample_norm, sample_fit = described(sample, sample_codes, books)
    allowed = calibrate(sample, sample_codes, sample_norm, sample_fit, books, k)
    sample = sample.astype(np.float32)  # for thresholds, which give way by more than it rounds

    def encode_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = _unit(_matrix(part.column(1)))
                codes = encode(x.astype(np.float32), books)
                norm, fit = described(x, codes, books)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norm), pa.array(fit)], names=["vec_id", "v", "codes", "norm", "fit"])

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, q = batch.column(0).to_numpy(), _unit(_matrix(batch.column(1)))
            least = thresholds(q, ids, sample, sample_ids, sample_codes, sample_norm, sample_fit, books, k + 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least)], names=["query_id", "q", "least"])

    index = materialize(reps.mapInArrow(encode_rows, "vec_id long, v array<double>, codes binary, norm float, fit float"), "index")
    queries = rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    queries = materialize(queries.mapInArrow(seed, "query_id long, q array<double>, least double"), "queries")
    passes = math.ceil(queries.count() / PASS)

    def one_pass(number: int) -> DataFrame:
        asked = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == number).toArrow()  # about PASS vectors
        ids, q, least = asked.column(0).to_numpy(), _unit(_matrix(asked.column(1).combine_chunks())), asked.column(2).to_numpy()

        def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            held, n = [], 0
            for batch in batches:
                held.append(batch)
                n += batch.num_rows
                if n >= CHUNK:
                    yield _chunk(held)
                    held, n = [], 0
            if n:
                yield _chunk(held)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block, best in enumerate(scan(q, least, books, allowed, k + 1, chunks(batches))):
                yield pa.RecordBatch.from_arrays([pa.array(ids[best.query + block * QUERY_BLOCK]), pa.array(best.id), pa.array(best.score)], names=["query_id", "rep", "near"])

        return materialize(index.mapInArrow(search, "query_id long, rep long, near double"), "found")

    found = [one_pass(n) for n in range(passes)]  # each a scan of the index
    if not found:
        return _none(rows)
    every_found = found[0]
    for f in found[1:]:
        every_found = every_found.unionByName(f)
    queries = queries.drop("least")
    best = every_found.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("near"), "rep"))).filter(F.col("n") <= k + 1)
    exact = best.select("query_id", "rep").join(queries, "query_id").join(reps.withColumnRenamed("vec_id", "rep"), "rep").select("query_id", "rep", cosine("q", "v").alias("score"))
    members = exact.join(ranked.select("rep", "vec_id"), "rep").filter(F.col("vec_id") != F.col("query_id"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return members.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _chunk(batches: list[pa.RecordBatch]) -> tuple:
    """ids, unit vectors, codes, norm, fit of rows of the index."""
    rows = pa.Table.from_batches(batches).combine_chunks()
    n = len(rows)
    codes = np.frombuffer(b"".join(rows.column(2).to_pylist()), np.uint8).reshape(n, -1)
    return rows.column(0).to_numpy(), _unit(_matrix(rows.column(1).combine_chunks())), codes, rows.column(3).to_numpy(), rows.column(4).to_numpy()


def _none(rows: DataFrame) -> DataFrame:
    return rows.limit(0).select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))


def neighbours(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 5, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each row whose key is divisible by ``every``."""
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    rows = materialize(rows.groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")
    lengths = [r["d"] for r in rows.groupBy(F.size("v").alias("d")).count().orderBy("d").collect()]  # a few lengths
    out = _none(rows)
    for d in lengths:
        out = out.unionByName(_searched(rows.filter(F.size("v") == d), k, every))
    return out
