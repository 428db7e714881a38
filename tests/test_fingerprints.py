"""Fingerprints: rows dealt over the cores, shingles hashed many at a time."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftlake.functions import md5
from weftlake.functions import text as T
from weftlake.operators import dedupe
from weftlake.plans import queries


@pytest.mark.parametrize("prints", [dedupe.simhash_md5, dedupe.simhash_blake2b])
def test_texts_are_dealt_over_the_cores(spark, prints):
    said = prints(queries.read(spark, "/root/testdata/sf0.001", "documents"))._jdf.queryExecution().executedPlan().toString()
    assert f", {4 * spark.sparkContext.defaultParallelism}), REPARTITION_BY_NUM" in said


def test_md5_of_many_is_md5():
    rng = random.Random(7)
    raw = rng.randbytes(5000)
    size = np.array([0, 1, 3, 4, 54, 55, 56, 57, 63, 64, 65, 119, 120, 1000] * (md5.LANES // 14 + 2))
    start = np.array([rng.randrange(len(raw) - k + 1) for k in size])
    start[:2] = len(raw), len(raw) - 1
    found = md5.first_eight(raw, start, size)
    assert all(h.tobytes() == hashlib.md5(raw[s : s + n]).digest()[:8] for h, s, n in zip(found, start, size))
    assert md5.first_eight(b"", start[:0], size[:0]).shape == (0, 8)


def test_fingerprints_of_odd_texts(spark):
    long = "ä" * 40
    texts = [None, "", " ..!\n", "One", "one TWO", "  a\tb;c  ", "a b c d", f"{long} {long} {long} x", "ÉCOLE Straße ΣΑΣ İx _ 漢字 𝒳𝟙 á", "x-y z\x00q w", "w " * 30_000, "the end "]
    texts += [" ".join(random.Random(k).choices(["aa", "b", "ccc", "ü"], k=k)) for k in range(1, 40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    expected = {}
    for doc, words in df.select("doc_id", T.words(F.col("text"))).collect():
        if not words:
            continue
        runs = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
        sums = [0] * 64
        for run in runs:
            bits = int.from_bytes(hashlib.md5(run.encode()).digest()[:8], "big")
            for k in range(64):
                sums[k] += 1 if bits >> k & 1 else -1
        whole = sum(1 << k for k in range(64) if sums[k] > 0)
        expected[doc] = (whole >> 32, whole & 0xFFFFFFFF)
    assert {r.doc_id: (r.hi, r.lo) for r in dedupe.simhash_md5(df).collect()} == expected and len(expected) == len(texts) - 3
