"""The pipeline against its stages' rules in plain Python, and its odd inputs."""

from collections import Counter

import numpy as np

import corpus_pipeline
from weftlake.llm import milquality, mixing, pii, tokens

from .test_hyperminhash import brute
from .test_mixing_sharding import plain_mix


def write(spark, folder, documents, labels):
    spark.createDataFrame(documents, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def corpus():
    rng = np.random.default_rng(12)
    vocab = ["".join(rng.choice(list("abcdefghijklm"), int(rng.integers(2, 8)))) for _ in range(900)]
    docs, labels = [], []
    for i in range(0, 300, 2):
        words = [str(rng.choice(vocab)) for _ in range(int(rng.integers(40, 200)))]
        bad = i % 10 == 0
        if bad:
            words = [w.upper() + "!!" for w in words]
        elif i % 14 == 0:
            words[3] = "me@mail.example.com"
        text = " ".join(words)
        docs.append((i, text, "en", f"s{i % 6}", len(text)))
        labels.append((i, int(not bad), 0))
        if i % 8 == 0:  # a copy, exact or near
            words[-1] = words[-1] if i % 16 else "other"
            docs.append((i + 1, " ".join(words), "en", f"s{i % 4}", len(" ".join(words))))
    return [*docs, (1001, None, None, None, None), (1003, "", "en", "s0", 0)], labels


def fewest(lengths, capacity=1024):
    """A lower bound on sequences: pieces too long to share one, and the room that is left beside them."""
    best = -(-sum(lengths) // capacity)
    for small in range(0, capacity // 2 + 1):
        alone = sum(n > capacity - small for n in lengths)
        large = [n for n in lengths if capacity / 2 < n <= capacity - small]
        rest = sum(n for n in lengths if small <= n <= capacity / 2)
        best = max(best, alone + len(large) + max(0, -(-(rest - (len(large) * capacity - sum(large))) // capacity)))
    return best


def test_stages_against_plain_python(spark, tmp_path):
    docs, labels = corpus()
    folder = write(spark, tmp_path, docs, labels)
    read = spark.read.parquet(f"{folder}/documents.parquet")
    columns = read.columns
    good = {r.doc_id for r in milquality.score_documents(read, spark.read.parquet(f"{folder}/labels.parquet")).filter("predicted = 1").collect()}
    assert {i for i, *_ in docs if i % 10 == 0 or i > 1000} & good == set()
    rows, frames = {d[0]: d for d in docs if d[0] in good}, read
    assert len(rows) > 100
    expected = [set(rows)]
    comp = brute([(i, d[1]) for i, d in rows.items()])
    rows = {i: d for i, d in rows.items() if comp[i][1] == i}
    expected += [set(rows), set(rows)]
    for (name, stage), ids in zip(corpus_pipeline.STAGES[:3], expected):
        frames = stage(spark, frames, folder)
        assert frames.columns == columns and {r.doc_id for r in frames.select("doc_id").collect()} == ids, name
    redacted = {r.doc_id: r for r in frames.collect()}
    for i, r in redacted.items():
        assert r.text == pii.redact_text(rows[i][1], pii.base_spans(rows[i][1])) and r.n_chars == len(r.text)
    assert any("[EMAIL]" in r.text for r in redacted.values())
    frames = corpus_pipeline.mix(spark, frames, folder)
    assert frames.columns == columns
    taken = Counter(r.doc_id for r in frames.collect())
    want = plain_mix([(r.doc_id, r.text, r.source) for r in redacted.values()])
    assert {i: taken.get(i, 0) for i in want} == {i: c for i, (_, _, _, c) in want.items()}
    e = tokens.Encoder(tokens.vocabulary_path())
    size = {i: len(next(e.batch([r.text.encode()]))) + 1 for i, r in redacted.items()}
    packed = corpus_pipeline.run(spark, folder).collect()
    total = Counter()
    for r in packed:
        total[r.doc_id] += r.length
    assert total == Counter({i: size[i] * n for i, n in taken.items()})
    # short of a lower bound by two sequences at most: the plan is greedy, the best one not known
    assert len({r.sequence_id for r in packed}) <= fewest([r.length for r in packed]) + 2
    print(len({r.sequence_id for r in packed}), fewest([r.length for r in packed]), sum(total.values()) / 1024)


def test_empty_tables(spark, tmp_path):
    folder = write(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, folder).count() == 0
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "pii", "mixing", "packing"]


def test_other_columns_and_none_of_the_counts(spark, tmp_path):
    """Extra columns, names that stages use themselves among them, and a table without n_chars."""
    docs, labels = corpus()
    rows = [(i, t, la, s, f"{i}k", i % 3, [i]) for i, t, la, s, _ in docs[:90]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, component_id string, kept int, spans array<long>").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    frames = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, frames = frames.columns, stage(spark, frames, str(tmp_path))
        assert frames.columns == before, name
        frames.write.parquet(f"{tmp_path}/{name}")
        frames = spark.read.parquet(f"{tmp_path}/{name}")
    left = frames.collect()
    assert left and all(r.component_id == f"{r.doc_id}k" and r.kept == r.doc_id % 3 and r.spans == [r.doc_id] for r in left)
    assert corpus_pipeline.pack(spark, frames, str(tmp_path)).count() >= len(left)
