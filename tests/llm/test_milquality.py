"""The multiple-instance classifier: gradients, held-out accuracy, odd inputs."""

import zlib

import numpy as np

from weftlake.llm import milquality as M


def corpus(n=500, seed=1):
    rng = np.random.default_rng(seed)
    vocab = ["".join(rng.choice(list("abcdefghijklmnop"), int(rng.integers(2, 9)))) for _ in range(800)]
    docs, labels = [], []
    for i in range(n):
        words = [str(rng.choice(vocab)) for _ in range(int(rng.integers(20, 400)))]
        bad = i % 4 == 0
        if bad:
            a = int(rng.integers(0, len(words) // 2))
            words[a : a + len(words) // 2] = [words[a]] * (len(words) // 2) if i % 8 else [w.upper() + "!!" for w in words[a : a + len(words) // 2]]
        docs.append((i, " ".join(words) + ".", i))
        labels.append((i, int(not bad), 0))
    return docs, labels


def test_gradients():
    rng = np.random.default_rng(0)
    bags = np.array([1, 3, 2, 5])
    x, y = rng.normal(size=(bags.sum(), M.FEATURES)), np.array([1.0, 0, 1, 0])
    m = M.train(x, bags, y, epochs=2)
    z = m.normal(x)
    loss = lambda: -np.mean(y * np.log(m.forward(z, bags)["y"]) + (1 - y) * np.log(1 - m.forward(z, bags)["y"]))
    for name, g in m.gradients(z, bags, y, ridge=0).items():
        v = m.p[name]
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = v[at]
        v[at] = old + 1e-5
        up = loss()
        v[at] = old - 1e-5
        down = loss()
        v[at] = old
        assert np.isclose((up - down) / 2e-5, g[at], rtol=1e-3, atol=1e-7), name


def test_passages_cover_all_words():
    texts = [b"", b"a b c", b"w " * 1000, b"x y " * 40, " ".join(["é"] * 65).encode()]
    bags = np.concatenate([b for b, _ in M.passages(texts)])
    assert bags.tolist() == [0, 1, 16, 2, 2]
    (_, x), = M.passages([b"one two two three"])
    assert np.isclose(x[0, 8], 3 / 4) and np.isclose(x[0, 9], 1 / 4)


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels = corpus()
    d = spark.createDataFrame([*docs, (None, "some text here", 1), (9000, None, 1), (9001, "", 1), (9002, " \n", 1)], "doc_id long, text string, score long").repartition(4)
    l = spark.createDataFrame([*labels, (3, None, 0), (None, 1, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in M.score_documents(d, l).collect()}
    right = total = 0
    for i, q, _ in labels:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        if got[i].held_out:
            total += 1
            right += got[i].predicted == q
    assert right / total >= 0.95
    assert got[9000].score == got[9001].score == got[9002].score == 0 and got[None].held_out is False
    kept = M.keep_good(d, l)
    assert kept.schema == d.schema and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted}
    assert {r.score for r in M.score_documents(d, l.limit(0)).collect()} == {0.0, 0.5}
    assert M.score_documents(d.limit(0), l).count() == 0


def test_forward_pass_against_a_plain_one():
    """Scores of bags by loops over passages, from the same weights."""
    from math import exp, tanh

    rng = np.random.default_rng(6)
    bags = np.array([1, 4, 7])
    x = rng.normal(size=(bags.sum(), M.FEATURES)) * 3
    model = M.train(x, bags, np.array([1.0, 0.0, 1.0]), epochs=5)
    p, at = model.p, 0
    for n, got in zip(bags.tolist(), model.score(x, bags)):
        rows = [[min(8, max(-8, (v - m) / s)) for v, m, s in zip(r, model.mean, model.scale)] for r in x[at : at + n]]
        at += n
        hidden = [[tanh(sum(a * w for a, w in zip(r, p["W"][:, k])) + p["b"][k]) for k in range(M.HIDDEN)] for r in rows]
        energy = [sum(p["u"][j] * tanh(sum(h * v for h, v in zip(hs, p["V"][:, j]))) / (1 + exp(-sum(h * v for h, v in zip(hs, p["U"][:, j])))) for j in range(M.ATTENTION)) for hs in hidden]
        weights = [exp(e - max(energy)) for e in energy]
        bag = [sum(w * hs[k] for w, hs in zip(weights, hidden)) / sum(weights) for k in range(M.HIDDEN)]
        want = 1 / (1 + exp(-(sum(b * c for b, c in zip(bag, p["c"])) + p["d"][0])))
        assert abs(want - got) < 1e-12


def test_long_labelled_texts_are_learned_from(spark):
    """With every labelled text longer than the bound on passages, the fit still separates them."""
    rng = np.random.default_rng(9)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(400)]
    docs, labels = [], []
    for i in range(60):
        t = [str(w) for w in rng.choice(words, 64 * 12)]
        docs.append((i, " ".join(w.upper() + "!!" for w in t) if i % 2 else " ".join(t)))
        labels.append((i, 1 - i % 2, 0))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    model = M.fit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), max_passages=5)
    assert model is not None
    scored = {i: float(model.score(*reversed(next(M.passages([t.encode()]))))[0]) for i, t in docs}
    assert min(s for i, s in scored.items() if i % 2 == 0) > max(s for i, s in scored.items() if i % 2)
