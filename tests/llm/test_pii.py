"""Personal data: base spans against the plain patterns, and the weak supervision."""

import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from weftlake.llm import pii


def naive(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        s = sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d)))
        if 16 <= len(d) <= 19 and s % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet=st.sampled_from("a@.-+_%1290 ()é\n"), max_size=60))
def test_base_equals_patterns(text):
    assert pii.base_spans(text) == naive(text)


def test_base_examples():
    for t in ["x a@b.c.d@e.f y", "4111 1111 1111 1111", "+1 (607) 555-1611.", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.255", "a@b@c.d", "a@b.c_d@e.f", "é1.2.3.4é" * 50, "4111111111111111" * 3]:
        assert pii.base_spans(t) == naive(t)
    assert len(pii.base_spans("1" * 50_000 + " " + "a" * 200_000 + "@")) == 0


def test_long_tokens_are_linear():
    for t in ["a" * 300_000 + " 7", "1" * 300_000, "a1" * 100_000 + "@" * 1000, "." * 200_000 + "1.1", "+" * 100_000 + "1 2", "AKIA" * 50_000]:
        pii.candidates(t, pii.base_spans(t))
    assert [x[:2] for x in pii.candidates('k="ab1234c" x1y2z3, aaaaaaa', [])] == [(3, 10), (12, 18)]


def corpus():
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    hexa = lambda n: "".join(rng.choice(list("0123456789abcdef"), n))
    key = lambda: "AKIA" + "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), 16))
    rows, want = [], {}
    for i in range(240):
        middle = [f"password={hexa(18)}", f'token = "{hexa(40)}"', key(), "Licensed under CC BY-NC 4.0.", f"version {i}.10.2-beta", "4839153833223933", "2024-01-02", f"me{i}@x.org", word()][i % 9]
        text = " ".join(word() for _ in range(8)) + f" {middle} " + " ".join(word() for _ in range(8))
        rows.append((i, text))
        want[i] = [re.search(r"[0-9a-f]{18,}|AKIA\w{16}", middle).group()] if i % 9 < 3 else []
    return rows, want


def test_method_finds_secrets(spark):
    rows, want = corpus()
    df = spark.createDataFrame([*rows, (None, None), (1000, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.digest(df).collect()}
    for i, text in rows:
        spans = [s.split(":") for s in got[i].spans.split(",") if s]
        assert [text[int(a) : int(b)] for k, a, b in spans if k == "secret"] == want[i], text
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in naive(text))
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(sum(s[0] == k for s in naive(text)) for k in pii.KINDS)
    assert got[None].spans == got[1000].spans == ""
    assert pii.digest(df.limit(0)).count() == 0


def test_redaction(spark):
    rows, want = corpus()
    df = spark.createDataFrame([(i, t, "s", len(t), t) for i, t in rows] + [(None, None, None, None, None)], "doc_id long, text string, source string, n_chars long, candidates string")
    got = {r.doc_id: r for r in pii.redact(df).collect()}
    assert pii.redact(df).schema == df.schema
    for i, t in rows:
        new = t
        for x in want[i]:
            new = new.replace(x, "[SECRET]")
        new = re.sub(r"me\d+@x.org", "[EMAIL]", new)
        assert got[i].text == new and got[i].n_chars == len(new) and got[i].candidates == t
    assert got[None].text is None


def test_reliabilities_follow_agreement():
    good, bad = 1 | 4, 128 | 256
    f = np.array([good * 100, bad * 100, 4 * 100, 0])
    post, right = pii.fit_reliabilities(f, np.array([50.0, 200, 10, 100]))
    assert post[0] > 0.9 and post[1] < 0.1 and post[3] < 0.5 and right[0] > 0.9 and right[7] > 0.9
