"""Personal data by weak supervision.

Base spans (email, ip, card, phone) come from fixed patterns and always stay.
Beyond them, tokens that could be credentials or account numbers, and dialled numbers, are candidates
on which labelers vote yes, no or not at all: patterns (key prefixes, long hex),
a gazetteer of cue words before the token, its context (assignment, quotes) and
its shape.  Expectation-maximisation over the counts of vote patterns estimates
each labeler's reliability without labels; the posteriors then train a
logistic span classifier on the votes and binned features, and candidates with
a probability of at least ``KEEP`` become spans of kind ``secret`` (or ``number``).

Vote patterns and binned features are finite: what the driver sees of the corpus
is one count per distinct combination (at most FEATURES_BOUND, and far fewer),
whatever its size.

Defined results: null and empty texts have no spans; repeated rows have equal
spans; columns other than doc_id and text are not read by the finder and pass
through the redaction, which replaces text and n_chars.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

KINDS = ("email", "ip", "card", "phone")
#: Kinds that the method adds: credentials, and card or phone numbers that the patterns lose in longer runs.
SECRET, NUMBER = "secret", "number"
KEEP = 0.5
EM_ROUNDS = 60
#: The share of secrets among candidates, before any vote.
PRIOR = 0.3

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """As the pattern finds them, from each @ outwards: no quadratic scan of long runs."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL_CHARS:
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            out.append((begin, m.end()))
            done = m.end()
        else:
            done = max(done, begin)
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The fixed patterns' spans: kind, start, end (code points), by kind, then start."""
    out = [("email", a, b) for a, b in _emails(text)]
    if any(map(text.__contains__, "0123456789")):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                    out.append(("phone", *m.span()))
    return out


# Cue words before a credential or an account number, and before harmless numbers.
CUES = frozenset("password passwd pwd passphrase secret token apikey api_key api-key access_key auth bearer login pin ssn passport iban account konto cuenta compte clave contraseña passwort kennwort motdepasse".split())
HARMLESS = frozenset("version v page chapter section figure table cc by-nc by-sa by license volume year no number isbn doi".split())

#: Tokens that may hold a credential: no spaces or quotes, a digit (or a known beginning), six characters or more.
_TOKEN = re.compile(r"""(?<![^\s"'`=<>()\[\]{},;])[^\s"'`=<>()\[\]{},;0-9]*+[0-9][^\s"'`=<>()\[\]{},;]*""")  # linear: begins at a token's start, never backtracks
# How credentials of well-known kinds begin.
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "glpat-", "sk-", "pk-", "xoxb-", "xoxp-", "AIza")
_PREFIX = re.compile(rf"(?<![A-Za-z0-9_-])(?:{'|'.join(PREFIXES)})[A-Za-z0-9_-]{{12,}}")
_HEX = re.compile(r"[0-9a-fA-F]{16,}")
_BEFORE = re.compile(r"""([\w-]+)\s*([=:]?)\s*(["'`]?)\Z""")
_DIALLED = re.compile(r"\+[0-9]{1,3}[ -]?\(?[0-9]{2,4}\)?[ -][0-9]{3,4}[ -][0-9]{3,4}(?![0-9])")
LABELERS = ("prefix", "hex", "cue", "assigned", "mixed", "luhn", "dialled", "harmless", "short", "plain_number")
#: Distinct combinations of votes and bins at most: 2 values for each labeler, 5 * 5 * 4 bins.
FEATURES_BOUND = 2 ** len(LABELERS) * 100


def entropy(token: str) -> float:
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in map(token.count, set(token)))


def candidate(text: str, begin: int, end: int) -> int:
    """A candidate's votes and binned features as one number."""
    token = text[begin:end]
    m = _BEFORE.search(text, max(0, begin - 48), begin)
    word, sign, quote = (m.group(1).lower(), m.group(2), m.group(3)) if m else ("", "", "")
    digits, letters = sum(c.isdigit() for c in token), sum(c.isalpha() for c in token)
    bits = entropy(token)
    fired = (
        bool(_PREFIX.fullmatch(token)),
        bool(_HEX.fullmatch(token)) and letters > 0,
        word in CUES,
        bool(sign),
        len(token) >= 12 and digits >= 2 and letters >= 2 and bits >= 2.8 and "." not in token,
        letters == 0 and digits == len(token) and 13 <= digits <= 19 and luhn(token),
        bool(_DIALLED.fullmatch(token)),
        word in HARMLESS,
        len(token) < 8,
        letters == 0 and not 13 <= digits <= 19 and token[0] != "+",
    )
    votes = sum(1 << k for k, x in enumerate(fired) if x)
    bins = min(4, len(token) // 8) * 20 + min(4, int(bits)) * 4 + min(3, int(4 * digits / len(token)))
    return votes * 100 + bins


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int, int]]:
    """Start, end and feature number of tokens outside base spans."""
    tokens = []
    if any(map(text.__contains__, "0123456789")):
        for m in _TOKEN.finditer(text):
            a, b = m.span()
            while b > a and text[b - 1] in ".,:!?":
                b -= 1
            tokens.append((a, b))
    if any(map(text.__contains__, PREFIXES)):  # may be without a digit
        tokens += _apart([m.span() for m in _PREFIX.finditer(text)], tokens)
    dialled = [m.span() for m in _DIALLED.finditer(text)] if "+" in text else []
    if not tokens and not dialled:
        return []
    out = []
    for a, b in _apart(_apart(tokens, dialled) + dialled, [(a, b) for _, a, b in base]):
        if b - a >= 6:
            out.append((a, b, candidate(text, a, b)))
    return out


def _apart(spans: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans, sorted, that overlap none of the others."""
    taken, out, k, top = sorted(taken), [], 0, 0  # top: the furthest end of taken spans that begin before
    for a, b in sorted(spans):
        while k < len(taken) and taken[k][0] < b:
            top = max(top, taken[k][1])
            k += 1
        if top <= a:
            out.append((a, b))
    return out


#: What a fired labeler says: secret or not; labelers that do not fire abstain.
POLARITY = np.array([1, 1, 1, 1, 1, 1, 1, 0, 0, 0])
#: Labelers whose candidates are numbers.
NUMBERS = (LABELERS.index("luhn"), LABELERS.index("dialled"))


def method_kind(feature: int) -> str:
    return NUMBER if any(feature // 100 >> k & 1 for k in NUMBERS) else SECRET


def _votes(features: np.ndarray) -> np.ndarray:
    return (features[:, None] // 100 >> np.arange(len(LABELERS))) & 1


def fit_reliabilities(features: np.ndarray, counts: np.ndarray, rounds: int = EM_ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """EM over vote patterns: the posterior of each and each labeler's reliability.

    A labeler is right, when it votes at all, with its reliability; abstaining
    says nothing.  Reliabilities have a prior of 8 right in 10 votes, the class
    share is the fixed ``PRIOR`` (a share that is estimated from so rare a class
    drifts to nothing).
    """
    fired = _votes(features).astype(float)
    right = np.full(len(LABELERS), 0.8)
    for _ in range(rounds):
        yes = np.where(POLARITY == 1, np.log(right / (1 - right)), np.log((1 - right) / right))
        post = 1 / (1 + np.exp(-np.clip(fired @ yes + math.log(PRIOR / (1 - PRIOR)), -50, 50)))
        agree = np.where(POLARITY == 1, post[:, None], 1 - post[:, None])
        n = fired * counts[:, None]
        right = np.clip(((n * agree).sum(0) + 8) / (n.sum(0) + 10), 0.02, 0.98)
    return post, right


def _design(features: np.ndarray) -> np.ndarray:
    """Votes and one-hot bins."""
    bins = features % 100
    hot = [np.eye(5)[bins // 20], np.eye(5)[bins // 4 % 5], np.eye(4)[bins % 4]]
    return np.concatenate([np.ones((len(features), 1)), _votes(features), *hot], 1)


def fit_classifier(features: np.ndarray, counts: np.ndarray, post: np.ndarray, ridge: float = 0.05, rounds: int = 40) -> np.ndarray:
    """Logistic regression on the EM's posteriors by Newton steps.

    Patterns weigh by the root of their counts, so that rare ones are heard.
    """
    x, n = _design(features), np.sqrt(counts)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (n * (post - p)) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def probability(features: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_design(features) @ w, -30, 30)))


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kinds, starts, ends, cs, ce, cf, n_base, n_cand = [], [], [], [], [], [], [0], [0]
        for text in batch.column(1).to_pylist():
            base = base_spans(text) if text else []
            for k, a, b in base:
                kinds.append(k)
                starts.append(a)
                ends.append(b)
            for a, b, f in candidates(text, base) if text else []:
                cs.append(a)
                ce.append(b)
                cf.append(f)
            n_base.append(len(kinds))
            n_cand.append(len(cs))
        spans = pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["kind", "start", "end"])
        cand = pa.StructArray.from_arrays([pa.array(cs, pa.int32()), pa.array(ce, pa.int32()), pa.array(cf, pa.int32())], names=["start", "end", "feature"])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(n_base, pa.int32()), spans), pa.ListArray.from_arrays(pa.array(n_cand, pa.int32()), cand)], names=["doc_id", "base", "candidates"])


_FOUND = "doc_id long, base array<struct<kind:string,start:int,end:int>>, candidates array<struct<start:int,end:int,feature:int>>"


def find(documents: DataFrame) -> DataFrame:
    """doc_id, base spans and candidates of each document; stored."""
    return materialize(documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(_find, _FOUND), "found")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen = Counter(f for text in batch.column(0).to_pylist() if text for _, _, f in candidates(text, base_spans(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["feature", "n"])


def feature_counts(documents: DataFrame) -> DataFrame:
    """feature, n: what candidates of all documents look like, without keeping them."""
    return documents.select("text").mapInArrow(_count, "feature int, n long")


def fit(found: DataFrame) -> np.ndarray | None:
    """The span classifier from stored candidates."""
    return fit_counts(found.select(F.explode("candidates.feature").alias("feature"), F.lit(1).alias("n")))


def fit_counts(features: DataFrame) -> np.ndarray | None:
    """The span classifier from all candidates' features (feature, n); None without candidates."""
    rows = features.groupBy("feature").agg(F.sum("n").alias("count")).toPandas()  # at most FEATURES_BOUND
    if not len(rows):
        return None
    rows = rows.sort_values("feature")
    features, counts = rows["feature"].to_numpy(np.int64), rows["count"].to_numpy(float)
    return fit_classifier(features, counts, fit_reliabilities(features, counts)[0])


def with_spans(found: DataFrame, w: np.ndarray | None) -> DataFrame:
    """doc_id, base and spans (base, then accepted candidates of kinds ``secret`` and ``number``).

    The classifier is a linear function of a feature number's parts, and stays an
    expression on the candidates' column.
    """
    if w is None:
        return found.select("doc_id", "base", F.col("base").alias("spans"))
    parts = np.split(w, np.cumsum([1, len(LABELERS), 5, 5]))

    def accepted(c):
        f = c["feature"]
        pick = lambda values, k: F.element_at(F.array(*[F.lit(float(v)) for v in values]), k.cast("int") + 1)
        bins = f % 100
        z = F.lit(float(parts[0][0])) + pick(parts[2], F.floor(bins / 20)) + pick(parts[3], F.floor(bins / 4) % 5) + pick(parts[4], bins % 4)
        for k, v in enumerate(parts[1]):
            z = z + F.when(F.floor(f / (100 << k)) % 2 == 1, F.lit(float(v))).otherwise(F.lit(0.0))
        return z >= F.lit(math.log(KEEP / (1 - KEEP)))

    fired = lambda f, k: F.floor(f / (100 << k)) % 2 == 1
    kind = lambda f: F.when(fired(f, NUMBERS[0]) | fired(f, NUMBERS[1]), F.lit(NUMBER)).otherwise(F.lit(SECRET))
    more = F.transform(F.filter("candidates", accepted), lambda c: F.struct(kind(c["feature"]).alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    of_kind = lambda k: F.filter(more, lambda s: s["kind"] == k)
    return found.select("doc_id", "base", F.concat("base", of_kind(SECRET), of_kind(NUMBER)).alias("spans"))


def digest(documents: DataFrame) -> DataFrame:
    """The contract's columns for all documents."""
    found = find(documents)
    rows = with_spans(found, fit(found))
    said = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", *[number(k) for k in KINDS], F.sha2(said("base"), 256).alias("base_sha256"), said("spans").alias("spans"))


def redact_text(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Each run of overlapping spans becomes its first kind's mark."""
    out, at, merged = [], 0, []
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    for kind, a, b in merged:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def redact(documents: DataFrame) -> DataFrame:
    """Documents with all spans replaced by marks; other columns as they are.

    The corpus is read twice: for the candidates' counts, then for the texts; no
    row is dropped and none is shuffled.
    """
    w = fit_counts(feature_counts(documents))
    schema = documents.schema
    names = documents.columns
    at = names.index("text")
    size = names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, texts = list(batch.columns), batch.column(at).to_pylist()
            out = []
            for text in texts:
                if text:
                    base = base_spans(text)
                    spans = list(base)
                    if w is not None and (c := candidates(text, base)):
                        p = probability(np.array([f for _, _, f in c]), w)
                        spans += [(method_kind(f), a, b) for (a, b, f), x in zip(c, p) if x >= KEEP]
                    text = redact_text(text, spans) if spans else text
                out.append(text)
            columns[at] = pa.array(out, pa.string())
            if size is not None:
                old = columns[size]
                columns[size] = pa.array([len(n) if n != o else v for n, o, v in zip(out, texts, old.to_pylist())], old.type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return documents.mapInArrow(run, schema)
