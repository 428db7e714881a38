"""State over batches and streams: as-of joins, indexes, ledgers, folds, containers and charsets."""

import datetime as dt
import io
import os
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftlake.functions import charset, detect
from weftlake.operators import dedupe, dupindex, ordered, specs, temporal
from weftlake.streaming import folds, ledger

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=float(seconds))


def test_as_of_join(spark):
    rng = np.random.default_rng(1)
    asks = [(i, f"h{rng.integers(3)}" if i % 50 else None, at(rng.integers(0, 90_000))) for i in range(300)] + [(400, "h0", None), (401, "none", at(5))]
    versions = [(k, "h0" if k % 3 else f"h{rng.integers(3)}", at(rng.integers(0, 90_000)), k) for k in range(120)] + [(500, None, at(1), 0), (501, "h1", None, 0), (502, "h2", at(50_000), 7), (503, "h2", at(50_000), 9)]
    left = spark.createDataFrame(asks, "id long, host string, at timestamp")
    right = spark.createDataFrame(versions, "v long, host string, since timestamp, id long").select("host", "since", "v", "id")
    for valid, stretch in ((None, 3600.0), (2000.0, 3600.0), (None, 1e9), (5000.0, 10.0)):
        got = {r.id: r.version.v if r.version else None for r in temporal.as_of_join(left, right, "host", "at", "since", valid, stretch).collect()}
        want = {}
        for i, h, t in asks:
            fit = [(s, v) for v, hh, s, _ in versions if h is not None and t is not None and hh == h and s is not None and s <= t]
            best = max(fit, default=None)
            want[i] = best[1] if best and (valid is None or (t - best[0]).total_seconds() < valid) else None
        assert got == want


@pytest.mark.parametrize("alpha", [0.0, 0.01, 0.25, 0.9, 1.0])
def test_averages_in_batches(spark, alpha):
    rng = np.random.default_rng(2)
    rows = [(int(k), i, float(v)) for i, (k, v) in enumerate(zip(rng.integers(0, 3, 700), rng.normal(size=700)))]
    want = {}
    for k, _, v in rows:
        want[k] = v if k not in want else want[k] + alpha * (v - want[k])
    df = spark.createDataFrame(rows, "k int, i int, v double")
    whole = {r.k: r.ema for r in ordered.moving_average(df, "k", ["i"], "v", alpha).collect()}
    done = spark.createDataFrame([], "k int, n long, ema double")
    for low in (0, 300, 305, 600):
        done = ordered.folded_average(done, df.filter(f"i >= {low} and i < {({0: 300, 300: 305, 305: 600, 600: 700})[low]}"), "k", ["i"], "v", alpha)
    assert all(abs(whole[k] - want[k]) < 1e-9 for k in want)
    assert all(abs(r.ema - want[r.k]) < 1e-9 for r in done.collect()) and done.agg(F.sum("n")).first()[0] == 700


def test_specs(spark):
    table = specs.learn(specs.empty(spark), spark.createDataFrame([("a", "r1", at(0)), ("b", "r1", at(0))], "key string, rules string, learned timestamp"))
    uses = spark.createDataFrame([("a", at(i), i, 0.0) for i in range(6)] + [("b", at(9), 9, 1.0), ("c", at(9), 9, 1.0)], "key string, at timestamp, seq long, fill double")
    table = specs.retire(specs.used(table, uses), F.lit(at(60)))
    assert {(r.key, r.n, r.retired is None) for r in table.collect()} == {("a", 6, False), ("b", 1, True)}
    again = specs.learn(table, spark.createDataFrame([("a", "r2", at(99)), ("b", "r9", at(99))], "key string, rules string, learned timestamp"))
    assert {(r.key, r.version, r.rules) for r in specs.current(again).collect()} == {("a", 2, "r2"), ("b", 1, "r1")}
    listed = {r.key: r for r in specs.listing(specs.retire(again, F.lit(at(40 * 86400)))).collect()}
    assert (listed["a"].versions, listed["a"].retirements, listed["a"].in_force) == (2, 2, None) and listed["b"].retirements == 1
    failed = spark.createDataFrame([("a",), ("a",), ("b",)], "key string")
    assert [r.key for r in specs.may_learn(spark.createDataFrame([("a",), ("b",), ("z",)], "key string"), failed).orderBy("key").collect()] == ["b", "z"]


def prints(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, hi long, lo long")


def test_duplicate_index_in_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(dedupe, "MEETING", 4)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 32, (12, 2))
    rows = []
    for i in range(240):
        hi, lo = (int(x) for x in base[rng.integers(12)])
        for bit in rng.integers(0, 64, rng.integers(0, 4)):
            hi, lo = (hi ^ (1 << int(bit - 32)), lo) if bit >= 32 else (hi, lo ^ (1 << int(bit)))
        rows.append((i, hi, lo))
    rows += [(240, 0, 0), (241, 0, 0)]
    want = {}
    for d, hi, lo in rows:
        near = [(n, e) for e, h, w in rows if e < d and (h or w) and (hi or lo) and (n := (hi ^ h).bit_count() + (lo ^ w).bit_count()) <= 3]
        want[d] = min(near)[::-1] if near else (None, None)
    got = {}
    for run in range(2):  # the second batch is repeated
        for number, (low, high) in enumerate(((0, 90), (90, 91), (91, 242))):
            if run == 0 or number == 1:
                found = dupindex.check_and_add(prints(spark, rows[low:high]), f"file://{tmp_path}/index", number).collect()
                got |= {r.doc_id: (r.duplicate_of, r.distance) for r in found}
    assert got == want
    assert dupindex.check_and_add(prints(spark, []), f"file://{tmp_path}/index", 3).collect() == []


def test_ledger_survives_crash_and_repetition(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/table"
    batch = lambda rows: spark.createDataFrame(rows, "k long, t long, v string")
    rows = lambda: sorted(tuple(r) for r in ledger.table(spark, path).collect())
    assert ledger.table(spark, path) is None
    assert ledger.upsert_batch(batch([(1, 1, "a"), (2, 1, "b")]), 0, path, ["k"], ["t"], 4)
    enter = ledger._enter
    monkeypatch.setattr(ledger, "_enter", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):  # between data and ledger
        ledger.upsert_batch(batch([(1, 2, "c"), (3, 1, "d")]), 1, path, ["k"], ["t"])
    assert rows() == [(1, 1, "a"), (2, 1, "b")]
    monkeypatch.setattr(ledger, "_enter", enter)
    assert ledger.upsert_batch(batch([(1, 2, "c"), (3, 1, "d")]), 1, path, ["k"], ["t"])
    assert not ledger.upsert_batch(batch([(1, 9, "again")]), 1, path, ["k"], ["t"])  # repeated: nothing changes
    assert ledger.upsert_batch(batch([]), 2, path, ["k"], ["t"]) and ledger.upsert_batch(batch([(2, 0, "old")]), 3, path, ["k"], ["t"])
    assert rows() == [(1, 2, "c"), (2, 1, "b"), (3, 1, "d")]
    assert ledger.vacuum(spark, path) >= 1 and rows() == [(1, 2, "c"), (2, 1, "b"), (3, 1, "d")]


def streamed(spark, rows, folder, schema):
    """Rows as files of a stream, one file a trigger."""
    for k, some in enumerate(rows):
        if not os.path.isdir(f"{folder}/in/{k}"):
            spark.createDataFrame(some, schema).coalesce(1).write.parquet(f"{folder}/in/{k}")
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def test_folds_in_a_stream_equal_those_of_the_table(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng = np.random.default_rng(4)
    times = np.sort(rng.uniform(0, 4000, 160)).round(3)
    rows = [(int(rng.integers(3)), i, at(t), bool(rng.random() < 0.6), float(rng.uniform(0, 9))) for i, t in enumerate(times)]
    schema = "host long, seq long, at timestamp, failed boolean, length double"
    mixed = [rows[:60], rows[60:110][::-1], rows[110:], [(9, 999, at(90_000), False, 0.0)]]  # the last row carries the watermark on
    table = spark.createDataFrame(rows, schema)
    seconds = F.unix_micros("at") / 1_000_000.0
    for kind, out, values in (("breaker", "host long, seq long, state string", ["failed"]), ("limiter", ordered.LIMITED, ["length"])):
        if kind == "breaker":
            want, start, step = ordered.breaker_states(table, "host", "seq", seconds, F.col("failed"), 3, 200.0), lambda: ("closed", 0, 0.0), ordered.breaker_step(3, 200.0)
        else:
            want, start, step = ordered.limited(table, "host", "seq", seconds, F.col("length"), 0.1, 2.0, 2, 1.0), lambda: ([], 2.0, None, None), ordered.limiter_step(0.1, 2.0, 2, 1.0)
        folder = f"{tmp_path}/{kind}"
        for stop in (2, 4):  # stopped and started again from its checkpoint
            stream = folds.fold_stream(streamed(spark, mixed[:stop], folder, schema), "host", "at", "seq", start, step, out, values, "1 minute")
            stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/c").option("path", f"{folder}/out").trigger(availableNow=True).start().awaitTermination()
        got = spark.read.parquet(f"{folder}/out").filter("seq < 999").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want.collect())) and len(got) == len(rows)


def test_starts_and_ends_in_a_stream(spark, tmp_path):
    starts = [(i, i % 3, at(100 * i)) for i in range(12)]
    ends = [(i % 3, at(100 * i + 40)) for i in range(0, 12, 2)]
    schema_s, schema_e = "id long, k int, at timestamp", "k int, until timestamp"
    s = streamed(spark, [starts, [(99, 9, at(50_000))]], f"{tmp_path}/s", schema_s)
    e = streamed(spark, [ends, [(9, at(50_000))]], f"{tmp_path}/e", schema_e)
    joined = temporal.with_timeouts(s, e, "k", "at", "until", 60, "10 seconds")
    joined.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").option("path", f"{tmp_path}/out").trigger(availableNow=True).start().awaitTermination()
    got = {(r.id, r.until) for r in spark.read.parquet(f"{tmp_path}/out").filter("id < 99").collect()}
    table = temporal.with_timeouts(spark.createDataFrame(starts, schema_s), spark.createDataFrame(ends, schema_e), "k", "at", "until", 60)
    assert got == {(r.id, r.until) for r in table.collect()} == {(i, at(100 * i + 40) if i % 2 == 0 else None) for i in range(12)}


def boxed(*members, before=b"", comment=b"", method=zipfile.ZIP_DEFLATED):
    to = io.BytesIO()
    with zipfile.ZipFile(to, "w", method) as z:
        for name, text in members:
            z.writestr(name, text)
        z.comment = comment
    return before + to.getvalue()


def test_containers():
    kind = lambda raw: detect.zip_kind(raw)[1:2] if detect.zip_kind(raw) else None
    assert kind(boxed(("a", "x"), ("word/document.xml", "y" * 9999))) == ("docx",)
    assert kind(boxed(("xl/worksheets/s.xml", "y"), before=b"MZ junk")) == ("xlsx",)
    assert kind(boxed(("a", ""), ("mimetype", "application/epub+zip"), comment=b"c" * 300)) == ("epub",)
    assert kind(boxed(("mimetype", "application/vnd.oasis.opendocument.text"), method=zipfile.ZIP_STORED)) == ("odt",)
    assert kind(boxed()) == ("zip",) and kind(boxed(("deep/word/document.xml", ""))) == ("zip",)
    whole = boxed(("word/document.xml", "y" * 99))
    assert kind(whole[:-30]) is None and kind(b"PK\x03\x04") is None and kind(None) is None and kind(b"") is None
    assert len(detect.zip_directory(boxed(*[(f"f{i}", "") for i in range(70_000)]))) == 70_000  # more than an old record can count


def test_charsets(spark):
    texts = [("fr", "L'été était très chaud à Évreux, où l'on goûtait des pêches mûres. " * 3), ("de", "Über die Straße läuft ein großer Bär, während Mäuse fröhlich übers Gras hüpfen. " * 3), ("es", "El niño español comió piñas y mañana cantará una canción según la tradición. " * 3), ("en", "A plain text without any accents at all. " * 3), ("en", None), (None, "x")]
    model = charset.learn(spark.createDataFrame(texts, "lang string, text string"))
    read = 0
    for lang, t in texts[:4]:
        for page in charset.PAGES:
            try:
                raw = t.encode(page)
            except UnicodeEncodeError:
                continue  # a page without the letter
            read += 1
            text, _, told = model.read(raw)
            assert text == t and (told in (lang, None) or lang == "en")
    assert read > 24
    assert model.read(texts[0][1].encode("utf-16"))[:2] == (texts[0][1], "utf-16") and model.read(b"")[0] is None and model.read(None)[0] is None
    assert model.read("é".encode("cp1252"))[0] == "é" and charset.Model({}).read(b"\xe9t\xe9")[0] == "été"
    late = "word " * 2000 + "é"
    assert model.read(late.encode("utf-16-le"))[0] == late and charset.learn(spark.createDataFrame([], "lang string, text string")).names == []
