"""Workers hold a slice of a batch."""

import pyarrow as pa

from weftlake.functions import payload
from weftlake.plans import readers
from weftlake.sources import captures, handlers


def test_readers_hold_a_slice_of_a_batch(tmp_path, spark):
    class Frame:
        dtypes = [("k", "bigint")]

        def select(self, *names):
            return self

        def mapInArrow(self, run, schema):  # noqa: N802
            return run

    blobs = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(["a,b\n1,2\n"] * 1000)], names=["k", "text"])
    made = list(handlers.delimited(Frame(), "k", "text")([blobs]))
    assert max(b.num_rows for b in made) <= 256 and sum(b.num_rows for b in made) == 1000
    zipped = list(readers._zip([blobs]))
    assert max(b.num_rows for b in zipped) <= 256 and sum(b.num_rows for b in zipped) == 1000


def test_captures_come_in_small_batches(tmp_path, spark):
    captures.record(spark.range(1000).selectExpr("'h' AS host", "id AS url", "200 AS status", "repeat('x', 50) AS body"), f"{tmp_path}/c", 3)
    (part,) = captures._listed(f"{tmp_path}/c")
    made = list(captures._rows(f"{tmp_path}/c", part))
    assert max(b.num_rows for b in made) <= 256 and sum(b.num_rows for b in made) == 1000 and made[0].schema.names == ["seq", "host", "url", "status", "body"]


def test_fragments_are_read_one_at_a_time():
    assert payload.fragment_text.func(pa.array(["<b>x</b> y", None, "&lt;", " z "])).to_pylist() == ["x y", "", "<", "z"]
