"""Code pages that look like damaged UTF-8, and lines of another language."""

from weftlake.functions import policy
from weftlake.functions.charset import learn


def test_code_pages_with_letters_from_0x80_on_are_not_damaged_utf8():
    raw = ("Los ciónrros osos. " * 9 + "Íñ " + "plain words " * 60).encode("cp850")
    assert policy.told_by_form(raw) == (None, None)
    damaged = ("más años después, así será " * 9).encode()[:-2] + b"\xff " + b"plain words " * 60
    assert policy.told_by_form(damaged)[1] == "utf-8"


def test_a_line_of_another_language(spark):
    rows = [("de", "die Mächte und Nächte " * 200), ("en", "the matter and the night, the latches " * 300), ("fr", "très près, mère, père " * 60)]
    model = learn(spark.createDataFrame(rows, "lang string, text string"))
    text = "the night and the latches " * 5 + "Mächte"
    assert [model.read(text.encode(p))[0] for p in ("mac_roman", "cp850", "cp437")] == [text] * 3
