"""Code pages told apart by the letters around one, where pairs choose another."""

from weftlake.functions.charset import learn


def test_a_capital_after_a_full_stop(spark):
    rows = [("fr", "vous êtes là et vous êtes ici, puis êtes partis " * 300 + ". Étude. Étage. Étoile. "), ("en", "plain words of a text, and no others. " * 100), ("en", "")]
    model = learn(spark.createDataFrame(rows, "lang string, text string"))
    text = "plain words of a text. Étude, plain words. Étage"
    assert [model.read(text.encode(p))[0] for p in ("cp850", "cp437", "mac_roman", "cp1252", "cp037", "cp500")] == [text] * 6


def test_a_window_counts_once_however_often_it_is_repeated(spark):
    rows = [("de", "so schön, so ö so " * 200), ("de", "auch. Ü Ü Ü Ü Ü Ü Ü Ü Ü Ü")]
    model = learn(spark.createDataFrame(rows, "lang string, text string"))
    text = "auch. " + "Ü " * 60 + "Ü"
    assert [model.read(text.encode(p))[0] for p in ("cp850", "mac_roman", "cp1252")] == [text] * 3
