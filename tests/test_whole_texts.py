"""Texts of white space alone, empty ones and such with a mark of their own, decoded whole."""

import hashlib

import pytest

from weftlake.plans import queries

ODD = ["", " ", "\n\n", " ", " \t", "﻿", "﻿﻿marked", "Ü", "ordinary words", None]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows = [(3 * k + form, "en", t) for k, t in enumerate(ODD) for form in range(3)]
    at = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(rows, "doc_id long, lang string, text string").coalesce(1).write.parquet(f"{at}/documents.parquet")
    return at, {i: t and hashlib.sha256(t.encode()).hexdigest() if t != "" else hashlib.sha256(b"").hexdigest() for i, _, t in rows}


def test_charset_decoding(spark, folder):
    at, want = folder
    assert {r.doc_id: r.sha for r in queries.QUERIES["charset_decoding"](spark, at).collect()} == want


def test_charset_guesses(spark, folder):
    at, want = folder
    got = {r.doc_id: r.sha for r in queries.QUERIES["charset_guesses"](spark, at).collect()}
    assert {k: v for k, v in got.items() if ODD[k // 3] != "Ü"} == {k: v for k, v in want.items() if ODD[k // 3] != "Ü"}  # a letter by itself tells no page
