from __future__ import annotations

import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.visual import display_form, display_text, fold_form, fold_text, visual_classes, visual_pairs


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("Café", "Café", True),
        ("wide", "ｗｉｄｅ", True),
        ("a b", "a b", True),
        ("a b", "a b", True),
        ("ab", "a​b", True),
        ("ab", "a­b️", True),
        ("scope", "sсоре", True),
        ("five-fold", "ﬁve‐fold", True),
        ("a\nb", "a\r\nb", True),
        ("ｶﾞ", "ガ", True),
        ("A", "a", False),
        ("resume", "résumé", False),
        ("a b", "a  b", False),
        ("a b", "a\nb", False),
        ("x2", "x²", False),
        ("ss", "ß", False),
        ("1/2", "½", False),
        ("a.b", "a,b", False),
    ],
)
def test_same_on_screen(a, b, same):
    assert (display_form(a) == display_form(b)) is same


def test_fold():
    assert fold_form("ＳＴＲＡＳＳＥ  x") == fold_form("straße x")
    assert fold_form(None) is display_form(None) is None


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=30))
def test_forms_are_stable(text):
    assert display_form(display_form(text)) == display_form(text)
    assert display_form(unicodedata.normalize("NFD", text)) == display_form(unicodedata.normalize("NFC", text))
    if display_form(text) == display_form(text.upper()):
        assert fold_form(text) == fold_form(text.upper())


def test_pairs(spark):
    rows = [(1, "same text"), (2, "same text"), (3, "sаme text"), (4, "same text"), (5, "Same text"), (6, " ​"), (7, " "), (8, ""), (9, None), (None, "same text"), (2, "same text")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as shown", "1 as raw")
    assert {tuple(r) for r in visual_pairs(df).collect()} == {(1, 2), (1, 3), (2, 3), (2, 4), (3, 4)}
    assert {r["doc_id"]: r["variants"] for r in visual_classes(df).collect()} == {1: 3, 2: 3, 3: 3, 4: 3, 5: 1}
    assert visual_pairs(df.where("false")).count() == 0


def test_hot_text_gives_no_pairs(spark):
    df = spark.createDataFrame([(k, "copied everywhere") for k in range(3000)] + [(9000, "x" * 500_000)], "doc_id long, text string")
    assert visual_pairs(df).count() == 0


def test_columns(spark):
    df = spark.createDataFrame([("Ｘ",), (None,)], "t string")
    assert [tuple(r) for r in df.select(fold_text("t"), display_text("t")).collect()] == [("x", "X"), (None, None)]
