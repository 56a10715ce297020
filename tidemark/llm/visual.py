"""One form for texts that look the same.

Two forms of a text are made, once per distinct value of an Arrow batch:

* ``fold``: compatibility normalisation, composed form, full case folding, mapped white space, no
  default-ignorable characters, look-alike letters mapped. This is the form to compare or index by.
* ``display``: what the screen shows. It keeps case, accents and the difference between, say, a
  superscript and a digit, but equates what looks alike: full-width forms, composed and combining
  accents, ligatures and their letters, look-alike letters, kinds of spaces, hyphens and line breaks.

``fold`` is made from ``display`` and finds the candidates, ``display`` decides.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import settled, stage_table

# Letters of other scripts whose usual glyph is that of a Latin letter.
_CYRILLIC = "А В Е К М Н О Р С Т Х Ѕ І Ј Ү Ԛ Ԝ а е о р с у х ѕ і ј һ ԁ ԛ ԝ"
_CYRILLIC_AS = "A B E K M H O P C T X S I J Y Q W a e o p c y x s i j h d q w"
_GREEK = "Α Β Ε Ζ Η Ι Κ Μ Ν Ο Ρ Τ Υ Χ ο ϲ ϳ"
_GREEK_AS = "A B E Z H I K M N O P T Y X o c j"
_ALIKE = {
    ord(a): b
    for a, b in [*zip(_CYRILLIC.split(), _CYRILLIC_AS.split(), strict=True), *zip(_GREEK.split(), _GREEK_AS.split(), strict=True)]
}
_SAME_GLYPH = {
    **_ALIKE,
    0x2010: "-",
    0x2011: "-",
    0x212A: "K",
    0x212B: "Å",
    0xFB00: "ff",
    0xFB01: "fi",
    0xFB02: "fl",
    0xFB03: "ffi",
    0xFB04: "ffl",
    0x037E: ";",
    # spaces of a line
    **dict.fromkeys([0x00A0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000], " "),
    # line breaks
    **dict.fromkeys([0x0B, 0x0C, 0x85, 0x2028, 0x2029], "\n"),
}
# The ranges of default-ignorable code points.
_IGNORABLE_RANGES = (
    "00AD 034F 061C 115F-1160 17B4-17B5 180B-180F 200B-200F 202A-202E 2060-206F 3164 FE00-FE0F FEFF FFA0 FFF0-FFF8 1BCA0-1BCA3 1D173-1D17A E0000-E0FFF"
)
_IGNORABLE = re.compile("[" + "".join("-".join(chr(int(c, 16)) for c in r.split("-")) for r in _IGNORABLE_RANGES.split()) + "]+")
_WIDTH = re.compile(r"[！-￮]+")
_BREAKS = {0x0D: "\n", 0x0B: "\n", 0x0C: "\n"}


_MAPPED = re.compile("[" + "".join(re.escape(chr(c)) for c in _SAME_GLYPH) + "]")
_OTHER_SCRIPT = re.compile("[\u0370-\u052f\u1f00-\u1fff]")


def _mapped(text: str) -> str:
    return _MAPPED.sub(lambda m: _SAME_GLYPH[ord(m[0])], text) if _MAPPED.search(text) else text


def display_form(text: str | None) -> str | None:
    """What a text shows on screen; ``None`` stays ``None``."""
    if text is None:
        return None
    if not text.isascii():
        text = _IGNORABLE.sub("", text)
        text = _WIDTH.sub(lambda m: unicodedata.normalize("NFKC", m[0]), text)
    text = text.replace("\r\n", "\n").translate(_BREAKS) if "\r" in text or "\x0b" in text or "\x0c" in text else text
    if text.isascii():
        return text
    text = _mapped(text)
    if _OTHER_SCRIPT.search(text):
        # accents are composed after letters were mapped, so that a mapped letter takes its accent along
        text = _mapped(unicodedata.normalize("NFD", text))
    return unicodedata.normalize("NFC", text)


def _folded(shown: str) -> str:
    if not shown.isascii():
        shown = unicodedata.normalize("NFKC", shown)
    folded = shown.casefold()
    return " ".join((folded if folded.isascii() else unicodedata.normalize("NFKC", folded)).split())


def fold_form(text: str | None) -> str | None:
    """The comparison form of a text; ``None`` stays ``None``."""
    return None if text is None else _folded(display_form(text))


def _per_distinct(values: pd.Series, form) -> pd.Series:
    known: dict = {}
    out = []
    for value in values:
        if value not in known:
            known[value] = form(value)
        out.append(known[value])
    return pd.Series(out, dtype=object)


@F.pandas_udf(T.StringType())
def fold_text(values: pd.Series) -> pd.Series:
    """Vectorised :func:`fold_form`."""
    return _per_distinct(values, fold_form)


@F.pandas_udf(T.StringType())
def display_text(values: pd.Series) -> pd.Series:
    """Vectorised :func:`display_form`."""
    return _per_distinct(values, display_form)


_DIGESTS = T.StructType([T.StructField("fold", T.BinaryType()), T.StructField("shown", T.BinaryType()), T.StructField("blank", T.BooleanType())])


@F.pandas_udf(_DIGESTS)
def _digests(values: pd.Series) -> pd.DataFrame:
    """128-bit digests of the two forms, once per distinct value of a batch; null for null."""
    known: dict = {None: (None, None, None)}
    for value in values:
        if value not in known:
            shown = display_form(value)
            known[value] = (*(hashlib.md5(x.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest() for x in (_folded(shown), shown)), not shown.strip())
    return pd.DataFrame([known[v] for v in values], columns=["fold", "shown", "blank"])


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def visual_digests(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id``, ``fold``, ``shown`` and ``raw`` digests of every document that is not blank.

    Whole texts are read; only 48 bytes per document travel on. Plain texts, which have as many bytes as
    characters, are formed in the JVM; only the others reach Python.
    """
    made = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    plain = F.octet_length("text") == F.length("text")
    own = F.when(plain, F.translate(F.replace("text", F.lit("\r\n"), F.lit("\n")), "\r\x0b\x0c", "\n\n\n"))
    folded = F.trim(F.regexp_replace(F.lower(own), r"[\s\x1c-\x1f]+", " "))
    formed = made.select("doc_id", "text", own.alias("own"), folded.alias("folded"), _digests(F.when(~plain, F.col("text"))).alias("d"))
    kept = formed.where(F.coalesce(~F.col("d.blank"), F.col("folded") != ""))
    # stored, as classes and pairs read it several times and every reading would form all texts again
    return stage_table(
        kept.select("doc_id", F.coalesce("d.fold", _digest(F.col("folded"))).alias("fold"), F.coalesce("d.shown", _digest(F.col("own"))).alias("shown"), _digest(F.col("text")).alias("raw")).distinct()
    )


@settled
def visual_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document with its class: documents of a class show the same.

    Result: ``doc_id``, ``fold``, ``shown`` (class digests), ``raw``, ``variants`` (different texts in the
    class). Defined cases: null and blank texts (nothing but spaces, line breaks and characters without
    appearance) are left out; repeated rows count once.
    """
    digests = visual_digests(docs, doc_id, text)
    per_class = digests.select("fold", "shown", "raw").distinct().groupBy("fold", "shown").agg(F.count(F.lit(1)).alias("variants"))
    return digests.join(per_class, ["fold", "shown"])


@settled
def visual_pairs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pairs ``doc_a`` < ``doc_b`` of documents with different text that show the same.

    Classes of one text, however many copies it has, give no pair and leave before any join. The different
    texts of a class are paired first, on the fold digest and the display digest together, which is the
    exact check; each pair of texts then meets its documents, so that copies of one text are never compared
    with each other and the work follows the size of the result.
    """
    members = visual_classes(docs, doc_id, text).where("variants > 1").select("fold", "shown", "raw", "doc_id")
    texts = members.select("fold", "shown", "raw").distinct()
    other = texts.withColumnRenamed("raw", "raw_b")
    pairs = texts.withColumnRenamed("raw", "raw_a").join(other, ["fold", "shown"]).where("raw_a < raw_b").select("raw_a", "raw_b")
    left = members.select(F.col("raw").alias("raw_a"), F.col("doc_id").alias("x"))
    right = members.select(F.col("raw").alias("raw_b"), F.col("doc_id").alias("y"))
    met = pairs.join(left, "raw_a").join(right, "raw_b").where("x <> y")
    return met.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b")).distinct()
