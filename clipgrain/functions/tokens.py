"""Transcript symbols as expressions; only Unicode composition needs Python."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks that stay with the symbol before them, and glyphs that join t, d, ʈ or ɖ.
HELD = "ːˑʰʷʲˤˠ̥̪̩͡"
JOINING = "ʃʒɕʑɲŋɭʈɖʂʐ"
STOPS = "tdʈɖ"
FORMATS = ("ipa", "espeak", "orthography_with_dictionary")

#: A glyph with its marks; a bare stop takes one glyph that joins it first.
SYMBOL = f"[{STOPS}][{JOINING}][{HELD}\\p{{M}}]*|[^\\s][{HELD}\\p{{M}}]*"


def nfc(column: Column) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))

    return run(column)


def ipa_symbols(composed: Column) -> Column:
    """Base glyphs with their marks, of text that ``nfc`` has composed; slashes, dots and stress marks are dropped."""
    text = F.translate(F.coalesce(composed, F.lit("")), "/.ˈˌ", "  ")
    return F.regexp_extract_all(text, F.lit(f"(?U){SYMBOL}"), F.lit(0))


def espeak_symbols(content: Column) -> Column:
    return F.filter(F.split(F.coalesce(content, F.lit("")), r"(?U)\s+"), lambda s: s != "")


def transcript_symbols(fmt: Column, content: Column) -> Column:
    """Symbols of a transcript by its format: ``ipa`` by glyph, ``espeak`` by white space; none for others."""
    kind = format_of(fmt)
    none = F.array().cast("array<string>")
    return F.when(kind == "ipa", ipa_symbols(nfc(content))).when(kind == "espeak", espeak_symbols(content)).otherwise(none)


def format_of(fmt: Column) -> Column:
    return F.lower(F.trim(F.coalesce(fmt, F.lit(""))))
