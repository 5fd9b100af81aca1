"""Texts as rows of tokens, in which phrases are found whole: by words, numbers and signs, whatever blanks, case and line ends lie between."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# A word, a number with its digit groups, a comparison of two signs, or any other sign by itself.
_TOKEN = r"[a-z]+|[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?|[<>]=|[^\sa-z0-9]"


def tokens(text: Column) -> Column:
    """The tokens of a text in small letters; of null none. A raised or lowered digit counts as a digit, a no-break space as a blank."""
    return F.regexp_extract_all(F.lower(F.translate(F.coalesce(text, F.lit("")), "₂³²  ", "232  ")), F.lit(_TOKEN), F.lit(0))


def spoken(text: Column, hyphens: bool = False) -> Column:
    """The tokens of a text as one string with a blank around each; hyphens are left out unless asked for."""
    found = tokens(text)
    found = found if hyphens else F.filter(found, lambda t: ~t.isin("-", "‑", "‐"))
    return F.concat(F.lit(" "), F.array_join(found, " "), F.lit(" "))


def says(said: Column, phrases: Iterable[str]) -> Column:
    """Whether a spoken text holds one of the phrases (tokens with single blanks between) as whole tokens."""
    found = F.lit(False)
    for phrase in phrases:
        found = found | F.contains(said, F.lit(f" {phrase} "))
    return found


def has_word_from(said: Column, stems: Iterable[str]) -> Column:
    """Whether a spoken text has a word that begins with one of the stems."""
    found = F.lit(False)
    for stem in stems:
        found = found | F.contains(said, F.lit(f" {stem}"))
    return found
