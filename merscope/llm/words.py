"""Words of a text, as Spark expressions."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# What stands between words, and words, before A-Z are lowered.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; other letters stay as they are."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def word_array(text: Column) -> Column:
    """The words of a text in order, A-Z lowered; null has none."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), BETWEEN), "")
