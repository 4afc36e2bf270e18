"""Fill-in-the-middle: prefix, middle and suffix cut out by one regular expression a text.

A text is a row of units. ``regexp_count`` gives their number; two numbers
drawn from a hash of the id say after how many units the prefix and the middle
end. They go as counts into a pattern of the row's own, whose possessive groups
take exactly so many units each and never back up, so that one match captures
the three parts of a text of any length in one pass and constant stack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a unit is, and what stands before each part of the output.
UNIT = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SALT = "1:"
CHANGED_PERCENT = 90
SUFFIX_FIRST_PERCENT = 20


def draws(doc_id: Column, salt: str) -> list[Column]:
    """Four numbers below 2**32 from the SHA-256 of salt and id; a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]


def counted_pattern(first: Column, second: Column) -> Column:
    """The pattern that captures ``first`` units, then ``second`` units, then the rest."""
    unit = f"(?:{UNIT})"
    return F.concat(F.lit(rf"(?s)\A({unit}{{"), first, F.lit(rf"}}+)({unit}{{"), second, F.lit(r"}+)(.*)\z"))


def transformed(
    docs: DataFrame,
    salt: str = SALT,
    changed_percent: int = CHANGED_PERCENT,
    suffix_first_percent: int = SUFFIX_FIRST_PERCENT,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, text, n, form, output``.

    ``form`` is ``psm`` (prefix, suffix, middle), ``spm`` (suffix, prefix,
    middle) or ``plain``, which leaves the text as it is: empty texts, texts
    that hold one of the markers, and those drawn so. Null text is empty text.
    A null id draws as an empty one; rows of one id and text come out alike.
    ``n`` is the number of units. A text and its units have to fit in a task's
    memory, as ``regexp_count`` lists them; no row is shuffled. Other columns
    are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id"), text.alias("text"), F.array(*draws(F.col("doc_id"), salt)).alias("h"))
    counted = rows.withColumn("n", F.regexp_count("text", F.lit(UNIT)).cast("bigint"))
    h = [F.col("h")[i] for i in range(4)]
    cuts = [F.pmod(h[i], F.col("n") + 1) for i in range(2)]
    marked = F.lit(False)
    for marker in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains(F.col("text"), F.lit(marker))
    plain = (F.col("text") == "") | marked | (F.pmod(h[2], F.lit(100)) >= changed_percent)
    form = F.when(plain, "plain").when(F.pmod(h[3], F.lit(100)) < suffix_first_percent, "spm").otherwise("psm")
    cut = counted.select(
        "doc_id", "text", "n", form.alias("form"), F.least(*cuts).alias("first"), (F.greatest(*cuts) - F.least(*cuts)).alias("second")
    )
    order = F.when(F.col("form") == "psm", f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2").otherwise(f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2")
    pattern = counted_pattern(F.col("first"), F.col("second"))
    output = F.when(F.col("form") == "plain", F.col("text")).otherwise(F.regexp_replace(F.col("text"), pattern, order))
    return cut.select("doc_id", "text", "n", "form", output.alias("output"))


def parts(output: Column, form: Column) -> Column:
    """``struct<prefix, middle, suffix>`` read back from an output; null where it is plain.

    No text that was changed holds a marker, so each stands in its output once.
    """

    def between(first: str, second: str) -> tuple[Column, Column, Column]:
        rest = F.substring_index(output, second, -1)
        opening = F.substring_index(output, second, 1)
        head = F.substring(opening, len(first) + 1, F.length(opening))
        return head, F.substring_index(rest, MIDDLE, 1), F.substring_index(rest, MIDDLE, -1)

    prefix, suffix, middle = between(PREFIX, SUFFIX)
    psm = F.struct(prefix.alias("prefix"), middle.alias("middle"), suffix.alias("suffix"))
    suffix, prefix, middle = between(SUFFIX, PREFIX)
    spm = F.struct(prefix.alias("prefix"), middle.alias("middle"), suffix.alias("suffix"))
    return F.when(form == "psm", psm).when(form == "spm", spm)


def restored(output: Column, form: Column) -> Column:
    """The text an output was made from."""
    found = parts(output, form)
    return F.when(form == "plain", output).otherwise(F.concat(found["prefix"], found["middle"], found["suffix"]))


def digests(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: counts, form and SHA-256 of the output and of the text rebuilt from it."""
    rows = transformed(docs).select("doc_id", "n", "form", "output", parts(F.col("output"), F.col("form")).alias("found"))
    whole = F.when(F.col("form") == "plain", F.col("output")).otherwise(F.concat("found.prefix", "found.middle", "found.suffix"))
    return rows.select(
        "doc_id",
        "n",
        "form",
        F.length("found.prefix").cast("bigint").alias("prefix_chars"),
        F.length("found.middle").cast("bigint").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(whole, 256).alias("restored_sha256"),
    )
