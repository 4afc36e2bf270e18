"""Language identification by compression with per-language dictionaries."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merscope.llm.batches import bound_batches, give_back

# Bounds of the sample that the dictionaries are made of.
TEXTS_PER_LANGUAGE = 128
DRAW_BUCKETS = 64
CHARS_PER_TEXT, CHARS_PER_PIECE = 768, 128
DICTIONARY_BYTES = 48 << 10
# Languages whose compressors a task holds at a time.
AT_ONCE = 64

LEVEL = 6
# A block this short would be stored as it is. It is compressed behind the
# beginning of the dictionary, whose own size is then taken off.
SHORT_LEVEL, SHORT_BYTES = 19, 256
BLOCK_BYTES = 16 << 10
NARROW = 0.005
UNDETERMINED = "und"
NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters_only(text: str) -> str:
    """Lower case, with one space for each run of other symbols."""
    return NOT_LETTERS.sub(" ", text.lower()).strip()


@dataclass(frozen=True)
class Dictionaries:
    """Raw-content dictionary of each language, most frequent language first."""

    content: tuple[tuple[str, bytes], ...]


def spread(text: str) -> str:
    """``CHARS_PER_TEXT`` characters of a letters-only text, all of a shorter one.

    The text is cut into equal stretches; each gives one piece, at a place
    chosen by hash, so that no part of the text is out of reach.
    """
    plain = letters_only(text)
    if len(plain) <= CHARS_PER_TEXT:
        return plain
    n, pieces = CHARS_PER_TEXT // CHARS_PER_PIECE, []
    for i in range(n):
        first, last = len(plain) * i // n, len(plain) * (i + 1) // n - CHARS_PER_PIECE
        at = first + zlib.crc32(plain.encode("utf-8", "replace"), i) % (last - first + 1)
        pieces.append(plain[at : at + CHARS_PER_PIECE])
    return " ".join(pieces)


def spread_text(text: Column) -> Column:
    @F.pandas_udf("string")
    def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([spread(t) for t in texts], dtype="object")

    return pieces(text)


def lowest(drawn: DataFrame, *by: str) -> DataFrame:
    """The ``TEXTS_PER_LANGUAGE`` rows of lowest ``draw`` for each value of ``by``."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("draw"))
    return drawn.withColumn("rank", rank).where(F.col("rank") <= TEXTS_PER_LANGUAGE).drop("rank")


def fit_dictionaries(labelled: DataFrame) -> Dictionaries:
    """Dictionaries from ``(text, lang)`` rows.

    Every language gets one. Its ``TEXTS_PER_LANGUAGE`` distinct texts that hash lowest give up to
    ``CHARS_PER_TEXT`` characters each, from all over the text, until
    ``DICTIONARY_BYTES`` are full: a bounded sample, the same on every run.
    Copies of a text count once. Only hashes of texts and the drawn pieces are
    shuffled. Rows with a null language or without letters are not used.
    """
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    languages = [r["lang"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()]
    hashed = rows.select("lang", "text", F.xxhash64("text").alias("draw"))
    # The lowest of each bucket first, so that no task sees all hashes of a language.
    parted = hashed.select("lang", "draw", F.pmod("draw", F.lit(DRAW_BUCKETS)).alias("bucket")).distinct()
    drawn = lowest(lowest(parted, "lang", "bucket"), "lang")
    last = drawn.groupBy("lang").agg(F.max("draw").alias("last"))
    texts = hashed.join(F.broadcast(last), "lang").where(F.col("draw") <= F.col("last"))
    sample = texts.select("lang", "draw", spread_text(F.col("text")).alias("piece")).groupBy("lang", "draw").agg(F.min("piece").alias("piece"))
    pieces = F.array_sort(F.collect_list(F.struct("draw", "piece")))["piece"]
    content = F.substring(F.concat_ws(" ", pieces, F.lit("")).cast("binary"), 1, DICTIONARY_BYTES)
    found = {r["lang"]: bytes(r["content"]) for r in sample.groupBy("lang").agg(content.alias("content")).collect()}
    return Dictionaries(tuple((lang, found[lang]) for lang in languages))


@dataclass
class Smallest:
    """The smallest and second smallest size of a text over the languages so far."""

    best: int = -1
    size: float = math.inf
    second: float = math.inf

    def add(self, sizes: list[int], first: int) -> None:
        """Sizes under the languages from number ``first``; the earlier one wins a tie."""
        for at, size in enumerate(sizes, first):
            if size < self.size:
                self.best, self.size, self.second = at, size, self.size
            elif size < self.second:
                self.second = size

    def verdict(self, languages: list[str]) -> tuple[str, float, bool]:
        """Language, score, and whether the margin is wide enough to accept it."""
        if self.best < 0:
            return UNDETERMINED, 0.0, False
        margin = 1 - self.size / self.second
        return languages[self.best], margin / (margin + 0.02), margin >= NARROW


class Sizer:
    """Compressed size of a text under each language's dictionary."""

    def __init__(self, dictionaries: Dictionaries) -> None:
        self.languages = [lang for lang, _ in dictionaries.content]
        self.usual = [self.compressor(text, LEVEL) for _, text in dictionaries.content]
        self.short = [self.compressor(text, SHORT_LEVEL) for _, text in dictionaries.content]
        self.heads = [text[:SHORT_BYTES] for _, text in dictionaries.content]
        self.head_sizes = [len(c.compress(h)) for c, h in zip(self.short, self.heads, strict=True)]

    @staticmethod
    def compressor(text: bytes, level: int) -> zstandard.ZstdCompressor:
        data = zstandard.ZstdCompressionDict(text, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(level)
        return zstandard.ZstdCompressor(level=level, dict_data=data, write_content_size=False, write_dict_id=False)

    def sizes(self, text: bytes) -> list[int]:
        if len(text) <= SHORT_BYTES:
            each = zip(self.short, self.heads, self.head_sizes, strict=True)
            return [max(1, len(c.compress(head + text)) - size) for c, head, size in each]
        blocks = [text[i : i + BLOCK_BYTES] for i in range(0, len(text), BLOCK_BYTES)]
        return [sum(len(c.compress(b)) for b in blocks) for c in self.usual]

    def add(self, text: str, found: Smallest, first: int = 0) -> None:
        """The sizes of a letters-only text, if it has letters, to what is found."""
        if any(map(str.isalpha, text)):
            found.add(self.sizes(text.encode("utf-8", "replace")), first)

    def identify(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score, and whether the margin is wide enough to accept it."""
        found = Smallest()
        self.add(letters_only(text or ""), found)
        return found.verdict(self.languages)


def identify_batches(batches: Iterator[pd.Series], dictionaries: Dictionaries, at_once: int = AT_ONCE) -> Iterator[pd.DataFrame]:
    """Each text under all dictionaries, with the compressors of ``at_once`` languages at a time.

    More languages than that are taken in blocks over the texts of a batch;
    only the two smallest sizes of each text are kept between blocks.
    """
    content = dictionaries.content
    languages = [lang for lang, _ in content]
    starts = range(0, len(content), at_once)
    only = Sizer(dictionaries) if len(starts) == 1 else None
    for texts in batches:
        plain = [letters_only(t or "") for t in texts]
        found = [Smallest() for _ in plain]
        for first in starts:
            sizer = only or Sizer(Dictionaries(content[first : first + at_once]))
            for text, smallest in zip(plain, found, strict=True):
                sizer.add(text, smallest, first)
        yield pd.DataFrame([f.verdict(languages) for f in found], columns=["lang_pred", "score", "accepted"])


def language_of(text: Column, dictionaries: Dictionaries) -> Column:
    """``struct<lang_pred, score, accepted>`` of a text, from the text alone.

    The whole text is compressed, in blocks, under every dictionary; the
    smallest sum wins, the more frequent language on a tie. ``score`` grows
    with the margin over the second best, 0 to 1. ``accepted`` is false for a
    margin under ``NARROW`` and for ``und``: null, empty or letterless text,
    or nothing learnt.
    """

    @F.pandas_udf("struct<lang_pred:string,score:double,accepted:boolean>")
    def identify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from identify_batches(batches, dictionaries)
        give_back()

    return identify(text)


def held_out() -> Column:
    """Documents whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame) -> Dictionaries:
    """Dictionaries from the documents that are not held out."""
    return fit_dictionaries(docs.where(~held_out()).select("text", "lang"))


def identify_documents(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, lang_pred, score, accepted``.

    Dictionaries come from the rows that are not held out; a null id counts as
    not held out. Repeated rows give repeated rows, an empty table none; other
    columns are not read. Nothing but hashes of the texts and the drawn sample is
    shuffled.
    """
    bound_batches(docs.sparkSession)
    found = docs.select("doc_id", held_out().alias("held_out"), language_of(F.col("text"), learn(docs)).alias("found"))
    return found.select("doc_id", "held_out", "found.*")


def drop_rejected(docs: DataFrame) -> DataFrame:
    """The documents with an accepted language, with their own columns."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("text").alias("own_text"))
    judged = rows.select("doc", language_of(F.col("own_text"), learn(docs)).alias("found"))
    return judged.where("found.accepted").select("doc.*")
