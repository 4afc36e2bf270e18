"""Small messy inputs and brute-force versions that several tests share."""

from __future__ import annotations

import re
import string
import zlib

from pyspark.sql import functions as F

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Names that the operators use themselves, as columns of the input.
CLASHES = ["hash", "norm", "words", "n", "token", "found", "doc", "id", "bucket", "rank", "at", "len", "score", "key", "rep", "u", "v", "label"]


def frame(spark, rows, clash=False, schema=SCHEMA):
    docs = spark.createDataFrame(rows, schema)
    for name in CLASHES if clash else []:
        docs = docs.withColumn(name, F.lit(1))
    return docs


def document(doc_id, text, lang="en", source="s"):
    return (doc_id, text, lang, source, None if text is None else len(text))


def messy():
    """Null ids and texts, empty and very long texts, ties and repeated rows."""
    long = " ".join(f"word{i % 977} and{i}" for i in range(20_000))
    return [
        document(1, "The quick brown fox jumps over the lazy dog near the river bank today"),
        document(1, "The quick brown fox jumps over the lazy dog near the river bank today"),
        document(2, "The quick brown  fox jumps over the lazy dog\tnear the river bank today", None, None),
        document(3, None, None, None),
        document(4, ""),
        document(5, " \n\t "),
        document(None, "a row without an id"),
        document(None, None, None, None),
        document(6, long),
        document(7, "123 !!! ..."),
        document(8, "Él niño ÉTÉ straße größer"),
        document(9, "tie tie tie tie tie tie"),
        document(10, "tie tie tie tie tie tie"),
    ]


def words(text):
    return WORD.findall((text or "").translate(LOW))


def crc(value):
    return zlib.crc32(str(value).encode())


def tuples(rows):
    return sorted((tuple(r) for r in rows.collect()), key=repr)
