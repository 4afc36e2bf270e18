"""Benchmark decontamination: a broadcast hash set of test n-grams, scanned for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merscope.llm.scratch import saved
from merscope.llm.words import BETWEEN, WORD, word_array

SPAN = 13
# Windows in one broadcast, a hash and a length each: about 50 MB in memory. A
# larger benchmark is scanned for in more blocks, each of at most about this many.
BLOCK = 1_000_000
# Rows of documents' keys, or of hits, whose broadcast is allowed.
MOST_BROADCAST = 1_000_000


def stretch(words: Column, at: Column, many: Column) -> Column:
    """``many`` words from place ``at``, from 1. Taken one by one: ``slice`` reads the whole array each time."""
    places = F.when(many > 0, F.sequence(at, at + many - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.get(words, i - 1))


def cut(words: Column, length: int) -> Column:
    """All windows of ``length`` words as ``array<struct<at, len, hash>>``, ``at`` from 1.

    The hash is that of the array of a window's words, which chains theirs.
    """
    starts = F.sequence(F.lit(1), F.size(words) - (length - 1))
    window = F.transform(
        starts,
        lambda i: F.struct(
            i.alias("at"), F.lit(length).alias("len"), F.xxhash64(*[F.get(words, i + (k - 1)) for k in range(length)]).alias("hash")
        ),
    )
    return F.when(F.size(words) >= length, window).otherwise(F.array().cast("array<struct<at:int,len:int,hash:bigint>>"))


def test_windows(benchmark: DataFrame, span: int) -> DataFrame:
    """Windows of the benchmark with the items they are of: ``(hash, len, win, item)``.

    An item of fewer than ``span`` words is one window. ``item`` is the id as
    a string; a null id stays null.
    """
    words = benchmark.select(F.col("item_id").cast("string").alias("item"), word_array(F.col("text")).alias("words"))
    size = F.size("words")
    starts = F.sequence(F.lit(1), F.greatest(size - (span - 1), F.lit(1)))
    windows = words.where(size > 0).select("item", F.explode(F.transform(starts, lambda i: stretch(F.col("words"), i, F.least(F.lit(span), size + 1 - i)))).alias("win"))
    return windows.distinct().select(F.xxhash64("win").alias("hash"), F.size("win").alias("len"), "win", "item")


def keyed(docs: DataFrame) -> list[Column]:
    return [F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")]


def scanned(docs: DataFrame, tests: DataFrame) -> DataFrame:
    """``(doc_id, text_hash, n_words, at, len, hash)`` of the windows whose hash a test window has.

    Every window of every text is hashed and looked up in a broadcast hash
    set. A window's row holds no words, so the work is in proportion to the
    text. Each row of ``docs`` also gives one row without a window, ``at`` 0,
    so that it is in the result when nothing matches.
    """
    keys = saved(tests.select("hash", "len").distinct())
    sized = keys.agg(F.count(F.lit(1)).alias("n"), F.collect_set("len").alias("lens")).first()
    blocks = max(1, -(-sized["n"] // BLOCK))
    # The number of words is taken here: above the windows it would need the words in each row.
    texts = docs.select(*keyed(docs), word_array(F.col("text")).alias("words")).withColumn("n_words", F.size("words"))
    mark = F.array(F.struct(F.lit(0).alias("at"), F.lit(0).alias("len"), F.lit(None).cast("long").alias("hash")))
    windows = [cut(F.col("words"), length) for length in sorted(sized["lens"])]

    def scan(block: int) -> DataFrame:
        every = F.concat(mark, *windows) if block == 0 else F.concat(*windows)
        rows = texts.select("doc_id", "text_hash", "n_words", F.inline(every))
        part = F.broadcast(keys.where(F.pmod("hash", F.lit(blocks)) == block).withColumnsRenamed({"hash": "key", "len": "length"}))
        same = (F.col("hash") == F.col("key")) & (F.col("len") == F.col("length"))
        return rows.join(part, same, "left").where((F.col("at") == 0) | F.col("key").isNotNull()).drop("key", "length")

    return saved(reduce(DataFrame.unionByName, [scan(b) for b in range(blocks)]))


def verified(docs: DataFrame, tests: DataFrame, found: DataFrame) -> DataFrame:
    """``(doc_id, text_hash, at, len, hash, win)`` of the windows found that equal a test window word by word.

    The documents with a match are read again; in each, its matches alone are
    cut out, and these rows of a window's words meet the test windows.
    """
    by_text = saved(found.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("many"), F.collect_set(F.struct("at", "len", "hash")).alias("hits")))
    few = (by_text.agg(F.sum("many")).first()[0] or 0) <= MOST_BROADCAST
    hits = by_text.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("text_key"), "hits")
    texts = docs.select(*keyed(docs), F.col("text"))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("text_key"))
    again = texts.join(F.broadcast(hits) if few else hits, same).select("doc_id", "text_hash", word_array(F.col("text")).alias("words"), "hits")
    cut_out = F.transform("hits", lambda h: F.struct(h["at"].alias("at"), h["len"].alias("len"), h["hash"].alias("hash"), stretch(F.col("words"), h["at"], h["len"]).alias("win")))
    rows = again.select("doc_id", "text_hash", F.inline(cut_out))
    return saved(rows.join(tests.select("hash", "len", "win").distinct(), ["hash", "len", "win"], "left_semi").distinct())


def find_hits(docs: DataFrame, benchmark: DataFrame, span: int = SPAN) -> DataFrame:
    """``(doc_id, text_hash, n_words, copies, hits, items)`` for each document.

    ``hits`` are the verified windows as ``(at, len)``, ``items`` the ids of
    the benchmark items with one of them. ``copies`` counts rows alike in id
    and text. Items are joined to the hits last: neither a broadcast nor the
    scan carries them, however many items share a window.
    """
    tests = saved(test_windows(benchmark, span))
    seen = scanned(docs, tests)
    true = verified(docs, tests, seen.where("at > 0"))
    items = true.join(tests, ["hash", "len", "win"]).where(F.col("item").isNotNull()).select("doc_id", "text_hash", "item").distinct()
    hit = F.struct("at", "len")
    none = F.lit(None)
    rows = (
        seen.where("at = 0")
        .select("doc_id", "text_hash", "n_words", none.cast("struct<at:int,len:int>").alias("hit"), none.cast("string").alias("item"))
        .unionByName(true.select("doc_id", "text_hash", hit.alias("hit")), allowMissingColumns=True)
        .unionByName(items, allowMissingColumns=True)
    )
    return rows.groupBy("doc_id", "text_hash").agg(
        F.max("n_words").alias("n_words"),
        F.count("n_words").alias("copies"),
        F.array_sort(F.collect_set("hit")).alias("hits"),
        F.collect_set("item").alias("items"),
    )


def covered(hits: Column) -> Column:
    """Number of words inside at least one hit; hits are sorted."""
    begin = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))

    def add(s: Column, hit: Column) -> Column:
        end = hit["at"] + hit["len"]
        fresh = F.greatest(end - F.greatest(s["end"], hit["at"]), F.lit(0))
        return F.struct(F.greatest(s["end"], end).alias("end"), (s["total"] + fresh).alias("total"))

    return F.aggregate(hits, begin, add, lambda s: s["total"])


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = SPAN) -> DataFrame:
    """One row per row of ``docs``: hit words, items hit, and the verdict.

    A document is contaminated when hit words are at least a twentieth of its
    words. Null or empty text has no words and no hits; an empty benchmark or
    one of texts without words hits nothing; an item with a null id hits words
    but is not counted as an item. Rows alike in id and text give alike rows.
    Other columns are not read.
    """
    found = find_hits(docs, benchmark, span).withColumn("n_hit", covered(F.col("hits")))
    ids = F.array_join(F.array_sort("items"), ",")
    rows = found.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.col("n_hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit").cast("long") * 20 >= F.col("n_words"))).alias("contaminated"),
        "text_hash",
        "hits",
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"),
    )
    return rows.drop("copy")


def whole(docs: DataFrame) -> DataFrame:
    """Each document as one column beside its id and text hash, so that no names clash."""
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        F.col("doc_id").alias("id"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, span: int = SPAN) -> DataFrame:
    """The documents that are not contaminated, with their own columns.

    Only the keys of the contaminated ones are joined, by a broadcast while
    they are few, so that the documents stay where they are.
    """
    bad = saved(contamination(docs, benchmark, span).where("contaminated").select("doc_id", "text_hash").distinct())
    rows = whole(docs)
    bad = F.broadcast(bad) if bad.count() <= MOST_BROADCAST else bad
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("text_key") == F.col("text_hash"))
    return rows.join(bad, same, "left_anti").select("doc.*")


def spared(hits: Column, words: Column) -> Column:
    """The stretches of words outside all hits, as ``array<struct<at, many>>``; hits are sorted."""
    kept = "array<struct<at:int,many:int>>"
    begin = F.struct(F.lit(1).alias("next"), F.array().cast(kept).alias("kept"))

    def add(s: Column, hit: Column) -> Column:
        gap = F.struct(s["next"].alias("at"), (hit["at"] - s["next"]).alias("many"))
        more = F.when(hit["at"] > s["next"], F.concat(s["kept"], F.array(gap))).otherwise(s["kept"])
        return F.struct(F.greatest(s["next"], hit["at"] + hit["len"]).alias("next"), more.alias("kept"))

    def close(s: Column) -> Column:
        rest = F.struct(s["next"].alias("at"), (F.size(words) + 1 - s["next"]).alias("many"))
        return F.concat(s["kept"], F.array(rest))

    return F.aggregate(hits, begin, add, close)


def cut_spans(docs: DataFrame, benchmark: DataFrame, span: int = SPAN) -> DataFrame:
    """All documents, without the hit words and what stands behind each of them."""
    hit = saved(find_hits(docs, benchmark, span).where(F.size("hits") > 0).select("doc_id", "text_hash", "hits"))
    few = (hit.agg(F.sum(F.size("hits"))).first()[0] or 0) <= MOST_BROADCAST
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("text_key") == F.col("text_hash"))
    text = F.coalesce(F.col("doc.text"), F.lit(""))
    words, gaps = F.array_remove(F.split(text, BETWEEN), ""), F.split(text, WORD, -1)
    joined = whole(docs).join(F.broadcast(hit) if few else hit, same, "left").withColumns({"words": words, "gaps": gaps})
    pairs = F.zip_with("words", F.slice("gaps", 2, F.greatest(F.size("gaps") - 1, F.lit(0))), lambda w, g: F.concat(w, g))
    paired = joined.withColumn("pairs", pairs)
    left = F.flatten(F.transform(spared(F.col("hits"), F.col("words")), lambda s: stretch(F.col("pairs"), s["at"], s["many"])))
    cleaned = F.concat(F.element_at("gaps", 1), F.array_join(left, ""))
    return paired.select(
        *[
            F.when(F.col("hits").isNull(), F.col("doc.text")).otherwise(cleaned).alias(c) if c == "text" else F.col(f"doc.`{c}`")
            for c in docs.columns
        ]
    )
