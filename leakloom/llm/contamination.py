"""Benchmark decontamination: short test items found inside long documents, in DataFrame operations only.

An item's set are its distinct shingles of five words (A-Z and other letters in lower case). A document contains an item if at
least `share` of the item's set is in the document's set. The search is by MinHash sketches cut
to size: the sketch of an item whose set has size q holds the
q - ceil(share * q) + 1 smallest of its shingle hashes. A document that contains the item misses
at most q - ceil(share * q) of its shingles, so it has one of the sketch: no contained item is
lost, whatever the document's length. Pairs found are then verified on the shingles themselves.

Documents are partitioned by size, by the power of two below their number of shingles (up to the largest that any item
needs). Each partition has an index of its own, with the sketches of those items that a document of its size can contain,
under hashes of its own; a document's shingles are hashed for its partition and probe that one only.

The sketches are a few values for each item and partition; below a checked size they are broadcast, so that
documents stream past them without a shuffle. Above it, both sides are shuffled by hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small, word_list

SHINGLE = 5
#: Sketch rows and candidate pairs beyond these numbers are joined by a shuffle.
BROADCAST_SKETCH = 500_000
BROADCAST_PAIRS = 500_000


def _words(text: str) -> Column:
    return word_list(F.lower(F.coalesce(F.col(text), F.lit(""))))


def _starts(n: Column) -> Column:
    """Where the shingles of n words begin; a shorter text is one shingle."""
    return F.sequence(F.lit(0), F.greatest(n - SHINGLE, F.lit(0)))


def _hash(words: Column, at: Column, *more: Column) -> Column:
    """Hash of the shingle that begins at a word; words behind the last are null, which the hash passes over."""
    return F.xxhash64(*[F.get(words, at + k) for k in range(SHINGLE)], *more)


def _shingles(words: Column, n: Column) -> Column:
    """The shingles themselves, in order."""
    each = F.transform(_starts(n), lambda i: F.array_join(F.slice(words, i + 1, SHINGLE), " "))
    return F.when(n > 0, each).otherwise(F.array().cast("array<string>"))


def _part(n: Column) -> Column:
    """The partition of sets of this size: the power of two that is not above it."""
    return F.floor(F.log2(n.cast("double"))).cast("int")


def item_sets(items: DataFrame, share: float, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, q (set size), need (shingles to be found), part (of need: no smaller document contains it), shingles, and
    sketch: the words of the shingles with the smallest hashes.

    Items without words are left out: nothing contains them.
    """
    held = items.select(F.col(id_col).alias("item_id"), _words(text_col).alias("_w")).where(F.size("_w") > 0)
    parts = F.array_distinct(F.transform(_starts(F.size("_w")), lambda i: F.slice("_w", i + 1, SHINGLE)))
    sets = held.withColumn("_s", parts).withColumn("q", F.size("_s")).withColumn("need", F.ceil(F.col("q") * F.lit(share) - F.lit(1e-9)).cast("int"))
    ranked = F.array_sort(F.transform("_s", lambda s: F.struct(_hash(s, F.lit(0)).alias("h"), s.alias("words"))))
    sketch = F.transform(F.slice(ranked, F.lit(1), F.col("q") - F.col("need") + 1), lambda x: x["words"])
    return sets.select("item_id", "q", "need", _part(F.col("need")).alias("part"), F.transform("_s", lambda s: F.array_join(s, " ")).alias("shingles"), sketch.alias("sketch"))


def contained_items(docs: DataFrame, items: DataFrame, share: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Every pair of a document and an item that it contains: doc_id, text_hash, item_id, hits, q, containment.

    text_hash tells rows with the same id but other texts apart; equal rows give one pair. Null and empty
    texts contain nothing, a null id is an id like any other. Texts of fewer than five words are one shingle.
    Extra columns play no part. Without documents or items there are no pairs.
    """
    sets = cut(item_sets(items, share, item_id_col, item_text_col))
    bounds = sets.agg(F.min("need").alias("least"), F.max("part").alias("top")).first()
    least, top = bounds["least"] or 1, bounds["top"] or 0
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    sketch = sets.select("item_id", "need", F.explode(F.sequence(F.col("part"), F.lit(top))).alias("part"), "sketch").select("item_id", "need", "part", F.explode("sketch").alias("_s"))
    sketch = sketch.select("item_id", "need", _hash(F.col("_s"), F.lit(0), F.col("part")).alias("h"))
    # so many shingles take as many words, and a word and its separator two bytes
    probe = read.where(F.octet_length("text") >= 2 * least - 1).select("doc_id", "text_hash", _words("text").alias("_w"))
    probe = probe.select("doc_id", "text_hash", "_w", F.greatest(F.size("_w") - (SHINGLE - 1), F.lit(1)).alias("most"))
    probe = probe.select("doc_id", "text_hash", "_w", "most", F.least(_part(F.col("most")), F.lit(top)).alias("part"), F.explode_outer(_starts(F.size("_w"))).alias("_i"))
    probe = probe.select("doc_id", "text_hash", "most", _hash(F.col("_w"), F.col("_i"), F.col("part")).alias("h"))
    found = probe.join(small(sketch, BROADCAST_SKETCH), "h").where(F.col("most") >= F.col("need")).select("doc_id", "text_hash", "item_id").distinct()
    by_text = found.groupBy("doc_id", "text_hash").agg(F.collect_set("item_id").alias("_items"))
    own = read.where(F.col("text").isNotNull()).withColumnRenamed("doc_id", "_id").withColumnRenamed("text_hash", "_hash")
    held = own.join(small(cut(by_text), BROADCAST_PAIRS), F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_hash") == F.col("text_hash")))
    held = held.select("doc_id", "text_hash", "_items", _words("text").alias("_w")).withColumn("_have", _shingles(F.col("_w"), F.size("_w")))
    pairs = held.select("doc_id", "text_hash", "_have", F.explode("_items").alias("item_id"))
    texts = sets.select("item_id", "q", "need", "shingles")
    judged = pairs.join(F.broadcast(texts) if _few(sets) else texts, "item_id").withColumn("hits", F.size(F.array_intersect("_have", "shingles")))
    return judged.where(F.col("hits") >= F.col("need")).select("doc_id", "text_hash", "item_id", "hits", "q", (F.col("hits") / F.col("q")).alias("containment")).distinct()


def _few(sets: DataFrame) -> bool:
    """Whether the items' shingles may be broadcast: at most 20,000 items and a million shingles."""
    n = sets.agg(F.count("*").alias("n"), F.coalesce(F.sum("q"), F.lit(0)).alias("q")).first()
    return n["n"] <= 20_000 and n["q"] <= 1_000_000


def decontaminate(docs: DataFrame, items: DataFrame, share: float = 0.8) -> DataFrame:
    """docs without the rows whose text contains an item; columns and rows that stay are as they were.

    Rows are judged by their texts: null and empty ones stay, repeated rows stay or go together, a null id is an id like
    any other. Without items all rows stay.
    """
    bad = cut(contained_items(docs, items, share).select(F.col("doc_id").alias("__leakloom_id"), F.col("text_hash").alias("__leakloom_hash")).distinct())
    same = F.col("doc_id").eqNullSafe(F.col("__leakloom_id")) & (F.xxhash64("text") == F.col("__leakloom_hash"))
    return docs.join(small(bad, BROADCAST_PAIRS), same, "left_anti")
