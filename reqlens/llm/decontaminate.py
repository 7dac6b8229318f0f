"""Benchmark decontamination: a hash set of normalised test n-grams, looked up for
every window of every text, hits verified word by word."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reqlens.llm.common import let, row_key, stored, text_of, without

# After A-Z became a-z: runs of digits, a-z and all characters beyond ASCII.
ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def item_words(text: Column) -> Column:
    # lower() would also change letters beyond ASCII, but is the same, and faster, without them.
    lowered = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER))
    return F.regexp_extract_all(lowered, F.lit(ITEM_WORD), F.lit(0))


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _windows(hashes: Column, length: int) -> Column:
    """A hash of each window of so many words, from the words' hashes."""
    n = F.size(hashes)
    return F.when(n >= length, F.transform(F.sequence(F.lit(1), n - length + 1), lambda i: F.xxhash64(
        F.slice(hashes, i, F.lit(length))))).otherwise(F.array().cast("array<bigint>"))


def test_windows(benchmark: DataFrame, window: int = 10) -> DataFrame:
    """One row per distinct window and item that holds it: len, hash, words, item. An item
    shorter than a window, but not empty, is one window. Items without an id still count as
    test text, but have no id to list."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"),
                             item_words(text_of()).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - window + 1))
    rows = items.select("item", F.explode(F.transform(
        starts, lambda i: F.slice("w", i, F.lit(window)))).alias("words")).distinct()
    return rows.select(F.size("words").alias("len"), F.xxhash64(word_hashes(F.col("words"))).alias("hash"), "words", "item")


def _covered(spans: Column) -> Column:
    """Words inside any of the (pos, len) spans."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))

    def add(acc, s):
        end = F.greatest(acc["end"], s["pos"] + s["len"])
        return F.struct(end.alias("end"), (acc["total"] + F.greatest(
            F.lit(0), s["pos"] + s["len"] - F.greatest(acc["end"], s["pos"]))).alias("total"))
    return F.aggregate(F.array_sort(spans), start, add, lambda acc: acc["total"]).cast("long")


def candidates(docs: DataFrame, tests: DataFrame, broadcast_windows: int) -> DataFrame:
    """Per distinct (doc_id, text): doc_id, key, copies (repeated rows), n_words, and at:
    position and length of the windows whose hash is a test window's.

    Windows are rows of a hash and a number; the text and its words stay where they are.
    """
    hashes = tests.select("len", "hash").distinct()
    shape = hashes.groupBy("len").count().collect()  # a row for each length up to the window's
    lengths = sorted(r["len"] for r in shape)
    d = docs.select("doc_id", row_key().alias("key"), item_words(text_of()).alias("_words"))
    d = d.withColumn("n_words", F.size("_words").cast("long"))
    # The first place stands for the document itself; then the windows of each length.
    places = let(word_hashes(F.col("_words")), lambda h: F.concat(
        F.array(F.col("key")), *[_windows(h, n) for n in lengths]))
    # No list of places is empty. A plain explode would first filter on that, and so make
    # every list twice.
    rows = d.select("doc_id", "key", "n_words", F.posexplode_outer(places).alias("at", "_hash"))
    found = hashes.select(F.col("hash").alias("_test")).distinct()
    if sum(r["count"] for r in shape) <= broadcast_windows:
        found = F.broadcast(found)  # a hash each, so their number bounds the bytes: 16 with the table's own
    itself = F.col("at") == 0
    rows = rows.join(found, F.col("_hash") == F.col("_test"), "left").filter(itself | F.col("_test").isNotNull())
    length, pos, base = F.lit(None).cast("int"), F.lit(None).cast("long"), F.lit(1).cast("long")
    for n in lengths:
        end = base + F.greatest(F.lit(0).cast("long"), F.col("n_words") - n + 1)
        here = length.isNull() & (F.col("at") >= base) & (F.col("at") < end)
        pos, length = F.when(here, F.col("at") - base).otherwise(pos), F.when(here, n).otherwise(length)
        base = end
    return rows.groupBy("doc_id", "key", "n_words").agg(
        F.sum(itself.cast("long")).alias("copies"),
        F.collect_set(F.when(~itself, F.struct(pos.cast("int").alias("pos"), length.alias("len")))).alias("at"))


def hits(docs: DataFrame, benchmark: DataFrame, window: int = 10,
         broadcast_windows: int = 2_000_000) -> DataFrame:
    """Per distinct (doc_id, text): doc_id, key, copies (repeated rows), n_words,
    spans (word position and length of each hit window), items (ids, as strings).

    Each text is scanned for hashes of test windows, of which up to broadcast_windows (of 16
    bytes) are sent to every executor; beyond that windows are joined by hash. Only the texts with such
    hashes are read again, and compared word by word. A null text has no words; an empty
    benchmark hits nothing; an empty table gives no rows. Columns other than doc_id and text
    are not read.
    """
    tests = stored(test_windows(benchmark, window), "leak-tests")
    found = stored(candidates(docs, tests, broadcast_windows), "leak-candidates")
    some = found.filter(F.size("at") > 0).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "at")
    texts = docs.select("doc_id", row_key().alias("key"), F.col("text").alias("text"))
    texts = texts.join(some, texts["doc_id"].eqNullSafe(some["_id"]) & (texts["key"] == some["_key"]))
    # A hit's own words leave the text before hits become rows, so no row holds a whole text.
    cut = let(item_words(text_of()), lambda w: F.transform("at", lambda p: F.struct(
        p["pos"].alias("pos"), p["len"].alias("len"), F.slice(w, p["pos"] + 1, p["len"]).alias("words"))))
    windows = texts.select("doc_id", "key", F.explode(cut).alias("c")).select("doc_id", "key", "c.*")
    true = windows.join(tests.select("words", "item"), "words").groupBy("doc_id", "key").agg(
        F.collect_set(F.struct("pos", "len")).alias("spans"), F.array_sort(F.collect_set("item")).alias("items"))
    true = true.withColumnsRenamed({"doc_id": "_id", "key": "_key"})
    out = found.join(true, found["doc_id"].eqNullSafe(true["_id"]) & (found["key"] == true["_key"]), "left")
    return out.select("doc_id", "key", "copies", "n_words",
                      F.coalesce("spans", F.array().cast("array<struct<pos:int,len:int>>")).alias("spans"),
                      F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """One row per row of docs, repeated ones included: doc_id, n_words, n_hit, n_items,
    items, contaminated. See hits() for nulls, empty tables and further columns."""
    found = hits(docs, benchmark, window)
    rows = found.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return rows.select(
        "doc_id", "n_words", _covered(F.col("spans")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"), "items",
        (F.size("spans") > 0).alias("contaminated"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """docs without the documents that hold a test window. Columns stay as they are."""
    return without(docs, hits(docs, benchmark, window).filter(F.size("spans") > 0))
