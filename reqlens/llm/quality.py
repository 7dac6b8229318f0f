"""Quality rules: word, symbol and repetition counts, and divergence from a language.

A document's histogram of character classes, and that of its language's common words,
are compared with the mean histograms of all documents of the language by
Jensen-Shannon distance (base 2, so 0 to 1), whatever its script. Texts below the minimum lengths aren't
judged by distance: their histograms say little.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reqlens.llm.common import let, row_key, stored, text_of, without, words_of

# Frequent function words of each language.
COMMON_WORDS = {
    "en": "the of and to in is that for it was on with as be at by this from or an are a not have".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se avec".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o".split(),
}
VOCABULARY = sorted({w for words in COMMON_WORDS.values() for w in words})
# Character classes besides white space, characters beyond ASCII and
# symbols (all other ASCII characters but lower-case letters, which are the rest).
COUNTED = {"upper": "A-Z", "digit": "0-9", "mark": r".,;:!?'\"()\-"}
SYMBOL = r"[^a-zA-Z0-9.,;:!?'\"()\-\x20\x09-\x0D\x{80}-\x{10FFFF}]"
N_CLASSES = len(COUNTED) + 4
SCALE = 1_000_000


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 20             # base rule
    max_repeated_percent: int = 30  # base rule
    judged_chars: int = 300         # shorter texts aren't judged by their characters
    judged_words: int = 100         # nor those with fewer words by their common words
    max_char_distance: float = 0.3
    max_word_distance: float = 0.335


def repeated_words(words: Column, window: int = 8) -> Column:
    """Words inside windows found twice or more in the text. Windows are told apart
    by 64-bit hashes within one text."""
    def covered(places: Column) -> Column:
        start = F.struct(F.lit(-window).alias("last"), F.lit(0).alias("total"))
        return F.aggregate(places, start, lambda acc, p: F.struct(
            p.alias("last"),
            (acc["total"] + F.least(F.lit(window), p - acc["last"])).alias("total")),
            lambda acc: acc["total"])

    def twice(ranked: Column) -> Column:
        def is_twice(x, i):
            before = (i > 0) & (F.get(ranked, i - 1)["h"] == x["h"])
            after = F.get(ranked, i + 1)["h"] == x["h"]
            return F.when(F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False)), x["p"])
        return F.array_sort(F.array_compact(F.transform(ranked, is_twice)))

    def of(hashes: Column) -> Column:
        ranked = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
            covered(let(ranked, twice)))

    def windows(one: Column) -> Column:
        return F.when(F.size(one) >= window, F.transform(
            F.sequence(F.lit(1), F.size(one) - window + 1),
            lambda i: F.xxhash64(F.slice(one, i, F.lit(window))))).otherwise(
            F.array().cast("array<bigint>"))
    each = F.transform(words, lambda w: F.xxhash64(w))
    return let(let(each, windows), of).cast("long")


def duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda l: l.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda ls: F.size(ls) - F.size(F.array_distinct(ls))).cast("long")


def features(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, key, lang, n_chars, the counts of `quality`, and
    chars and common, the counts of each class and each common word. One pass over the
    texts, without a shuffle."""
    df = docs.select("doc_id", row_key().alias("key"), F.col("lang").cast("string").alias("lang"),
                     text_of().alias("_text"))
    df = df.withColumn("_words", words_of(F.col("_text")))
    listed = F.filter(F.transform("_words", F.lower), lambda w: w.isin(VOCABULARY))
    df = df.withColumns({
        "_listed": F.concat(F.lit(" "), F.array_join(listed, "  "), F.lit(" ")),
        "n_chars": F.length("_text").cast("long"),
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": F.size(F.regexp_extract_all("_text", F.lit(r"[#*$%&|<>]"), F.lit(0))).cast("long"),
        "n_dup_lines": duplicate_lines(F.col("_text")),
        "n_repeat_words": repeated_words(F.col("_words")),
        "_beyond": F.when(F.octet_length("_text") == F.char_length("_text"), F.lit(0)).otherwise(
            F.length(F.regexp_replace("_text", r"[\x00-\x7F]++", ""))).cast("long"),
        "_symbols": F.size(F.regexp_extract_all("_text", F.lit(SYMBOL), F.lit(0))).cast("long"),
        **{f"_{name}": F.length(F.regexp_replace("_text", f"[^{members}]++", "")).cast("long")
           for name, members in COUNTED.items()}})
    some = ["_beyond", "_symbols", *[f"_{name}" for name in COUNTED]]
    space = F.col("n_chars") - F.col("word_chars")
    rest = F.col("n_chars") - space
    for name in some:
        rest = rest - F.col(name)
    df = df.withColumn("chars", F.array(*[F.col(c) for c in some], space, rest))
    # The listed words stand between two spaces each, so a word's count is what its
    # removal takes away.
    counts = [((F.octet_length("_listed") - F.octet_length(F.replace("_listed", F.lit(f" {w} "), F.lit("")))
                ) / (len(w.encode()) + 2)).cast("long") for w in VOCABULARY]
    df = df.withColumn("_counts", F.array(*counts))
    other = F.col("n_words") - F.aggregate("_counts", F.lit(0).cast("long"), lambda a, x: a + x)
    return df.select("doc_id", "key", "lang", "n_chars", "n_words", "word_chars", "n_symbols",
                     "n_dup_lines", "n_repeat_words", "chars",
                     F.concat("_counts", F.array(other)).alias("common"))


def _shares(counts: str, total: str) -> Column:
    return F.transform(counts, lambda c: F.floor(c * SCALE / F.col(total)))


def references(found: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """(lang, ref_chars, ref_words): mean histograms of every language of the corpus, over
    all its documents long enough to be judged.

    Shares are summed as whole millionths: the result doesn't depend on the order of the
    rows. A language without a list of common words has all its words in the last place.
    """
    df = found.filter(F.col("lang").isNotNull() & (F.col("n_chars") >= rules.judged_chars)
                      & (F.col("n_words") >= rules.judged_words))
    df = df.select("lang", _shares("chars", "n_chars").alias("c"), _shares("common", "n_words").alias("w"))
    sizes = {"c": N_CLASSES, "w": len(VOCABULARY) + 1}
    sums = df.groupBy("lang").agg(*[F.sum(F.get(part, F.lit(i))).alias(f"{part}{i}")
                                    for part, n in sizes.items() for i in range(n)])

    def share(part: str) -> Column:
        values = [F.col(f"{part}{i}") for i in range(sizes[part])]
        total = F.aggregate(F.array(*values), F.lit(0).cast("long"), lambda a, x: a + x)
        return let(F.greatest(F.lit(1).cast("long"), total), lambda t: F.array(*[v / t for v in values]))
    return sums.select("lang", share("c").alias("ref_chars"), share("w").alias("ref_words"))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares, base 2."""
    def side(a: Column, m: Column) -> Column:
        return F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)

    terms = F.zip_with(p, q, lambda a, b: (side(a, (a + b) / 2) + side(b, (a + b) / 2)) / 2)
    total = F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)
    return F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)))


def _distance(counts: str, total: Column, ref: str) -> Column:
    return F.when((total > 0) & F.col(ref).isNotNull(), js_distance(
        F.transform(counts, lambda c: c / total), F.col(ref)))


def quality(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """One row per row of docs: doc_id, key, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, char_distance, word_distance, kept.

    A null text counts as an empty one and fails the base rule; a document without a
    language, or whose language has no document long enough, has the base rule alone;
    repeated rows each get the same verdict; an empty table gives an empty one.

    The references, a row per language, are a written table, so Spark joins them by
    their true size, and splits a frequent language if they are too many to broadcast.
    """
    found = stored(features(docs), "quality-features")
    refs = stored(references(found, rules), "quality-references")
    df = found.join(refs, "lang", "left").withColumns({
        "char_distance": F.when(F.col("n_chars") >= rules.judged_chars, _distance(
            "chars", F.col("n_chars"), "ref_chars")),
        "word_distance": F.when(F.col("n_words") >= rules.judged_words, _distance(
            "common", F.col("n_words"), "ref_words")),
        "base_failed": (F.col("n_words") < rules.min_words) | (
            F.col("n_repeat_words") * 100 > F.col("n_words") * rules.max_repeated_percent)})
    far = ((F.coalesce("char_distance", F.lit(0.0)) > rules.max_char_distance)
           | (F.coalesce("word_distance", F.lit(0.0)) > rules.max_word_distance))
    return df.withColumn("kept", ~F.col("base_failed") & ~far).drop(
        "lang", "n_chars", "chars", "common", "ref_chars", "ref_words")


def keep_quality(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """docs without the rejected documents. Columns stay as they are."""
    return without(docs, quality(docs, rules).filter(~F.col("kept")))
