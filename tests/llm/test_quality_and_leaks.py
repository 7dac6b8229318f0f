import random

import brute
import pytest
from pyspark.sql import functions as F

from reqlens.llm import decontaminate as dec
from reqlens.llm import quality as q


def test_counts_equal_brute_force(odd_docs, odd_rows):
    got = q.quality(odd_docs).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted([(str(r["doc_id"]), *(r[n] for n in names)) for r in got]) == sorted(
        [(str(r[0]), *brute.quality(r[1])) for r in odd_rows])
    assert not any(r["kept"] for r in got if r["base_failed"])


def test_repeated_words_of_overlapping_windows(spark):
    texts = ["a b c d e f g h " * 2, "a b c d e f g h i", "z " * 20, " ".join(map(str, range(40))),
             "p q r s t u v w x p q r s t u v w y"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(q.repeated_words(F.split(F.trim("t"), " "))).collect()]
    assert got == [brute.quality(t)[4] for t in texts]


def test_divergence_tells_junk_from_prose(spark):
    words = "the house of and river to in mountain is that for it was stone on with".split()
    good = [" ".join(words[(i * 7 + j * j) % len(words)] for j in range(200)) + "." for i in range(30)]
    junk = [" | ".join(f"Q{j * i}#" for j in range(150)) for i in range(1, 4)]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(good + junk)], "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in q.quality(df).filter("char_distance < 0.3").collect()}
    assert kept == set(range(30))


def test_each_language_has_its_own_reference(spark):
    """Clean texts in another script stay, junk that calls itself that language goes, and
    texts without a language have the base rule alone."""
    rng = random.Random(17)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(3, 9)))
    text = lambda letters: " ".join(word(letters) for _ in range(160)) + "."
    rows = [(i, text("абвгдежзиклмнопрстуфхцчшы"), "ru") for i in range(30)]
    rows += [(100 + i, text("etaoinshrdlucmfw"), "xx") for i in range(30)]
    rows += [(200 + i, " | ".join(f"Q{j * i}#%{j}" for j in range(150)), "ru") for i in (1, 2)]
    rows += [(300, text("абвгде"), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in q.quality(df).collect()}
    assert {i for i, r in got.items() if r["kept"]} == {*range(30), *range(100, 130), 300}
    assert got[300]["char_distance"] is None and not got[201]["base_failed"]


def test_distance_of_equal_and_disjoint_shares(spark):
    row = spark.range(1).select(
        q.js_distance(F.array(F.lit(0.5), F.lit(0.5)), F.array(F.lit(0.5), F.lit(0.5))).alias("same"),
        q.js_distance(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0))).alias("apart")).first()
    assert row["same"] == 0 and row["apart"] == pytest.approx(1)


def test_stage_keeps_columns_and_rows(odd_docs, no_docs):
    kept = q.keep_quality(odd_docs)
    assert kept.columns == odd_docs.columns
    verdict = q.quality(odd_docs).filter("kept").count()
    assert kept.count() == verdict
    assert {r["_key"] for r in kept.collect()} <= {r["_key"] for r in odd_docs.collect()}
    assert q.quality(no_docs).count() == 0 and q.keep_quality(no_docs).count() == 0


ITEMS = [(1, "ka lo mi ren tu sa be dor fin gal ka lo"), (2, "one two three"), (3, None), (4, "!!"), (None, "Café é"),
         (5, "Same TEXT here for all to see same text here for"), (5, "x y z x y z x y z x y z"), (10, "one two three")]


@pytest.mark.parametrize("limit", [10 ** 6, 0])
def test_hits_equal_brute_force(spark, odd_docs, odd_rows, limit, monkeypatch):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    original = dec.hits
    monkeypatch.setattr(dec, "hits", lambda d, b, w: original(d, b, w, broadcast_windows=limit))
    got = dec.decontaminate(odd_docs, items).withColumn("sha", F.sha2(F.array_join("items", ","), 256))
    got = [(str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["sha"], r["contaminated"]) for r in got.collect()]
    want = [(str(r[0]), *r[1:]) for r in brute.leaks([(r[0], r[1]) for r in odd_rows], ITEMS)]
    assert sorted(got) == sorted(want)
    assert any(w[-1] for w in want)


def test_contaminated_documents_go(spark, odd_docs, odd_rows, no_docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    left = dec.remove_contaminated(odd_docs, items)
    clean = [r[0] for r in brute.leaks([(r[0], r[1]) for r in odd_rows], ITEMS) if not r[-1]]
    assert sorted(str(r["doc_id"]) for r in left.collect()) == sorted(map(str, clean))
    assert left.columns == odd_docs.columns
    assert left.filter("key = 5").count() == odd_docs.filter("key = 5").count()
    none = spark.createDataFrame([], "item_id long, text string")
    assert dec.remove_contaminated(odd_docs, none).count() == odd_docs.count()
    assert dec.decontaminate(no_docs, items).count() == 0


def test_time_is_linear_in_the_length_of_a_text(spark):
    import time
    items = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(12))) for i in range(50)], "item_id long, text string")

    def seconds(n):
        words = [f"w{i // 12 % 60}x{i % 12}" if i % 240 < 12 else f"v{i}" for i in range(n)]
        docs = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
        began = time.time()
        r = dec.decontaminate(docs, items).first()
        assert r["n_words"] == n and r["n_hit"] == 12 * len({i // 240 for i in range(n) if i // 240 * 20 % 60 < 50})
        return time.time() - began
    seconds(2_000)
    few = min(seconds(40_000) for _ in range(2))
    assert min(seconds(160_000) for _ in range(2)) <= 4.6 * few
