import random

import brute
import pytest
from pyspark.sql import functions as F

from reqlens.llm import common, manifest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def results(df):
    rows = manifest.manifest(df).select("doc_id", "leaf", "subroot", "root", manifest.joined_digest(F.col("proof")).alias(
        "p"), "folded_root", "verified").collect()
    return sorted((tuple(r) for r in rows), key=repr)


def expected(rows):
    return sorted((tuple(r) for r in brute.manifest([r[:5] for r in rows])), key=repr)


def test_odd_rows_equal_whole_trees(odd_docs, odd_rows, no_docs):
    got = results(odd_docs)
    assert got == expected(odd_rows) and len(got) == len(odd_rows)
    assert {r[-1] for r in got} == {True, False}
    assert results(no_docs) == []


@pytest.mark.parametrize("sizes", [[1], [1, 1], [1, 2, 3, 4, 9, 10, 26, 27, 28, 81, 82, 730] + [2] * 20])
def test_trees_of_all_shapes(spark, sizes):
    rng = random.Random(sum(sizes))
    rows = [(10 * d + s, f"text {rng.random()}\nmore" if rng.random() < 0.8 else None, "en", None if s == 1 else f"s{s}", d)
            for s, n in enumerate(sizes) for d in range(n)]
    rng.shuffle(rows)
    assert results(spark.createDataFrame(rows, COLUMNS).repartition(5)) == expected(rows)


def test_copies_of_one_row_in_many_ranges(spark):
    rows = [(7, "same\ntext", "en", "a", 1)] * 200 + [(i, f"t{i}", "en", "a", i) for i in range(60)]
    assert results(spark.createDataFrame(rows, COLUMNS)) == expected(rows)


def test_numbers_are_dense_and_in_order(spark):
    rng = random.Random(3)
    rows = [(rng.choice("abc"), rng.randrange(50)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "g string, v int").repartition(7)
    got = common.numbered(df, "t-numbered", "g", ["v"]).collect()
    for g in "abc":
        mine = sorted((r["rank"], r["v"], r["n"]) for r in got if r["g"] == g)
        assert [m[0] for m in mine] == list(range(len(mine))) and {m[2] for m in mine} == {len(mine)}
        assert [m[1] for m in mine] == sorted(v for x, v in rows if x == g)
    assert sorted(r["rank"] for r in common.numbered(df, "t-input").collect()) == list(range(3000))
    assert common.numbered(df.limit(0), "t-none").columns == ["g", "v", "n", "rank"]
