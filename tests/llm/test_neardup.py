import random

import brute
import numpy as np
import pytest
from conftest import prose

from reqlens.llm import neardup as nd
from reqlens.llm.components import components


def as_dict(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


def test_odd_rows(odd_docs, odd_rows, no_docs):
    got = nd.near_duplicates(odd_docs).collect()
    assert len(got) == len(odd_rows)
    want = brute.near_duplicates([(r[0], r[1]) for r in odd_rows if r[0] is not None])
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == want[r["doc_id"]]
    assert nd.near_duplicates(no_docs).count() == 0 and nd.deduplicate(no_docs).count() == 0


def test_stage_keeps_one_of_each(odd_docs, odd_rows):
    want = brute.near_duplicates([(r[0], r[1]) for r in odd_rows if r[0] is not None])
    out = nd.deduplicate(odd_docs)
    assert out.columns == odd_docs.columns
    assert sorted(str(r["doc_id"]) for r in out.collect()) == sorted(
        ["None"] + [str(d) for d, (_, _, kept) in want.items() if kept])


def edited(rng, words, share):
    return [w if rng.random() > share else prose(rng, 1).strip(".\n") for w in words]


@pytest.mark.parametrize("share", [0.002, 0.008, 0.015, 0.03])
def test_groups_of_edited_copies(spark, share):
    """Links near the threshold, chains of edits, and groups whose members differ more
    from each other than from their source."""
    rng = random.Random(int(share * 1e4))
    docs = []
    for _ in range(6):
        base = prose(rng, rng.randint(40, 400)).split(" ")
        docs += [" ".join(edited(rng, base, share)) for _ in range(25)]
        chain = base
        for _ in range(10):
            chain = edited(rng, chain, share)
            docs.append(" ".join(chain))
    docs += [prose(rng, 200) for _ in range(40)]
    shared = prose(rng, 80)
    docs += [prose(rng, 60) + " " + shared + " " + prose(rng, 60) for _ in range(40)]
    rng.shuffle(docs)
    rows = list(enumerate(docs))
    got = as_dict(nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)))
    assert got == brute.near_duplicates(rows)


def test_stars_lose_no_link_between_members(spark):
    """The centre links neither a nor b, but a and b are linked."""
    rng = random.Random(3)
    base = prose(rng, 120).split(" ")
    a = base[:]
    for i in (5, 30, 55, 80):
        a[i] = "changed"
    b = a[:]
    b[100] = "again"
    rows = list(enumerate([" ".join(base), " ".join(a), " ".join(b)] + [
        " ".join(base[:60] + edited(rng, base[60:], 0.01)) for _ in range(8)]))
    got = as_dict(nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == brute.near_duplicates(rows)


def test_one_of_each_component_stays_whatever_its_id(spark):
    """Unrelated texts without an id, and two under one id, all stay; a near copy goes."""
    rng = random.Random(29)
    texts = [prose(rng, 90) for _ in range(8)]
    near = texts[0] + " again"
    rows = [(None, t) for t in texts[:5]] + [(None, near)]
    rows += [(7, texts[5]), (7, texts[6]), (7, texts[6] + " again"), (8, texts[7]), (None, texts[7]), (7, ""), (None, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = [(r["doc_id"], r["text"]) for r in nd.deduplicate(df).collect()]
    first = [r for r in out if r[1] in (texts[0], near)]
    second = [r for r in out if r[1] in (texts[6], texts[6] + " again")]
    assert len(first) == 1 and len(second) == 1
    rest = [r for r in out if r not in first + second]
    assert sorted(map(str, rest)) == sorted(map(str, [(None, t) for t in texts[1:5]] + [
        (7, texts[5]), (8, texts[7]), (7, ""), (None, " ")]))


def kept_at(docs, percent):
    """Ids of docs (of distinct ids) that are the least of their component, by all pairs."""
    sets = {d: brute.shingles(t) for d, t in docs}
    comp = {d: d for d in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((comp[a], comp[b]))
                comp = {d: x if c == y else c for d, c in comp.items()}
    return [d for d in sorted(sets) if comp[d] == d]


def test_stage_at_80_percent(spark):
    """Pairs with similarities on both sides of 0.8 and of 0.85."""
    rng = random.Random(17)
    docs = []
    for changes in range(9):  # of 196 shingles, about 5 of each word are changed
        for _ in range(3):
            base = prose(rng, 200).split(" ")
            copy = base[:]
            for i in range(changes):
                copy[10 + 20 * i] = "changed"
            docs += [" ".join(base), " ".join(copy)]
    rows = list(enumerate(docs))
    want = kept_at(rows, 80)
    assert len(want) < len(kept_at(rows, 85))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r["doc_id"] for r in nd.deduplicate(df, nd.NearDup(percent=80)).collect()) == want


def test_matches_follow_the_threshold():
    assert nd.matches(85) == 36 and nd.matches(80) < 36 and nd.matches(100) == nd.COORDINATES
    with pytest.raises(ValueError, match="coordinates"):
        nd.matches(10)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = np.unique(pool[:2000]), np.unique(pool[500:2500])  # Jaccard 0.6
    agree = [(nd.signature(a + np.uint64(k)) == nd.signature(b + np.uint64(k))).mean() for k in range(30)]
    assert abs(np.mean(agree) - 0.6) < 0.06
    sig = nd.signature(a)
    packed = nd.nibbles(sig).view(np.uint64)
    assert [int(packed[i // 16] >> np.uint64(4 * (i % 16))) & 15 for i in range(64)] == [int(x) & 15 for x in sig]


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(60)] + [(200, 200 + i) for i in range(1, 50)] + [(300, 300)]
    links += [(rng.randint(400, 460), rng.randint(400, 460)) for _ in range(50)]
    parent = {n: n for e in links for n in e if e[0] != e[1]}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: root(n) for n in parent}
