import math

import numpy as np
import pytest

from reqlens.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, x string"


def whole(rows):
    """Usable (vec_id, x), by a loop."""
    out = []
    for vec_id, v in rows:
        if v and all(c is not None and math.isfinite(c) for c in v):
            out.append((vec_id, tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v)))
    return out


def check(df, rows, opts, k, tol=1e-7):
    got = whitening.whiten(df, opts).collect()
    every = whole(rows)
    fit = np.array(sorted({x for _, x in every}), dtype=object)
    n, sums = len(fit), [sum(col) for col in fit.T]
    centred = fit.astype(float) - np.array([s / n for s in sums])
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    assert len(got) == len(every) * k
    assert {r["component"] for r in got} == set(range(1, k + 1)) and {r["n"] for r in got} == {n}
    assert max(r["identity_error"] for r in got) < 1e-6
    flip = {}
    want = {}
    for vec_id, x in every:
        d = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        w = (np.array(x, float) - np.array(sums, float) / n) @ v[:, :k] / np.sqrt(e[:k])
        want.setdefault(vec_id, []).append((d, w))
    for r in got:
        c = r["component"] - 1
        assert r["deviation"] in [d for d, _ in want[r["vec_id"]]]
        assert r["explained"] == pytest.approx(e[c] / e.sum(), rel=1e-9)
        near = [w[c] for d, w in want[r["vec_id"]] if abs(abs(w[c]) - abs(r["whitened"])) < tol]
        assert near
        if abs(near[0]) > 1e-3:
            sign = int(np.sign(near[0] * r["whitened"]))
            assert len(near) > 1 or flip.setdefault(c, sign) == sign


def test_equals_dense_eigenvectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(700, 6)) @ np.diag([2, 1.6, 1.2, 0.9, 0.6, 0.4]) + rng.normal(size=6)
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[3][1]) for i in range(300)]                      # a third are copies
    rows += [(rows[5][0], rows[5][1]), (None, rows[6][1])]                    # a repeated row, a null id
    rows += [(2000, None), (2001, [1.0, None] + [0.0] * 4), (2002, [float("nan")] * 6), (2003, [float("inf")] * 6),
             (2004, []), (2005, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], SCHEMA).repartition(5)
    rows = [r for r in rows if r[0] != 2005]
    check(df, rows, whitening.Whitening(components=4, block_rows=64, blocks_per_split=2), 4)
    check(df, rows, whitening.Whitening(components=16, block_rows=50, block_columns=4, blocks_per_split=3), 6)


def test_no_rows_one_vector_and_flat_dimensions(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None, 1, 1, "")], SCHEMA)).collect() == []
    one = whitening.whiten(spark.createDataFrame([(i, [0.5, 1.5], 1, 1, "") for i in range(9)], SCHEMA)).collect()
    assert len(one) == 18 and all(r["whitened"] is None and r["explained"] is None and r["deviation"] == 0
                                  and r["n"] == 1 and r["identity_error"] == 0 for r in one)
    flat = whitening.whiten(spark.createDataFrame([(i, [i / 4, 2.0, i % 3.0], 1, 1, "") for i in range(50)], SCHEMA)).collect()
    assert all((r["whitened"] is None) == (r["component"] == 3) for r in flat) and len(flat) == 150
    assert all(r["identity_error"] < 1e-9 for r in flat)


def test_large_entries_stay_exact(spark):
    # n x - S beyond a long in its square: null; just below: exact.
    rows = [(i, [1e9 * i, 0.0], 1, 1, "") for i in range(3)] + [(9, [1e30, 0.0], 1, 1, "")]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["vec_id"] for r in got} == {0, 1, 2}
    x = [math.floor(64 * float(np.float32(1e9 * i))) + 10 ** 6 for i in range(3)]
    for r in got:
        d = (3 * x[r["vec_id"]] - sum(x)) ** 2
        assert r["deviation"] == (d if d < 1 << 63 else None)


def test_query_over_the_given_table(spark):
    from reqlens.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]

    got = QUERIES["op12_block_matrix"](spark, sf).collect()
    assert len(got) == len(whole(rows)) * 16
    check(spark.read.parquet(f"{sf}/embeddings.parquet"), rows, whitening.Whitening(), 16)
