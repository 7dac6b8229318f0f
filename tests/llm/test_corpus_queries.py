"""The registered queries and the pipeline, beside SQL and plain versions."""
import os

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from compare import TABLES, rows_of
from reqlens.llm import decontaminate, mixing, quality, tokenbinary
from reqlens.llm.common import stored
from reqlens.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF) or not os.path.exists("/opt/tokenizers"), reason="no test tables")


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_every_operator_has_one_query():
    names = [n for n in contract.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names if n in QUERIES) == list(range(1, 14))
    assert set(ORACLE) <= set(contract.oracle_sql()) and "pipeline" in contract.queries()
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality rules", "near-dedup", "decontamination", "source mix", "token output"]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    cur = db.execute(ORACLE[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cur.fetchall())


def test_line_query_deletes_only_what_was_there_before(spark):
    texts = {r["doc_id"]: r["text"] for r in documents(spark).collect()}
    got = {r["doc_id"]: r for r in QUERIES["op1_winnowed_lines"](spark, SF).collect()}
    seen = set()
    for d in sorted(texts):
        lines = brute.lines(texts[d])
        spans = [tuple(map(int, s.split(":"))) for s in got[d]["deleted"].split(",") if s]
        inside = [ls for ls in lines if any(a <= ls[1] and ls[2] <= b for a, b in spans)]
        earlier = set(seen)
        for ls in lines:
            if ls in inside:
                assert ls[0] in earlier
            earlier.add(ls[0])
        seen |= {ls[0] for ls in lines}
        assert got[d]["n_lines"] == len(lines) and got[d]["deleted_lines"] == len(inside)


def test_pii_and_toxic_queries(spark):
    texts = {r["doc_id"]: r["text"] for r in documents(spark).collect()}
    found = QUERIES["op8_pii_chain"](spark, SF).collect()
    assert {r["doc_id"]: r["base_sha256"] for r in found} == {d: brute.sha(brute.pii_spans(t)) for d, t in texts.items()}
    scored = QUERIES["op7_toxic_chain"](spark, SF).collect()
    assert {r["doc_id"] for r in scored} == set(texts) and all(0 <= r["score"] <= 1 for r in scored)
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in scored)


def test_pipeline_equals_its_stages_by_brute_force(spark):
    docs = documents(spark)
    verdict = {r["doc_id"]: r["kept"] for r in quality.quality(docs).collect()}
    first = stored(corpus_pipeline.quality_rules(spark, docs, SF), "t1")
    assert {r["doc_id"] for r in first.collect()} == {d for d, kept in verdict.items() if kept}
    for r in docs.collect():
        assert not (verdict[r["doc_id"]] and brute.quality(r["text"])[5])

    second = stored(corpus_pipeline.near_dedup(spark, first, SF), "t2")
    near = brute.near_duplicates([(r["doc_id"], r["text"]) for r in first.collect()], 80)
    assert sorted(r["doc_id"] for r in second.collect()) == sorted(d for d, x in near.items() if x[2])

    third = stored(corpus_pipeline.decontamination(spark, second, SF), "t3")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = [x[0] for x in brute.leaks([(r["doc_id"], r["text"]) for r in second.collect()], items) if not x[-1]]
    assert sorted(r["doc_id"] for r in third.collect()) == sorted(clean)

    fourth = stored(corpus_pipeline.source_mix(spark, third, SF), "t4")
    takes = mixing.mix_documents(third).groupBy("source").agg(F.sum("taken").alias("n"), F.first("target").alias("t"))
    got = {}
    texts = {r["doc_id"]: r["text"] for r in third.collect()}
    for r in fourth.collect():
        words = brute.WORD.findall(r["text"])
        assert words == brute.WORD.findall(texts[r["doc_id"]])[:len(words)]
        got[r["source"]] = got.get(r["source"], 0) + len(words)
    for r in takes.collect():
        assert got.get(r["source"], 0) == r["n"] and abs(r["n"] - r["t"]) <= 0.05 * r["t"] + 5
    for df in (first, second, third, fourth):
        assert df.columns == docs.columns

    rows = sorted(corpus_pipeline.token_output(spark, fourth, SF).collect(), key=lambda r: r["slot"])
    encode = tokenbinary.encoder(tokenbinary.TokenShards().ranks_file)
    total = sum(len(encode(r["text"])) + 1 for r in fourth.collect())
    assert [r["slot"] for r in rows] == list(range(-(-total // 512))) and {r["n_tokens"] for r in rows} == {512}
    assert sorted(r["slot"] for r in corpus_pipeline.run(spark, SF).collect()) == [r["slot"] for r in rows]
    assert decontaminate.decontaminate(fourth, spark.read.parquet(f"{SF}/benchmark.parquet")).filter(
        "contaminated").count() == 0
    assert np.array([r["offset"] for r in rows]).tolist() == [
        r["slot"] % 32_768 * tokenbinary.TokenShards().stride for r in rows]
