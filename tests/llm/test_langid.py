import random
import zlib

import pyarrow as pa
import pytest

from reqlens.llm import bytewords as bw
from reqlens.llm import langid

# Parts of words of four invented languages; they share letters and some parts.
PARTS = {"aa": "the ing tion ou and er st".split(), "bb": "sch ein keit ung der en ge".split(),
         "cc": "ção lh ões mente qu os ar".split(), "дд": "ств ова ние ых ая ст ро".split()}
SCHEMA = "doc_id long, text string, lang string"


def words(rng, lang, n):
    return ["".join(rng.choices(PARTS[lang], k=rng.randint(1, 3))) for _ in range(n)]


def corpus(n=400):
    rng = random.Random(5)
    langs = sorted(PARTS)
    return [(i, "\n".join(" ".join(words(rng, langs[i % 4], 12)) for _ in range(rng.randint(1, 6))), langs[i % 4])
            for i in range(n)]


@pytest.fixture(scope="module")
def learned(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    return rows, docs, langid.train(langid.training_rows(docs))


def test_held_out_documents(learned):
    rows, docs, model = learned
    got = langid.identify(docs, model).withColumn("held", langid.held_out()).collect()
    lang = {i: y for i, _, y in rows}
    assert {r["doc_id"] for r in got if r["held"]} == {i for i in lang if zlib.crc32(str(i).encode()) % 3 == 1}
    held = [r for r in got if r["held"]]
    assert len(held) > 80 and all(0 <= r["score"] <= 1 for r in got)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) / len(held) >= 0.98


def test_words_of_switched_text(spark, learned):
    model = learned[2]
    rng = random.Random(6)
    right = total = 0
    for _ in range(60):
        a, b = rng.sample(sorted(PARTS), 2)
        parts = [words(rng, a, 9), words(rng, b, 9)]
        text = "Ü " + " ".join(parts[0] + parts[1])
        row = langid.identify(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first() if total == 0 else None
        column = pa.array([text])
        found, p = langid.label_words(next(bw.chunks(column)), model)
        got = [model.langs[y] for y in p.argmax(axis=1)][1:]
        right += sum(x == y for x, y in zip(got, [a] * 9 + [b] * 9))
        total += 18
        if row:
            spans = [s.rsplit(":", 2) for s in row["segments"].split(",")]
            assert row["n_words"] == 19 and int(spans[0][1]) == 0 and int(spans[-1][2]) == len(text)
            assert all(text[int(s) - 1] == " " for _, s, _ in spans[1:])
            assert all(x[0] != y[0] for x, y in zip(spans, spans[1:]))
    assert right / total >= 0.95


def test_learns_from_no_held_out_or_unlabelled_row(spark):
    rows = corpus(60) + [(100, "und und", None), (None, "keine", "bb"), (101, None, "aa")]
    copies = rows[:1] * 50
    docs = spark.createDataFrame(rows + copies, SCHEMA)
    want = sorted((t, y) for i, t, y in rows if i is not None and t is not None and y is not None
                  and zlib.crc32(str(i).encode()) % 3 != 1)
    assert sorted(langid.training_rows(docs)) == want
    few = langid.training_rows(docs, langid.LangId(rows=8))
    assert len(few) == 8 and set(few) <= set(want) and {y for _, y in few} == set(PARTS)
    small = langid.training_rows(docs, langid.LangId(bytes=20_000))
    assert all(len(t.encode()) <= 20_000 // 4 // 8 for t, _ in small)


def test_odd_rows(spark, learned, odd_docs, odd_rows, no_docs):
    model = learned[2]
    got = langid.identify(odd_docs, model).collect()
    assert len(got) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in got)
    texts = {r[0]: r[1] for r in odd_rows}
    for r in got:
        if r["doc_id"] is not None:
            letter = any(c.isalpha() for c in texts[r["doc_id"]] or "")
            assert (r["lang_pred"] in PARTS) == letter and (r["lang_pred"] == "und") == (not letter)
    signs = spark.createDataFrame([(1, "— … 123 “”"), (2, "…é"), (3, "—" * 5000 + " the")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in langid.identify(signs, model).collect()}
    assert got[1]["lang_pred"] == "und" and got[1]["score"] == 0 and got[1]["segments"] == ""
    assert got[2]["lang_pred"] in PARTS and got[3]["lang_pred"] in PARTS
    assert langid.identify(no_docs, model).count() == 0
    nothing = langid.train(langid.training_rows(no_docs))
    assert {r["lang_pred"] for r in langid.identify(odd_docs, nothing).collect()} == {"und"}
    wordless = langid.train([("1 2 3", "aa"), ("", "bb")])
    assert {r["lang_pred"] for r in langid.identify(signs, wordless).collect()} == {"und", "aa"}
