"""Column functions against plain-Python restatements of their definitions."""
import html
import math
import random
import re
import unicodedata
from collections import Counter
from urllib.parse import unquote_plus

import pytest
from pyspark.sql import functions as F

from reqlens.functions import scalars, text

ALPHABET = list("abcXYZ019 /?&=.%+;<>'\"\t\n\r\x00\x07") + ["é", "Ａ", "&lt;", "%2e", "%252f", "%", "\U0001f4a9", "\u00a0", "٣"]


def samples(n=300, seed=5):
    rng = random.Random(seed)
    fixed = ["", "100%", "%zz", "a+b", "&amp;lt;", "%25253C", "  x  y ", "\x1f\x1c", "plain text"]
    return fixed + ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(40))) for _ in range(n)]


def normal(s):
    for _ in range(4):
        nxt = unquote_plus(s)
        if nxt == s:
            break
        s = nxt
    s = unicodedata.normalize("NFKC", html.unescape(s))
    s = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", s)
    return re.sub(r"\s+", " ", s)


def delta(s):
    return max(0.0, min(1.0, (len(s) - len(normal(s))) / len(s))) if s else 0.0


def entropy(s):
    return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values()) if s else 0.0


def share(pattern, s):
    return len(re.findall(pattern, s)) / len(s) if s else 0.0


def test_text_functions(spark):
    rows = samples()
    df = spark.createDataFrame(list(enumerate(rows)), "i int, s string")
    got = df.select(
        "i", text.normalize("s").alias("n"), text.canonical("s").alias("c"),
        text.decode_delta("s").alias("d"), text.shannon_entropy("s").alias("e"),
        text.special_ratio("s").alias("sp"), text.digit_ratio("s").alias("dg"),
        text.upper_ratio("s").alias("up"), text.nonascii_ratio("s").alias("na"),
        text.url_decode_loop("s").alias("u")).collect()
    for r in got:
        s = rows[r.i]
        assert r.n == normal(s), s
        assert r.c == normal(s).lower(), s
        assert r.d == pytest.approx(delta(s)), s
        assert r.e == pytest.approx(entropy(s), abs=1e-9), s
        assert r.sp == pytest.approx(share(r"[^A-Za-z0-9 _\-./]", s)), s
        assert r.dg == pytest.approx(share(r"\d", s)), s
        assert r.up == pytest.approx(share(r"[A-Z]", s)), s
        assert r.na == pytest.approx(sum(ord(c) > 127 for c in s) / len(s) if s else 0), s


def test_payload_equals_single_functions(spark):
    rows = samples(100, 9)
    df = spark.createDataFrame([(i, s, rows[-i], rows[i // 2]) for i, s in enumerate(rows)],
                               "i int, path string, query string, body string")
    got = text.with_payload(df).withColumns({
        "pd": text.decode_delta("path"), "qd": text.decode_delta("query"),
        "cb": text.canonical("body")}).collect()
    for r in got:
        target = r.path + ("?" + r.query if r.query else "")
        assert r.canon_path == normal(target).lower()
        assert (r.canon_body, r.path_decode_delta, r.q_decode_delta) == (r.cb, r.pd, r.qd)


@pytest.mark.parametrize("path,want", [
    ("/a/17", "/a/{id}"), ("/a/17?x=/9", "/a/{id}"), ("//a///b/", "/a/b"), ("", "/"), ("?q=1", "/"),
    ("/o/01234567-89ab-CDEF-0123-456789abcdef", "/o/{uuid}"), ("/f/0123456789ABCDEF", "/f/{hash}"),
    ("/n/1234567890123456", "/n/{id}"), ("/v2/x.y", "/v2/x.y"), ("/d/٣٤", "/d/{id}")])
def test_path_template(spark, path, want):
    assert spark.range(1).select(text.path_template(F.lit(path))).first()[0] == want


def test_params_and_segments(spark):
    r = spark.range(1).select(
        text.param_values(F.lit("a=1&b=x=y&c&&=zz")), text.max_param_value(F.lit("a=1&b=x=y&c")),
        text.path_depth(F.lit("/a" * 30), 20), text.path_numeric_ratio(F.lit("/1/a/22/b")),
        text.max_param_value(F.lit(""))).first()
    assert list(r) == [["1", "x=y", "", "zz"], 3, 20, 0.5, 0]


def test_scalars(spark):
    df = spark.createDataFrame([(1050.0, 1000.0, 100.0), (90000.0, 1000.0, 100.0), (5.0, 5.0, 0.0)],
                               "v double, m double, s double")
    assert [r[0] for r in df.select(scalars.safe_z("v", "m", "s")).collect()] == [0.5, 10.0, 0.0]
    labels = spark.createDataFrame([("attack:a:b",), ("attack",), ("normal:x",), ("",), (None,), ("z",)],
                                   "label string")
    got = [tuple(r) for r in labels.select(*scalars.parse_label("label")).collect()]
    assert got == [(1, "a:b"), (1, "unknown"), (0, None), (None, None), (None, None), (None, None)]


def test_client_chain(spark):
    rows = [("p", None), ("p", " , "), ("p", "a"), ("p", "a, b ,, c")]
    df = spark.createDataFrame(rows, "peer string, xff string")
    got = [tuple(r) for r in df.select(*[scalars.client_id("peer", "xff", h) for h in (0, 1, 2, 9)]).collect()]
    assert got == [("p",) * 4, ("p",) * 4, ("p", "a", "a", "a"), ("p", "c", "b", "a")]


def test_sql_names(spark):
    from reqlens.functions.register import register
    register(spark)
    r = spark.sql("SELECT payload_canonical('A%2BB  c'), payload_normalize('&lt;X'), "
                  "payload_decode('%2541'), text_entropy('abab')").first()
    assert list(r) == ["a b c", "<X", "A", 1.0]


def test_chains_are_shortened_at_once(monkeypatch):
    """As many rounds in one step as a round by round decoding would take, with its results."""
    import random
    from urllib.parse import unquote_plus

    def by_rounds(value):
        rounds = 0
        while (decoded := unquote_plus(value)) != value:
            rounds += 1
            value = decoded if rounds < text.PLAIN_ROUNDS else text._CHAIN.sub("%", decoded)
        return value

    rng = random.Random(7)
    parts = ["a", "+", "%", "%2", "%25", "3C", "25", "%C3", "A9", "%252B", "%2525", "%25252525252525252525", "\u00e9", "2525"]
    values = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(30_000)]
    values += ["%" + "25" * k + "C3%" + "25" * j + "A9+" for k in range(14) for j in range(14)]
    assert [text._decode(v) for v in values] == [by_rounds(v) for v in values]

    calls = []
    monkeypatch.setattr(text, "unquote_plus", lambda v: calls.append(v) or unquote_plus(v))
    assert text._decode("a+%25252525253Cb%25252525253E") == "a <b>" and len(calls) == 2
