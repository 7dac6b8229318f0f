"""Canonical payload form and text-shape measurements as columns.

Everything that Spark can express stays in the JVM. Lenient percent-decoding,
HTML entities and NFKC have no built-in counterpart, so one Arrow UDF does those,
and only for strings that can change under them.
"""
from __future__ import annotations

import html
import re
import unicodedata
from urllib.parse import unquote_plus

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Rounds after which a chain of encoded percent signs is collapsed at once.
PLAIN_ROUNDS = 8
# Stripped from canonical text. Tab, newline and carriage return stay and are
# then folded into single spaces.
CONTROL = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]"
_CONTROL = re.compile(CONTROL)
_SPACE = re.compile(r"\s+")
_CHAIN = re.compile(r"%(?:25)+")

# The character classes of the ratio features and the id shapes
# that collapse a concrete path to its template. (?d) keeps "\n" the only line
# terminator, (?U) gives Unicode digits.
SPECIAL = r"[^A-Za-z0-9 _\-./]"
DIGIT = r"(?U)\d"
UPPER = r"[A-Z]"
NON_ASCII = r"[^\x00-\x7F]"
NUMERIC_SEGMENT = r"(?dU)^\d+$"
UUID_SEGMENT = r"(?di)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
HEX_SEGMENT = r"(?di)^[0-9a-f]{16,}$"


# ── canonical form ───────────────────────────────────────────────────────────

def _links(text: str) -> int:
    """The rounds in which decoding does no more than take a link off every chain."""
    marks = text.count("%")
    if not marks or text.count("%25") < marks:
        return 0
    return min(map(len, _CHAIN.findall(text))) // 2


def _decode(text: str) -> str:
    """Decodes until nothing changes. Every change uses up a "%" or "+", so it
    ends; a chain "%252525..." loses one link a round, so long ones are cut short.
    Rounds that only shorten chains are taken at once."""
    rounds = 0
    while True:
        if links := _links(text):
            rounds += links
            text = text.replace("+", " ")
            text = text.replace("%" + "25" * links, "%") if rounds < PLAIN_ROUNDS else _CHAIN.sub("%", text)
        if (decoded := unquote_plus(text)) == text:
            return text
        rounds += 1
        text = decoded if rounds < PLAIN_ROUNDS else _CHAIN.sub("%", decoded)


def _normal(text: str) -> str:
    if not text:
        return ""
    text = unicodedata.normalize("NFKC", html.unescape(_decode(text)))
    return _SPACE.sub(" ", _CONTROL.sub("", text))


def _per_value(fn):
    def batch(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else fn(v) for v in values], dtype=object)
    return batch


def url_decode_udf():
    def decode(values: pd.Series) -> pd.Series:
        return _per_value(_decode)(values)
    return F.pandas_udf(decode, "string")


def normalize_udf():
    def norm(values: pd.Series) -> pd.Series:
        return _per_value(_normal)(values)
    return F.pandas_udf(norm, "string")


def canonical_udf():
    def canon(values: pd.Series) -> pd.Series:
        return _per_value(lambda v: _normal(v).lower())(values)
    return F.pandas_udf(canon, "string")


def _text(col) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def needs_decoding(col) -> Column:
    """True where canonicalising can do more than fold case and white space."""
    # Printable ASCII and white space but %, & and +: one run is read much faster than a search.
    return ~_text(col).rlike(r"\A[\x20-\x24\x27-\x2A\x2C-\x7E\t\n\r]*\z")


def single_spaces(text: Column) -> Column:
    """Runs of white space as one space each; texts without any are only looked through."""
    runs = F.contains(text, F.lit("  "))
    for mark in "\t\n\r":
        runs = runs | F.contains(text, F.lit(mark))
    return F.when(runs, F.regexp_replace(text, "[ \\t\\n\\r]+", " ")).otherwise(text)


def _with_fast_path(udf, col, native) -> Column:
    """Plain text never reaches Python: the UDF only sees NULL for it."""
    hard = needs_decoding(col)
    return F.when(hard, udf(F.when(hard, _text(col)))).otherwise(native)


def url_decode_loop(col) -> Column:
    hard = _text(col).rlike("[%+]")
    return F.when(hard, url_decode_udf()(F.when(hard, _text(col)))).otherwise(_text(col))


def normalize(col) -> Column:
    return _with_fast_path(normalize_udf(), col, single_spaces(_text(col)))


def canonical(col) -> Column:
    return _with_fast_path(canonical_udf(), col, F.lower(single_spaces(_text(col))))


def shrink_ratio(raw, normal: Column) -> Column:
    """How much shorter `normal` is than `raw`, as a share of `raw` in [0, 1]."""
    raw = _text(raw)
    share = (F.length(raw) - F.length(normal)) / F.length(raw)
    return F.when(F.length(raw) == 0, 0.0).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))


def decode_delta(col) -> Column:
    return shrink_ratio(col, normalize(col))


def payload_udf():
    """canon_target, canon_body, path_normal_len, query_normal_len in one crossing."""
    def payload(target: pd.Series, body: pd.Series, path: pd.Series,
                query: pd.Series) -> pd.DataFrame:
        def each(fn, values):
            return [None if v is None else fn(v) for v in values]
        return pd.DataFrame({
            "canon_path": each(lambda v: _normal(v).lower(), target),
            "canon_body": each(lambda v: _normal(v).lower(), body),
            "path_normal": each(_normal, path),
            "query_normal": each(_normal, query),
        })
    return F.pandas_udf(
        payload, "canon_path string, canon_body string, path_normal string, query_normal string")


def with_payload(df, path="path", query="query", body="body"):
    """Adds canon_path, canon_body, path_decode_delta and q_decode_delta."""
    p, q, b = _text(path), _text(query), _text(body)
    target = F.when(q != "", F.concat(p, F.lit("?"), q)).otherwise(p)
    hard_t, hard_b = needs_decoding(target), needs_decoding(b)
    hard_p, hard_q = needs_decoding(p), needs_decoding(q)

    df = df.withColumn("_pl", payload_udf()(
        F.when(hard_t, target), F.when(hard_b, b), F.when(hard_p, p), F.when(hard_q, q)))
    return df.withColumns({
        "canon_path": F.when(hard_t, F.col("_pl.canon_path")).otherwise(F.lower(single_spaces(target))),
        "canon_body": F.when(hard_b, F.col("_pl.canon_body")).otherwise(F.lower(single_spaces(b))),
        "path_decode_delta": shrink_ratio(
            p, F.when(hard_p, F.col("_pl.path_normal")).otherwise(single_spaces(p))),
        "q_decode_delta": shrink_ratio(
            q, F.when(hard_q, F.col("_pl.query_normal")).otherwise(single_spaces(q))),
    }).drop("_pl")


# ── shapes ───────────────────────────────────────────────────────────────────

def segments(path) -> Column:
    return F.filter(F.split(_text(path), "/"), lambda s: s != "")


def path_template(path) -> Column:
    """/api/users/1837?x=1 -> /api/users/{id}. Numeric wins over hash-like."""
    clean = F.substring_index(_text(path), "?", 1)
    parts = F.transform(segments(clean), lambda s: (
        F.when(s.rlike(NUMERIC_SEGMENT), F.lit("{id}"))
        .when(s.rlike(UUID_SEGMENT), F.lit("{uuid}"))
        .when(s.rlike(HEX_SEGMENT), F.lit("{hash}"))
        .otherwise(s)))
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def path_depth(path, limit: int | None = None) -> Column:
    depth = F.size(segments(path))
    return depth if limit is None else F.least(depth, F.lit(limit))


def path_max_segment(path) -> Column:
    return F.coalesce(F.array_max(F.transform(segments(path), F.length)), F.lit(0))


def path_numeric_ratio(path) -> Column:
    segs = segments(path)
    numeric = F.size(F.filter(segs, lambda s: s.rlike(NUMERIC_SEGMENT)))
    return F.when(F.size(segs) > 0, numeric / F.size(segs)).otherwise(0.0)


def params(query) -> Column:
    return F.filter(F.split(_text(query), "&"), lambda p: p != "")


def param_values(query) -> Column:
    """Text after the first '=' of each parameter, '' where there is none."""
    return F.transform(params(query), lambda p: F.when(
        F.contains(p, F.lit("=")), F.substr(p, F.instr(p, F.lit("=")) + 1)).otherwise(""))


def max_param_value(query) -> Column:
    return F.coalesce(F.array_max(F.transform(param_values(query), F.length)), F.lit(0))


def class_ratio(text, pattern: str) -> Column:
    text = _text(text)
    return F.when(F.length(text) == 0, 0.0).otherwise(
        F.regexp_count(text, F.lit(pattern)) / F.length(text))


def special_ratio(text) -> Column:
    return class_ratio(text, SPECIAL)


def digit_ratio(text) -> Column:
    return class_ratio(text, DIGIT)


def upper_ratio(text) -> Column:
    return class_ratio(text, UPPER)


def nonascii_ratio(text) -> Column:
    return class_ratio(text, NON_ASCII)


def _bits(s: str) -> float:
    points = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    counts = np.bincount(points)
    share = counts[counts > 0] / len(points)
    return float(-(share * np.log2(share)).sum())


def entropy_udf():
    """Over Arrow values as they are: one text at a time becomes a string."""
    def bits(values: pa.Array) -> pa.Array:
        texts = (v.as_py() for v in values)
        return pa.array([None if not t else _bits(t) for t in texts], pa.float64())
    bits.__annotations__ = {"values": pa.Array, "return": pa.Array}
    return F.arrow_udf(bits, "double")


def shannon_entropy(text) -> Column:
    """Bits per character, counted in Arrow batches in time linear in the length."""
    text = _text(text)
    return F.when(F.length(text) == 0, 0.0).otherwise(
        entropy_udf()(F.when(F.length(text) > 0, text)))
