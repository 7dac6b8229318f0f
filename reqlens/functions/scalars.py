"""Numeric, hashing and identity expressions."""
from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from reqlens.config import DEFAULTS, Settings


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def clip(col, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), _c(col).cast("double")))


def safe_z(value, mean, std) -> Column:
    """Z-score within +/-10; 0 where there is no usable spread."""
    std = _c(std)
    return F.when(std > 1e-9, clip((_c(value) - _c(mean)) / std, -10, 10)).otherwise(0.0)


def norm_score(value, low, high) -> Column:
    low = F.lit(low) if isinstance(low, (int, float)) else _c(low)
    high = F.lit(high) if isinstance(high, (int, float)) else _c(high)
    return clip((_c(value) - low) / (high - low + 1e-9), 0, 1)


def rate_score(window, burst, settings: Settings = DEFAULTS) -> Column:
    """Observed rate over allowed rate, the worse of the two windows, in [0, 1]."""
    return clip(F.greatest(
        F.coalesce(_c(window), F.lit(0)) / max(1, settings.window_limit),
        F.coalesce(_c(burst), F.lit(0)) / max(1, settings.burst_limit)), 0, 1)


def hash_client(client) -> Column:
    return F.substring(F.sha2(_c(client), 256), 1, 16)


def request_id(ts_us, client, path) -> Column:
    return F.substring(
        F.sha2(F.concat(_c(ts_us).cast("string"), _c(client), _c(path)), 256), 1, 16)


def client_id(peer, forwarded, hops: int) -> Column:
    """The address the outermost trusted proxy appended, else the socket peer."""
    peer = F.coalesce(_c(peer), F.lit("unknown"))
    if hops <= 0:
        return peer
    chain = F.filter(
        F.transform(F.split(F.coalesce(_c(forwarded), F.lit("")), ","),
                    lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")),
        lambda p: p != "")
    at = F.greatest(F.size(chain) - hops + 1, F.lit(1))
    return F.coalesce(F.try_element_at(chain, at), peer)


def pool_hash(client, seed: int) -> Column:
    digest = F.sha2(F.concat(_c(client), F.lit(f"|{seed}")), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % 100


def pool_of(client, seed: int) -> Column:
    """Session-grouped split: 45 base, 25 meta, 15 val, 15 test."""
    h = pool_hash(client, seed)
    return (F.when(h < 45, "base").when(h < 70, "meta").when(h < 85, "val").otherwise("test"))


def vector_signature(columns: Iterable) -> Column:
    """Digest of a vector rounded to 4 places: equal digests are duplicates."""
    return F.md5(F.to_json(F.array(*[F.bround(_c(c).cast("double"), 4) for c in columns])))


def feature_map(names: Iterable[str], digits: int = 5) -> Column:
    pairs = []
    for name in names:
        pairs += [F.lit(name), F.bround(F.col(name).cast("double"), digits)]
    return F.create_map(*pairs)


def to_time(ts) -> Column:
    return F.timestamp_millis(F.round(_c(ts) * 1000).cast("bigint"))


def epoch_seconds(ts) -> Column:
    """Timestamp -> epoch seconds with millisecond precision, as logged."""
    return F.bround(F.unix_micros(_c(ts)) / 1e6, 3)


def parse_label(label) -> tuple[Column, Column]:
    """('attack:sqli') -> (1, 'sqli'); ('normal...') -> (0, NULL); else NULLs."""
    label = _c(label)
    y = F.when(label.startswith("attack"), 1).when(label.startswith("normal"), 0)
    at = F.instr(label, F.lit(":"))
    family = F.when(label.startswith("attack"),
                    F.when(at > 0, F.substr(label, at + 1)).otherwise("unknown"))
    return y.cast("int"), family
