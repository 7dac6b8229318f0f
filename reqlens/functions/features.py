"""The behavioural feature vector: one expression per feature.

Batch scoring, training replays and the streaming scorer all call
`with_features`, so there is a single definition.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reqlens.config import DEFAULTS, Settings
from reqlens.functions import scalars, text
from reqlens.schemas import FEATURE_NAMES

METHODS = ("GET", "POST", "PUT", "DELETE", "PATCH")


def _flag(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)


def feature_columns(settings: Settings = DEFAULTS) -> dict[str, Column]:
    """Feature name -> expression over a request joined with its baseline.

    Expects the request columns plus path_decode_delta, q_decode_delta,
    body_mean, body_std and path_known. Shapes are measured on raw strings.
    """
    head = F.coalesce(F.col("body"), F.lit(""))
    if settings.feature_body_chars is not None:
        head = F.substring(head, 1, settings.feature_body_chars)
    path = F.coalesce(F.nullif(F.col("path"), F.lit("")), F.lit("/"))
    query = F.coalesce(F.col("query"), F.lit(""))
    size = F.col("body_size").cast("double")
    method = F.upper(F.coalesce(F.nullif(F.col("method"), F.lit("")), F.lit("GET")))
    out = {
        "body_log_size": F.log1p(F.greatest(F.lit(0.0), size)),
        "body_entropy": text.shannon_entropy(head),
        "body_special_ratio": text.special_ratio(head),
        "body_digit_ratio": text.digit_ratio(head),
        "body_upper_ratio": text.upper_ratio(head),
        "body_nonascii_ratio": text.nonascii_ratio(head),
        "body_size_z": F.coalesce(
            scalars.safe_z(size, F.col("body_mean"), F.col("body_std")), F.lit(0.0)),
        "has_body": _flag(size > 0),
        "ct_json": _flag(F.contains(F.lower(F.coalesce(F.col("content_type"), F.lit(""))),
                                    F.lit("json"))),
        "path_len": F.length(path),
        "path_depth": text.path_depth(path, settings.path_depth_limit),
        "path_max_seg": text.path_max_segment(path),
        "path_entropy": text.shannon_entropy(path),
        "path_special_ratio": text.special_ratio(path),
        "path_digit_ratio": text.digit_ratio(path),
        "path_numeric_seg_ratio": text.path_numeric_ratio(path),
        "path_nonascii_ratio": text.nonascii_ratio(path),
        "path_decode_delta": F.col("path_decode_delta"),
        "path_dot_count": F.length(path) - F.length(F.replace(path, F.lit("."), F.lit(""))),
        "path_known": F.col("path_known"),
        "q_param_count": F.size(text.params(query)),
        "q_max_val_len": text.max_param_value(query),
        "q_total_len": F.length(query),
        "q_special_ratio": text.special_ratio(query),
        "q_decode_delta": F.col("q_decode_delta"),
        "win_distinct_paths": F.log1p(F.coalesce(F.col("window_distinct"), F.lit(0))),
        "m_other": _flag(~method.isin(*METHODS)),
        "is_write": _flag(method.isin("POST", "PUT", "DELETE", "PATCH")),
        "n_flags": F.coalesce(F.col("n_flags"), F.lit(0)),
    }
    for name in METHODS:
        out[f"m_{name.lower()}"] = _flag(method == name)
    return {name: out[name].cast("double") for name in FEATURE_NAMES}


# Features that need history: the baseline, or the client's session.
LATE = ("body_size_z", "path_known", "win_distinct_paths")
EARLY = tuple(n for n in FEATURE_NAMES if n not in LATE)


def early_columns(settings: Settings = DEFAULTS) -> dict[str, Column]:
    """The features of the request alone, from its text and its `hits`."""
    every = feature_columns(settings)
    out = {name: every[name] for name in EARLY}
    out["n_flags"] = F.size("hits").cast("double")
    return out


def late_columns() -> dict[str, Column]:
    every = feature_columns()
    return {name: every[name] for name in LATE}


def with_features(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Adds the feature columns in contract order."""
    return df.withColumns(feature_columns(settings))


def assemble(columns=FEATURE_NAMES) -> Column:
    """The vector as array<double>, missing values 0, in contract order."""
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])


def from_map(df: DataFrame, column: str = "features") -> DataFrame:
    """Unpacks a logged feature map into contract-order columns."""
    return df.withColumns({
        name: F.coalesce(F.try_element_at(F.col(column), F.lit(name)), F.lit(0.0))
        for name in FEATURE_NAMES})
