"""Explicit schemas as DDL. Logs are never read with an inferred schema."""
# The feature contract. Names and order belong to a fitted model.
FEATURE_NAMES = [
    "body_log_size", "body_entropy", "body_special_ratio", "body_digit_ratio",
    "body_upper_ratio", "body_nonascii_ratio", "body_size_z", "has_body", "ct_json",
    "path_len", "path_depth", "path_max_seg", "path_entropy",
    "path_special_ratio", "path_digit_ratio", "path_numeric_seg_ratio",
    "path_nonascii_ratio", "path_decode_delta", "path_dot_count", "path_known",
    "q_param_count", "q_max_val_len", "q_total_len", "q_special_ratio", "q_decode_delta",
    "win_distinct_paths",
    "m_get", "m_post", "m_put", "m_delete", "m_patch", "m_other", "is_write",
    "n_flags",
]

BASE_SCORES = ["rate", "isolation_forest", "autoencoder"]

REQUEST = ("""
    event_id BIGINT, client STRING, ts TIMESTAMP,
    method STRING, path STRING, query STRING, body STRING, body_size BIGINT,
    template STRING, content_type STRING, user_agent STRING, header_count INT,
    has_referer BOOLEAN, has_auth BOOLEAN, status INT, latency_ms DOUBLE, label STRING
""")

EVENT_LOG = ("""
    ts DOUBLE, client STRING, method STRING, template STRING, path_len INT,
    body_size BIGINT, status INT, window_count INT, burst_count INT,
    latency_ms DOUBLE, detect_ms DOUBLE, action STRING, enforced BOOLEAN,
    layer STRING, reason STRING, probability DOUBLE, scores MAP<STRING, DOUBLE>,
    rule_hits ARRAY<STRING>, categories ARRAY<STRING>, degraded BOOLEAN,
    features MAP<STRING, DOUBLE>, label STRING
""")

ENDPOINT_BASELINE = (
    "template STRING, body_mean DOUBLE, body_std DOUBLE, count BIGINT")
RATE_BASELINE = ("mean DOUBLE, std DOUBLE, n_samples BIGINT")

DECISION = ("""
    version INT, trained_at STRING, seed INT, feature_names ARRAY<STRING>,
    threshold DOUBLE, if_lo DOUBLE, if_hi DOUBLE, ae_lo DOUBLE, ae_hi DOUBLE,
    meta_inputs ARRAY<STRING>, pool_sizes MAP<STRING, BIGINT>,
    novel_families ARRAY<STRING>, test_metrics MAP<STRING, DOUBLE>,
    test_roc_auc DOUBLE, test_pr_auc DOUBLE, zero_day_recall DOUBLE,
    unique_feature_ratio DOUBLE, calibrated_at STRING, calibration_samples BIGINT,
    calibration_target_fpr DOUBLE, calibration_observed_fpr DOUBLE,
    model_version STRING
""")

SCALER = ("feature STRING, mean DOUBLE, scale DOUBLE")
FOREST_NODES = (
    "tree INT, node INT, feature INT, threshold DOUBLE, left INT, right INT, size INT")
FOREST_META = ("trees INT, sample_size INT")
AE_WEIGHTS = ("layer INT, row INT, col INT, value DOUBLE")
META_WEIGHTS = ("name STRING, value DOUBLE")

SEED_RUNS = ("""
    seed INT, f1 DOUBLE, recall DOUBLE, precision DOUBLE, fpr DOUBLE,
    roc_auc DOUBLE, pr_auc DOUBLE, zero_day_recall DOUBLE
""")
