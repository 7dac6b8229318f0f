"""All tunables in one immutable object; the defaults are the policy values."""
from __future__ import annotations

from dataclasses import dataclass, replace

MODES = ("enforce", "enforce-l1", "monitor")


@dataclass(frozen=True)
class Settings:
    # enforcement
    mode: str = "enforce-l1"
    trust_label: bool = False
    trusted_hops: int = 0
    fail_closed: bool = True
    fallback_threshold: float = 0.5

    # request size limits
    max_body_bytes: int = 1_048_576
    # Optional limits on what rules and body features see; by default the whole body.
    inspect_bytes: int | None = None
    feature_body_chars: int | None = None
    path_depth_limit: int | None = None

    # request rate policy
    window_seconds: int = 60
    window_limit: int = 240
    burst_seconds: int = 5
    burst_limit: int = 40
    session_gap_seconds: int = 120

    # calibration
    calibration_min_samples: int = 2_000
    target_fpr: float = 0.01
    max_contamination: float = 0.02
    baseline_min_count: int = 5

    # training
    seed: int = 42
    novel_families: tuple[str, ...] = ("cmdi", "exfil", "ssti")
    min_pool_rows: int = 50
    forest_trees: int = 300
    forest_samples: int = 4_096
    ae_shards: int = 8
    ae_sync_epochs: int = 5  # passes over a shard between two averages
    ae_hidden: int = 32
    ae_bottleneck: int = 12
    ae_lr: float = 1e-3
    ae_epochs: int = 300
    ae_batch: int = 256
    ae_patience: int = 15
    ae_noise: float = 0.0

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}, got {self.mode!r}")

    def but(self, **changes) -> "Settings":
        """A copy with some values replaced."""
        return replace(self, **changes)


DEFAULTS = Settings()
