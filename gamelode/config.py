"""Knobs of the engine, with their defaults; times in milliseconds unless named otherwise."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

DAY_MS = 86_400_000


@dataclass(frozen=True)
class Config:
    reporting_offset_min: int = 0
    skew_dead_band_ms: int = 60_000
    fallback_after_ms: int = 26 * 3_600_000
    seal_grace_ms: int = 48 * 3_600_000
    dedup_window_ms: int = DAY_MS
    name_cap: int = 500
    currency_cap: int = 500
    dimension_cap: int = 50
    property_key_cap: int = 50
    session_cap_min: int = 720
    session_min_ms: int = 0
    retention_targets: tuple[int, ...] = (1, 7, 30)
    retention_slack_days: int = 15
    retention_low_size: int = 30
    level_buckets: tuple[int, ...] = (10, 20, 30, 40, 50)
    economy_low_count: int = 100
    fx_max_age_days: int = 7
    whale_spend: int = 100
    dolphin_spend: int = 10
    whale_low_size: int = 20
    staging_ms: int = 48 * 3_600_000
    rate_per_s: int = 200
    rate_burst: int = 5_000
    session_gap_ms: int = 30 * 60_000
    active_dims: tuple[str, ...] = ("in_game_state", "payer_tier", "region")
    pii_keys: tuple[str, ...] = ()

    @property
    def span_days(self) -> int:
        return max(self.retention_targets) + self.retention_slack_days


DEFAULT = Config()

#: Least and greatest value of each number that a game may set for itself.
BOUNDS = {
    "reporting_offset_min": (-720, 840), "skew_dead_band_ms": (0, DAY_MS), "fallback_after_ms": (3_600_000, 7 * DAY_MS), "seal_grace_ms": (0, 7 * DAY_MS), "dedup_window_ms": (3_600_000, 7 * DAY_MS), "name_cap": (1, 10_000),
    "currency_cap": (1, 10_000), "dimension_cap": (1, 1_000), "property_key_cap": (1, 1_000), "session_cap_min": (1, 1_440), "session_min_ms": (0, 3_600_000), "retention_slack_days": (0, 60), "retention_low_size": (0, 10_000),
    "economy_low_count": (0, 100_000), "fx_max_age_days": (0, 90), "whale_spend": (1, 1_000_000), "dolphin_spend": (1, 1_000_000), "whale_low_size": (0, 10_000), "staging_ms": (0, 7 * DAY_MS), "rate_per_s": (1, 100_000),
    "rate_burst": (1, 1_000_000), "session_gap_ms": (1_000, DAY_MS),
}


def for_game(overrides: dict, base: Config = DEFAULT) -> Config:
    """base with a game's own values. ValueError for an unknown knob, a value of another type, one out of bounds, or
    values that don't fit together; personal keys are only ever added."""
    known = {f.name: getattr(base, f.name) for f in fields(Config)}
    out = {}
    for name, value in overrides.items():
        if name not in known:
            raise ValueError(f"unknown knob {name}")
        if isinstance(known[name], tuple):
            value = tuple(value)
            if not all(isinstance(x, str if name in ("active_dims", "pii_keys") else int) for x in value) or not value and name != "pii_keys":
                raise ValueError(f"{name} must list {'names' if name in ('active_dims', 'pii_keys') else 'whole numbers'}")
            out[name] = (*base.pii_keys, *[k for k in value if k not in base.pii_keys]) if name == "pii_keys" else value
        elif isinstance(value, bool) or not isinstance(value, int) or not BOUNDS[name][0] <= value <= BOUNDS[name][1]:
            raise ValueError(f"{name} must be a whole number from {BOUNDS[name][0]} to {BOUNDS[name][1]}")
        else:
            out[name] = value
    made = replace(base, **out)
    if made.dolphin_spend >= made.whale_spend or list(made.level_buckets) != sorted(set(made.level_buckets)) or min(made.retention_targets) < 1:
        raise ValueError("spends and level buckets must rise, retention targets start at day 1")
    return made
