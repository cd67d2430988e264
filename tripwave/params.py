"""Detection, scoring and windowing parameters.

Every operator takes one of these dataclasses, so a caller can rescale
thresholds without touching operator code.
"""

from __future__ import annotations

from dataclasses import dataclass

# The three classes, in index order 0, 1, 2.
CLASSES = ("Non-Event", "Pothole", "Speed Bump")

# Standard gravity (m/s^2) and mean earth radius (m).
G_TO_MS2 = 9.80665
EARTH_RADIUS_M = 6_371_000.0


@dataclass(frozen=True)
class Resampling:
    # 100 Hz grid, 5 s recording gap, five-bin fills.
    bin_len: int = 10
    max_gap: int = 5_000
    linear_limit: int = 5
    fill_limit: int = 5
    max_null_ratio: float = 0.1
    min_rows: int = 50


@dataclass(frozen=True)
class Detection:
    # Trailing energy window, slow EMA, threshold multiplier,
    # minimum peak distance (rows at 100 Hz) and absolute gyro trigger (rad/s).
    window_rows: int = 20
    alpha: float = 0.01
    multiplier: float = 3.0
    min_dist_rows: int = 20
    gyro_trigger: float = 1.5
    min_dist_s: float = 0.2
    fallback_hz: float = 50.0


@dataclass(frozen=True)
class Clustering:
    # 0.8 s and 10 m between consecutive peaks.
    max_dt: int = 800
    max_dist_m: float = 10.0


@dataclass(frozen=True)
class Severity:
    # Vertical G and gyro rad/s bounds of the two upper levels.
    candidate_g: float = 1.4
    high_g: float = 1.8
    candidate_gyro: float = 4.0
    high_gyro: float = 6.0


@dataclass(frozen=True)
class Scoring:
    # Component weights, normalisation bounds, priority cuts.
    w_accel: float = 0.45
    w_gyro: float = 0.20
    w_jerk: float = 0.20
    w_duration: float = 0.15
    accel_min_g: float = 1.0
    accel_max_g: float = 1.8
    gyro_max: float = 6.0
    jerk_max: float = 400.0
    duration_max_s: float = 0.15
    high: float = 0.50
    medium: float = 0.30
    speed_low: float = 2.0
    speed_high: float = 8.0


@dataclass(frozen=True)
class EventWindow:
    # Fixed values (ms): half width, background context, narrow shape window.
    half: int = 1_000
    context_from: int = 5_000
    context_to: int = 1_000
    narrow: int = 150
    smooth_rows: int = 5
    ema_alpha: float = 0.05
    ema_multiplier: float = 3.0
    per_second: float = 1_000.0


@dataclass(frozen=True)
class Tensor:
    # 230 rows (2.3 s at 100 Hz), 200-row crop, 70 % coverage,
    # 0.5 s guard band around recording gaps, channel order.
    rows: int = 230
    crop: int = 200
    min_coverage: float = 0.7
    half: int = 1_150
    gap_guard: int = 500
    channels: tuple[str, ...] = ("speed", "ax", "ay", "az", "gx", "gy", "gz")


# Causal 1-20 Hz band-pass at 100 Hz, difference-equation coefficients.
BANDPASS_B = (0.19061660009749753, 0.0, -0.38123320019499507, 0.0, 0.19061660009749753)
BANDPASS_A = (1.0, -2.3350824020765124, 1.9509646897792021, -0.8192636853124013, 0.2066719851665643)
