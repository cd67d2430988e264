"""A synthetic 100 Hz trip with jitter, holes, impulses and a duplicate timestamp."""

import numpy as np
import pandas as pd

T0 = 1_780_000_000_000


def trip(seconds=40, trip_id="aa-1", t0=T0, holes=(), potholes=(), bumps=(), seed=3):
    """Rows of one trip; ``holes`` are (start_s, length_s), events are at the given seconds."""
    i = np.arange(seconds * 100)
    ts = t0 + 10 * i + (i * 7) % 5 - 2
    t = 10 * i / 1000.0
    rng = np.random.default_rng(seed)
    tilt = np.radians(2)
    up = np.array([0.0, np.cos(tilt), np.sin(tilt)])
    v = 0.3 * np.sin(2 * np.pi * 5 * t) + rng.normal(0, 0.02, len(i))
    for s in potholes:
        v += np.where((t >= s) & (t < s + 0.04), -15.0, 0) + np.where((t >= s + 0.04) & (t < s + 0.08), 8.0, 0)
    for s in bumps:
        inside = (t >= s) & (t < s + 0.4)
        v += np.where(inside, 3.0 * (1 - np.cos(2 * np.pi * (t - s) / 0.4)), 0)
    lin = np.outer(v, up) + 0.05 * rng.normal(size=(len(i), 3))
    grav = np.tile(9.80665 * up, (len(i), 1))
    df = pd.DataFrame({
        "trip_id": trip_id, "ts_ms": ts.astype("int64"),
        **{f"lin_a{a}": lin[:, k] for k, a in enumerate("xyz")}, **{f"grav_{a}": grav[:, k] for k, a in enumerate("xyz")},
        **{f"a{a}": (lin + grav)[:, k] for k, a in enumerate("xyz")},
        **{f"g{a}": 0.05 * np.sin(2 * np.pi * (k + 1) * t) for k, a in enumerate("xyz")},
        "lat": -7.0 + 1e-6 * i, "lon": 110.0 + 1e-6 * i, "speed": 6.0 + np.sin(t / 5)})
    for start, length in holes:
        df = df[~((df.ts_ms >= t0 + start * 1000) & (df.ts_ms < t0 + (start + length) * 1000))]
    return df.reset_index(drop=True)


NUMERIC = ["ax", "ay", "az", "gx", "gy", "gz", "lin_ax", "lin_ay", "lin_az", "grav_x", "grav_y", "grav_z", "lat", "lon", "speed"]
