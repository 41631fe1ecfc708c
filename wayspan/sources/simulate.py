"""Simulated foraging trips around a hub: seeded correlated random walks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayspan.session import ship

METRES_PER_DEGREE = 111320
#: Share of a trip's points, turning concentration, step share of the top speed, and its sd, by phase.
PHASES = (("explore", 0.25, 0.9, 0.6, 0.1), ("forage", 0.5, 0.3, 0.2, 0.1), ("return", 0.25, 0.95, 0.7, 0.05))


def walk(n: int, lon: float, lat: float, dt: float, max_speed: float, noise: float, least_return: int, equal_space: bool, rng: np.random.Generator) -> pd.DataFrame:
    """One trip: outwards, about, and home."""
    top = max_speed * dt / METRES_PER_DEGREE
    counts = [max(1, round(n * share)) for _, share, *_ in PHASES]
    counts[2] = max(counts[2], least_return)
    xs, ys, names = [lon], [lat], ["explore"]
    heading = rng.uniform(-np.pi, np.pi)
    for (name, _, rho, share, sd), m in zip(PHASES, counts):
        for i in range(m):
            if name == "return":
                home = np.arctan2(lat - ys[-1], lon - xs[-1])
                away = np.hypot(lat - ys[-1], lon - xs[-1])
                step = away / (m - i)
                heading = home + rng.normal(0, noise) * (m - i > 1)
            else:
                heading += rng.normal(0, np.sqrt(-2 * np.log(rho)) + noise)
                step = top * float(np.clip(rng.normal(share, sd), 0, 1))
            xs.append(xs[-1] + step * np.cos(heading))
            ys.append(ys[-1] + step * np.sin(heading))
            names.append(name)
    xs[-1], ys[-1] = lon, lat
    x, y = np.array(xs), np.array(ys)
    if equal_space:
        at = np.r_[0, np.cumsum(np.hypot(np.diff(x), np.diff(y)))]
        grid = np.linspace(0, at[-1], len(x))
        names = [names[int(np.searchsorted(at, g, "right") - 1)] for g in grid]
        x, y = np.interp(grid, at, x), np.interp(grid, at, y)
    return pd.DataFrame({"longitude": x, "latitude": y, "phase": names})


def sim_data(spark: SparkSession, animals: int = 3, n_trips: int = 5, points: int = 50, hub: tuple[float, float] = (0.0, 40.0), dt: float = 300, max_speed: float = 50, noise: float = 0.1, min_return_steps: int = 10, equal_space: bool = False, tol: float = 0.05, start: str = "2024-01-01", seed: int = 1) -> DataFrame:
    """Trips of several animals, each from its own seed: TagID, trip, DateTime, position, phase, dist_m, dt_s,
    speed_m_s, pdop, nsats, speed_basic."""
    jobs = spark.range(animals).select(F.concat(F.lit("animal_"), (F.col("id") + 1).cast("string")).alias("TagID"), F.explode(F.sequence(F.lit(1), F.lit(n_trips))).alias("trip"))
    begin = pd.Timestamp(start)

    def run(b: pd.DataFrame) -> pd.DataFrame:
        tag, trip = b["TagID"].iloc[0], int(b["trip"].iloc[0])
        rng = np.random.default_rng([seed, trip, int(tag.split("_")[1])])
        vary = lambda v: v * (1 + rng.uniform(-tol, tol))
        t = walk(points, *hub, vary(dt), vary(max_speed), vary(noise), min_return_steps, equal_space, rng)
        n = len(t)
        step = np.r_[np.nan, np.hypot(np.diff(t["longitude"]) * np.cos(np.radians(t["latitude"][1:])), np.diff(t["latitude"])) * METRES_PER_DEGREE]
        gaps = np.r_[np.nan, rng.uniform(dt * (1 - tol), dt * (1 + tol), n - 1)]
        at = begin + pd.to_timedelta((trip - 1) * (points * 2 + min_return_steps) * dt + np.cumsum(np.nan_to_num(gaps)), unit="s")
        return t.assign(
            TagID=tag, trip=trip, DateTime=at.astype("datetime64[us]"), dist_m=step, dt_s=gaps, speed_m_s=step / gaps, pdop=1 + 9 * rng.beta(2, 5, n), nsats=np.round(np.clip(rng.normal(8, 2, n), 3, 14)), speed_basic=(step / gaps > max_speed).astype(int)
        )[["TagID", "trip", "DateTime", "longitude", "latitude", "phase", "dist_m", "dt_s", "speed_m_s", "pdop", "nsats", "speed_basic"]]

    ship(spark)
    schema = "TagID string, trip int, DateTime timestamp, longitude double, latitude double, phase string, dist_m double, dt_s double, speed_m_s double, pdop double, nsats double, speed_basic int"
    return jobs.groupBy("TagID", "trip").applyInPandas(run, schema)
