"""Small planted panels."""

from datetime import date, timedelta

import numpy as np
import pandas as pd


def panel(n_units=12, n_weeks=20, n_treated=4, effect=-0.12, seed=0, drop=0.0, noise=0.05,
          start=date(2024, 10, 28), shock=date(2025, 1, 5)):
    """Weekly panel with unit and week effects and a constant treated effect."""
    rng = np.random.default_rng(seed)
    unit, week = rng.normal(4, 1, n_units), rng.normal(0, 0.3, n_weeks)
    rows = []
    for i in range(n_units):
        for t in range(n_weeks):
            day = start + timedelta(weeks=t)
            post, treat = int(day >= shock), int(i < n_treated)
            fee = (1.0 + 0.5 * i) * post * treat
            y = unit[i] + week[t] + effect * post * treat + rng.normal(0, noise)
            rows.append((i + 1, day, y, float(np.expm1(y)), treat, post,
                         (day - shock).days // 7, fee, ["Manhattan", "Bronx", "Queens"][i % 3],
                         2 if treat else int(i == n_treated), rng.random()))
    df = pd.DataFrame(rows, columns=[
        "zone_id", "date", "log_trip_count", "trip_count", "treat_binary", "post", "rel_week",
        "avg_cbd_fee", "borough", "treat_ring", "x"])
    df["week"] = df["date"]
    if drop:
        df = df[rng.random(len(df)) >= drop].reset_index(drop=True)
    return df


def dummy_regression(df, y, xs, unit="zone_id", time="date", cluster="zone_id"):
    """Coefficients and CR1 errors from explicit dummies: the slow, plain way."""
    d = np.hstack([
        df[xs].to_numpy(float), pd.get_dummies(df[unit]).to_numpy(float),
        pd.get_dummies(df[time]).to_numpy(float)[:, 1:]])
    b = np.linalg.lstsq(d, df[y].to_numpy(float), rcond=None)[0]
    e = df[y].to_numpy(float) - d @ b
    inv = np.linalg.pinv(d.T @ d)
    groups = df[cluster].to_numpy()
    meat = np.zeros((d.shape[1],) * 2)
    for g in np.unique(groups):
        s = d[groups == g].T @ e[groups == g]
        meat += np.outer(s, s)
    n = len(np.unique(groups))
    v = inv @ meat @ inv * n / (n - 1)
    return b[: len(xs)], np.sqrt(np.diag(v)[: len(xs)])
