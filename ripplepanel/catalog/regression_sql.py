"""Fixed-effects regressions written out as SQL sweeps."""

from __future__ import annotations

from collections.abc import Sequence

from ripplepanel.catalog.sqltext import normal_p


def sweeps(
    src: str, columns: Sequence[str], unit: str = "zone_id", time: str = "date",
    by: Sequence[str] = (), rounds: int = 14, tag: str = "",
) -> dict[str, str]:
    """CTEs that end in ``net``: columns minus unit and time means (t_<name>).

    ``tag`` goes in front of every name, for two regressions in one query.
    """
    keys = "".join(f"{k}, " for k in by)
    using_t = ", ".join([*by, time])
    using_u = ", ".join([*by, unit])
    out = {f"{tag}b": f"SELECT {keys}{unit}, {time}, {', '.join(f'({c})::DOUBLE AS {c}' for c in columns)} "
                f"FROM {src}"}
    zeros = ", ".join(f"0.0::DOUBLE AS g_{c}" for c in columns)
    out[f"{tag}g0"] = f"SELECT DISTINCT {keys}{time}, {zeros} FROM {tag}b"
    for k in range(1, rounds + 1):
        us = ", ".join(f"avg({c}-g_{c}) AS u_{c}" for c in columns)
        gs = ", ".join(f"avg({c}-u_{c}) AS g_{c}" for c in columns)
        out[f"{tag}u{k}"] = (f"SELECT {keys}{unit}, {us} FROM {tag}b JOIN {tag}g{k - 1} "
                            f"USING ({using_t}) GROUP BY ALL")
        out[f"{tag}g{k}"] = (f"SELECT {keys}{time}, {gs} FROM {tag}b JOIN {tag}u{k} "
                            f"USING ({using_u}) GROUP BY ALL")
    us = ", ".join(f"avg({c}-g_{c}) AS u_{c}" for c in columns)
    out[f"{tag}uz"] = (f"SELECT {keys}{unit}, {us} FROM {tag}b JOIN {tag}g{rounds} "
                       f"USING ({using_t}) GROUP BY ALL")
    nets = ", ".join(f"{c}-g_{c}-u_{c} AS t_{c}" for c in columns)
    out[f"{tag}net"] = (f"SELECT {keys}{unit}, {time}, {nets} FROM {tag}b JOIN {tag}g{rounds} "
                        f"USING ({using_t}) JOIN {tag}uz USING ({using_u})")
    return out


def one_regressor(
    outcomes: Sequence[str], x: str, unit: str = "zone_id", by: Sequence[str] = (), tag: str = "",
) -> dict[str, str]:
    """CTE ``fits`` on top of ``net``: coef, se, p_value, n, r2 per outcome and key."""
    keys = "".join(f"{k}, " for k in by)
    same = " AND ".join([f"f.{k} = n.{k}" for k in by] or ["TRUE"])
    parts = []
    for y in outcomes:
        parts.append(f"""
  SELECT {keys}'{y}' AS outcome, any_value(coef) AS coef, any_value(n) AS n, any_value(r2) AS r2,
    sqrt(sum(s*s))/any_value(sxx)*sqrt(count(*)/(count(*)-1.0::DOUBLE)) AS se
  FROM (
    SELECT {''.join(f'n.{k}, ' for k in by)}n.{unit}, any_value(coef) AS coef,
      any_value(f.cnt) AS n, any_value(r2) AS r2, any_value(sxx) AS sxx,
      sum(t_{x}*(t_{y}-coef*t_{x})) AS s
    FROM {tag}net n JOIN (
      SELECT {keys}count(*) AS cnt, sum(t_{x}*t_{x}) AS sxx,
        CASE WHEN sum(t_{x}*t_{x}) > 1e-9 THEN sum(t_{x}*t_{y})/sum(t_{x}*t_{x}) END AS coef,
        pow(sum(t_{x}*t_{y}), 2)/sum(t_{x}*t_{x})/sum(t_{y}*t_{y}) AS r2
      FROM {tag}net GROUP BY ALL) f ON {same}
    GROUP BY ALL)
  GROUP BY ALL""")
    body = "\nUNION ALL\n".join(parts)
    return {
        f"{tag}fits0": body,
        f"{tag}fits": f"SELECT *, {normal_p('coef/se')} AS p_value FROM {tag}fits0",
    }
