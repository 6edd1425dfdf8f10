"""Building blocks of the DuckDB oracle texts."""

from __future__ import annotations

VALID = "(coalesce(reachable, false) AND NOT coalesce(off_network, false) AND t_min IS NOT NULL)"
NO_ACCESS = "(NOT coalesce(reachable, false) OR coalesce(off_network, false))"


def pct(part: str, whole: str, decimals: int = 2) -> str:
    return (
        f"CASE WHEN ({whole}) <> 0 THEN {rnd(f'100.0 * ({part}) / ({whole})', decimals)} ELSE 0 END"
    )


def rnd(expr: str, decimals: int) -> str:
    return f"CAST(round_even(round(CAST({expr} AS DOUBLE), {decimals + 6}), {decimals}) AS DOUBLE)"


def weighted_quantile(source: str, by: list[str], q: float, name: str, value="t_min", weight="weight") -> str:
    """A query returning ``by..., name``; ``source`` is a table or subquery of valid rows."""
    keys = ", ".join(by)
    part = f"PARTITION BY {keys}" if by else ""
    sel = f"{keys}, " if by else ""
    group = f"GROUP BY {keys}" if by else ""
    return f"""SELECT {sel}CASE WHEN lo IS NULL THEN hi.v WHEN hi IS NULL OR hi.c = lo.c THEN lo.v
  ELSE lo.v + (pos - lo.c) * (hi.v - lo.v) / (hi.c - lo.c) END AS {name}
FROM (SELECT {sel}max(pos) AS pos, arg_max(pt, c) FILTER (WHERE c <= pos) AS lo, arg_min(pt, c) FILTER (WHERE c >= pos) AS hi
  FROM (SELECT *, {{'c': c, 'v': v}} AS pt FROM (
    SELECT {sel}CAST({value} AS DOUBLE) AS v,
      sum({weight}) OVER ({part} ORDER BY {value}, {weight} ROWS UNBOUNDED PRECEDING) - {weight} / 2 AS c,
      {q} * sum({weight}) OVER ({part}) AS pos
    FROM {source} WHERE {value} IS NOT NULL AND {weight} > 0) a) b {group}) d"""
