"""Robust decomposition of the hourly series, and its SQL: local regressions as joins, a table for each pass."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decompose
from .detection import DIRECTION, S, hourly

#: Three robust rounds are enough to take outliers out of these series; each costs both engines some seconds.
PERIOD, ROUNDS = 24, 3
#: Scores lie half way between two digits now and then, where engines round differently; a shift avoids it.
SHIFT = 0.00137


def line(source: str, keys: str, value: str, n: str) -> str:
    """Rows of source (keys, d, y, w, n, near) as the values of their weighted lines at d = 0."""
    spread = "(sdd / sw - (sd / sw) ** 2)"
    return (
        f"SELECT {keys}, CASE WHEN sw > 0 THEN CASE WHEN sqrt(greatest(0.0, {spread})) > 0.001 * ({n} - 1)"
        f" THEN sy / sw - sd / sw * (sdy / sw - sd / sw * (sy / sw)) / {spread} ELSE sy / sw END ELSE near END AS {value}"
        f" FROM (SELECT {keys}, {n}, any_value(near) AS near, sum(w) AS sw, sum(w * d) AS sd, sum(w * d * d) AS sdd, sum(w * y) AS sy,"
        f" sum(w * d * y) AS sdy FROM ({source}) GROUP BY {keys}, {n})"
    )


def tricube(q: int, at: str, n: str, rho: str) -> tuple[str, str]:
    """Weight of point b for place a, and which points take part."""
    left = f"greatest(0, least(a.{at} - {q // 2}, a.{n} - {q}))"
    right = f"least({left} + {q - 1}, a.{n} - 1)"
    reach = f"(greatest(a.{at} - {left}, {right} - a.{at}) + CASE WHEN a.{n} < {q} THEN ({q} - a.{n}) // 2 ELSE 0 END)"
    far = f"abs(b.{at} - a.{at})"
    weight = f"{rho} * CASE WHEN {far} <= 0.001 * {reach} THEN 1.0 WHEN {far} <= 0.999 * {reach} THEN (1 - ({far} / {reach}) ** 3) ** 3 ELSE 0.0 END"
    return weight, f"b.{at} BETWEEN {left} AND {right}"


def stl_sql(period: int, seasonal: int, trend: int, low: int, rounds: int, passes: int) -> str:
    """CTEs from s to stl (key, idx, v, trend, seasonal, residual, rho)."""
    tables = {
        "e0": "SELECT key, idx, v, 1.0 AS rho, 0.0 AS trend, CAST(count(*) OVER (PARTITION BY key) AS INTEGER) AS n FROM s"
        f" QUALIFY count(*) OVER (PARTITION BY key) > {2 * period}",
        "series": "SELECT DISTINCT key, n FROM e0",
        "places": f"SELECT *, CAST(ceil((n - phase) / {period}) AS INTEGER) AS cycles FROM ("
        f"SELECT key, n, idx, idx % {period} AS phase, idx // {period} AS pos FROM e0"
        f" UNION ALL SELECT key, n, k - {period}, k, -1 FROM series, range({period}) t(k)"
        f" UNION ALL SELECT key, n, n + k, (n + k) % {period}, (n + k) // {period} FROM series, range({period}) t(k))",
    }
    k, old = 0, "e0"
    ahead = f"OVER (PARTITION BY key ORDER BY idx ROWS BETWEEN CURRENT ROW AND {period - 1} FOLLOWING)"
    for turn in range(rounds + 1):
        if turn:
            tables[f"r{k}"] = (
                "SELECT key, idx, v, n, trend, CASE WHEN off <= 0.001 * six THEN 1.0 WHEN off <= 0.999 * six THEN (1 - (off / six) ** 2) ** 2 ELSE 0.0 END AS rho"
                " FROM (SELECT *, 6 * quantile_cont(off, 0.5) OVER (PARTITION BY key) AS six"
                f" FROM (SELECT *, abs(v - trend - seasonal) AS off FROM e{k}))"
            )
            old = f"r{k}"
        for _ in range(passes):
            k += 1
            weight, near = tricube(seasonal, "pos", "cycles", "b.rho")
            points = (
                f"SELECT a.key, a.idx, a.cycles, b.pos - a.pos AS d, b.y, {weight} AS w, arg_min(b.y, abs(b.pos - a.pos)) OVER (PARTITION BY a.key, a.idx) AS near"
                f" FROM places a JOIN (SELECT *, v - trend AS y, idx % {period} AS phase, idx // {period} AS pos FROM {old}) b"
                f" ON a.key = b.key AND a.phase = b.phase AND {near}"
            )
            tables[f"c{k}"] = line(points, "key, idx", "c", "cycles")
            tables[f"m{k}"] = (
                f"SELECT key, idx, c, avg(m2) OVER (PARTITION BY key ORDER BY idx ROWS BETWEEN {period} PRECEDING AND {period - 2} PRECEDING) AS m"
                f" FROM (SELECT *, avg(m1) {ahead} AS m2 FROM (SELECT *, avg(c) {ahead} AS m1 FROM c{k}))"
            )
            tables[f"f{k}"] = f"SELECT o.key, o.idx, o.v, o.n, o.rho, m.c, m.m FROM {old} o JOIN m{k} m USING (key, idx)"
            weight, near = tricube(low, "idx", "n", "1.0")
            points = f"SELECT a.key, a.idx, a.n, b.idx - a.idx AS d, b.m AS y, {weight} AS w, a.m AS near FROM f{k} a JOIN f{k} b ON a.key = b.key AND {near}"
            tables[f"g{k}"] = f"SELECT f.*, f.c - l.low AS seasonal FROM f{k} f JOIN ({line(points, 'key, idx', 'low', 'n')}) l USING (key, idx)"
            weight, near = tricube(trend, "idx", "n", "b.rho")
            points = (
                f"SELECT a.key, a.idx, a.n, b.idx - a.idx AS d, b.v - b.seasonal AS y, {weight} AS w, a.v - a.seasonal AS near"
                f" FROM g{k} a JOIN g{k} b ON a.key = b.key AND {near}"
            )
            tables[f"e{k}"] = f"SELECT g.key, g.idx, g.v, g.n, g.rho, g.seasonal, t.trend FROM g{k} g JOIN ({line(points, 'key, idx', 'trend', 'n')}) t USING (key, idx)"
            old = f"e{k}"
    parts = ", ".join(f"{name} AS MATERIALIZED ({body})" for name, body in tables.items())
    return f"{parts}, stl AS (SELECT key, idx, v, trend, seasonal, v - trend - seasonal AS residual, rho FROM e{k})"


#: Season, trend and low pass for 24 hours: the shorter of 24 and 13; 1.5 * 24 / (1 - 1.5 / 13), rounded up to 41; 25.
STL = stl_sql(24, 13, 41, 25, 3, 2)
ROUNDED = ("trend", "seasonal", "residual", "rho")

QUERIES = {
    "e01_stl": lambda sp, d: decompose.stl(hourly(sp, d), PERIOD, ROUNDS).select("key", "idx", *(F.round(c, 3).alias(c) for c in ROUNDED)),
    "e01_stl_outliers": lambda sp, d: decompose.stl_outliers(hourly(sp, d), PERIOD, robust_rounds=ROUNDS).select("key", "idx", "v", F.round(F.col("score") + SHIFT, 2).alias("score"), "kind"),
}
SQL = {
    "e01_stl": f"WITH {S}, {STL} SELECT key, idx, {', '.join(f'round({c}, 3) AS {c}' for c in ROUNDED)} FROM stl",
    "e01_stl_outliers": f"""WITH {S}, {STL} SELECT key, idx, v, round(round(score, 4) + {SHIFT}, 2) AS score, {DIRECTION} FROM (
        SELECT *, (residual - avg(residual) OVER (PARTITION BY key)) / nullif(stddev_samp(residual) OVER (PARTITION BY key), 0) AS score FROM stl) WHERE abs(score) > 3""",
}
