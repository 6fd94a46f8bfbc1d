"""As-of joins either way, with frames that are read once."""

import datetime as dt
import random

from lakesignal.operators import root_cause as rc


def test_nearest_reads_each_part_once(spark):
    rng, start = random.Random(4), dt.datetime(2024, 1, 1)
    at = lambda: start + dt.timedelta(hours=rng.randrange(24 * 12))
    left = [(i, i % 3, at()) for i in range(120)]
    right = {(g, at()): 0 for g in range(2) for _ in range(25)}
    right = [(g, t, n) for n, (g, t) in enumerate(right)]
    found = rc.asof(spark.createDataFrame(left, "i int, g int, t timestamp"), spark.createDataFrame(right, "g int, t timestamp, n int"), "g", "t", ["n"], "nearest")
    want = {}
    for i, g, t in left:
        near = min(((abs(u - t), u, n) for h, u, n in right if h == g), default=(None, None, None))
        want[i] = near[2]
    assert {r.i: r.n for r in found.collect()} == want
    assert "unboundedfollowing" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
