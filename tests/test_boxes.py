"""Boxes on pages against comparing everything on a page, with boxes of all sizes and broken rows."""

import random

from lakesignal.operators import boxes

KEYS = ["doc", "page"]


def layout(seed=1, n=60):
    rng = random.Random(seed)
    visuals, lines = [], []
    for doc in range(2):
        for page in range(3):
            for i in range(12):
                x, y, w, h = rng.uniform(-50, 600), rng.uniform(-50, 800), rng.choice([0, 0.5, 7, 90, 700, 5000]), rng.choice([0, 3, 64, 300])
                visuals.append((doc, page, i, [x, y, x + w, y + h]))
            for i in range(n):
                x, y = rng.choice([rng.uniform(-60, 620), visuals[-1][3][0]]), rng.uniform(-60, 820)
                text = rng.choice(["Figure 3: x", "fig. 2", "tables of x", " plain", "", None, "TABLE 1"])
                lines.append((doc, page, i, [x, y, x + rng.uniform(0, 40), y + 9], text))
    visuals += [(0, 0, 90, [5.0, 5.0, 1.0, 9.0]), (0, 1, 91, [None, 0.0, 9.0, 9.0]), (0, 1, 92, None)]
    lines += [(0, 0, 90, [None, 1.0, 2.0, 2.0], "Figure 9"), (0, 0, 91, None, "Figure 8"), (None, 0, 92, [1.0, 1.0, 2.0, 2.0], "Figure 7")]
    return visuals, lines


def frames(spark, visuals, lines):
    v = spark.createDataFrame(visuals, "doc int, page int, visual_id int, box array<double>")
    b = spark.createDataFrame(lines, "doc int, page int, line_id int, block array<double>, text string")
    return v, b


def sound(visuals):
    return [v for v in visuals if v[3] and None not in v[3] and v[3][0] <= v[3][2] and v[3][1] <= v[3][3]]


def inside(box, x, y, left, top, right, bottom):
    return box[0] - left <= x <= box[2] + right and box[1] - top <= y <= box[3] + bottom


def test_containment(spark):
    visuals, lines = layout()
    v, b = frames(spark, visuals, lines)
    placed = [x for x in lines if x[3] and None not in x[3]]
    middle = lambda r: ((r[0] + r[2]) / 2, (r[1] + r[3]) / 2)
    in_table = {x[:3] for x in placed for t in sound(visuals) if t[:2] == x[:2] and inside(t[3], *middle(x[3]), 5, 5, 5, 5)}
    got = [(r.doc, r.page, r.line_id) for r in boxes.outside_tables(b, v, KEYS, "line_id").collect()]
    assert sorted(map(str, got)) == sorted(str(x[:3]) for x in lines if x[:3] not in in_table) and in_table
    words = b.withColumnRenamed("line_id", "word_id")
    want = {(*x[:3], t[2]) for x in placed for t in sound(visuals) if t[:2] == x[:2] and inside(t[3], *x[3][:2], 20, 20, 20, 20) and inside(t[3], *x[3][2:], 20, 20, 20, 20)}
    got = [(r.doc, r.page, r.word_id, r.visual_id) for r in boxes.words_in_visuals(words, v, KEYS).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_captions(spark):
    visuals, lines = layout(2)
    v, b = frames(spark, visuals, lines)
    got = {(r.doc, r.page, r.visual_id): r.caption for r in boxes.captions(v, b, KEYS).collect()}
    want = {}
    for t in sound(visuals):
        near = []
        for x in lines:
            if x[:2] == t[:2] and x[3] and None not in x[3] and (x[4] or "").strip():
                cx, cy = (x[3][0] + x[3][2]) / 2, (x[3][1] + x[3][3]) / 2
                text = x[4].strip()
                if inside(t[3], cx, cy, 30, 40, 30, 60):
                    near.append((not text.lower().startswith(("figure", "fig.", "table 1")), cy, cx, x[2], text))
        if near:
            want[t[:3]] = min(near)[4]
    assert got == want and want
    long = spark.createDataFrame([(0, 0, 1, [0.0, 0.0, 1.0, 1.0], "Figure " + "x" * 300), (0, 1, 1, [0.0, 0.0, 1.0, 1.0], "y" * 300)], b.schema)
    one = spark.createDataFrame([(0, p, 1, [0.0, 0.0, 9.0, 9.0]) for p in (0, 1)], v.schema)
    assert sorted(len(r.caption) for r in boxes.captions(one, long, KEYS).collect()) == [150, 200]


def test_nearest_and_largest(spark):
    visuals, lines = layout(3)
    v, b = frames(spark, visuals, lines)
    hits = b.selectExpr("doc", "page", "line_id as hit_id", "block[0] as x", "block[1] as y")
    got = {(r.doc, r.page, r.hit_id): (r.visual_id, round(r.distance, 6)) for r in boxes.nearest_visual(hits, v, KEYS, 150.0).collect()}
    want = {}
    for x in lines:
        if x[3] and x[3][0] is not None:
            gaps = [(((x[3][0] - t[3][0]) ** 2 + (x[3][1] - t[3][1]) ** 2) ** 0.5, t[2]) for t in visuals if t[:2] == x[:2] and t[3] and t[3][0] is not None]
            if gaps and min(gaps)[0] < 150:
                want[x[:3]] = (min(gaps)[1], round(min(gaps)[0], 6))
    assert got == want and 20 < len(want) < len(lines)
    big = {(r.doc, r.page): r.visual_id for r in boxes.largest_visual(spark.createDataFrame(sound(visuals), v.schema), KEYS).collect()}
    area = lambda t: (t[3][2] - t[3][0]) * (t[3][3] - t[3][1])
    assert big == {k: max((t for t in sound(visuals) if t[:2] == k), key=lambda t: (area(t), -t[2]))[2] for k in big} and len(big) == 6


def test_large_boxes_meet_few_tiles(spark):
    """However large a box, it is joined through four tiles at most."""
    v = spark.createDataFrame([(0, 0, i, [0.1, 0.1, 0.1 + 10.0**i, 5.0]) for i in range(6)], "doc int, page int, visual_id int, box array<double>")
    p = spark.createDataFrame([(0, 0, 50_000.0, 1.0)], "doc int, page int, x double, y double")
    assert [r.visual_id for r in boxes.within(p, v, KEYS).collect()] == [5]


def test_empty_tables(spark):
    v, b = frames(spark, [], [])
    assert boxes.captions(v, b, KEYS).count() == 0 and boxes.outside_tables(frames(spark, [], layout()[1])[1], v, KEYS, "line_id").count() == len(layout()[1])
    assert boxes.nearest_visual(b.selectExpr("doc", "page", "line_id as hit_id", "1.0 as x", "1.0 as y"), v, KEYS).count() == 0


def test_few_boxes_need_no_tiles(spark, monkeypatch):
    """Pages of few boxes are joined by page alone, fuller ones by tiles; together or alone they give the same rows."""
    rng = random.Random(5)
    at = lambda page: ("d", page, rng.uniform(0, 300), rng.uniform(0, 300))
    shapes = [(*at(p), rng.uniform(5, 120)) for p, n in ((1, 3), (2, 30)) for _ in range(n)]
    v = spark.createDataFrame([(d, p, i, [x, y, x + s, y + s]) for i, (d, p, x, y, s) in enumerate(shapes)], "doc string, page int, visual_id long, box array<double>")
    spots = [at(p) for p in (1, 2, 3) for _ in range(60)]
    b = spark.createDataFrame([(d, p, i, [x, y, x + 9, y + 4], f"Fig. {i}" if i % 5 else "x") for i, (d, p, x, y) in enumerate(spots)], "doc string, page int, line_id long, block array<double>, text string")
    words, hits = b.withColumnRenamed("line_id", "word_id"), b.selectExpr("doc", "page", "line_id as hit_id", "block[0] as x", "block[1] as y")
    runs = []
    for few in (0, 5, 10_000):
        monkeypatch.setattr(boxes, "FEW_BOXES", few)
        out = (
            boxes.words_in_visuals(words, v, KEYS), boxes.outside_tables(b, v, KEYS, "line_id").select(*KEYS, "line_id"),
            boxes.captions(v, b, KEYS), boxes.nearest_visual(hits, v, KEYS, 150.0),
        )
        if few > 10:
            plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in out]
            assert not any("Generate explode" in p for p in plans)
        runs.append([sorted(map(tuple, df.collect())) for df in out])
    assert runs[0] == runs[1] == runs[2] and all(runs[0])
