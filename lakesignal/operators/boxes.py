"""Boxes and points on pages: what lies in what, and what is nearest, by a join on grid tiles.

A box is a struct-like array [left, top, right, bottom]. The grid has levels whose
tiles double in size; a box goes to the level whose tiles are as large as it is,
where it meets four tiles at most, however large it is. A point goes to its tile
on each level that has boxes. So points meet boxes in an equi-join on page, level
and tile, never all points of a page with all its boxes.

A page of few boxes needs no tiles: its points meet them all, so both sides are
shuffled once, by page, and nothing is copied. Only the points of fuller pages go to tiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Side of a tile on level 0, and levels; greater boxes share the last level.
TILE, LEVELS = 8.0, 24
#: Boxes of a page of few.
FEW_BOXES = 256
#: A table's block may stick out by so much; words belong to a visual up to here; where captions are looked for: left, top, right, bottom.
TABLE_MARGIN, VISUAL_MARGIN, CAPTION_REACH = 5.0, 20.0, (30.0, 40.0, 30.0, 60.0)
#: How a caption begins, and how much of one (or of another line) is kept.
CAPTION = r"(?i)^(?:Fig\.|(?:Figure|Diagram|Chart|Illustration|Photo|Image|Table)\b)"
CAPTION_CHARS, LINE_CHARS = 200, 150
#: A hit further than this from every visual names none.
HIT_REACH = 400.0


def grown(box: Column, left: float, top: float, right: float, bottom: float) -> Column:
    return F.array(box[0] - left, box[1] - top, box[2] + right, box[3] + bottom)


def holds(box: Column, x: Column, y: Column) -> Column:
    """Is the point in the box? Edges count."""
    return (x >= box[0]) & (x <= box[2]) & (y >= box[1]) & (y <= box[3])


def _tile(c: Column, level: Column) -> Column:
    return F.floor(c / (TILE * F.pow(F.lit(2.0), level))).cast("long")


def _full_pages(boxes: DataFrame, keys: list[str]) -> DataFrame | None:
    """The keys of pages with more than FEW_BOXES boxes, one in so many boxes at most; None if there are none."""
    full = boxes.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > FEW_BOXES).select(*keys)
    return None if full.isEmpty() else F.broadcast(full)


def within(points: DataFrame, boxes: DataFrame, keys: list[str]) -> DataFrame:
    """points (keys, x, y, ...) with each box (keys, box, ...) of the same keys that holds them.

    Points and boxes with a null coordinate or a box that ends before it begins
    take no part. Other columns must have different names. Ids are for the
    caller: repeated ones stand for one thing in what is grouped by them.
    """
    few = lambda p, b: p.join(b, keys).where(holds(F.col("box"), F.col("x"), F.col("y")))
    full = _full_pages(boxes, keys)
    if full is None:
        return few(points, boxes)
    split = lambda how: (points.join(full, keys, how), boxes.join(full, keys, how))
    return few(*split("left_anti")).unionByName(_within_tiles(*split("left_semi"), keys))


def _within_tiles(points: DataFrame, boxes: DataFrame, keys: list[str]) -> DataFrame:
    side = F.greatest(F.col("box")[2] - F.col("box")[0], F.col("box")[3] - F.col("box")[1])
    level = F.least(F.lit(LEVELS - 1), F.ceil(F.log2(F.greatest(side, F.lit(TILE)) / TILE))).cast("int")
    ends = boxes.where((F.col("box")[0] <= F.col("box")[2]) & (F.col("box")[1] <= F.col("box")[3])).withColumn("_level", level)
    spans = [F.sequence(_tile(F.col("box")[i], F.col("_level")), _tile(F.col("box")[i + 2], F.col("_level"))) for i in (0, 1)]
    tiled = ends.withColumn("_tx", F.explode(spans[0])).withColumn("_ty", F.explode(spans[1]))
    used = F.lit([r[0] for r in tiled.select("_level").distinct().collect()]).cast("array<int>")  # LEVELS numbers at most
    placed = points.where(F.col("x").isNotNull() & F.col("y").isNotNull()).withColumn("_level", F.explode(used))
    placed = placed.withColumn("_tx", _tile(F.col("x"), F.col("_level"))).withColumn("_ty", _tile(F.col("y"), F.col("_level")))
    met = placed.join(tiled, [*keys, "_level", "_tx", "_ty"])
    return met.where(holds(F.col("box"), F.col("x"), F.col("y"))).drop("_level", "_tx", "_ty")


def _middle(low: int, high: int) -> Column:
    return (F.col("block")[low] + F.col("block")[high]) / 2


def outside_tables(blocks: DataFrame, tables: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """Text blocks (keys, id, block) whose centre is in no table (keys, box), a margin included."""
    wide = tables.select(*keys, grown(F.col("box"), *[TABLE_MARGIN] * 4).alias("box"))
    full = _full_pages(wide, keys)
    some = blocks if full is None else blocks.join(full, keys, "left_anti")
    rest = wide if full is None else wide.join(full, keys, "left_anti")
    rest = rest.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("box").alias("_box"))
    same = [F.col(k) == F.col(f"_{k}") for k in keys]
    out = some.join(rest, [*same, holds(F.col("_box"), _middle(0, 2), _middle(1, 3))], "left_anti")
    if full is None:
        return out
    more = blocks.join(full, keys, "left_semi")
    points = more.select(*keys, F.col(id_col).alias("_id"), "block", _middle(0, 2).alias("x"), _middle(1, 3).alias("y"))
    inside = _within_tiles(points, wide.join(full, keys, "left_semi"), keys).select(*keys, F.col("_id").alias(id_col), "block").distinct()
    return out.unionByName(more.join(inside, [*keys, id_col, "block"], "left_anti"))


def words_in_visuals(words: DataFrame, visuals: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, word_id, visual_id): words (keys, word_id, block) that lie in a visual (keys, visual_id, box), a margin included, as a whole."""
    points = words.select(*keys, "word_id", "block", F.col("block")[0].alias("x"), F.col("block")[1].alias("y"))
    wide = visuals.select(*keys, "visual_id", grown(F.col("box"), *[VISUAL_MARGIN] * 4).alias("box"))
    found = within(points, wide, keys).where(holds(F.col("box"), F.col("block")[2], F.col("block")[3]))
    return found.select(*keys, "word_id", "visual_id")


def captions(visuals: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, visual_id, caption): of the lines (keys, line_id, block, text) around each visual the first that begins like a caption, else the first.

    A line is around a visual if its centre is; lines count from top to bottom, then left to right, then by id.
    """
    points = lines.where(F.trim("text") != "").select(*keys, "line_id", F.trim("text").alias("text"), _middle(0, 2).alias("x"), _middle(1, 3).alias("y"))
    around = visuals.select(*keys, "visual_id", grown(F.col("box"), *CAPTION_REACH).alias("box"))
    named = F.col("text").rlike(CAPTION)
    kept = F.when(named, F.substring("text", 1, CAPTION_CHARS)).otherwise(F.substring("text", 1, LINE_CHARS))
    first = F.min(F.struct((~named).alias("no"), "y", "x", "line_id", kept.alias("caption")))
    found = within(points, around, keys).groupBy(*keys, "visual_id").agg(first.alias("first"))
    return found.select(*keys, "visual_id", F.col("first.caption").alias("caption"))


def nearest_visual(hits: DataFrame, visuals: DataFrame, keys: list[str], reach: float = HIT_REACH) -> DataFrame:
    """(keys, hit_id, visual_id, distance): for each hit (keys, hit_id, x, y) the visual whose top left corner is nearest, nearer than reach.

    On a page of few visuals a hit meets them all. On fuller pages there are rings
    of the grid: corners within the tile's size of a hit are found first; only hits
    without one look in tiles twice as large, up to reach. Ties go to the smaller id.
    """
    corners = visuals.where(F.col("box")[0].isNotNull() & F.col("box")[1].isNotNull())
    corners = corners.select(*keys, "visual_id", F.col("box")[0].alias("_bx"), F.col("box")[1].alias("_by"))
    left = hits.where(F.col("x").isNotNull() & F.col("y").isNotNull()).select(*keys, "hit_id", "x", "y")
    full = _full_pages(corners, keys)
    if full is None:
        return _nearest_on_page(left, corners, keys, reach)
    split = lambda how: (left.join(full, keys, how), corners.join(full, keys, how))
    return _nearest_on_page(*split("left_anti"), keys, reach).unionByName(_nearest_in_rings(*split("left_semi"), keys, reach))


def _nearest_on_page(left: DataFrame, corners: DataFrame, keys: list[str], reach: float) -> DataFrame:
    gap = F.sqrt((F.col("x") - F.col("_bx")) ** 2 + (F.col("y") - F.col("_by")) ** 2)
    near = left.join(corners, keys).withColumn("distance", gap).where(F.col("distance") < reach)
    best = near.groupBy(*keys, "hit_id").agg(F.min(F.struct("distance", "visual_id")).alias("b"))
    return best.select(*keys, "hit_id", F.col("b.visual_id").alias("visual_id"), F.col("b.distance").alias("distance"))


def _nearest_in_rings(left: DataFrame, corners: DataFrame, keys: list[str], reach: float) -> DataFrame:
    gap = F.sqrt((F.col("x") - F.col("_bx")) ** 2 + (F.col("y") - F.col("_by")) ** 2)
    steps = F.array(*(F.lit(k) for k in (-1, 0, 1)))
    out, size = None, TILE
    while True:
        size = min(size * 4, reach)
        tile = lambda c, s=size: F.floor(F.col(c) / s).cast("long")
        asked = left.withColumn("_dx", F.explode(steps)).withColumn("_dy", F.explode(steps))
        asked = asked.withColumn("_tx", tile("x") + F.col("_dx")).withColumn("_ty", tile("y") + F.col("_dy")).drop("_dx", "_dy")
        held = corners.withColumn("_tx", tile("_bx")).withColumn("_ty", tile("_by"))
        near = asked.join(held, [*keys, "_tx", "_ty"]).withColumn("distance", gap)
        near = near.where(F.col("distance") < size)
        best = near.groupBy(*keys, "hit_id").agg(F.min(F.struct("distance", "visual_id")).alias("b"))
        best = best.select(*keys, "hit_id", F.col("b.visual_id").alias("visual_id"), F.col("b.distance").alias("distance"))
        out = best if out is None else out.unionByName(best)
        if size >= reach:
            return out
        left = left.join(best.select(*keys, "hit_id"), [*keys, "hit_id"], "left_anti")


def largest_visual(visuals: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, visual_id): each page's largest visual by area, for hits that are near none; ties to the smaller id."""
    area = (F.col("box")[2] - F.col("box")[0]) * (F.col("box")[3] - F.col("box")[1])
    return visuals.groupBy(*keys).agg(F.max_by("visual_id", F.struct(area, -F.col("visual_id"))).alias("visual_id"))
