"""Box queries over pages laid out from orders (visuals and tables) and their lines (blocks of text), and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boxes
from ..sources.tables import load

KEYS = ["page"]


def visuals(spark, sf_dir):
    """Boxes of forty order keys a page; one in two hundred covers much of its page."""
    o, left, top = load(spark, sf_dir, "orders"), F.col("o_custkey") * 11 % 500, F.col("o_orderkey") * 17 % 700
    right = left + 20 + F.col("o_orderkey") % 150 + F.when(F.col("o_orderkey") % 200 == 7, 400).otherwise(0)
    box = F.array(*(c.cast("double") for c in (left, top, right, top + 15 + F.col("o_custkey") % 120)))
    return o.select(F.floor(F.col("o_orderkey") / 40).alias("page"), F.col("o_orderkey").alias("visual_id"), box.alias("box"))


def lines(spark, sf_dir):
    """A block of text for each order line."""
    li, left, top = load(spark, sf_dir, "lineitem"), F.col("l_partkey") * 7 % 560, (F.col("l_orderkey") * 13 + F.col("l_linenumber") * 97) % 760
    block = F.array(*(c.cast("double") for c in (left, top, left + F.col("l_quantity") * 3, top + 10)))
    text = F.when(F.col("l_linenumber") == 3, F.concat(F.lit("Figure "), F.col("l_partkey").cast("string"))).otherwise(F.concat(F.lit(" "), "l_linestatus"))
    ids = (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")
    return li.select(F.floor(F.col("l_orderkey") / 40).alias("page"), ids.alias("line_id"), block.alias("block"), text.alias("text"))


def words(spark, sf_dir):
    return lines(spark, sf_dir).withColumnRenamed("line_id", "word_id")


def hits(spark, sf_dir):
    """Search hits: corners of the blocks."""
    return lines(spark, sf_dir).select("page", F.col("line_id").alias("hit_id"), F.col("block")[0].alias("x"), F.col("block")[1].alias("y"))


def located(spark, sf_dir):
    """Each hit's nearest visual, else the page's largest."""
    v, h = visuals(spark, sf_dir), hits(spark, sf_dir)
    near = boxes.nearest_visual(h, v, KEYS, 120.0)
    rest = h.join(near, [*KEYS, "hit_id"], "left_anti").join(boxes.largest_visual(v, KEYS), KEYS)
    return near.select("hit_id", "visual_id", F.round("distance", 4).alias("distance")).unionByName(rest.select("hit_id", "visual_id").distinct(), allowMissingColumns=True)


QUERIES = {
    "j15_outside_tables": lambda sp, d: boxes.outside_tables(lines(sp, d), visuals(sp, d), KEYS, "line_id").select("line_id", "text"),
    "j15_words_in_visuals": lambda sp, d: boxes.words_in_visuals(words(sp, d), visuals(sp, d), KEYS).groupBy("visual_id").agg(F.count("*").alias("n"), F.min("word_id").alias("first_word")),
    "j15_nearest_visual": located,
    "o21_captions": lambda sp, d: boxes.captions(visuals(sp, d), lines(sp, d), KEYS).select("visual_id", "caption"),
}

PAGES = """v AS (SELECT o_orderkey // 40 AS page, o_orderkey AS visual_id, CAST(o_custkey * 11 % 500 AS DOUBLE) AS x0, CAST(o_orderkey * 17 % 700 AS DOUBLE) AS y0,
  CAST(o_custkey * 11 % 500 + 20 + o_orderkey % 150 + CASE WHEN o_orderkey % 200 = 7 THEN 400 ELSE 0 END AS DOUBLE) AS x1,
  CAST(o_orderkey * 17 % 700 + 15 + o_custkey % 120 AS DOUBLE) AS y1 FROM orders),
b AS (SELECT l_orderkey // 40 AS page, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS id, CAST(l_partkey * 7 % 560 AS DOUBLE) AS x0, CAST((l_orderkey * 13 + l_linenumber * 97) % 760 AS DOUBLE) AS y0,
  CAST(l_partkey * 7 % 560 + l_quantity * 3 AS DOUBLE) AS x1, CAST((l_orderkey * 13 + l_linenumber * 97) % 760 + 10 AS DOUBLE) AS y1,
  CASE WHEN l_linenumber = 3 THEN 'Figure ' || l_partkey ELSE ' ' || l_linestatus END AS text FROM lineitem)"""
SQL = {
    "j15_outside_tables": f"""WITH {PAGES} SELECT id AS line_id, text FROM b WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.page = b.page
        AND (b.x0 + b.x1) / 2 BETWEEN v.x0 - 5 AND v.x1 + 5 AND (b.y0 + b.y1) / 2 BETWEEN v.y0 - 5 AND v.y1 + 5)""",
    "j15_words_in_visuals": f"""WITH {PAGES} SELECT visual_id, count(*) AS n, min(id) AS first_word FROM b JOIN v ON v.page = b.page AND b.x0 >= v.x0 - 20 AND b.x1 <= v.x1 + 20
        AND b.y0 >= v.y0 - 20 AND b.y1 <= v.y1 + 20 GROUP BY 1""",
    "j15_nearest_visual": f"""WITH {PAGES}, near AS (SELECT b.id AS hit_id, b.page, visual_id, sqrt((b.x0 - v.x0) ** 2 + (b.y0 - v.y0) ** 2) AS distance FROM b JOIN v ON v.page = b.page
          QUALIFY row_number() OVER (PARTITION BY b.page, b.id ORDER BY distance, visual_id) = 1),
        big AS (SELECT page, visual_id FROM v QUALIFY row_number() OVER (PARTITION BY page ORDER BY (x1 - x0) * (y1 - y0) DESC, visual_id) = 1)
        SELECT hit_id, CASE WHEN distance < 120 THEN near.visual_id ELSE big.visual_id END AS visual_id, CASE WHEN distance < 120 THEN round(distance, 4) END AS distance FROM near JOIN big USING (page)""",
    "o21_captions": f"""WITH {PAGES} SELECT visual_id, CASE WHEN text LIKE 'Figure%' THEN substr(text, 1, 200) ELSE substr(trim(text), 1, 150) END AS caption FROM v JOIN b ON v.page = b.page
        AND (b.x0 + b.x1) / 2 BETWEEN v.x0 - 30 AND v.x1 + 30 AND (b.y0 + b.y1) / 2 BETWEEN v.y0 - 40 AND v.y1 + 60
        QUALIFY row_number() OVER (PARTITION BY visual_id ORDER BY text NOT LIKE 'Figure%', (b.y0 + b.y1) / 2, (b.x0 + b.x1) / 2, id) = 1""",
}
