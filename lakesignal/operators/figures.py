"""Figures: similarity of fingerprints, nearest match, class and shape; their places on pages are in boxes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.math import cosine, hamming_similarity, histogram_intersection
from .explain import fixed
from .nearest import SLACK, best_rows, matrix, row_dots
from .retrieval import meet

MATCH = 0.78


def similarity(a: str, b: str) -> Column:
    """Of fingerprint structs (dhash, ahash, ncc, histogram): .40, .25, .20 and .15 of their similarities."""
    x, y = F.col(a), F.col(b)
    return F.round(
        0.40 * hamming_similarity(x["dhash"], y["dhash"]) + 0.25 * hamming_similarity(x["ahash"], y["ahash"])
        + 0.20 * F.greatest(F.lit(0.0), cosine(x["ncc"], y["ncc"])) + 0.15 * histogram_intersection(x["histogram"], y["histogram"]), 4
    )


class Prints:
    """similarity() of fingerprint columns, block by block; the same additions in the same order."""

    digits, most = 4, np.inf

    def __init__(self, left: pa.Table, right: pa.Table):
        self.x, self.y = ({c: matrix(t[c]) if c in ("ncc", "histogram") else t[c].to_numpy() for c in FIELDS} for t in (left, right))
        self.x_norm, self.y_norm = (np.sqrt(row_dots(t["ncc"], t["ncc"])) for t in (self.x, self.y))
        self.slack = SLACK * (1 + np.abs(self.x["histogram"]).sum(axis=1))

    def _sum(self, dhash: np.ndarray, ahash: np.ndarray, cos: np.ndarray, common: np.ndarray) -> np.ndarray:
        same = lambda x: 1 - np.bitwise_count(x.view(np.uint64)) / 64.0
        return 0.40 * same(dhash) + 0.25 * same(ahash) + 0.20 * np.maximum(0.0, cos) + 0.15 * (common / 3.0)

    def rough(self, s: int, e: int) -> np.ndarray:
        x, y = self.x, {c: v[s:e] for c, v in self.y.items()}
        common = sum(np.minimum.outer(x["histogram"][:, d], y["histogram"][:, d]) for d in range(x["histogram"].shape[1]))
        cos = x["ncc"] @ y["ncc"].T / (np.outer(self.x_norm, self.y_norm[s:e]) + 1e-8)
        return self._sum(x["dhash"][:, None] ^ y["dhash"], x["ahash"][:, None] ^ y["ahash"], cos, common)

    def exact(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        x, y = ({c: v[k] for c, v in t.items()} for t, k in ((self.x, i), (self.y, j)))
        cos = row_dots(x["ncc"], y["ncc"]) / (self.x_norm[i] * self.y_norm[j] + 1e-8)
        common = np.cumsum(np.minimum(x["histogram"], y["histogram"]), axis=1)[:, -1]
        return self._sum(x["dhash"] ^ y["dhash"], x["ahash"] ^ y["ahash"], cos, common)


FIELDS = ("dhash", "ahash", "ncc", "histogram")


def best_match(queries: DataFrame, stored: DataFrame, threshold: float = MATCH) -> DataFrame:
    """(query_id, figure_id, similarity): the most similar other stored figure of a stated query set, ties to the smaller id.

    Whole fingerprints (of the commonest lengths, finite) meet block by block; any others meet all rows in Spark's own arithmetic.
    """
    stored = stored.withColumnRenamed("figure_id", "chunk_id")
    lengths = stored.groupBy(F.size("f.ncc").alias("n"), F.size("f.histogram").alias("h")).agg(F.count("*").alias("c")).where("n > 0 and h > 0")
    n, h, _ = lengths.orderBy(F.desc("c"), "n", "h").first() or (0, 0, 0)

    def whole(row_id: str, f: str) -> Column:
        finite = lambda v: F.forall(v, lambda x: F.coalesce(F.abs(x) < 1e100, F.lit(False)))
        known = F.col(row_id).isNotNull() & F.col(f)["dhash"].isNotNull() & F.col(f)["ahash"].isNotNull()
        sized = (F.size(F.col(f)["ncc"]) == n) & (F.size(F.col(f)["histogram"]) == h)
        return F.coalesce(known & sized & finite(F.col(f)["ncc"]) & finite(F.col(f)["histogram"]), F.lit(False))

    of_q, of_f = whole("query_id", "q"), whole("chunk_id", "f")
    (n_q, odd_q), (n_f, odd_f) = (df.agg(F.count("*"), F.count_if(~p)).first() for df, p in ((queries, of_q), (stored, of_f)))
    flat = lambda df, i, f: df.select(i, *(F.col(f)[c].cast("long" if c.endswith("hash") else "array<double>").alias(c) for c in FIELDS))
    asked, rows = flat(queries.where(of_q), "query_id", "q"), flat(stored.where(of_f), "chunk_id", "f").withColumn("ok", F.lit(True))
    pairs = best_rows(asked, rows, (n_q, n_f), 1, False, Prints).select("query_id", "chunk_id", F.col("score").alias("similarity"))
    for a, b in ((queries.where(~of_q), stored),) * bool(odd_q) + ((queries.where(of_q), stored.where(~of_f)),) * bool(odd_f):
        more = meet(a, b).where("query_id <> chunk_id").withColumn("similarity", similarity("q", "f"))
        pairs = pairs.unionByName(more.select(*pairs.columns))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "chunk_id"))
    best = pairs.withColumn("_n", place).where((F.col("_n") == 1) & (F.col("similarity") >= threshold))
    return best.select("query_id", F.col("chunk_id").alias("figure_id"), "similarity")


#: Classes by the share of edge pixels, and what shapes are called.
SCHEMATIC, CHART, PHOTO = "Technical Schematic / Architectural Diagram / Flowchart", "Chart / Graph / Data Plot", "Photographic Image / Illustration"
SCHEMATIC_EDGES, CHART_EDGES, LANDSCAPE, PORTRAIT = 0.045, 0.015, 1.3, 0.77


def figure_class(edges: Column) -> Column:
    """By the share of pixels that are edges."""
    return F.when(edges > SCHEMATIC_EDGES, SCHEMATIC).when(edges > CHART_EDGES, CHART).otherwise(PHOTO)


def aspect(width: Column, height: Column) -> Column:
    """'1.8:1 (Landscape)', '1:1.5 (Portrait)', '1.05:1 (Standard)'; without a size it is '1:1 (Square)'."""
    ratio = F.when((width > 0) & (height > 0), width / height)
    return (
        F.when(ratio > LANDSCAPE, F.concat(fixed(ratio, 1), F.lit(":1 (Landscape)")))
        .when(ratio < PORTRAIT, F.concat(F.lit("1:"), fixed(1 / ratio, 1), F.lit(" (Portrait)")))
        .when(ratio.isNotNull(), F.concat(fixed(ratio, 2), F.lit(":1 (Standard)")))
        .otherwise("1:1 (Square)")
    )
