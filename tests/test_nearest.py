"""Block search: the same as all pairs, whatever the blocks; no join of all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from lakesignal.functions.math import cosine, dot
from lakesignal.operators import figures, nearest
from lakesignal.operators import retrieval as rt


@pytest.fixture
def small(monkeypatch):
    for name, n in {"BLOCK_QUERIES": 3, "BLOCK_ROWS": 40, "FIRST_SLICE": 5, "SLICE": 7, "LEAST_ROWS": 10, "PAIRS": 16}.items():
        monkeypatch.setattr(nearest, name, n)


def chunks_of(spark, odd=True):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 0.6) for _ in range(8)], i % 4) for i in range(90)]
    rows += [(100 + i, rows[7][1], i % 4) for i in range(30)]  # copies
    if odd:
        rows += [(200, None, 0), (201, [1.0, 2.0], 1), (202, [0.5] * 7 + [None], 2), (203, [float("nan")] * 8, 3), (204, [0.0] * 8, 0)]
    return spark.createDataFrame(rows, "chunk_id long, e array<double>, label int")


def expected(rows, k):
    out = {}
    for q, c, s in rows:
        out.setdefault(q, []).append((-s, c))
    return sorted((q, n + 1, c, -s) for q, x in out.items() for n, (s, c) in enumerate(sorted(x)[:k]))


@pytest.mark.parametrize("k", [1, 5, 200])
def test_same_as_all_pairs(spark, small, k):
    c = chunks_of(spark, odd=False)
    q = c.where("chunk_id % 7 = 0").select(F.col("chunk_id").alias("query_id"), F.col("e").alias("q"))
    pairs = q.crossJoin(c)
    inner = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(F.col("q"), F.col("e")))), 6)
    want = expected([tuple(r) for r in pairs.where("query_id <> chunk_id").select("query_id", "chunk_id", inner).collect()], k)
    assert sorted(tuple(r) for r in rt.similarity_search(q, c, k).collect()) == want
    want = expected([tuple(r) for r in pairs.select("query_id", "chunk_id", F.round(cosine(F.col("q"), F.col("e")), 6)).collect()], k)
    assert sorted(tuple(r) for r in rt.cosine_search(q, c, k).collect()) == want


def test_odd_vectors_and_filters(spark, small):
    c = chunks_of(spark)
    q = c.where("chunk_id % 7 = 0 or chunk_id > 199").select(F.col("chunk_id").alias("query_id"), F.col("e").alias("q"))
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(F.col("q"), F.col("e")))), 6)
    rows = [tuple(r) for r in q.crossJoin(c).where("query_id <> chunk_id").select("query_id", "chunk_id", F.when(~F.isnan(score), score).otherwise(9.0), "label").collect()]
    flat = lambda df: sorted((r[0], r[1], r[2], 9.0 if r[3] != r[3] else r[3]) for r in df.collect())
    assert flat(rt.similarity_search(q, c, 6)) == expected([r[:3] for r in rows], 6)
    assert flat(rt.similarity_search(q, c, 6, F.col("label") % 2 == 0)) == expected([r[:3] for r in rows if r[3] % 2 == 0], 6)
    label = {(r[0], r[1]): r[3] for r in rows}
    kept = [(q_, c_, s) for q_, _, c_, s in expected([r[:3] for r in rows], 12) if label[q_, c_] % 2 == 0]
    assert flat(rt.similarity_search(q, c, 6, F.col("label") % 2 == 0, True)) == expected(kept, 6)


def test_no_join_of_all_pairs(spark):
    c = chunks_of(spark, odd=False)
    q = c.where("chunk_id % 7 = 0").select(F.col("chunk_id").alias("query_id"), F.col("e").alias("q"))
    prints = c.select(F.col("chunk_id").alias("figure_id"), F.struct((F.col("chunk_id") * 77).alias("dhash"), F.col("chunk_id").alias("ahash"), F.col("e").alias("ncc"), F.transform("e", F.abs).alias("histogram")).alias("f"))
    asked = prints.where("figure_id % 7 = 0").select(F.col("figure_id").alias("query_id"), F.col("f").alias("q"))
    for df in (rt.similarity_search(q, c, 3), rt.cosine_search(q, c, 3), figures.best_match(asked, prints, 0.1)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_figures_same_as_all_pairs(spark, small):
    c = chunks_of(spark, odd=False)
    f = F.struct((F.col("chunk_id") * 2654435761).alias("dhash"), (F.col("chunk_id") % 7).alias("ahash"), F.col("e").alias("ncc"), F.transform("e", F.abs).alias("histogram"))
    prints = c.select(F.col("chunk_id").alias("figure_id"), f.alias("f"))
    asked = prints.where("figure_id % 7 = 0").select(F.col("figure_id").alias("query_id"), F.col("f").alias("q"))
    pairs = asked.crossJoin(prints).where("query_id <> figure_id").select("query_id", "figure_id", figures.similarity("q", "f"))
    want = [(q, c_, s) for q, _, c_, s in expected([tuple(r) for r in pairs.collect()], 1) if s >= 0.3]
    assert sorted(tuple(r) for r in figures.best_match(asked, prints, 0.3).collect()) == want
