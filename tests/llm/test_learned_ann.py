"""Learned partitions: recall against brute force, pruning on clustered vectors, exact scores, hard rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakesignal.llm import learned_ann as la
from lakesignal.llm import queries

ROWS = "vec_id long, embedding array<double>, label int, part int, uid long, score double"


def table_of(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, 2, 3, 0.5) for i, v in rows], ROWS)


def brute(ids, x, is_query, k=5):
    """{query id: [(id, cosine)]} of the k nearest of all other rows."""
    out, norm = {}, np.sqrt((x**2).sum(axis=1))
    for i in np.flatnonzero(is_query(ids)):
        score = (x * x[i]).sum(axis=1) / (norm * norm[i])
        order = [j for j in np.lexsort((ids, -score)) if j != i][:k]
        out[int(ids[i])] = [(int(ids[j]), score[j]) for j in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.id, r.score))
    return out


def recall(got, want):
    assert got.keys() == want.keys()
    return sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) / sum(map(len, want.values()))


def test_recall_on_the_given_vectors(spark, sf_dir):
    """Vectors that point evenly in all directions: nothing to prune, the mass must show it."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    want = brute(np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float), lambda i: i % 50 == 0)
    out = queries.QUERIES["op11_learned_ann"](spark, sf_dir)
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    assert recall(found(out.withColumnRenamed("vec_id", "id")), want) >= 0.9
    assert {r.query_id: r["list"] for r in out.groupBy("query_id").agg(F.sort_array(F.collect_list("rank")).alias("list")).collect()} == {q: [1, 2, 3, 4, 5] for q in want}


def test_clustered_vectors_ask_few_partitions(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 24))[rng.integers(0, 40, 6000)] + 0.25 * rng.normal(size=(6000, 24))
    ids, report = np.arange(6000), {}
    got = found(la.learned_ann(table_of(spark, zip(ids.tolist(), x.tolist(), strict=True)), F.col("id") % 20 == 0, report=report))
    want = brute(ids, x, lambda i: i % 20 == 0)
    assert recall(got, want) >= 0.95 and report["partitions"] == 32 and report["compared"] < 0.3
    for q in got:
        for i, score in got[q]:
            assert score == pytest.approx(x[q] @ x[i] / np.sqrt((x[q] @ x[q]) * (x[i] @ x[i])), abs=1e-12)


def test_partitions_are_balanced_and_cut_fewer_edges():
    rng = np.random.default_rng(2)
    x = la.unit(rng.normal(size=(16, 8))[rng.integers(0, 16, 2000)] + 0.3 * rng.normal(size=(2000, 8)))
    graph = la.nearest(x, x, la.DEGREE, own=True)
    first = la.halved(x, 8)
    label = la.balanced(graph, first, 8)
    assert np.bincount(label, minlength=8).max() <= np.ceil(1.05 * 250)
    within = [np.mean(c[graph] == c[:, None]) for c in (rng.permutation(first), first, label)]
    assert within[0] < within[1] < within[2]
    assert all((graph[i] != i).all() for i in range(2000))


def test_hard_rows(spark):
    """Few rows make one partition, which is exact: nulls, zeros, ties, repeats, lengths, extreme components."""
    bad = [(50, None), (100, []), (150, [0.0, 0.0]), (200, [1.0, None]), (250, [float("nan"), 1.0]), (300, [float("inf"), 1.0]), (None, [1.0, 1.0])]
    good = [(0, [1, 0]), (7, [2, 0]), (3, [3, 0]), (4, [1]), (5, [1, 1]), (6, [-1, 0]), (350, [0, 1, 0]), (8, [1e-170, 0]), (9, [0, 1e200]), (0, [1, 0])]
    got = found(la.learned_ann(table_of(spark, bad + good), F.col("id") % 50 == 0))
    assert got[0] == [(i, 1.0) for i in (0, 0, 3, 3, 4, 4, 7, 7, 8, 8)]  # two rows of one id, each finds the other
    assert got[350][0] == (9, 1.0) and got[350][1] == (5, pytest.approx(0.5**0.5)) and len(got[350]) == 5
    assert found(la.learned_ann(table_of(spark, []), F.col("id") % 50 == 0)) == {}
    assert found(la.learned_ann(table_of(spark, bad), F.col("id") % 50 == 0)) == {}
    assert found(la.learned_ann(table_of(spark, [(50, [1.0]), (1, [2.0])]), F.col("id") % 50 == 0)) == {50: [(1, 1.0)]}


def test_a_third_of_equal_rows_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(la, "BLOCK_ROWS", 100)
    monkeypatch.setattr(la, "GROUP_ROWS", 16)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 6))
    x[::3] = x[0]
    ids = np.arange(1500)
    got = found(la.learned_ann(table_of(spark, zip(ids.tolist(), x.tolist(), strict=True)), F.col("id") % 25 == 0))
    want = brute(ids, x, lambda i: i % 25 == 0)
    assert recall(got, want) >= 0.95
    assert [i for i, _ in got[0]] == [3, 6, 9, 12, 15] and [i for i, _ in got[75]] == [0, 3, 6, 9, 12]


def test_network_learns_shares():
    rng = np.random.default_rng(6)
    x = la.unit(rng.normal(size=(600, 5)))
    target = np.stack([x[:, 0] > 0, x[:, 0] <= 0], axis=1).astype(float)
    router = la.Router(5, 2)
    router.train(x, target)
    assert np.mean(router.probabilities(x).argmax(axis=1) == target.argmax(axis=1)) > 0.95
    few = router.route(x[:3], np.array([4, 0]), 3)
    assert few.tolist() == [[True, False]] * 3
