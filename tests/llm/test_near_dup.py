"""Crowded regions of the near-duplicate forest."""

import glob

import numpy as np
import pytest

from lakesignal.llm import near_dup
from lakesignal.llm.common import work_dir


@pytest.mark.parametrize(("share", "values", "cells"), [(1, 7, 50), (128, 1024, 2_000_000), (10**9, 7, 50)])
def test_common_counts_equal_brute_force(monkeypatch, share, values, cells):
    for name, value in (("DENSE_SHARE", share), ("DENSE_VALUES", values), ("PAIR_CELLS", cells)):
        monkeypatch.setattr(near_dup, name, value)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 60, np.uint64)
    left, right = ([np.unique(rng.choice(base, rng.integers(1, 60))) for _ in range(n)] for n in (17, 23))
    left.append(np.array([1], np.uint64))
    want = [[len(np.intersect1d(x, y)) for y in right] for x in left]
    assert near_dup.common_counts(left, right).tolist() == want


def test_two_classes_of_a_crowded_region_give_one_link_and_only_regions_meet(spark):
    """Before, each member gave a link, and regions joined by a class met as a whole."""
    words = lambda n: " ".join(f"{n}w{i}" for i in range(40))
    first = [(0, b"a" * 16, i, 0 if i < 6 else 6, words("x")) for i in range(12)]
    second = [(0, b"b" * 16, 20 + i, 0 if i < 6 else 26, words("y") if i < 6 else words("x")) for i in range(12)]
    rows = first + second
    trees = spark.createDataFrame([r[:4] for r in rows], "tree int, key binary, id long, label long")
    texts = spark.createDataFrame([(r[2], r[4]) for r in rows], "id long, text string")
    got = [(r.a, r.b) for r in near_dup.crowded_links(trees, texts, 5, 80).collect()]
    assert len(got) == 1 and {x < 6 for x in got[0]} == {True, False} and max(got[0]) < 12


def _edited(rng, n: int) -> list[str]:
    """Copies of a text of 60 words with up to 6 words replaced, of 48 to 60 words."""
    out = []
    for k in range(n):
        words = [f"w{i}" for i in range(rng.integers(48, 61))]
        for at in rng.integers(0, len(words), rng.integers(0, 7)):
            words[at] = f"e{k}x{at}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize(("few", "rows", "out"), [(10**9, 1024, 512), (0, 7, 5), (60, 7, 5)])
def test_crowded_links_equal_brute_force(spark, monkeypatch, few, rows, out):
    for name, value in (("FEW_PAIRS", few), ("ALL_ROWS", rows), ("OUTSIDE_ROWS", out)):
        monkeypatch.setattr(near_dup, name, value)
    texts = _edited(np.random.default_rng(5), 70)
    labels = [0 if i < 12 else i for i in range(70)]
    regions = {i: ([b"a" * 16] if i < 50 else []) + ([b"b" * 16] if i >= 30 else []) for i in range(70)}
    trees = [(0 if key[:1] == b"a" else 1, key, i, labels[i]) for i in regions for key in regions[i]]
    got = near_dup.crowded_links(
        spark.createDataFrame(trees, "tree int, key binary, id long, label long"),
        spark.createDataFrame(list(enumerate(texts)), "id long, text string"), 3, 80,
    ).collect()
    sets = [set(near_dup.shingles(t, 3).tolist()) for t in texts]
    linked = lambda i, j: 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    pairs = {(i, j) for i in range(70) for j in range(i) if linked(i, j) and set(regions[i]) & set(regions[j])}
    want = {tuple(sorted((labels[i], labels[j]))) for i, j in pairs if labels[i] != labels[j]}
    assert want and len(got) == len(want) and {tuple(sorted((labels[r.a], labels[r.b]))) for r in got} == want
    assert all(linked(r.a, r.b) for r in got)


def test_members_that_only_share_a_passage_never_meet(spark):
    """Before, all members outside a region's largest class were compared with all its members."""
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [(i, " ".join(f"t{i}x{k}" for k in range(30)) + " " + passage) for i in range(200)]
    trees = spark.createDataFrame([(0, b"a" * 16, i, i) for i in range(200)], "tree int, key binary, id long, label long")
    seen = set(_tables(spark, "nd-cells"))
    assert near_dup.crowded_links(trees, spark.createDataFrame(texts, "id long, text string"), 5, 80).isEmpty()
    (new,) = set(_tables(spark, "nd-cells")) - seen
    assert spark.read.parquet(new).isEmpty()


def _tables(spark, name: str) -> list[str]:
    return glob.glob(f"{work_dir(spark).removeprefix('file://')}/{name}-*")
