"""Scans, sinks, chunking, p-values and streaming jobs on small inputs."""

import collections
import hashlib
import math
import random
import re
import statistics

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakesignal.functions import chunker
from lakesignal.functions.math import student_p
from lakesignal.operators import cleaning, quality, retrieval, sketches
from lakesignal.operators import root_cause as rc
from lakesignal.sources import sinks
from lakesignal.sources import tables as src
from lakesignal.streaming import jobs


def test_csv_and_tsv_scans(spark, tmp_path):
    (tmp_path / "a.csv").write_text("d,v,s\n2024-01-01,1.5,x\nbad,NaN,\"a,b\"\n", encoding="utf-8")
    (tmp_path / "b.tsv").write_text("d\tv\n2024-01-01\t2\n", encoding="utf-8")
    rows = src.read_delimited(spark, str(tmp_path / "a.csv"), "d string, v double, s string", "d").collect()
    assert [(r.d is None, r.v, r.s) for r in rows] == [(False, 1.5, "x"), (True, None, "a,b")]
    assert src.read_delimited(spark, str(tmp_path / "b.tsv")).columns == ["d", "v"]


def test_encoding_and_structure(spark, tmp_path):
    (tmp_path / "l.csv").write_bytes("näme,x\nü,1\n".encode("latin-1"))
    assert src.detect_encoding(spark, str(tmp_path / "l.csv")) == "ISO-8859-1"
    assert src.read_delimited(spark, str(tmp_path / "l.csv")).columns == ["näme", "x"]
    (tmp_path / "d.csv").write_text("a,a\n1,2\n")
    (tmp_path / "e.csv").write_text("")
    (tmp_path / "n.csv").write_text("a,b\n1,\n2,\n")
    assert "twice" in src.check_structure(spark, str(tmp_path / "d.csv"))[0]
    assert src.check_structure(spark, str(tmp_path / "e.csv")) == ["file is empty"]
    assert src.check_structure(spark, str(tmp_path / "n.csv")) == ["column has no value: b"]


def test_documents_and_files(spark, tmp_path):
    (tmp_path / "x.txt").write_bytes("é".encode("latin-1"))
    (tmp_path / "y.txt").write_text("é", encoding="utf-8")
    got = {r.path[-5:]: r.content for r in src.read_documents(spark, str(tmp_path)).collect()}
    assert got == {"x.txt": "é", "y.txt": "é"}
    assert src.list_files(spark, str(tmp_path), ("txt",)).count() == 2


def test_json_is_normalised_or_kept(spark):
    df = spark.createDataFrame([('{"b": 1,\n "a": 2}',), ("no json",)], "t string")
    assert [r[0] for r in df.select(src.pretty_json(F.col("t"))).collect()][1] == "no json"


def test_runs_are_visible_by_manifest(spark, tmp_path):
    df = spark.range(3)
    sinks.write_run({"a": df}, str(tmp_path), "r1")
    df.write.parquet(f"{tmp_path}/a/run=r2")
    assert sinks.read_run(spark, str(tmp_path), "a").count() == 3


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .!?\n|-#1é`", max_size=400), st.integers(3, 40))
def test_chunker_loses_no_text(text, size):
    parts = chunker.chunks(text, size, overlap=0)
    joined = "".join("".join(t for _, t, _ in parts).split())
    kept = "".join(text.split())
    for c in set(kept):
        assert joined.count(c) >= kept.count(c) or c == "|" or c == "-"


def test_chunks_follow_headings_and_sizes():
    text = "# One\n" + "A word here. " * 100 + "\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n# Two\nEnd."
    parts = chunker.chunks(text, 50, 10)
    assert {s for s, _, _ in parts} == {"One", "Two"} and all(n <= 50 for _, _, n in parts)
    assert any(t.startswith("| a | b |") for _, t, _ in parts)


@pytest.mark.parametrize("t, df, p", [(2.0, 10, 0.0733880), (0.0, 5, 1.0), (12.0, 3, 0.0012472), (1.0, 1, 0.5)])
def test_student_p(t, df, p):
    assert abs(student_p(t, df) - p) < 1e-5


def test_shares_sum_to_100(spark):
    rng = random.Random(1)
    rows = [(1, "d", f"s{i}", rng.uniform(-5, 5)) for i in range(9)]
    seg = spark.createDataFrame(rows, "anomaly_id int, dimension string, segment string, deviation double")
    assert abs(rc.attribution(seg).agg(F.sum("share")).first()[0] - 100) < 1e-6
    assert abs(rc.contributions(seg).agg(F.sum("contribution")).first()[0] - 100) < 1e-6


def test_shapley_sums_to_the_whole(spark):
    rows = [(x, y, float(3 * i + 5 * j)) for i, x in enumerate("ab") for j, y in enumerate("cd")]
    base = spark.createDataFrame(rows, "x string, y string, v double")
    both = base.withColumn("now", F.lit(False)).union(base.where("x = 'b' and y = 'd'").withColumn("now", F.lit(True)))
    got = {r.dimension: r.value for r in rc.shapley(both, ["x", "y"]).collect()}
    assert abs(sum(got.values()) - (8.0 - 4.0)) < 1e-9


def test_bootstrap_interval_holds_the_ratio(spark):
    rows = [(i, 1, "d", "s", i % 5 == 0, float(i % 10) + (5 if i % 5 == 0 else 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "row_id long, anomaly_id int, dimension string, segment string, now boolean, v double")
    r = rc.bootstrap_ratios(df, 300).first()
    assert (r.anomaly_id, r.dimension, r.segment) == (1, "d", "s") and r.low < 1.0 < r.high and r.high - r.low < 1.2
    assert rc.bootstrap_ratios(df.where("row_id < 0"), 10).count() == 0


def test_asof_equals_brute_force(spark):
    rng = random.Random(7)
    stamp = lambda n: f"2024-01-{1 + n // 24:02d} {n % 24:02d}:00:00"
    left = [(i, rng.choice("ab"), rng.randrange(400)) for i in range(60)] + [(99, "c", 5), (98, None, 5)]
    right = [(rng.choice("ab"), rng.randrange(400), rng.randrange(9)) for _ in range(25)] + [("a", 7, 1), ("a", 7, 8)]
    l_df = spark.createDataFrame([(i, k, stamp(n)) for i, k, n in left], "i int, k string, t string").withColumn("t", F.to_timestamp("t"))
    r_df = spark.createDataFrame([(k, stamp(n), v) for k, n, v in right], "k string, t string, v int").withColumn("t", F.to_timestamp("t"))
    for how in ("backward", "nearest"):
        want = {}
        for i, k, n in left:
            near = [(abs(m - n), m, -v) for x, m, v in right if x == k and (m <= n or how == "nearest")]
            want[i] = -min(near)[2] if near else None
        assert {r.i: r.v for r in rc.asof(l_df, r_df, "k", "t", ["v"], how).collect()} == want


def test_baseline_times_of_anomalies_outside_the_panel(spark):
    days = [f"2024-0{m}-{d:02d}" for m in (1, 2, 3) for d in (1, 9, 20)]
    panel = spark.createDataFrame([(x, 1.0) for x in days * 2], "t string, v double").withColumn("t", F.to_timestamp("t"))
    asked = {1: "2024-02-09", 2: "2024-02-10", 3: "2024-01-01", 4: "2025-01-01", 5: "2023-01-01", 6: "2024-01-09"}
    a = spark.createDataFrame(list(asked.items()), "anomaly_id int, t string").withColumn("t", F.to_timestamp("t"))
    got = {}
    for r in rc.baseline_times(panel, a, 4).collect():
        got.setdefault(r.anomaly_id, []).append(str(r.t)[:10])
    want = {i: [d for d in days if d < t][-4:] for i, t in asked.items()}
    assert {i: sorted(x) for i, x in got.items()} == {i: x for i, x in want.items() if x}


def test_ranks_with_ties_and_nulls(spark):
    rng = random.Random(2)
    values = [rng.choice([None, 1.0, 2.0, rng.random() * 5]) for _ in range(300)]
    df = rc.with_rank(spark.createDataFrame(list(enumerate(values)), "i int, m double"), "m", 8)
    known = sorted(v for v in values if v is not None)
    for r in df.collect():
        v = values[r.i]
        assert r.m is None if v is None else r.m == (known.index(v) + 1 + known.index(v) + known.count(v)) / 2


def test_validation_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "a long, b string")
    got = {r.rule: r.passed for r in quality.validate(empty).collect()}
    assert got["minimum_rows"] is False


def test_one_hot_leaves_no_category_out(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",), (None,), ("a",)], "s string")
    out = cleaning.encode(df, "s", "one_hot", rare=0.0, most=1)
    assert out.columns == ["s", "s_a", "s__OTHER_"]
    assert sorted((r[0] or "", r[1], r[2]) for r in out.collect()) == [("", 0, 0), ("a", 1, 0), ("a", 1, 0), ("b", 0, 1), ("c", 0, 1)]


def test_chunk_table_function_equals_the_operator(spark):
    docs = spark.createDataFrame([(1, "# One\nA b c.\n\n# Two\nD e."), (2, None), (3, "plain")], "doc_id long, text string")
    chunker.register(spark)
    docs.createOrReplaceTempView("_chunk_test")
    got = spark.sql("SELECT d.doc_id, c.* FROM _chunk_test d, LATERAL chunks(d.text) c").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, chunker.chunk_documents(docs, "doc_id", "text").collect()))


def test_stream_appends_once(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        jobs.run_once(jobs.read_table(spark, f"{tmp_path}/in"), jobs.append_index(f"{tmp_path}/out"), f"{tmp_path}/check")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 5


def test_shapley_of_many_dimensions_is_sampled_and_sums_to_the_impact(spark):
    """Seven dimensions with effects that add up: sampled orders give them exactly."""
    rng = random.Random(4)
    dims = [f"d{i}" for i in range(7)]
    rows = []
    for anomaly in (1, 2):
        for _ in range(300):
            x = [rng.randrange(2) for _ in dims]
            rows.append((anomaly, False, *x, 100.0))
        rows += [(anomaly, True, *([1] * 7), 100.0 + 10 * anomaly) for _ in range(5)]
    df = spark.createDataFrame(rows, "anomaly_id int, now boolean, " + ", ".join(f"{d} int" for d in dims) + ", v double")
    got = rc.shapley(df, dims, orders=8).collect()
    assert len(got) == 14 and all(abs(r.value) < 1e-9 for r in got)  # a flat baseline tells no dimension from another
    steps = rc.shapley_steps(dims, orders=8)
    assert all(abs(sum(w for _, d, w in steps if d == name) - 1) < 1e-9 for name in dims) and steps == rc.shapley_steps(dims, orders=8)
    few = spark.createDataFrame([(False, a, b, 10.0 * a + 2.0 * b) for a in (0, 1) for b in (0, 1)] + [(True, 1, 1, 15.0)], "now boolean, a int, b int, v double")
    got = {r.dimension: r for r in rc.shapley(few, ["a", "b"]).collect()}
    assert abs(got["a"].value - 5) < 1e-9 and abs(got["b"].value - 1) < 1e-9
    assert abs(sum(r.percent for r in got.values()) - 100) < 1e-9 and abs(got["a"].percent - 100 * 5 / 6) < 1e-9
    sampled = {r.dimension: r.value for r in rc.shapley(few, ["a", "b"], exact=0, orders=4).collect()}
    assert abs(sampled["a"] - 5) < 1e-9 and abs(sampled["b"] - 1) < 1e-9


def test_segments_have_exact_medians(spark):
    """Values of all sizes and signs, ties, one hot value, odd and even numbers of rows."""
    rng = random.Random(5)
    rows = []
    for month in range(1, 11):
        for _ in range(rng.randint(40, 60)):
            v = rng.choice([7.0, 7.0, rng.gauss(0, 1e-3), rng.gauss(0, 1e6), rng.randint(-3, 3) * 1.0])
            rows.append((f"2024-{month:02d}-01 00:00:00", rng.choice("ab"), rng.choice("xyz"), v))
    rows.append(("2024-03-01 00:00:00", "a", "x", None))
    panel = spark.createDataFrame(rows, "t string, p string, q string, v double").withColumn("t", F.to_timestamp("t"))
    anomalies = spark.createDataFrame([(1, "2024-10-01 00:00:00"), (2, "2024-09-01 00:00:00")], "anomaly_id int, t string").withColumn("t", F.to_timestamp("t"))
    got = {(r.anomaly_id, r.dimension, r.segment): r for r in rc.segments(panel, anomalies, ["p", "q"]).collect()}
    assert len(got) == 10
    for anomaly, month in ((1, 10), (2, 9)):
        for d, place in (("p", 1), ("q", 2)):
            for s in {r[place] for r in rows}:
                base = [r[3] for r in rows if month - 7 <= int(r[0][5:7]) < month and r[place] == s and r[3] is not None]
                now = [r[3] for r in rows if int(r[0][5:7]) == month and r[place] == s]
                r = got[anomaly, d, s]
                assert (r.size, r.now_rows) == (len(base), len(now)) and r.median == statistics.median(base)
                assert abs(r.actual - sum(now)) < 1e-6 and abs(r.mean - statistics.fmean(base)) < 1e-6 and abs(r.sd / statistics.stdev(base) - 1) < 1e-9


def test_bootstrap_of_all_anomalies_holds_the_ratio(spark):
    rows = [(i, f"2024-{1 + i % 9:02d}-01", "ab"[i % 2], float(i % 10) + (40 if i % 9 == 8 else 0)) for i in range(1800)]
    panel = spark.createDataFrame(rows, "row_id long, t string, s string, v double").withColumn("t", F.to_timestamp("t"))
    anomalies = spark.createDataFrame([(1, "2024-09-01"), (2, "2024-05-01")], "anomaly_id int, t string").withColumn("t", F.to_timestamp("t"))
    got = {(r.anomaly_id, r.segment): r for r in rc.bootstrap_all(panel, anomalies, ["s"], 200).collect()}
    assert set(got) == {(1, "a"), (1, "b")}  # the second anomaly's months are all alike: no impact to resample
    assert all(0.7 < r.low < 1.0 < r.high < 1.3 for r in got.values())


def test_bootstrap_draws_a_row_once_for_all_dimensions(spark):
    rows = [(i, f"2024-{1 + i % 3:02d}-01", "ab"[i % 2], None if i % 11 == 0 else "xyz"[i // 7 % 3], None if i % 13 == 0 else float(i % 10) + 0.25) for i in range(700)]
    panel = spark.createDataFrame(rows, "row_id long, t string, p string, q string, v double").repartition(3)
    drawn = rc._resampled(panel, ["t"], 50, ["p", "q"])
    assert "Generate" not in drawn._jdf.queryExecution().toString()  # no copy of a row for each dimension
    got = {(r.t, r.dimension, r.segment, r.round): (r.total, r.n) for r in drawn.collect()}
    hashes = {r.row_id: r.h for r in panel.selectExpr("row_id", "xxhash64(row_id) as h").collect()}
    limits = np.cumsum([np.exp(-1) / math.factorial(k) for k in range(9)])
    expected = {}
    for i, t, p, q, v in rows:
        for k in range(51 if v is not None else 0):
            x = (hashes[i] + k * 0x9E3779B97F4A7C15) % 2**64
            x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
            x = (x ^ (x >> 27)) * 0x94D049BB133111EB % 2**64
            w = int(np.searchsorted(limits, ((x ^ (x >> 31)) >> 11) / 2.0**53, side="right")) if k else 1
            for cell in ((t, "p", p, k), (t, "q", q, k)):
                total, n = expected.get(cell, (0.0, 0))
                expected[cell] = (total + w * v, n + w)
    assert got.keys() == expected.keys()
    assert all(got[c][1] == n and abs(got[c][0] - total) < 1e-9 for c, (total, n) in expected.items())
    high = [(i, "t", f"s{i}", float(i)) for i in range(rc.HELD_CELLS + 200)]  # more cells than a task holds
    many = spark.createDataFrame(high, "row_id long, t string, s string, v double").coalesce(1)
    whole = rc._resampled(many, ["t"], 2, ["s"]).where("round = 0").collect()
    assert len(whole) == len(high) and sum(r.total for r in whole) == sum(r[3] for r in high) and all(r.n == 1 for r in whole)


def test_reported_ranges(spark):
    df = spark.createDataFrame([(100.004, 0.5, 1.0, 2.0), (100.006, None, 3.0, 2.0), (float("nan"), -0.0004, 1.0, 1.0)], "contribution double, p_value double, expected_min double, expected_max double")
    got = [(r.invalid, r.p_value) for r in quality.checked(df).collect()]
    assert got == [([], 0.5), (["contribution", "expected_min, expected_max"], None), (["contribution", "p_value"], -0.0004)]


def test_sketches_merge_to_the_whole(spark):
    df = spark.range(20_000).selectExpr("id % 7 as part", "id % 5000 as k", "if(id % 10 = 0, null, double(id)) as v", "concat('s', id % 3) as s", "cast('nan' as double) as bad")
    whole = {r.column: r for r in sketches.estimates(sketches.sketch(df, ["k", "v", "s", "bad"])).collect()}
    parts = {r.column: r for r in sketches.estimates(sketches.merge(sketches.sketch(df, ["k", "v", "s", "bad"], ["part"]))).collect()}
    for found in (whole, parts):
        assert [found[c].nulls for c in ("k", "v", "s", "bad")] == [0, 2000, 0, 20_000] and found["s"].distinct == 3 and found["s"].quantiles is None
        assert abs(found["k"].distinct / 5000 - 1) < 3 * sketches.DISTINCT_ERROR and (found["v"].least, found["v"].greatest) == (1.0, 19_999.0)
        assert all(abs(q - x * 20_000) < 4 * sketches.RANK_ERROR * 20_000 for q, x in zip(found["v"].quantiles, (0.25, 0.5, 0.75), strict=True))
    assert found["bad"].distinct == 0 and found["bad"].quantiles is None
    got = {r.column: r["values"] for r in sketches.sample_values(df, ["k", "s"], {"k": 5000, "s": 3}).collect()}
    assert len(set(got["k"])) == 5 and sorted(got["s"]) == ["s0", "s1", "s2"]
    assert sketches.sample_values(df.where("k < 0"), ["k"], {"k": 0}).count() == 0


def test_hashed_embeddings_count_words_within_rows(spark, monkeypatch):
    texts = [(1, "One two, two THREE three three äö"), (2, None), (3, " a . "), (4, "one " * 3000 + "two")]
    again = [(5, "one two"), (5, "two four"), (5, None), (None, "one one"), (None, "two")]
    expected = {}
    for k, t in texts + again:
        for w in re.findall(r"\w{2,}", (t or "").lower()):
            cells = expected.setdefault(k, collections.Counter())
            cells[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 384] += 1
    for rows, plain, most in ((texts, True, 10), (texts + again, False, 10), (texts + again, False, 1)):
        monkeypatch.setattr(retrieval, "BROADCAST_KEYS", most)
        df = spark.createDataFrame(rows, "k long, x string")
        out = retrieval.hashed_embeddings(df, ["k"], "x")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert not plain or ("Exchange" not in plan and "Aggregate" not in plan)  # a task holds one text, no table of words
        got = {(r.k, r.bucket): r.weight for r in out.collect()}
        cells = {(k, b): n / math.sqrt(sum(x * x for x in c.values())) for k, c in expected.items() if k in dict(rows) for b, n in c.items()}
        assert got.keys() == cells.keys() and all(abs(got[c] - x) < 1e-12 for c, x in cells.items())
