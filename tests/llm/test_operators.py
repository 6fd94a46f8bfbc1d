"""The corpus operators against brute force, with nulls, empty and long texts, ties, repeats and clashing columns."""

import gzip
import hashlib
import html
import random
import re
import textwrap
import time
from collections import Counter
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lakesignal.llm import bpe, common, html_text, knn_join, license_scan, near_dup, packing, quality_cnn, quality_rules, queries, url_filter, warc

from ..helpers import spark_rows, sql_rows

DOCS = "doc_id long, text string, words string, stats string, score double"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y", 0.5) for i, t in enumerate(texts)], DOCS)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, sf_dir, duck, name):
    assert spark_rows(queries.QUERIES[name](spark, sf_dir)) == sql_rows(duck, queries.SQL[name])


def test_work_folder_is_shared_or_local_and_can_be_cleaned(spark):
    df = common.settle(spark.range(3), "x")
    assert df.count() == 3
    common.clean(spark)
    with pytest.raises(Exception, match="(?i)not exist|not found"):
        df.count()
    far = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.work_dir(far)


# --- 1 quality rules ------------------------------------------------------------------------------------------


def brute_counts(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def hard_texts():
    rng = random.Random(2)
    alphabet = ["a", "b", "c", "é", "日", "#", "|", "\n", "\n", " ", "  ", "\t", " ", "A!"]
    texts = [None, "", " \n\t", "one", "a a a a", "a b a b a b", "x\n\nx\nx", "long " * 9000]
    return texts + [" ".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(150)]


def test_quality_counts_equal_brute_force(spark):
    texts = hard_texts()
    out = quality_rules.quality_rules(docs_of(spark, texts), quality_rules.DecisionList())
    assert out.columns == [*docs_of(spark, []).columns, "quality_rules"]
    for r in out.collect():
        q = r.quality_rules
        n = brute_counts(texts[r.doc_id])
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == n, texts[r.doc_id]
        assert q.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0]) and q.kept == (not q.base_failed)


def test_rules_are_learned_and_applied_in_order(spark):
    good = ["word%d is here and there %s." % (i, " ".join(f"w{i}x{k}" for k in range(60))) for i in range(60)]
    junk = [" ".join(f"v{i}x{k}###" for k in range(70)) for i in range(40)]
    docs = docs_of(spark, good + junk)
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(100)], "doc_id long, quality int, toxic int")
    rules = quality_rules.fit(docs, labels)
    assert rules.rules and "reject if" in str(rules)
    kept = {r.doc_id for r in quality_rules.keep_good(docs, labels).collect()}
    assert kept == set(range(60))


def test_learning_without_both_labels_keeps_all(spark):
    assert quality_rules.learn([(1.0, 1), (2.0, 1)], ["a"]).rules == []
    empty = docs_of(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_rules.keep_good(empty, labels).count() == 0


def test_native_plans_have_no_python(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for df in (quality_rules.quality_rules(docs, quality_rules.DecisionList()), license_scan.scan(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


# --- 2 licence scan -------------------------------------------------------------------------------------------


def test_licences_are_found_and_others_left_alone(spark):
    texts = [
        "Text.\nLicensed under the Apache License, Version 2.0.\nMore text.", "Released under the MIT License.", "All rights reserved.",
        "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.",
        "He lost his license.", "Nothing here.", None, "", "x " * 5000 + "\nAll rights reserved.",
    ]
    got = {(r.doc_id, r.place): (r.family, r.confirmed) for r in license_scan.scan(docs_of(spark, texts)).collect()}
    assert got == {
        (0, 1): ("apache-2.0", True), (1, 0): ("mit", True), (2, 0): ("all-rights-reserved", True), (3, 0): ("cc-by-nc", True),
        (4, 0): ("gpl", True), (5, 0): ("unknown", False), (9, 1): ("all-rights-reserved", True),
    }


def test_other_licences_are_unknown(spark):
    """Some that the model was trained with, some that it wasn't."""
    texts = [
        "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: EPL-2.0", "Released under the ISC License.",
        "Licensed under the Common Development and Distribution License, version 1.0.", "Released under the Microsoft Public License.",
    ]
    got = {(r.doc_id, r.family, r.confirmed) for r in license_scan.scan(docs_of(spark, texts)).collect()}
    assert got == {(i, "unknown", False) for i in range(5)}


def brute_lines(text, model):
    """(place, family, probability) of the single lines of a text that the model reports, every line looked at."""
    out = set()
    for place, line in enumerate((text or "").split("\n")):
        words = license_scan.ascii_words(line)
        p = model.probabilities(words)
        best = max(p)
        at = p.index(best)
        confirmed = any(
            len(set(words) & set(own)) >= license_scan.TEMPLATE_SHARE * len(set(own))
            for own in map(license_scan.ascii_words, license_scan.NOTICES[model.families[at]])
        )
        named = any(a in line.lower() for a in license_scan.ANCHORS) or re.search(license_scan.NAMES, line, re.A)
        reached = best >= model.least[at]
        if reached or named:
            out.add((place, model.families[at] if reached and (confirmed or best >= license_scan.SURE) else "unknown", round(best, 4)))
    return out


def test_licence_lines_equal_brute_force(spark):
    """Every line of every text is scored by the model itself; lines stand alone, so no wrapped run forms."""
    model, rng = license_scan.train(), random.Random(4)
    notices = [n for ns in license_scan.NOTICES.values() for n in ns] + license_scan.OTHERS + [b for bs in license_scan.BODIES.values() for b in bs]
    words = sorted({w for g in model.weights for w in g.split()})
    lines = notices + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 12))) for _ in range(150)] + ["plain words only"] * 30
    rng.shuffle(lines)
    texts = ["\n\n".join(lines[i : i + 9]) for i in range(0, len(lines), 9)] + [None, "", "\n\n"]
    got = {}
    for r in license_scan.scan(docs_of(spark, texts), model).collect():
        got.setdefault(r.doc_id, set()).add((r.place, r.family, round(r.probability, 4)))
    assert got == {i: brute for i, t in enumerate(texts) if (brute := brute_lines(t, model))}


def test_licence_model_is_calibrated_on_unseen_notices():
    figures = license_scan.held_out_figures()
    assert figures["precision_sure"] >= 0.95 and figures["recall_sure"] >= 0.5 and figures["precision_least"] >= 0.9


def test_licence_rows_repeat_and_ties(spark):
    df = docs_of(spark, ["All rights reserved."]).union(docs_of(spark, ["All rights reserved."]))
    assert [(r.doc_id, r.family) for r in license_scan.scan(df).collect()] == [(0, "all-rights-reserved")]
    assert license_scan.scan(df.where("doc_id < 0")).count() == 0
    families = list(license_scan.NOTICES)
    tied = license_scan.Model(families, {"zzz": [5.0] * len(families)}, [-1.0] * len(families), [0.5] * len(families))
    assert [r.family for r in license_scan.scan(docs_of(spark, ["zzz"]), tied).collect()] == [families[0]]


def test_every_notice_is_found_whole_and_wrapped(spark):
    notices = [(f, n) for f, ns in license_scan.NOTICES.items() for n in ns]
    whole = {r.doc_id: r for r in license_scan.scan(docs_of(spark, [n for _, n in notices])).collect() if r.family != "unknown"}
    assert {i: whole[i].family for i in whole} == {i: f for i, (f, _) in enumerate(notices)}
    assert all(r.confirmed for r in whole.values())
    wrapped = ["Some text.\n\n" + textwrap.fill(n, 30, break_on_hyphens=False) + "\n\nMore." for _, n in notices]
    found = {(r.doc_id, r.family) for r in license_scan.scan(docs_of(spark, wrapped)).collect() if r.confirmed}
    assert {(i, f) for i, (f, _) in enumerate(notices)} <= found
    names = ["GPL v3", "CC0 1.0 Universal", "BSD", "MIT", "Apache", "CC BY"]
    assert {r.doc_id for r in license_scan.scan(docs_of(spark, names)).collect()} == set(range(len(names)))


def test_words_that_rule_lines_out_lose_none():
    model = license_scan.train()
    need, rng = set(license_scan.needed_words(model)), random.Random(1)
    words = sorted({w for g in model.weights for w in g.split()} - need)
    grams = sorted(g for g in model.weights if not set(g.split()) & need)
    for texts in [grams, words] + [rng.sample(grams, 60) for _ in range(50)]:
        p = model.probabilities(" ".join(texts).split())
        assert all(x < least for x, least in zip(p, model.least, strict=True))


# --- 3 kNN join -----------------------------------------------------------------------------------------------


def brute_knn(rows, k):
    usable = [(i, np.floor(256 * np.array(v, float))) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = Counter()
    for n, (q, a) in enumerate(usable):
        if q % 5 == 0:
            scored = [(-int((a[: len(b)] * b[: len(a)]).sum()), i) for m, (i, b) in enumerate(usable) if m != n]
            out.update((q, rank, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k], 1))
    return out


@pytest.mark.parametrize("cell_rows", [4096, 15])
def test_knn_join_equals_brute_force(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(knn_join, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(knn_join, "BLOCK_ROWS", cell_rows)
    monkeypatch.setattr(knn_join, "GROUP_ROWS", 7)
    monkeypatch.setattr(knn_join, "SLICE", 5)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8))
    rows = [(i, [float(x) for x in centres[i % 6] + 0.1 * rng.normal(size=8)]) for i in range(180)]
    rows += [(i, [0.5] * 8) for i in range(200, 260)]  # many ties
    rows += [(300, None), (301, [float("nan")] * 8), (302, [None] + [1.0] * 7), (303, [float("inf")] * 8), (305, []), (310, [0.25, 0.5]), (311, [9.0] * 8)]
    df = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], "vec_id long, embedding array<double>, cell int, score int, uid int")
    got = Counter(tuple(r) for r in knn_join.knn_join(df, F.col("id") % 5 == 0, k=4).collect())
    assert got == brute_knn(rows, 4)
    assert knn_join.knn_join(df.where("vec_id < 0"), F.col("id") % 5 == 0).count() == 0


def test_knn_join_with_hot_query_ids_and_several_pivots(spark, monkeypatch):
    """Rows of one id, equal ones too, are queries and candidates each."""
    monkeypatch.setattr(knn_join, "CELL_ROWS", 2)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(1, 120) if i % 5]
    for i in range(0, 40, 5):  # each id on many rows, far from all others
        rows += [(i, [8.0 if j == i // 5 else 0.0 for j in range(8)])] * 20
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = Counter(tuple(r) for r in knn_join.knn_join(df, F.col("id") % 5 == 0, k=4).collect())
    assert got == brute_knn(rows, 4)


def test_knn_join_scores_few_rows_of_clustered_vectors(spark, monkeypatch):
    monkeypatch.setattr(knn_join, "CELL_ROWS", 20)
    rng = np.random.default_rng(5)
    centres = 3 * rng.normal(size=(20, 16))
    rows = [(i, [float(x) for x in centres[i % 20] + 0.1 * rng.normal(size=16)]) for i in range(800)]
    df, report = spark.createDataFrame(rows, "vec_id long, embedding array<double>"), {}
    got = Counter(tuple(r) for r in knn_join.knn_join(df, F.col("id") % 5 == 0, k=4, report=report).collect())
    assert got == brute_knn(rows, 4) and report["scored"] < 0.5


# --- 4 packing ------------------------------------------------------------------------------------------------


def brute_pack(sizes, lengths, overhead, double_at):
    """The cheapest of best fit with each length and of best fit with the length of least cost for its possible contents."""
    price = {n: overhead + n + n * n / double_at for n in lengths}

    def worth(i, n):
        room = n
        for s in sizes[i:]:
            room -= s if s <= room else 0
        return price[n] / (n - room), n

    def run(choose):
        bins, place = [], []
        for i, s in enumerate(sizes):
            fits = [b for b in range(len(bins)) if bins[b][0] - bins[b][1] >= s]
            if not fits:
                bins.append([choose(i, s), 0])
            b = min(fits, key=lambda b: (bins[b][0] - bins[b][1], b)) if fits else len(bins) - 1
            place.append(b)
            bins[b][1] += s
        return place, [min(x for x in lengths if x >= u) for _, u in bins]

    ways = [run(lambda i, s: min((n for n in lengths if n >= s), key=lambda n: worth(i, n)))]
    ways += [run(lambda i, s, n=n: min(x for x in lengths if x >= max(n, s))) for n in lengths]
    return min(ways, key=lambda w: sum(price[n] for n in w[1]))


def test_packing_equals_brute_force():
    rng = random.Random(6)
    for _ in range(60):
        top = rng.choice([12, 40, 64])
        sizes = sorted((rng.randint(1, top) for _ in range(rng.randint(1, 80))), reverse=True)
        double_at = rng.choice([64, 256, 100_000])
        bins, offsets, lengths = packing.pack(sizes, (16, 32, 64), 4, double_at)
        assert (bins, lengths) == brute_pack(sizes, (16, 32, 64), 4, double_at)


def test_several_lengths_together_cost_less_than_any_alone():
    sizes = [1000] * 3000 + [700] * 3000
    _, _, lengths = packing.pack(sizes)
    assert {1024, 4096} <= set(lengths)
    for n in packing.LENGTHS:
        _, _, used = packing.best_fit(sizes, lambda i, n=n: n)
        alone = sum(packing.cost(min(x for x in packing.LENGTHS if x >= u)) for u in used)
        assert sum(map(packing.cost, lengths)) < 0.98 * alone


def test_packing_of_one_document_per_shard_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_DOCS", 1)
    rows = [(i, "w " * n, 1, 2, 3, 4) for i, n in ((0, 40_000), (0, 40_000), (None, 3), (2, 0))]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int, shard int, piece int, rest int")
    got = packing.best_fit_packing(df).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.n_tokens) for r in got) == Counter(
        [(0, k, 8192 * k, min(8192, 40_000 - 8192 * k)) for k in range(5)] * 2 + [(None, 0, 0, 3), (2, 0, 0, 0)]
    )
    used = Counter((r.seq_id, r.seq_offset) for r in got if r.n_tokens)
    assert max(used.values()) == 1 and {r.seq_len for r in got if r.n_tokens == 8192} == {8192}


def test_packed_pieces_cover_documents_and_fit(spark):
    texts = [None, "", "a b c", "w " * 30_000, "x " * 8192, *("y " * n for n in range(1, 300, 7)), "same text", "same text"]
    df = docs_of(spark, texts).union(docs_of(spark, ["a b c"] * 3))
    rows = packing.best_fit_packing(df).collect()
    assert sum(r.n_tokens for r in rows) == sum(len((t or "").split()) for t in texts) + 9
    seqs = {}
    for r in rows:
        if r.n_tokens:
            seqs.setdefault(r.seq_id, []).append(r)
        else:
            assert r.seq_id is None and r.doc_id in (0, 1)
    for parts in seqs.values():
        parts.sort(key=lambda r: r.seq_offset)
        ends = [0] + [r.seq_offset + r.n_tokens for r in parts]
        assert [r.seq_offset for r in parts] == ends[:-1] and ends[-1] <= parts[0].seq_len
        assert parts[0].seq_len == min(n for n in packing.LENGTHS if n >= ends[-1])
    long = sorted((r.start, r.n_tokens) for r in rows if r.doc_id == 3)
    assert long[0] == (0, 8192) and sum(n for _, n in long) == 30_000
    assert packing.best_fit_packing(docs_of(spark, [])).count() == 0


# --- 5 WARC ---------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "é" * 300 + "</p>"
    tricky = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc" + "y" * 200
    long, other = "z" * 3_000_000, "o" * 200
    rows = [
        (1, "http://a.org/x?q#f", big), (2, None, big), (3, "no scheme\r\nX: y", None), (4, "http://b/", ""), (5, "http://c", tricky), (6, "u", "s" * 50),
        (7, "u", "s" * 50), (None, "u", big), (None, "u", "z"), (8, "v", other), (8, "v", other), (9, "w", other), (9, "w", other), (10, "l", long),
    ]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, payload string")
    warc.write_warc(df, f"{tmp_path}/w")
    captures = warc.assemble(warc.read_warc(spark, f"{tmp_path}/w")).collect()
    assert len({r.capture_id for r in captures}) == len(rows)
    got = Counter((r.metadata.fields.get("id"), r.response.type, r.metadata.fields.get("refers-to-id"), r.response.payload_bytes, r.response.digest) for r in captures)
    want = Counter()
    for i, _, body in rows:
        payload = (body or "").encode()
        first = min((j for j, _, other_body in rows if j is not None and other_body == body), default=None)
        revisit = len(payload) >= 100 and first is not None and i != first
        want[None if i is None else str(i), "revisit" if revisit else "response", str(first) if revisit else None, len(payload), hashlib.sha256(payload).hexdigest()] += 1
    assert got == want
    by_id = {r.metadata.fields.get("id"): r for r in captures}
    assert bytes(by_id["5"].response.payload).decode() == tricky and bytes(by_id["10"].response.payload).decode() == long
    assert by_id["1"].request.type == "request" and by_id["1"].response.target_uri == "http://a.org/x?q#f"
    assert by_id["2"].response.refers_to == by_id["1"].capture_id and by_id["9"].response.refers_to is None  # page 8 stands twice


def test_foreign_archive_with_links_either_way(spark, tmp_path):
    def record(kind, rid, extra, block):
        head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{rid}>\r\n{extra}Content-Type: application/http\r\nContent-Length: {len(block)}\r\n\r\n"
        return gzip.compress(head.encode() + block + b"\r\n\r\n")

    body = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n\xff\xfe binary"
    data = record("response", "r1", "WARC-Concurrent-To: <q1>\r\n", body) + record("request", "q1", "", b"GET / HTTP/1.1\r\n\r\n") + record("response", "r2", "", body)
    (tmp_path / "a.warc.gz").write_bytes(data)
    got = {r.capture_id: r for r in warc.assemble(warc.read_warc(spark, str(tmp_path))).collect()}
    assert set(got) == {"r1", "r2"} and got["r1"].request.record_id == "q1" and got["r2"].request is None
    assert bytes(got["r1"].response.payload) == b"\xff\xfe binary"


def test_truncated_archive_raises(spark, tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 99\r\n\r\nabc"))
    with pytest.raises(Exception, match="ends within a record"):
        warc.read_warc(spark, str(tmp_path)).collect()


def test_empty_table_gives_empty_archive(spark, tmp_path):
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), f"{tmp_path}/w")
    assert warc.assemble(warc.read_warc(spark, f"{tmp_path}/w")).count() == 0


# --- 6 BPE ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block_words", [bpe.BLOCK_WORDS, 5, 1])
def test_bpe_equals_the_library(spark, monkeypatch, block_words):
    monkeypatch.setattr(bpe, "BLOCK_WORDS", block_words)
    monkeypatch.setattr(bpe, "OUT_BYTES", 300)
    monkeypatch.setattr(bpe, "TASK_WORDS", 50)
    rng = random.Random(8)
    bits = ["the ", "ing", "é", " ", "  ", "\n", "'s", "<|endoftext|>", "12", "½", "日本", "🎉", "́", "\x1c", "\x85", "\u2003", "!!", "ʰ", "zq" * 40, "\ufffd", "\0"]
    texts = [None, "", " ", "ab" * 20_000] + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(120)]
    lib = Tokenizer.from_file(VOCABULARY)
    v = spark.sparkContext.broadcast(bpe.Vocabulary.load(VOCABULARY))
    rows = [(i, t, 1, 2, 3) for i, t in enumerate(texts)] + [(None, "x y", 1, 2, 3)] * 3
    df = spark.createDataFrame(rows, "key long, text string, block int, number int, word int")
    n = 0
    for r in bpe.decode(bpe.encode(df, v), v).collect():
        text = "x y" if r.key is None else texts[r.key] or ""
        ids = lib.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids and r.text == lib.decode(ids, skip_special_tokens=False)
        n += 1
    assert n == len(texts) + 3
    both = bpe.round_trip(df, v).collect()
    assert Counter(map(tuple, both)) == Counter(map(tuple, bpe.decode(bpe.encode(df, v), v).collect()))
    assert bpe.encode(df.where("key < 0"), v).count() == 0


def test_bpe_query_equals_the_library(spark, sf_dir):
    lib = Tokenizer.from_file(VOCABULARY)
    got = {r.doc_id: r for r in bpe.op6_bpe(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = lib.encode(d.text or "", add_special_tokens=False).ids
        text = lib.decode(ids, skip_special_tokens=False)
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        assert tuple(got[d.doc_id])[1:] == want


# --- 7 URL filter ---------------------------------------------------------------------------------------------


def test_urls(spark):
    cases = [
        (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("xxx", "", "", None, "block"),
        ("http://A.Example.ORG/es/x?y", "a.example.org", "/es/x", "example.org/es/", "block"),
        ("http://example.org/en/17#a", "example.org", "/en/17", "example.org/en/1", "block"),
        ("http://example.org", "example.org", "", None, "allow"), ("http://b.org/porn", "b.org", "/porn", "org/", "allow"),
        ("http://notexample.com/de/1", "notexample.com", "/de/1", "com/de/", "block"), ("ftp://x.net?q://y/", "x.net", "", None, "allow"),
        ("http://x.net/Porn-1", "x.net", "/Porn-1", None, "block"), ("http://x.net/pornographer", "x.net", "/pornographer", None, "allow"),
        ("http://x.net/casino/casino", "x.net", "/casino/casino", None, "allow"), ("http://x.net/casino?free", "x.net", "/casino", None, "block"),
        ("http://x.net/?q=%20porn", "x.net", "/", None, "block"), ("http://x.net/%50orn%2fa", "x.net", "/%50orn%2fa", None, "block"),
        ("http://x.net/adult_x", "x.net", "/adult_x", None, "block"), ("http://adult-x.net/", "adult-x.net", "/", None, "block"),
        ("http://adultx.net/", "adultx.net", "/", None, "allow"), ("http://free-bets.net/", "free-bets.net", "/", None, "block"),
        ("http://x.net/bet/bets", "x.net", "/bet/bets", None, "allow"), ("http://x.net/pornos", "x.net", "/pornos", None, "block"),
        ("http://x.net/%ff%zzporn%", "x.net", "/%ff%zzporn%", None, "allow"), ("http://x.net/%ffporn", "x.net", "/%ffporn", None, "block"),
        ("http://x.net/" + "a/" * 200_000 + "xxx", "x.net", "/" + "a/" * 200_000 + "xxx", None, "block"),
    ]
    df = spark.createDataFrame([(i, c[0], "h") for i, c in enumerate(cases)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.url_filter(df, url_filter.OP7_RULES).collect()}
    assert got == {i: c[1:] for i, c in enumerate(cases)}
    twice = url_filter.url_filter(df.union(df), url_filter.OP7_RULES)
    assert twice.count() == 2 * len(cases) and url_filter.url_filter(df.where("page_id < 0")).count() == 0
    assert {r.verdict for r in url_filter.url_filter(df, strict=(), soft=()).collect()} == {"allow"}


def test_url_rules_of_equal_length(spark):
    """The longer host wins, then block before allow."""
    df = spark.createDataFrame([(1, "http://a.bc/xy")], "page_id long, url string")
    rule = url_filter.Rule
    for rules, want in (
        ([rule("allow", "a.bc", "/"), rule("block", "bc", "/xy")], ("a.bc/", "allow")),
        ([rule("allow", "a.bc", "/"), rule("block", "a.bc", "/")], ("a.bc/", "block")),
    ):
        for order in (rules, rules[::-1]):
            (row,) = url_filter.url_filter(df, order).collect()
            assert (row.rule, row.verdict) == want


# --- 8 near-duplicates ----------------------------------------------------------------------------------------


def brute_components(texts, width, percent):
    sets = []
    for t in texts:
        w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in WORD.findall(t or "")]
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in range(len(texts))}


def near_texts():
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(4000)]
    texts = [None, "", "  ", "one", "One", "one two", "É", "é", "a\u00a0b c d e", "A\u00a0b c d e"]
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(5, 150))]
        for _ in range(rng.choice([1, 2, 3, 12])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy).upper() if rng.random() < 0.2 else " ".join(copy))
    base = [rng.choice(vocabulary) for _ in range(160)]  # a crowded star: copies like the base, less like each other
    for _ in range(90):
        copy = list(base)
        for _ in range(rng.choice([3, 4, 5])):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates_equal_brute_force(spark, width):
    texts = near_texts()
    got = near_dup.near_duplicates(docs_of(spark, texts), width).collect()
    assert {r.id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute_components(texts, width, 80)


def test_rows_of_one_id_with_several_texts_are_one_document(spark):
    rng = random.Random(3)
    base = [" ".join(f"v{rng.randrange(9999)}" for _ in range(40)) for _ in range(4)]
    near = [b.rsplit(" ", 1)[0] + " other" for b in base]
    rows = [(5, base[0]), (5, base[1]), (5, base[1]), (2, near[0]), (7, near[1]), (9, base[2]), (9, None), (11, near[2]), (1, base[3])]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, digest int, label int")
    got = Counter((r.id, r.component_id, r.kept) for r in near_dup.near_duplicates(df, 4).collect())
    assert got == Counter([(5, 2, False)] * 3 + [(2, 2, True), (7, 2, False), (9, 9, True), (9, 9, True), (11, 9, False), (1, 1, True)])


def test_near_duplicates_of_very_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(200_000))
    df = docs_of(spark, [long, long + " end", "z" * 1_000_000, long[: len(long) // 2]])
    assert {(r.id, r.component_id) for r in near_dup.near_duplicates(df, 5).collect()} == {(0, 0), (1, 0), (2, 2), (3, 3)}


def test_keep_one_leaves_columns_and_null_ids(spark):
    df = docs_of(spark, ["a b c d e f g"] * 3 + [None, ""]).union(spark.createDataFrame([(None, "a b c d e f g", "", "", 0.0)], DOCS))
    out = near_dup.keep_one(df)
    assert out.columns == df.columns and sorted((r.doc_id for r in out.collect()), key=str) == [0, 3, 4, None]
    assert near_dup.keep_one(df.where("doc_id < 0")).count() == 0


def test_components_of_a_long_chain(spark):
    order = list(range(500))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame(list(zip(order, order[1:], strict=False)) + [(1000, 1001)], "a long, b long").repartition(7)
    got = near_dup.components(edges).collect()
    assert {r.label for r in got if r.node < 500} == {0} and {r.label for r in got if r.node >= 1000} == {1000} and len(got) == 502


# --- 9 classifier ---------------------------------------------------------------------------------------------


def test_network_gradient_is_right():
    net = quality_cnn.Network.start()
    for p in net.params():
        p += 0.01
    data, y = [quality_cnn.to_bytes("hello world " * 40), quality_cnn.to_bytes("ZZ!! " * 9)], np.array([1.0, 0.0], np.float32)

    def loss():
        p = net.scores(["hello world " * 40, "ZZ!! " * 9])
        return -float(np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))

    grads = net.gradient(data, y)
    for p, g in zip(net.params(), grads, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        eps, old = 2e-3, p[at]
        p[at] = old + eps
        up = loss()
        p[at] = old - eps
        down = loss()
        p[at] = old
        assert abs((up - down) / (2 * eps) - g[at]) < 0.05 * abs(g[at]) + 1e-3


def test_classifier_holds_out_and_learns(spark, sf_dir):
    rows = quality_cnn.op9_quality_cnn(spark, sf_dir).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) >= 0.8


def test_classifier_on_odd_rows(spark):
    net = quality_cnn.train([], [])
    docs = docs_of(spark, [None, "", "x" * 200_000])
    scores = [r[0] for r in docs.select(quality_cnn.score(docs, net)).collect()]
    assert len(scores) == 3 and all(0 <= s <= 1 for s in scores) and scores[0] == scores[1]
    whole = "clean text here. " * 4000
    assert not np.array_equal(net.features(whole), net.features(whole + "ZZZ!!!###" * 200))


def test_classifier_keeps_columns_repeated_rows_and_empty_tables(spark):
    good, bad = "A clean sentence about the town and its river. " * 8, "$$$ BUY NOW ### !!! " * 12
    docs = docs_of(spark, [good, bad] * 25 + [None, ""])
    docs = docs.union(docs.where("doc_id < 2"))
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(50)], "doc_id long, quality int")
    kept = quality_cnn.keep_good(docs, labels)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.where("doc_id < 50").collect())
    assert ids == Counter(list(range(0, 50, 2)) + [0])
    assert quality_cnn.keep_good(docs.where("doc_id < 0"), labels, docs).count() == 0


# --- 10 HTML --------------------------------------------------------------------------------------------------

PARAGRAPH = "This is a sentence of the article that is long enough to be text. " * 3


def test_html_keeps_the_article_only():
    page = f"""<html><head><title>T</title><style>p{{}}</style></head><body class="no-sidebar"><header><h1>Site</h1></header>
      <nav><ul><li><a href=x>Menu</a></li></ul></nav><div class="cookie-notice">We use cookies.</div>
      <script>var a="</p>";</script><!-- c --><article><h2>Title</h2><p>{PARAGRAPH}<br>A &amp; B&nbsp;&lt;c&gt; &#233;</p>
      <form>Name</form><p>Second <b>bold</b>   text.</p></article><aside>Related</aside>
      <section id="comments"><p>{PARAGRAPH}</p></section><footer>&copy; me</footer></body></html>"""
    want = f"Title {PARAGRAPH.strip()} A & B <c> é Second bold text."
    assert html_text.main_text(page) == want


def test_html_without_article_element():
    menu = "".join(f"<li><a href=x>Item {i}</a></li>" for i in range(40))
    page = f"<body><div id=top><ul>{menu}</ul></div><div><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p></div><div>Short note</div></body>"
    assert html_text.main_text(page) == f"{PARAGRAPH.strip()} {PARAGRAPH.strip()}"


def test_html_keeps_every_line_of_all_articles():
    cells = "<table><tr><td>A1</td><td>B1</td></tr><tr><td>A2</td><td>B2</td></tr></table>"
    first = f"<article><header><div>Title</div></header><div><p>{PARAGRAPH}</p></div><div>Short.</div>{cells}<figure><figcaption>Caption</figcaption></figure></article>"
    second = "<article><div class='comment-policy'>Second, small.</div><div class='share'>Share it</div><blockquote>Quote</blockquote></article>"
    want = f"Title {PARAGRAPH.strip()} Short. A1 B1 A2 B2 Caption Second, small. Quote"
    assert html_text.main_text(f"<body><nav>Menu</nav>{first}{second}<footer>End</footer></body>") == want


def test_html_keeps_tables_and_short_sections_without_article():
    long = f"<div>{f'<p>{PARAGRAPH}</p>' * 20}</div>"
    table = "<table><tr><td>A1</td><td>B1</td></tr></table><section>Short.</section>"
    page = f"<body>{long}<div><p>{PARAGRAPH}</p>{table}</div></body>"
    assert html_text.main_text(page) == " ".join([PARAGRAPH.strip()] * 21 + ["A1 B1 Short."])


def test_html_line_blocks_decide(spark, sf_dir):
    """Without the runs between surges and dives every page of the table would keep menus, adverts and footers."""
    pages = [r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    assert pages
    for page in pages:
        lines = [x for x in html_text.lines_of(page) if x[0]]
        kept = html_text.main_text(page)
        article = re.sub(r"<script.*?</script>|<style.*?</style>", " ", re.search("(?s)<article>(.*)</article>", page)[1], flags=re.S)
        want = re.sub(r"\s+", "", html.unescape(re.sub("<[^>]*>", "", article)))
        assert re.sub(r"\s+", "", kept) == want
        assert " ".join(t for t, _, _ in lines) != kept
    menu = "".join(f"<li><a href=x>Item {i}</a></li>" for i in range(40))
    bare = f"<div><ul>{menu}</ul></div><div><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p></div><div><p>Sponsor.</p></div>"
    assert html_text.main_text(bare) == f"{PARAGRAPH.strip()} {PARAGRAPH.strip()}"


def brute_runs(weights, surge):
    sums = [sum(weights[i : i + html_text.WINDOW]) for i in range(len(weights))]
    out = []
    for i in range(len(sums)):
        if sums[i] and (i == 0 or not sums[i - 1]):
            end = min((j for j in range(i, len(sums)) if not sums[j]), default=len(sums))
            if any(x >= surge for x in sums[i:end]):
                out.append((min(j for j in range(i, end) if weights[j]), end))
    return out


def test_html_runs_equal_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        weights = [rng.choice([0, 0, 0, 1, 30, 90]) for _ in range(rng.randint(0, 30))]
        surge = rng.choice([1, 40, 80])
        assert html_text.runs(weights, surge) == brute_runs(weights, surge)


def test_html_classes_of_paragraphs_and_lone_links_in_articles():
    page = "<article><p>One</p><p class='advert'>BUY NOW</p><section class='related-work'>Related work</section><div></div><div><a href=x>Only a link</a></div><div></div><ul><li class=ad>x<li>y</ul></article><p>outside"
    assert html_text.main_text(page) == "One Related work Only a link y"


@pytest.mark.parametrize("bad", ['<a "', "<a b='", '<a b="x', "<p x=", "<!--", "<![", "<div>", "</div>", "<li>", "<", "a < b ", "<script>", "&", "<p>a</p>"])
def test_html_broken_pages_of_a_megabyte_take_no_long_time(bad):
    start = time.monotonic()
    html_text.main_text("<p>" + bad * (1_000_000 // len(bad)))
    assert time.monotonic() - start < 10  # seconds, with room for a busy machine; quadratic scans took minutes


def test_html_long_page_is_read_whole():
    body = "".join(f"<p>{PARAGRAPH}{i}</p>" for i in range(5000))
    assert html_text.main_text(f"<body>{body}</body>") == " ".join(f"{PARAGRAPH}{i}" for i in range(5000))


@pytest.mark.parametrize("page", [None, "", " ", "<", "<p", "<script>", "<!-- x", "<div><nav>a</nav>", "</p></div>", "<a b='c>"])
def test_html_odd_pages_give_text(page):
    assert isinstance(html_text.main_text(page), str)


def test_html_rows(spark):
    df = spark.createDataFrame([(1, "u", f"<article><p>{PARAGRAPH}</p></article>", "t"), (2, None, None, "t"), (1, "u", "", "t")], "page_id long, url string, html string, text string")
    got = sorted((r.page_id, r.n_chars) for r in html_text.html_text(df).collect())
    assert got == [(1, 0), (1, len(PARAGRAPH.strip())), (2, 0)]
    twice = html_text.html_text(df.union(df).union(spark.createDataFrame([(None, None, "x", "t")], df.schema)))
    assert twice.count() == 7 and twice.columns == ["page_id", "url", "text", "n_chars"]
    assert html_text.html_text(df.where("page_id < 0")).count() == 0
