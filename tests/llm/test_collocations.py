"""Collocations against plain counting, the automaton against all substrings, with hard rows."""

import random
import re
from collections import Counter

import pytest

from lakesignal.llm import collocations as co

DOCS = "doc_id long, text string, lang string, phrase string, n long, score double, h long"


def brute(rows, least, most=5, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, most + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    out = []
    for (lang, p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        if any(f[x] >= a for x in f if x[0] == lang and len(x[1]) > len(p) and any(x[1][i : i + len(p)] == p for i in range(len(x[1]) - len(p) + 1))):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
        score, _, left, right = min(cuts)
        out.append((lang, -score, -a, " ".join(p).encode(), left, right, n[lang]))
    got, rank = [], Counter()
    for lang, score, a, phrase, left, right, total in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            got.append((lang, rank[lang], phrase.decode(), -a, left, right, total, -score))
    return sorted(got)


def run(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, x, "p", 1, 0.5, 2) for i, (t, x) in enumerate(rows)], DOCS)
    return sorted(tuple(r) for r in co.collocations(docs, **options).collect())


def hard_rows():
    rng = random.Random(5)
    words = ["a", "b", "c", "dé", "日", "A", "x#", "\xa0", "\x1c"]
    ends = [" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n", ";", "!?"]
    rows = [(None, "en"), ("", "en"), ("one two", None), ("one two", ""), (" \t\n", "de"), ("...", "en")]
    for k in range(200):
        text = "".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randint(0, 40)))
        rows.append((text, rng.choice(["en", "en", "de", None])))
    return [*rows, *[("copies of one text stand here", "en")] * 30, ("long run " * 3000, "fr"), ("z " * 700, "fr")]


@pytest.mark.parametrize("least", [2, 10])
def test_phrases_equal_plain_counting(spark, monkeypatch, least):
    """Small shards and chunks, so that one text meets several of each."""
    monkeypatch.setattr(co, "SHARD_WORDS", 50)
    assert run(spark, hard_rows(), least=least) == brute(hard_rows(), least)


def test_top_and_shorter_phrases(spark):
    assert run(spark, hard_rows(), least=3, top=4, most_words=3) == brute(hard_rows(), 3, 3, 4)


def test_empty_table_and_texts_without_words(spark):
    assert run(spark, []) == [] and run(spark, [(None, None), ("", "en"), (". ,", "en")], least=1) == []


def test_products_beyond_64_bits_stay_exact(spark):
    row = spark.sql("select (1000 * cast(9000000000001 as decimal(16)) * cast(8000000000000003 as decimal(16))) div (cast(9000000000007 as decimal(16)) * cast(9100000000001 as decimal(16)))")
    assert row.first()[0] == 1000 * 9000000000001 * 8000000000000003 // (9000000000007 * 9100000000001)


def test_long_texts_come_in_parts():
    class Batch:
        def column(self, name):
            import pyarrow as pa

            return pa.array(["en", "en"]) if name == "lang" else pa.array(["A b. c d! " * 50, "e f"])

    parts = [x for held in co._chunks([Batch()], 64) for x in held["en"]]
    assert len(parts) > 5 and all(len(p) < 90 for p in parts)
    assert b"\n".join(parts).split() == (b"a b c d " * 50 + b"e f").split()


def test_automaton_counts_every_substring():
    rng = random.Random(3)
    for _ in range(200):
        runs = [(tuple(rng.choice("abc") for _ in range(rng.randint(1, 12))), rng.randint(0, 3), rng.randint(1, 4)) for _ in range(rng.randint(1, 5))]
        automaton, want, before = co.Automaton(), Counter(), {}
        for run, context, weight in runs:
            automaton.add(run, context, weight)
            for end in range(context, len(run)):
                for size in range(2, min(5, end + 1) + 1):
                    p = run[end - size + 1 : end + 1]
                    want[p] += weight
                    before.setdefault(p, set()).add(run[end - size] if end >= size else None)
        got = {tuple(p): (n, b) for p, n, b in automaton.phrases(5)}
        assert {p: n for p, (n, _) in got.items()} == dict(want)
        for p, (_, b) in got.items():
            if b is not None:
                assert before[p] == {b}, (runs, p)
            elif len(p) < 5:
                assert len(before[p]) > 1 or None in before[p], (runs, p)


def test_bit_tables_miss_nothing(spark):
    hashes = [(k * 7919 + 13) * 0x9E3779B97F4A7C15 % 2**64 for k in range(5000)]
    table = co.bits_of(spark.createDataFrame([(h - 2**64 if h >= 2**63 else h,) for h in hashes], "h long"))
    assert all(h in table for h in hashes)
    assert sum((h ^ 0x5A5A5A5A) in table for h in hashes) < 1000
    assert 5 not in co.bits_of(spark.createDataFrame([], "h long"))
