"""Query understanding, headings, refusals and follow-ups, case by case."""

import pytest
from pyspark.sql import functions as F

from lakesignal.functions import chunker, text
from lakesignal.operators import explain, retrieval


def column(spark, values, f):
    df = spark.createDataFrame(list(enumerate(values)), "i int, q string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("q"))).collect()]


INTENTS = [
    ("Hello!", "greeting", 1), ("good morning", "greeting", 1), ("what is on page 12?", "page_lookup", 5), ("the 3rd page", "page_lookup", 5),
    ("draw the circuit layout", "visual", 4), ("compare cats and dogs", "comparative", 6), ("alpha vs beta", "comparative", 6),
    ("the pump as well as the valve", "multi_part", 6), ("is it red? is it blue?", "multi_part", 6), ("what is it and how long", "multi_part", 6),
    ("who wrote this", "factual", 4), ("please explain the whole of the method in detail", "analytical", 5), ("see section 4.2 of the long text here", "lookup", 4),
    ("revenue of the northern branch", "standard", 5), ("page 20000", "standard", 5), ("what can be said of the very long text here", "standard", 5),
]


def test_intents(spark):
    queries = [q for q, _, _ in INTENTS]
    assert column(spark, queries, text.intent) == [i for _, i, _ in INTENTS]
    assert column(spark, queries, lambda q: text.top_k(text.intent(q))) == [k for _, _, k in INTENTS]


def test_refusals(spark):
    refused = [
        "I could not find it.", "This cannot be found", "There is no mention of it", "It is not mentioned in the documents.", "not found in the provided files",
        "The provided document does not contain this", "No details are available in it", "Based on the context, there is no such", "It is not specified in the uploaded file",
    ]
    kept = ["I don't have a car.", "It mentions gains.", "", "unable to find peace", "it is specified in the uploaded file"]
    assert column(spark, refused + kept, text.is_refusal) == [True] * len(refused) + [False] * len(kept)


HEADINGS = ["=== PAGE 1 - TEXT CONTENT ===", "## Sub", "1. introduction", "2.1.3 Storage", "section 3", "CHAPTER 2: x", "Appendix B", "EXECUTIVE SUMMARY", "Key Metrics:"]
PLAIN = ["", "A plain sentence.", "ALL CAPS.", "ABC", "lower:", "#nospace", "1.2", "x" * 91]


def test_headings(spark):
    assert column(spark, HEADINGS + PLAIN, text.is_heading) == [True] * len(HEADINGS) + [False] * len(PLAIN)
    assert [chunker.is_heading(x) for x in HEADINGS + PLAIN] == [True] * len(HEADINGS) + [False] * len(PLAIN)
    assert [c[0] for c in chunker.chunks("=== PAGE 1 - TEXT ===\nBody.\n\nNotes:\nMore.")] == ["TEXT", "Notes"]


@pytest.mark.parametrize(
    "query, want",
    [
        ("compare cats and dogs", ["compare cats and dogs", "cats specifications features overview", "dogs specifications features overview", "comparison difference between cats and dogs"]),
        ("Where is it now? And what then?", ["Where is it now? And what then?", "Where is it now", "And what then"]),
        ("explain pumps, valves and also it", ["explain pumps, valves and also it", "pumps", "valves"]),
        ("bhai kya hai pump", ["what is definition details pump"]),
        ("one thing", ["one thing"]),
    ],
)
def test_sub_queries(spark, query, want):
    assert column(spark, [query], text.parts_of) == [want]


@pytest.mark.parametrize(
    "query, history, want",
    [
        ("Why is it expensive?", [("user", "Explain transformers."), ("assistant", "They attend.")], "Why is it expensive on page 7 regarding transformers"),
        ("Show me the figure", [("user", "What is the pump curve?")], "Show me the figure regarding the pump curve"),
        ("List the annual revenue of all northern branches", [("user", "Explain pumps.")], "List the annual revenue of all northern branches"),
        ("Why is it so?", [], "Why is it so?"),
        ("Is this on page 3?", [("user", "see page 9")], "Is this on page 3 regarding see"),
    ],
)
def test_follow_ups(query, history, want):
    if "page 7" in want:
        history = [*history, ("assistant", "see page 7")]
    assert explain.rewrite_follow_up(query, history) == want


def test_lexical_search_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "PASS_QUERIES", 2)
    monkeypatch.setattr(retrieval, "SLICE", 3)
    texts = {i: t for i, t in enumerate(["ab abc", "xab", "", "zz top", None, "abc zz", "AB", "top ab zz"] * 3)}
    queries = {1: ["ab"], 2: ["zz", "ab"], 3: ["nothing"], 4: ["top", "zz", "abc"], 5: []}
    chunks = spark.createDataFrame(list(texts.items()), "chunk_id long, text string").repartition(3)
    asked = spark.createDataFrame(list(queries.items()), "query_id int, tokens array<string>")
    want = set()
    for q, tokens in queries.items():
        scored = [(-round(sum(t in (x or "").lower() for t in tokens) / len(tokens), 6), i) for i, x in texts.items() if tokens]
        want |= {(q, n, i, -s) for n, (s, i) in enumerate(sorted(x for x in scored if x[0])[:4], 1)}
    assert {tuple(r) for r in retrieval.lexical_search(asked, chunks, 4).collect()} == want
    assert retrieval.lexical_search(asked.where("query_id = 5"), chunks, 4).count() == 0
