"""Text, retrieval, feedback and grounding queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.chunker import chunk_documents
from ..functions.math import cosine
from ..operators import retrieval as rt
from ..sources.tables import load

#: How queries start; the whole of a benchmark text follows unless a start is one of ALONE.
STARTS = (
    "hello", "what is", "what is the difference between alpha unit and beta unit.", "show the figure on page 12 of", "why does", "see section 4.2:",
    "tell me about a main part; and then about the rest?", "the one about", "who", "Bhai isme kya hai", "give a summary of", "Good morning!",
    "pump as well as valve, explain how", "on the 12th page:", "alpha vs. beta with", "samjhao antar aur fayde",
)
ALONE = (0, 8, 11)
TOP = 5


def asked(spark, sf_dir):
    """(query_id, query): a start by number and a benchmark text."""
    b = load(spark, sf_dir, "benchmark")
    starts, n = F.array(*map(F.lit, STARTS)), (F.col("item_id") % len(STARTS)).cast("int")
    body = F.when(n.isin(*ALONE), "").otherwise(F.concat(F.lit(" "), F.col("text")))
    return b.select(F.col("item_id").alias("query_id"), F.concat(F.get(starts, n), body).alias("query"))


def vectors(spark, sf_dir):
    return load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("e"), "label")


def vector_queries(spark, sf_dir):
    v = load(spark, sf_dir, "embeddings").where("vec_id % 20 = 0")
    return v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def word_queries(spark, sf_dir):
    return asked(spark, sf_dir).select("query_id", tx.search_tokens(F.col("query")).alias("tokens"))


def texts(spark, sf_dir):
    return load(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")


def said_queries(spark, sf_dir):
    """(query_id, query): what vector queries ask in words, a benchmark text each."""
    return load(spark, sf_dir, "benchmark").select((F.col("item_id") * 20).alias("query_id"), F.col("text").alias("query"))


def answers(spark, sf_dir):
    """Assistant turns, whole; every third cites at its end, every fifth refuses."""
    c = load(spark, sf_dir, "conversations").where("role = 'assistant'")
    said = F.concat(
        "text",
        F.when(F.col("conv_id") % 3 == 0, " [2] and [1], [2] [9]").otherwise(""),
        F.when(F.col("conv_id") % 10 == 0, " There is no mention of it").when(F.col("conv_id") % 10 == 5, " Gains are not specified in the uploaded file.").otherwise(""),
    )
    return c.select("conv_id", "turn", said.alias("answer"))


def ratings(spark, sf_dir):
    """Events as ratings: purchases are up, errors down; keys are a chunk's id and a document."""
    e = load(spark, sf_dir, "events").where("event_type in ('purchase', 'error')")
    return e.select(
        F.array((F.col("user_id") % 40).cast("string"), F.concat(F.lit("d"), F.col("user_id") % 7)).alias("keys"),
        (F.col("event_type") == "purchase").alias("positive"),
        F.concat(F.lit("avoid "), (F.col("event_id") % 23).cast("string")).alias("comment"),
        F.col("event_id").alias("at"),
    )


def both_lists(spark, sf_dir):
    """The dense and the lexical list of each vector query."""
    k = rt.candidate_k(TOP)
    near = rt.similarity_search(vector_queries(spark, sf_dir), vectors(spark, sf_dir), k)
    said = said_queries(spark, sf_dir).join(vector_queries(spark, sf_dir), "query_id", "left_semi")
    words = rt.lexical_search(said.select("query_id", tx.search_tokens(F.col("query")).alias("tokens")), texts(spark, sf_dir), k)
    return near, words


def reranked(spark, sf_dir):
    """Fused candidates with cosine, word and history hits, figures, feedback and pages in one score."""
    fused = rt.fuse(*both_lists(spark, sf_dir)).select("query_id", "chunk_id")
    said = said_queries(spark, sf_dir)
    past = said.select((F.col("query_id") + 20).alias("query_id"), F.col("query").alias("before"))  # the query before is the history
    rows = fused.join(vector_queries(spark, sf_dir), "query_id").join(vectors(spark, sf_dir).drop("label"), "chunk_id")
    rows = rows.join(texts(spark, sf_dir), "chunk_id", "left").join(said, "query_id", "left").join(past, "query_id", "left")
    hits, history = rt.word_hits(F.col("text"), tx.search_tokens(F.col("query")), tx.search_tokens(F.col("before")))
    rows = rows.select(
        "query_id", "chunk_id", F.concat(F.lit("d"), (F.col("chunk_id") % 7).cast("string")).alias("doc"),
        F.round(cosine(F.col("q"), F.col("e")), 6).alias("cos"), hits.alias("hits"), history.alias("history"),
        F.coalesce(F.lower("text").contains("figure"), F.lit(False)).alias("figure"), (F.col("chunk_id") % 97 == F.col("query_id") % 97).alias("on_page"),
    )
    rows = rt.feedback_weight(rows, rt.net_weights(ratings(spark, sf_dir)).withColumn("weight", F.col("weight") / 100))
    score = rt.rerank_score(F.col("cos"), F.col("hits"), F.col("history"), F.col("figure"), F.col("weight"), F.col("on_page"))
    return rows.withColumn("final", F.round(score, 5))


def answered(spark, sf_dir):
    """Retrieval, reranking, answering and grounding end to end: each query's best chunks, the answer made of them, how far it holds the query's words, confidence and status."""
    best = rt.best_of(reranked(spark, sf_dir), "final", TOP, 0.2).select("query_id", "rank", "chunk_id", "final").join(texts(spark, sf_dir), "chunk_id", "left")
    top = F.array_sort(F.collect_list(F.struct("rank", "chunk_id", F.substring("text", 1, rt.PASSAGE_CHARS).alias("text"))))
    by = best.groupBy("query_id").agg(top.alias("top"), F.avg(F.when(F.col("rank") <= 3, F.col("final"))).alias("mean"))
    rows = by.join(said_queries(spark, sf_dir), "query_id", "left").withColumn("answer", rt.extractive_answer(F.transform("top", lambda x: x["text"])))
    overlap = F.coalesce(rt.token_overlap(tx.search_tokens(F.col("query")), tx.search_tokens(F.col("answer"))), F.lit(0.0))
    rows = rows.withColumn("overlap", F.round(overlap, 6))
    refusal = F.coalesce(tx.is_refusal(F.col("answer")), F.lit(False))
    conf = rt.grounded_confidence(rt.calibrated_confidence(F.col("mean"), F.col("overlap")), refusal)
    cited = tx.citations(F.col("answer"), F.size("top"))
    chunks = F.array_join(F.transform("top", lambda x: x["chunk_id"].cast("string")), ",")
    status = rt.grounding_status(F.col("answer"), refusal, conf, cited)
    return rows.select("query_id", chunks.alias("chunks"), F.sha2("answer", 256).alias("answer"), "overlap", conf.alias("confidence"), status.alias("status"))


def grounded(spark, sf_dir):
    a = answers(spark, sf_dir)
    refusal = tx.is_refusal(F.col("answer"))
    conf = rt.grounded_confidence(rt.calibrated_confidence((F.col("conv_id") % 10) / 10.0, F.lit(0.5)), refusal)
    cited = tx.citations(F.col("answer"), F.lit(5))
    status = rt.grounding_status(F.col("answer"), refusal, conf, cited)
    return a.select("conv_id", "turn", conf.alias("confidence"), F.array_join(cited, ",").alias("cited"), status.alias("status"))


def prompts(spark, sf_dir):
    """The three best chunks of each query, 400 characters each, under a budget."""
    near = rt.similarity_search(vector_queries(spark, sf_dir), vectors(spark, sf_dir), 3)
    rows = near.join(texts(spark, sf_dir), "chunk_id").select("query_id", "rank", F.substring("text", 1, 400).alias("t"))
    lines = F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("t")).alias("line"))))
    return rows.groupBy("query_id").agg(F.sha2(F.array_join(F.transform(lines, lambda x: x["line"]), "\n"), 256).alias("prompt"))


on_query = lambda name, f: lambda sp, d: asked(sp, d).select("query_id", f(F.col("query")).alias(name))
on_doc = lambda name, f: lambda sp, d: load(sp, d, "documents").select("doc_id", f(F.col("text")).alias(name))


def headings(spark, sf_dir):
    """Heading lines by document: its own lines, and seven forms of its source's name."""
    d = load(spark, sf_dir, "documents")
    forms = ("=== PAGE 3 - {} ===", "## {}", "2.1 {}", "appendix b {}", "{} Notes:", "{}. Not one.")
    made = F.array(*(F.replace(F.lit(f), F.lit("{}"), F.initcap("source")) for f in forms), F.upper("lang"))
    lines = d.select("doc_id", F.explode(F.concat(F.split(F.coalesce("text", F.lit("")), "\n"), made)).alias("line"))
    return lines.groupBy("doc_id").agg(F.count_if(F.coalesce(tx.is_heading(F.col("line")), F.lit(False))).alias("headings"))


def tagged(spark, sf_dir):
    """(doc_id, tagged, half): whole texts with a page tag and a figure tag at a third and two thirds of their length."""
    d = load(spark, sf_dir, "documents").where("text is not null")
    third = F.floor(F.length("text") / 3).cast("int")
    part = lambda k: F.substring(F.col("text"), third * k + 1, F.length("text") if k == 2 else third)
    text = F.concat(part(0), F.lit(" [Page 1] [FIGURE: a b | 7] "), part(1), F.lit(" [Page 2] [FIGURE: c|12]"), part(2))
    return d.select("doc_id", text.alias("tagged"))


def page_rows(spark, sf_dir):
    return tagged(spark, sf_dir).select("doc_id", F.explode(tx.pages_of(F.col("tagged"))).alias("p")).select("doc_id", "p.page", F.sha2("p.text", 256).alias("text"))


def page_hits(spark, sf_dir):
    """Chunks of the page that a query names go ahead of its fused hits."""
    v = vectors(spark, sf_dir).select("chunk_id", (F.col("chunk_id") % 97).alias("page"))
    return rt.with_page_hits(rt.fuse(*both_lists(spark, sf_dir)), v, vector_queries(spark, sf_dir).select("query_id", (F.col("query_id") % 97).alias("page")))


QUERIES = {
    "x01_count_tokens": on_doc("n_tokens", lambda t: tx.count_tokens(t).cast("long")),
    "x02_clean_text": on_doc("clean", lambda t: F.sha2(tx.clean(t), 256)),
    "x03_headings": headings,
    "x04_table_detector": lambda sp, d: load(sp, d, "documents").select("doc_id", tx.is_table(F.concat(F.lit("| a | b |\n|---|---|\n"), F.when(F.col("doc_id") % 2 == 0, "x"), F.col("text"))).alias("is_table")),
    "x05_markdown_rows": lambda sp, d: load(sp, d, "customer").select("c_custkey", tx.markdown_row(F.array("c_name", F.concat(F.lit("a|"), "c_mktsegment"))).alias("row")),
    "x06_contextual_header": lambda sp, d: load(sp, d, "documents").select("doc_id", F.sha2(tx.contextual(F.col("text"), F.col("source"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")), F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") % 50)), 256).alias("h")),
    "x07_document_type": lambda sp, d: load(sp, d, "part").select("p_partkey", tx.document_type(
        F.concat(F.get(F.array(*map(F.lit, ("Runbook ", "GLOSSARY-", "post issue ", "", ""))), F.col("p_size") % 5), "p_name", F.lit(".process.txt")),
        F.get(F.array(*map(F.lit, ("Incidents", "all definitions", "misc"))), F.col("p_size") % 3)).alias("kind")),
    "x08_greeting": on_query("greeting", tx.is_greeting),
    "x09_target_page": on_query("page", tx.target_page),
    "x10_intent": lambda sp, d: asked(sp, d).select("query_id", tx.intent(F.col("query")).alias("intent"), tx.top_k(tx.intent(F.col("query"))).alias("top_k")),
    "x11_mixed_words": on_query("query", tx.normalise_mixed),
    "x12_sub_queries": lambda sp, d: asked(sp, d).select("query_id", F.array_join(tx.parts_of(F.col("query")), "|").alias("parts")),
    "x13_expand_intent": on_query("query", tx.expand_intent),
    "x16_refusal": lambda sp, d: answers(sp, d).select("conv_id", "turn", tx.is_refusal(F.col("answer")).alias("refusal")),
    "x17_citations": lambda sp, d: answers(sp, d).select("conv_id", "turn", F.array_join(tx.citations(F.col("answer"), F.lit(5)), ",").alias("cited"), F.sha2(tx.without_citations(F.col("answer")), 256).alias("plain")),
    "x18_grounding": grounded,
    "x19_keywords": lambda sp, d: asked(sp, d).select("query_id", F.array_join(tx.keywords(F.col("query")), " ").alias("keywords")),
    "x20_figure_tags": lambda sp, d: tagged(sp, d).select("doc_id", F.array_join(tx.figure_tags(F.col("tagged")), ";").alias("figures")),
    "x15_history": lambda sp, d: rt.last_turns(load(sp, d, "conversations")).withColumn("history", F.sha2("history", 256)),
    "w18_last_turns": lambda sp, d: rt.last_turns(load(sp, d, "conversations"), 2).select("conv_id", F.length("history").alias("chars")),
    "x21_prompt": prompts,
    "x26_safe_name": lambda sp, d: load(sp, d, "pages").select("page_id", tx.safe_name(F.col("url")).alias("name")),
    "x28_truncate": lambda sp, d: load(sp, d, "documents").select("doc_id", F.sha2(F.substring(F.trim("text"), 1, 200), 256).alias("head")),
    "r02_page_tags": page_rows,
    "r05_content_hash": on_doc("sha256", lambda t: F.sha2(t, 256)),
    "j10_vector_search": lambda sp, d: rt.similarity_search(vector_queries(sp, d), vectors(sp, d), 10),
    "t06_filtered_search": lambda sp, d: rt.similarity_search(vector_queries(sp, d), vectors(sp, d), 5, F.col("label") % 2 == 0),
    "t06_post_filtered_search": lambda sp, d: rt.similarity_search(vector_queries(sp, d), vectors(sp, d), 5, F.col("label") % 2 == 0, True),
    "m07_cosine": lambda sp, d: rt.cosine_search(vector_queries(sp, d), vectors(sp, d), 20),
    "j11_lexical_search": lambda sp, d: rt.lexical_search(word_queries(sp, d), texts(sp, d), 10),
    "a43_rank_fusion": lambda sp, d: rt.fuse(*both_lists(sp, d)),
    "j12_page_hits": page_hits,
    "m09_rerank": lambda sp, d: reranked(sp, d).select("query_id", "chunk_id", "final"),
    "t07_candidates": lambda sp, d: rt.similarity_search(vector_queries(sp, d), vectors(sp, d), rt.candidate_k(TOP)).select("query_id", "rank", "chunk_id"),
    "f14_min_score": lambda sp, d: rt.best_of(reranked(sp, d), "final", TOP, 0.4).select("query_id", "rank", "chunk_id", "final"),
    "o28_answers": answered,
    "r08_hashed_embeddings": lambda sp, d: rt.hashed_embeddings(load(sp, d, "documents"), ["doc_id"], "text").withColumn("weight", F.round("weight", 6)),
    "o25_cached_embeddings": lambda sp, d: rt.cached_embeddings(load(sp, d, "conversations").where("role = 'user'"), ["conv_id", "turn"], "text").withColumn("weight", F.round("weight", 6)),
    "j13_feedback_weight": lambda sp, d: rt.feedback_weight(
        texts(sp, d).select((F.col("chunk_id") % 60).alias("chunk_id"), F.concat(F.lit("d"), F.col("chunk_id") % 9).alias("doc"), F.col("chunk_id").alias("n")),
        rt.net_weights(ratings(sp, d)),
    ),
    "a44_net_weights": lambda sp, d: rt.net_weights(ratings(sp, d)),
    "a45_constraints": lambda sp, d: rt.last_constraints(ratings(sp, d)),
    "a45_constraints_read": lambda sp, d: rt.last_constraints(ratings(sp, d), 3).select("comment"),
    "a42_index_stats": lambda sp, d: rt.index_stats(vectors(sp, d).select("chunk_id", F.col("label").alias("doc_id"), (F.col("label") % 3).alias("org_id"))),
    "f06_metadata_filter": lambda sp, d: rt.metadata_filter(
        load(sp, d, "documents").select("doc_id", F.create_map(F.lit("lang"), "lang", F.lit("source"), "source").alias("metadata")), {"lang": "en"}, {"source": ["src1", "src2"]}
    ).select("doc_id"),
    "o12_similar_chunks": lambda sp, d: rt.similarity_search(vector_queries(sp, d), vectors(sp, d), 3),
    "c04_chunk_documents": lambda sp, d: chunk_documents(load(sp, d, "documents"), "doc_id", "text"),
}

ASKED = r"""asked AS (SELECT item_id AS query_id, ['hello', 'what is', 'what is the difference between alpha unit and beta unit.', 'show the figure on page 12 of',
  'why does', 'see section 4.2:', 'tell me about a main part; and then about the rest?', 'the one about', 'who', 'Bhai isme kya hai', 'give a summary of',
  'Good morning!', 'pump as well as valve, explain how', 'on the 12th page:', 'alpha vs. beta with', 'samjhao antar aur fayde'][item_id % 16 + 1]
  || CASE WHEN item_id % 16 IN (0, 8, 11) THEN '' ELSE ' ' || text END AS query FROM benchmark)"""
W = r"regexp_extract_all(lower(query), '([\p{L}\p{N}_]+)', 1)"
B, E = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"  # word boundaries for letters of any script


def sql_list(text: str, by: str = " ") -> str:
    return "[" + ", ".join(f"'{x}'" for x in text.split(by)) + "]"


def has(what: str, pattern: str) -> str:
    return f"regexp_matches({what}, '{B}(?:{pattern}){E}')"


def stripped(what: str) -> str:
    return rf"regexp_replace({what}, '^\s+|\s+$', '', 'g')"


GREETING_WORDS = sql_list("hi,hello,hey,namaste,kem cho,kaise ho,kya haal hai,good morning,good evening,good afternoon,hola,greetings,sup,yo,pranam", ",")
CLEAN = r"regexp_replace(lower(query), '[!., ?]+$', '')"
GREETS = f"(len({W}) <= 3 AND (list_contains({GREETING_WORDS}, {CLEAN}) OR list_has_any({W}, {GREETING_WORDS})))"
PAGES = [
    rf"{B}(?:page|opage|pge|pag|pg|p\.?|pno|page\s*no|page\s*number)\s*[:#\-]?\s*(\d+){E}",
    rf"{B}(?:on|at|in|see)\s+(?:page|opage|pge)\s*[:#\-]?\s*(\d+){E}",
    rf"{B}(\d+)\s*(?:th|st|nd|rd)?\s*(?:page|opage|number\s*page){E}",
]
FOUND_PAGES = [f"try_cast(nullif(regexp_extract(lower(query), '{p}', 1), '') AS BIGINT)" for p in PAGES]
PAGE = "coalesce(" + ", ".join(f"CASE WHEN {x} BETWEEN 1 AND 10000 THEN {x} END" for x in FOUND_PAGES) + ")"
FIGURE_WORDS = sql_list(
    "diagram diagrams figure figures chart charts graph graphs plot image images visual visuals drawing circuit architecture layout schematic"
    " blueprint illustration preview photo photos pic pics picture pictures snapshot crop screenshot snippet"
)
QUESTIONS = "(?:what|how|why|where|when|explain)"
INTENT = f"""CASE WHEN {GREETS} THEN 'greeting' WHEN {PAGE} IS NOT NULL THEN 'page_lookup' WHEN list_has_any({W}, {FIGURE_WORDS}) THEN 'visual'
  WHEN {has("lower(query)", r"compare|comparison|versus|vs|difference between|differences between")} THEN 'comparative'
  WHEN {has("lower(query)", "and also|as well as|along with|plus|aur|tatha")} OR length(query) - length(replace(query, '?', '')) > 1
    OR regexp_matches(lower(query), '{B}{QUESTIONS}{E}(?:.*[^\\p{{L}}\\p{{N}}_])?(?:and|aur){E}(?:.*[^\\p{{L}}\\p{{N}}_])?{QUESTIONS}{E}') THEN 'multi_part'
  WHEN len(list_distinct({W})) <= 5 AND list_has_any({W}, ['what', 'who', 'when', 'where', 'define']) THEN 'factual'
  WHEN list_has_any({W}, ['compare', 'difference', 'explain', 'why', 'how', 'analyze', 'summarize']) THEN 'analytical'
  WHEN {has("lower(query)", r"section|chapter|part|model|v\d+|\d+\.\d+")} THEN 'lookup' ELSE 'standard' END"""


def mixed_sql(query: str) -> str:
    """Every word is set between two spaces, so that neighbours don't share one."""
    pairs = """bhai=,yaar=,isme=in this,isme se=from this,ye=this,yeh=this,kaise=how,kaam karta hai=works mechanics architecture,
        kaam karti hai=works mechanics architecture,karta hai=does,karti hai=does,kya hai=what is definition details,kya=what,konsa=which,kounsa=which,
        batao=explain describe details,samjhao=explain overview details,karo=,kariye=,aur=and,tatha=and,ke bare me=about regarding,bare me=about regarding,
        ke baare mein=about regarding,baare mein=about regarding,fayde=benefits advantages,nuksan=disadvantages limitations,antar=difference comparison,
        farq=difference comparison"""
    out = f"lower({stripped(query)})"
    for pair in pairs.split(","):
        word, _, other = pair.strip().partition("=")
        out = rf"regexp_replace({out}, '(^|[^\p{{L}}\p{{N}}_]){word}($|[^\p{{L}}\p{{N}}_])', '\1{other}\2', 'g')"
    out = stripped(rf"regexp_replace({out}, '\s+', ' ', 'g')")
    signs = has(f"lower({query})", "bhai|yaar|isme|kaise|kya|konsa|batao|samjhao|ke bare|karta hai|fayde|antar")
    return f"CASE WHEN {signs} AND length({out}) >= 4 THEN {out} ELSE {stripped(query)} END"


DISTINCT = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
CLAUSE = stripped(
    r"regexp_replace(regexp_replace(regexp_replace(y, '^\s+|\s+$', '', 'g'), '^[,. ]+|[,. ]+$', '', 'g'), '(?i)^(what is|tell me about|how does|why is|explain)\s+', '')"
)
#: Clauses are cut at marks that stand for conjunctions and commas.
PARTS = rf"""m AS (SELECT query_id, {stripped("query")} AS whole, {mixed_sql("query")} AS main FROM asked),
v AS (SELECT *, '(?i)(?:compare|comparison between|difference between|differences between)\s+([a-zA-Z0-9_\-\s]+?)\s+(?:and|with|versus|vs\.?)\s+([a-zA-Z0-9_\-\s]+)' AS pat,
  regexp_replace(regexp_replace(main, '(?i)(^|[^\p{{L}}\p{{N}}_])(?:and also|as well as|along with|plus|and what|and how|and why|and where|and explain|and)($|[^\p{{L}}\p{{N}}_])', '\1' || chr(1) || '\2', 'g'), ',', chr(1), 'g') AS cut,
  list_filter(list_transform(regexp_split_to_array(whole, '[?;]'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) > 5) AS pieces FROM m),
w AS (SELECT *, regexp_replace(regexp_extract(main, pat, 1), '^\s+|\s+$', '', 'g') AS a, regexp_replace(regexp_extract(main, pat, 2), '^\s+|\s+$', '', 'g') AS b FROM v),
x AS (SELECT query_id, CASE WHEN a <> '' AND b <> '' THEN [main, a || ' specifications features overview', b || ' specifications features overview',
    'comparison difference between ' || a || ' and ' || b]
  WHEN len(pieces) > 1 THEN [main] || list_transform(pieces[1:3], lambda y: {mixed_sql("y")})
  WHEN contains(cut, chr(1)) THEN [main] || list_filter(list_transform(string_split(cut, chr(1)), lambda y: {CLAUSE}),
    lambda y: length(y) > 3 AND y NOT IN ('this', 'that', 'it', 'how')) ELSE [main] END AS parts FROM w)"""
SALIENT = (
    r"list_filter(regexp_extract_all(lower(query), '([a-z0-9_\-\.]+)', 1), lambda w: length(w) > 1 AND NOT list_contains("
    + sql_list(
        "the a an is of and or in to for with diagram diagrams figure figures chart charts show give me what how part image images photo photos picture"
        " pictures pic pics preview crop snapshot document doc pdf file page section portion content view display take send tell about write extract find"
        " please can you there this that from here box node component"
    )
    + ", w))"
)
ANSWERS = """answers AS (SELECT conv_id, turn, text || CASE WHEN conv_id % 3 = 0 THEN ' [2] and [1], [2] [9]' ELSE '' END
  || CASE conv_id % 10 WHEN 0 THEN ' There is no mention of it' WHEN 5 THEN ' Gains are not specified in the uploaded file.' ELSE '' END AS answer
  FROM conversations WHERE role = 'assistant')"""
REFUSAL = has(
    "lower(answer)",
    "i could not find|could not be found|i cannot find|cannot be found|there is no mention|no mention of|not mentioned in (?:the )?documents?"
    "|not present in (?:the )?documents?|not found in (?:the )?provided|not in the provided|the provided documents? (?:do not|does not) contain"
    "|documents? contain no information|no information provided about|no details (?:are )?available in|based on the provided context, there is no"
    "|based on the context, there is no|is not specified in the uploaded|are not specified in the uploaded",
)
FOUND = r"list_filter(list_transform(regexp_extract_all(answer, '\[(\d+)\]', 1), lambda x: try_cast(x AS INTEGER)), lambda x: x BETWEEN 1 AND {0})"
CITED = f"CASE WHEN {REFUSAL} THEN [] ELSE {DISTINCT.format(FOUND.format(5))} END"
RATINGS = """ratings AS (SELECT [CAST(user_id % 40 AS VARCHAR), 'd' || (user_id % 7)] AS keys, event_type = 'purchase' AS positive,
  'avoid ' || (event_id % 23) AS comment, event_id AS seen_at FROM events WHERE event_type IN ('purchase', 'error')),
weights AS (SELECT key, CAST(round(sum(d), 3) AS DOUBLE) AS weight FROM (SELECT unnest(keys) AS key, CASE WHEN positive THEN 0.12 ELSE -0.15 END AS d FROM ratings) GROUP BY key)"""


def search_sql(k: int, where: str = "true", queries: str = "vec_id % 20 = 0", extra: str = "") -> str:
    return f"""SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, c.label,
      round(greatest(0.0, least(1.0, list_sum(list_transform(list_zip(q.embedding, c.embedding), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))))), 6) AS score,
      CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY round(greatest(0.0, least(1.0, list_sum(list_transform(list_zip(q.embedding, c.embedding),
        lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))))), 6) DESC, c.vec_id) AS INTEGER) AS rank
      FROM embeddings q JOIN embeddings c ON q.{queries} AND q.vec_id <> c.vec_id AND {where} QUALIFY rank <= {k} {extra}"""


TOKENS = r"list_distinct(regexp_extract_all(lower({0}), '([a-z0-9_\-\.]{{2,}})', 1))"
LEX = """SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM (
  SELECT query_id, doc_id AS chunk_id, round(len(list_filter(tokens, lambda w: contains(lower(text), w))) / len(tokens), 6) AS score
  FROM {0}, documents WHERE len(tokens) > 0 AND text IS NOT NULL) WHERE score > 0"""
SAID = f"said AS (SELECT item_id * 20 AS query_id, text AS query, {TOKENS.format('text')} AS tokens FROM benchmark)"
LISTS = f"""near AS ({search_sql(15)}), {SAID}, sv AS (SELECT said.* FROM said JOIN embeddings ON vec_id = query_id),
words AS (SELECT * FROM ({LEX.format("sv")}) WHERE rank <= 15)"""
FUSED = f"""{LISTS}, fused AS (SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)), 8) AS rrf FROM
  (SELECT query_id, chunk_id, rank FROM near UNION ALL SELECT query_id, chunk_id, rank FROM words) GROUP BY 1, 2)"""
COSINE = """round(list_sum(list_transform(list_zip(q.embedding, c.embedding), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))
  / (sqrt(list_sum(list_transform(q.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) * sqrt(list_sum(list_transform(c.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) + 1e-8), 6)"""
HITS = "coalesce(len(list_filter({0}, lambda w: length(w) >= 3 AND contains(lower(coalesce(d.text, '')), w))), 0)"
RERANKED = f"""{FUSED}, {RATINGS},
r AS (SELECT f.query_id, f.chunk_id, {COSINE} AS cos, {HITS.format("s.tokens")} AS hits, {HITS.format("h.tokens")} AS history,
    coalesce(contains(lower(d.text), 'figure'), false) AS figure, f.chunk_id % 97 = f.query_id % 97 AS on_page,
    coalesce(w1.weight, 0) / 100 AS w1, coalesce(w2.weight, 0) / 100 AS w2
  FROM fused f JOIN embeddings q ON q.vec_id = f.query_id JOIN embeddings c ON c.vec_id = f.chunk_id LEFT JOIN documents d ON d.doc_id = f.chunk_id
  LEFT JOIN said s ON s.query_id = f.query_id LEFT JOIN said h ON h.query_id + 20 = f.query_id
  LEFT JOIN weights w1 ON w1.key = CAST(f.chunk_id AS VARCHAR) LEFT JOIN weights w2 ON w2.key = 'd' || (f.chunk_id % 7)),
b AS (SELECT *, 0.65 * cos + least(0.08 * hits, 0.25) + least(0.04 * history, 0.1) + CASE WHEN figure THEN 0.05 ELSE 0.0 END + CASE WHEN w1 <> 0 THEN w1 ELSE w2 END AS base FROM r),
final AS (SELECT query_id, chunk_id, round(greatest(0.0, least(1.0, CASE WHEN base < 0.35 AND hits > 0 THEN 0.7 ELSE base END + CASE WHEN on_page THEN 2.0 ELSE 0.0 END)), 5) AS final FROM b)"""
HASHED = r"""SELECT {0}, CAST(bucket AS INTEGER) AS bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY {0})), 6) AS weight FROM (
  SELECT {0}, ('0x' || substr(md5(w), 1, 8))::BIGINT % 384 AS bucket, count(*) AS n FROM (
    SELECT {0}, unnest(regexp_extract_all(lower({1}), '([\p{{L}}\p{{N}}_]{{2,}})', 1)) AS w FROM {2}) GROUP BY ALL)"""
TAGGED = """tg AS (SELECT doc_id, substr(text, 1, n) AS a, substr(text, n + 1, n) AS b, substr(text, 2 * n + 1) AS c
  FROM (SELECT doc_id, text, length(text) // 3 AS n FROM documents WHERE text IS NOT NULL))"""
HEADING = r"""length(l) BETWEEN 1 AND 90 AND (regexp_matches(l, '^===\s*(?:PAGE\s+\d+\s*-\s*)?.*\s*===$') OR regexp_matches(l, '^#{1,6}\s+.+$')
  OR regexp_matches(l, '^\d+(?:\.\d+)*\.?\s+[A-Za-z0-9].*$') OR regexp_matches(l, '^(?i:section|chapter|appendix|part)\s+[A-Za-z0-9.\-]+(?::\s*.*|\s+.*)?$')
  OR regexp_matches(l, '^[A-Z][A-Za-z0-9\s\-]{2,50}:$') OR (length(regexp_replace(l, '[^A-Za-z]', '', 'g')) >= 4 AND upper(l) = l AND NOT regexp_matches(l, '[.,]$')))"""
SQL = {
    "x01_count_tokens": r"SELECT doc_id, CAST(len(regexp_extract_all(text, '([\p{L}\p{N}_]+|[^\p{L}\p{N}_\s])', 1)) AS BIGINT) AS n_tokens FROM documents",
    "x02_clean_text": r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'),
        '[​‌‍﻿]', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' {2,}', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS clean FROM documents""",
    "x03_headings": f"""WITH f AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10)) || [upper(lang)] || list_transform(['=== PAGE 3 - ', '## ', '2.1 ', 'appendix b ', '', ''],
          lambda x, i: x || upper(source[1]) || lower(source[2:]) || [' ===', '', '', '', ' Notes:', '. Not one.'][i])) AS line FROM documents),
        g AS (SELECT doc_id, {stripped("line")} AS l FROM f) SELECT doc_id, count(*) FILTER ({HEADING}) AS headings FROM g GROUP BY 1""",
    "x04_table_detector": r"""SELECT doc_id, regexp_matches('| a | b |' || chr(10) || '|---|---|' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'x' END || text,
        '(?m)^\s*\|.*\|\s*\n\s*\|[\s:|-]+\|\s*$') AS is_table FROM documents""",
    "x05_markdown_rows": r"SELECT c_custkey, '| ' || c_name || ' | a\|' || c_mktsegment || ' |' AS row FROM customer",
    "x06_contextual_header": """SELECT doc_id, sha256('[' || concat_ws(' | ', 'Document: ' || source, CASE WHEN doc_id % 3 = 0 THEN 'Page: ' || (doc_id % 50) END,
        CASE WHEN doc_id % 2 = 0 THEN 'Section: ' || lang END) || ']' || chr(10) || text) AS h FROM documents""",
    "x07_document_type": r"""WITH n AS (SELECT p_partkey, lower(['Runbook ', 'GLOSSARY-', 'post issue ', '', ''][p_size % 5 + 1] || p_name || '.process') AS f,
        ['incidents', 'all definitions', 'misc'][p_size % 3 + 1] AS g FROM part)
        SELECT p_partkey, CASE WHEN f LIKE '%metric%' OR f LIKE '%definition%' OR f LIKE '%glossary%' THEN 'metric_def' WHEN f LIKE '%process%' OR f LIKE '%procedure%' OR f LIKE '%runbook%' THEN 'process'
        WHEN f LIKE '%incident%' OR f LIKE '%postmortem%' OR f LIKE '%outage%' OR f LIKE '%issue%' THEN 'incident'
        WHEN g = 'incidents' THEN 'incident' WHEN g = 'all definitions' THEN 'metric_def' ELSE 'other' END AS kind FROM n""",
    "x08_greeting": f"WITH {ASKED} SELECT query_id, {GREETS} AS greeting FROM asked",
    "x09_target_page": f"WITH {ASKED} SELECT query_id, {PAGE} AS page FROM asked",
    "x10_intent": f"""WITH {ASKED}, i AS (SELECT query_id, {INTENT} AS intent FROM asked) SELECT query_id, intent,
        CASE intent WHEN 'greeting' THEN 1 WHEN 'visual' THEN 4 WHEN 'factual' THEN 4 WHEN 'lookup' THEN 4 WHEN 'comparative' THEN 6 WHEN 'multi_part' THEN 6 ELSE 5 END AS top_k FROM i""",
    "x11_mixed_words": f"WITH {ASKED} SELECT query_id, {mixed_sql('query')} AS query FROM asked",
    "x12_sub_queries": f"WITH {ASKED}, {PARTS} SELECT query_id, array_to_string(({DISTINCT.format('parts')})[1:4], '|') AS parts FROM x",
    "x13_expand_intent": f"""WITH {ASKED} SELECT query_id, {stripped("query")} || CASE WHEN regexp_matches(lower(query), 'summarize|summary|overview|main points|saaransh') THEN ' abstract executive summary main findings key takeaways'
        WHEN regexp_matches(lower(query), 'diagram|figure|circuit|flowchart|schematic|architecture') THEN ' architecture workflow visual schematic layout component diagram' ELSE '' END AS query FROM asked""",
    "x16_refusal": f"WITH {ANSWERS} SELECT conv_id, turn, {REFUSAL} AS refusal FROM answers",
    "x17_citations": rf"""WITH {ANSWERS} SELECT conv_id, turn, array_to_string({CITED}, ',') AS cited,
        sha256(CASE WHEN {REFUSAL} THEN {stripped(r"regexp_replace(regexp_replace(answer, '\[\d+\]', '', 'g'), ' +', ' ', 'g')")} ELSE answer END) AS plain FROM answers""",
    "x18_grounding": f"""WITH {ANSWERS}, g AS (SELECT *, {REFUSAL} AS refusal, {CITED} AS c, round(1 / (1 + exp(-9 * (0.75 * (conv_id % 10) / 10.0 + 0.25 * 0.5 - 0.45))), 4) AS raw FROM answers),
        h AS (SELECT *, CASE WHEN refusal THEN least(raw, 0.25) ELSE raw END AS confidence FROM g)
        SELECT conv_id, turn, confidence, array_to_string(c, ',') AS cited, CASE WHEN answer = '' THEN 'empty_response' WHEN refusal THEN 'refusal_not_in_context'
        WHEN confidence < 0.4 THEN 'low_confidence' WHEN len(c) > 0 THEN 'verified_with_citations' ELSE 'grounded' END AS status FROM h""",
    "x19_keywords": f"WITH {ASKED} SELECT query_id, array_to_string({SALIENT}, ' ') AS keywords FROM asked",
    "x20_figure_tags": f"WITH {TAGGED} SELECT doc_id, 'a b@7;c@12' AS figures FROM tg",
    "x15_history": """SELECT conv_id, sha256(string_agg(role || ': ' || CASE WHEN role = 'assistant' THEN substr(text, 1, 350) ELSE text END, chr(10) ORDER BY turn)) AS history
        FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4) GROUP BY 1""",
    "w18_last_turns": """SELECT conv_id, CAST(length(string_agg(role || ': ' || CASE WHEN role = 'assistant' THEN substr(text, 1, 350) ELSE text END, chr(10) ORDER BY turn)) AS INTEGER) AS chars
        FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2) GROUP BY 1""",
    "x21_prompt": f"""WITH near AS ({search_sql(3)}) SELECT query_id, sha256(string_agg('[' || rank || '] ' || substr(text, 1, 400), chr(10) ORDER BY rank)) AS prompt
        FROM near JOIN documents ON doc_id = chunk_id GROUP BY 1""",
    "x26_safe_name": r"""WITH b AS (SELECT page_id, replace(replace(regexp_replace(list_last(string_split(regexp_replace(url, '/+$', ''), '/')), '[\x00-\x1f\x7f-\x9f]', '', 'g'), '..', ''), '\', '') AS base FROM pages),
        c AS (SELECT page_id, base, lower(regexp_extract(base, '^.+(\.[^.]+)$', 1)) AS suffix FROM b),
        d AS (SELECT *, trim(regexp_replace(substr(base, 1, length(base) - length(suffix)), '[^a-zA-Z0-9_\- ]', '_', 'g')) AS stem FROM c)
        SELECT page_id, substr(CASE WHEN stem = '' THEN 'document' ELSE stem END, 1, greatest(10, 255 - length(suffix))) || suffix AS name FROM d""",
    "x28_truncate": "SELECT doc_id, sha256(substr(trim(text), 1, 200)) AS head FROM documents",
    "r02_page_tags": rf"""WITH {TAGGED}, p AS (SELECT doc_id, 0 AS page, a AS t FROM tg UNION ALL SELECT doc_id, 1, '[FIGURE: a b | 7] ' || b FROM tg UNION ALL SELECT doc_id, 2, '[FIGURE: c|12]' || c FROM tg)
        SELECT doc_id, CAST(page AS INTEGER) AS page, sha256(trim(t)) AS text FROM p WHERE length(trim(t)) > 0""",
    "r05_content_hash": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "j10_vector_search": f"SELECT query_id, rank, chunk_id, score FROM ({search_sql(10)})",
    "t06_filtered_search": f"SELECT query_id, rank, chunk_id, score FROM ({search_sql(5, 'c.label % 2 = 0')})",
    "t06_post_filtered_search": f"""SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank, chunk_id, score
        FROM ({search_sql(10)}) WHERE label % 2 = 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 5""",
    "m07_cosine": f"""SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, {COSINE} AS cosine,
        CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY {COSINE} DESC, c.vec_id) AS INTEGER) AS rank FROM embeddings q, embeddings c WHERE q.vec_id % 20 = 0 QUALIFY rank <= 20""",
    "j11_lexical_search": f"""WITH {ASKED}, t AS (SELECT query_id, {TOKENS.format("query")} AS tokens FROM asked) SELECT * FROM ({LEX.format("t")}) WHERE rank <= 10""",
    "a43_rank_fusion": f"WITH {FUSED} SELECT * FROM fused",
    "j12_page_hits": f"""WITH {FUSED}, hits AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id FROM embeddings q JOIN embeddings c ON q.vec_id % 97 = c.vec_id % 97 WHERE q.vec_id % 20 = 0)
        SELECT query_id, chunk_id, 1.0 AS rrf FROM hits UNION ALL SELECT f.* FROM fused f ANTI JOIN hits USING (query_id, chunk_id)""",
    "m09_rerank": f"WITH {RERANKED} SELECT * FROM final",
    "t07_candidates": f"SELECT query_id, rank, chunk_id FROM ({search_sql(15)})",
    "f14_min_score": f"""WITH {RERANKED} SELECT query_id, chunk_id, final, CAST(row_number() OVER (PARTITION BY query_id ORDER BY final DESC, chunk_id) AS INTEGER) AS rank
        FROM final WHERE final >= 0.4 QUALIFY rank <= 5""",
    "o28_answers": f"""WITH {RERANKED}, top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, chunk_id) AS rank FROM final WHERE final >= 0.2 QUALIFY rank <= 5),
        y AS (SELECT query_id, string_agg(chunk_id, ',' ORDER BY rank) AS chunks, avg(final) FILTER (rank <= 3) AS mean, count(*) AS n, 'Relevant passages from your local documents:' || chr(10) || chr(10)
          || string_agg('[' || rank || '] ' || substr(coalesce(text, ''), 1, 500), chr(10) || chr(10) ORDER BY rank) FILTER (rank <= 3) AS answer FROM top LEFT JOIN documents ON doc_id = chunk_id GROUP BY 1),
        w AS (SELECT y.*, {TOKENS.format("b.text")} AS tokens, {TOKENS.format("answer")} AS words FROM y LEFT JOIN benchmark b ON item_id * 20 = query_id),
        z AS (SELECT *, {REFUSAL} AS refusal, CASE WHEN {REFUSAL} THEN [] ELSE {DISTINCT.format(FOUND.format("n"))} END AS c,
          CASE WHEN len(tokens) > 0 THEN round(len(list_filter(tokens, lambda t: list_contains(words, t))) / len(tokens), 6) ELSE 0.0 END AS overlap FROM w),
        k AS (SELECT *, round(1 / (1 + exp(-9 * (0.75 * mean + 0.25 * overlap - 0.45))), 4) AS raw FROM z),
        sure AS (SELECT *, CASE WHEN refusal THEN least(raw, 0.25) ELSE raw END AS confidence FROM k)
        SELECT query_id, chunks, sha256(answer) AS answer, overlap, confidence, CASE WHEN refusal THEN 'refusal_not_in_context' WHEN confidence < 0.4 THEN 'low_confidence'
          WHEN len(c) > 0 THEN 'verified_with_citations' ELSE 'grounded' END AS status FROM sure""",
    "r08_hashed_embeddings": HASHED.format("doc_id", "text", "documents"),
    "o25_cached_embeddings": HASHED.format("conv_id, turn", "trim(text)", "conversations WHERE role = 'user'"),
    "j13_feedback_weight": f"""WITH {RATINGS} SELECT doc_id % 60 AS chunk_id, 'd' || (doc_id % 9) AS doc, doc_id AS n,
        CASE WHEN coalesce(a.weight, 0) <> 0 THEN a.weight ELSE coalesce(b.weight, 0.0) END AS weight FROM documents
        LEFT JOIN weights a ON a.key = CAST(doc_id % 60 AS VARCHAR) LEFT JOIN weights b ON b.key = 'd' || (doc_id % 9)""",
    "a44_net_weights": f"WITH {RATINGS} SELECT * FROM weights",
    "a45_constraints": f"WITH {RATINGS} SELECT comment, min(seen_at) AS first_at FROM ratings WHERE NOT positive GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "a45_constraints_read": f"WITH {RATINGS} SELECT comment FROM (SELECT comment, min(seen_at) AS first_at FROM ratings WHERE NOT positive GROUP BY 1) ORDER BY first_at DESC, comment LIMIT 3",
    "a42_index_stats": "SELECT count(*) AS vectors, count(DISTINCT label) AS documents, count(DISTINCT label % 3) AS orgs FROM embeddings",
    "f06_metadata_filter": "SELECT doc_id FROM documents WHERE lang = 'en' AND source IN ('src1', 'src2')",
    "o12_similar_chunks": f"SELECT query_id, rank, chunk_id, score FROM ({search_sql(3)})",
}
