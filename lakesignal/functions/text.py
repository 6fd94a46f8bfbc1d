"""Text functions as column expressions: tokens, cleaning, headings, query understanding, grounding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: patterns and word lists of the documented behaviour --------------------------------------
TOKEN = r"([\p{L}\p{N}_]+|[^\p{L}\p{N}_\s])"
WORD = r"([\p{L}\p{N}_]+)"
#: What a heading line may look like, at most HEADING_CHARS long; a line in capitals is one, too (see is_heading).
HEADINGS = (
    r"^===\s*(?:PAGE\s+\d+\s*-\s*)?(.*?)\s*===$",
    r"^#{1,6}\s+(.+)$",
    r"^\d+(?:\.\d+)*\.?\s+([A-Za-z0-9].*)$",
    r"^(?i:Section|Chapter|Appendix|Part)\s+([A-Za-z0-9.\-]+(?::\s*.*|\s+.*)?)$",
    r"^[A-Z][A-Za-z0-9\s\-]{2,50}:$",
)
HEADING_CHARS = 90
DOCUMENT_TYPES = (
    ("metric", "metric_def"), ("definition", "metric_def"), ("glossary", "metric_def"), ("process", "process"), ("procedure", "process"),
    ("runbook", "process"), ("incident", "incident"), ("postmortem", "incident"), ("outage", "incident"), ("issue", "incident"),
)
FOLDER_TYPES = (
    ("process", "process"), ("procedure", "process"), ("incident", "incident"), ("postmortem", "incident"), ("metric", "metric_def"),
    ("definition", "metric_def"),
)
GREETINGS = (
    "hi", "hello", "hey", "namaste", "kem cho", "kaise ho", "kya haal hai", "good morning", "good evening", "good afternoon", "hola",
    "greetings", "sup", "yo", "pranam",
)
PAGE_PATTERNS = (
    r"(?i)\b(?:page|opage|pge|pag|pg|p\.?|pno|page\s*no|page\s*number)\s*[:#\-]?\s*(\d+)\b",
    r"(?i)\b(?:on|at|in|see)\s+(?:page|opage|pge)\s*[:#\-]?\s*(\d+)\b",
    r"(?i)\b(\d+)\s*(?:th|st|nd|rd)?\s*(?:page|opage|number\s*page)\b",
)
VISUAL = (
    "diagram", "diagrams", "figure", "figures", "chart", "charts", "graph", "graphs", "plot", "image", "images", "visual", "visuals",
    "drawing", "circuit", "architecture", "layout", "schematic", "blueprint", "illustration", "preview", "photo", "photos", "pic", "pics",
    "picture", "pictures", "snapshot", "crop", "screenshot", "snippet",
)
COMPARATIVE = r"\b(compare|comparison|versus|vs\.?|difference between|differences between)\b"
SEVERAL_PARTS = (
    r"\b(and also|as well as|along with|plus|aur|tatha)\b",
    r"\b(what|how|why|where|when|explain)\b.*\b(and|aur)\b.*\b(what|how|why|where|when|explain)\b",
)
FACTUAL, FACTUAL_WORDS = ("what", "who", "when", "where", "define"), 5
ANALYTICAL = ("compare", "difference", "explain", "why", "how", "analyze", "summarize")
LOOKUP = r"\b(section|chapter|part|model|v\d+|\d+\.\d+)\b"
TOP_K = {"greeting": 1, "page_lookup": 5, "visual": 4, "comparative": 6, "multi_part": 6, "factual": 4, "analytical": 5, "lookup": 4, "standard": 5}
REFUSALS = (
    r"\b(i could not find|could not be found|i cannot find|cannot be found)\b",
    r"\b(there is no mention|no mention of|not mentioned in (the )?documents?)\b",
    r"\b(not present in (the )?documents?|not found in (the )?provided|not in the provided)\b",
    r"\b(the provided documents? (do not|does not) contain|documents? contain no information)\b",
    r"\b(no information provided about|no details (are )?available in)\b",
    r"\b(based on the provided context, there is no|based on the context, there is no)\b",
    r"\b(is not specified in the uploaded|are not specified in the uploaded)\b",
)
STOP_WORDS = (
    "the", "a", "an", "is", "of", "and", "or", "in", "to", "for", "with", "diagram", "diagrams", "figure", "figures", "chart", "charts",
    "show", "give", "me", "what", "how", "part", "image", "images", "photo", "photos", "picture", "pictures", "pic", "pics", "preview", "crop",
    "snapshot", "document", "doc", "pdf", "file", "page", "section", "portion", "content", "view", "display", "take", "send", "tell", "about",
    "write", "extract", "find", "please", "can", "you", "there", "this", "that", "from", "here", "box", "node", "component",
)
#: Words of mixed queries and what they mean, replaced in this order; a query is mixed if it holds one of MIXED_SIGNS.
MIXED_WORDS = (
    ("bhai", ""), ("yaar", ""), ("isme", "in this"), ("isme se", "from this"), ("ye", "this"), ("yeh", "this"), ("kaise", "how"),
    ("kaam karta hai", "works mechanics architecture"), ("kaam karti hai", "works mechanics architecture"), ("karta hai", "does"),
    ("karti hai", "does"), ("kya hai", "what is definition details"), ("kya", "what"), ("konsa", "which"), ("kounsa", "which"),
    ("batao", "explain describe details"), ("samjhao", "explain overview details"), ("karo", ""), ("kariye", ""), ("aur", "and"),
    ("tatha", "and"), ("ke bare me", "about regarding"), ("bare me", "about regarding"), ("ke baare mein", "about regarding"),
    ("baare mein", "about regarding"), ("fayde", "benefits advantages"), ("nuksan", "disadvantages limitations"),
    ("antar", "difference comparison"), ("farq", "difference comparison"),
)
MIXED_SIGNS = ("bhai", "yaar", "isme", "kaise", "kya", "konsa", "batao", "samjhao", "ke bare", "karta hai", "fayde", "antar")
PAIR = (
    r"(?i)(?:compare|comparison between|difference between|differences between)\s+([a-zA-Z0-9_\-\s]+?)\s+(?:and|with|versus|vs\.?)"
    r"\s+([a-zA-Z0-9_\-\s]+)"
)
CLAUSES = r"(?i)\b(?:and also|as well as|along with|plus|and what|and how|and why|and where|and explain|\band\b)\b|,"
CLAUSE_START = r"(?i)^(what is|tell me about|how does|why is|explain)\s+"
NO_CLAUSE = ("this", "that", "it", "how")
SUMMARY_SIGNS = ("summarize", "summary", "overview", "main points", "saaransh")
SUMMARY_TERMS = " abstract executive summary main findings key takeaways"
FIGURE_SIGNS = ("diagram", "figure", "circuit", "flowchart", "schematic", "architecture")
FIGURE_TERMS = " architecture workflow visual schematic layout component diagram"
# ------------------------------------------------------------------------------------------------------------


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(1))


def count_tokens(text: Column) -> Column:
    """Words and single punctuation marks; letters and digits of any script."""
    return F.regexp_count(text, F.lit(TOKEN))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(1))


def clean(text: Column) -> Column:
    """LF line ends, at most one empty line, single spaces, no zero-width characters, trimmed."""
    out = F.regexp_replace(text, r"\r\n?", "\n")
    out = F.regexp_replace(out, "[​‌‍﻿]", "")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    out = F.regexp_replace(out, r" {2,}", " ")
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def is_heading(line: Column) -> Column:
    """Page markers, Markdown, numbered and named sections, lines in capitals, short lines with a colon."""
    line = strip(line)
    fits = reduce(lambda a, b: a | b, (line.rlike(p) for p in HEADINGS))
    capitals = (F.regexp_count(line, F.lit("[A-Za-z]")) >= 4) & (F.upper(line) == line) & ~line.rlike("[.,]$")
    return (F.length(line) > 0) & (F.length(line) <= HEADING_CHARS) & (fits | capitals)


def is_table(text: Column) -> Column:
    """Markdown table: a line of cells followed by a rule of dashes."""
    return text.rlike(r"(?m)^\s*\|.*\|\s*\n\s*\|[\s:|-]+\|\s*$")


def contextual(text: Column, title: Column, section: Column, page: Column) -> Column:
    """'[Document: .. | Page: n | Section: ..]' and the text; missing parts are left out."""
    parts = F.concat_ws(
        " | ",
        F.concat(F.lit("Document: "), title),
        F.concat(F.lit("Page: "), page.cast("string")),
        F.concat(F.lit("Section: "), section),
    )
    return F.when(parts == "", text).otherwise(F.concat(F.lit("["), parts, F.lit("]\n"), text))


def markdown_row(cells: Column) -> Column:
    """An array of cells as a row: bars escaped, line ends as spaces, nulls empty."""
    safe = F.transform(cells, lambda c: F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), r"\s*\n\s*", " "))
    return F.concat(F.lit("| "), F.array_join(safe, " | "), F.lit(" |"))


def document_type(name: Column, parent: Column) -> Column:
    """From keywords of the file name without its suffix, then of its folder, in list order; else other."""
    stem, out = F.lower(F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")), None
    for where, kinds in ((stem, DOCUMENT_TYPES), (F.lower(parent), FOLDER_TYPES)):
        for key, kind in kinds:
            out = F.when(where.contains(key), kind) if out is None else out.when(where.contains(key), kind)
    return out.otherwise("other")


def is_greeting(query: Column) -> Column:
    """At most three words; a greeting as a whole, or one of them is."""
    whole = F.regexp_replace(F.lower(strip(query)), r"[!.,? ]+$", "")
    w = words(whole)
    return (F.size(w) <= 3) & (whole.isin(*GREETINGS) | F.arrays_overlap(w, F.array(*map(F.lit, GREETINGS)))) & (F.length(query) > 0)


def target_page(query: Column) -> Column:
    """The page that a query names, 1 to 10000, by the first pattern that finds one, else null."""
    found = [F.regexp_extract(query, p, 1).try_cast("long") for p in PAGE_PATTERNS]
    return F.coalesce(*(F.when(x.between(1, 10_000), x) for x in found))


def _has(w: Column, terms) -> Column:
    return F.arrays_overlap(w, F.array(*map(F.lit, terms)))


def _any(text: Column, patterns) -> Column:
    return reduce(lambda a, b: a | b, (text.rlike(p) for p in patterns))


def intent(query: Column) -> Column:
    """The first that fits: greeting, page_lookup, visual, comparative, multi_part, factual, analytical, lookup, standard."""
    low = F.lower(query)
    w = F.array_distinct(words(query))
    return (
        F.when(is_greeting(query), "greeting")
        .when(target_page(query).isNotNull(), "page_lookup")
        .when(_has(w, VISUAL), "visual")
        .when(low.rlike(COMPARATIVE), "comparative")
        .when(_any(low, SEVERAL_PARTS) | (F.regexp_count(query, F.lit(r"\?")) > 1), "multi_part")
        .when((F.size(w) <= FACTUAL_WORDS) & _has(w, FACTUAL), "factual")
        .when(_has(w, ANALYTICAL), "analytical")
        .when(low.rlike(LOOKUP), "lookup")
        .otherwise("standard")
    )


def top_k(kind: Column) -> Column:
    out = F.lit(TOP_K["standard"])
    for name, k in TOP_K.items():
        out = F.when(kind == name, k).otherwise(out)
    return out


def normalise_mixed(query: Column) -> Column:
    """Known words of mixed-language queries replaced, in list order; other queries, and results under four characters, stay."""
    plain = strip(query)
    low = F.lower(plain)
    out = low
    for a, b in MIXED_WORDS:
        out = F.regexp_replace(out, rf"\b{a}\b", b)
    out = strip(F.regexp_replace(out, r"\s+", " "))
    return F.when(_any(low, (rf"\b{x}\b" for x in MIXED_SIGNS)) & (F.length(out) >= 4), out).otherwise(plain)


def parts_of(query: Column, most: int = 4) -> Column:
    """Sub-queries, each once, the first `most`: the normalised query, then what one of these finds.

    The sides of a comparison and their difference; up to three pieces between
    question marks and semicolons; clauses between conjunctions and commas.
    """
    whole = strip(query)
    main = normalise_mixed(whole)
    sides = [strip(F.regexp_extract(main, PAIR, k)) for k in (1, 2)]
    features = [F.concat(x, F.lit(" specifications features overview")) for x in sides]
    pair = F.array(main, *features, F.concat(F.lit("comparison difference between "), sides[0], F.lit(" and "), sides[1]))
    pieces = F.filter(F.transform(F.split(whole, "[?;]"), strip), lambda x: F.length(x) > 5)
    asked = F.concat(F.array(main), F.transform(F.slice(pieces, 1, 3), normalise_mixed))

    def bare(clause: Column) -> Column:
        edges = F.regexp_replace(strip(clause), r"^[,. ]+|[,. ]+$", "")
        return strip(F.regexp_replace(edges, CLAUSE_START, ""))

    clauses = F.split(main, CLAUSES)
    kept = F.filter(F.transform(clauses, bare), lambda x: (F.length(x) > 3) & ~x.isin(*NO_CLAUSE))
    several = F.when(F.size(clauses) > 1, F.concat(F.array(main), kept)).otherwise(F.array(main))
    out = F.when((F.length(sides[0]) > 0) & (F.length(sides[1]) > 0), pair).when(F.size(pieces) > 1, asked).otherwise(several)
    return F.when(F.length(whole) == 0, F.array(query)).otherwise(F.slice(F.array_distinct(out), 1, most))


def expand_intent(query: Column) -> Column:
    """The query with terms of a summary, or else of a figure, if it asks for one."""
    low, plain = F.lower(query), strip(query)
    asks = lambda signs: reduce(lambda a, b: a | b, (low.contains(x) for x in signs))
    return (
        F.when(asks(SUMMARY_SIGNS), F.concat(plain, F.lit(SUMMARY_TERMS)))
        .when(asks(FIGURE_SIGNS), F.concat(plain, F.lit(FIGURE_TERMS)))
        .otherwise(plain)
    )


def keywords(query: Column) -> Column:
    """Words of ASCII letters, digits, dashes, dots, of two characters or more, that are no stop words; in order, repeated ones too."""
    found = F.regexp_extract_all(F.lower(query), F.lit(r"([a-zA-Z0-9_\-\.]+)"), F.lit(1))
    return F.filter(found, lambda w: (F.length(w) > 1) & ~w.isin(*STOP_WORDS))


def search_tokens(query: Column) -> Column:
    """Distinct tokens of lexical search, of two characters or more."""
    return F.array_distinct(F.regexp_extract_all(F.lower(query), F.lit(r"([a-zA-Z0-9_\-\.]{2,})"), F.lit(1)))


def is_refusal(answer: Column) -> Column:
    return _any(answer, (f"(?i){p}" for p in REFUSALS))


def citations(answer: Column, most: Column) -> Column:
    """Distinct cited chunk numbers from 1 to most, in order; none in a refusal."""
    found = F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.try_cast("int"))
    valid = F.array_distinct(F.filter(found, lambda x: (x >= 1) & (x <= most)))
    return F.when(is_refusal(answer), F.array().cast("array<int>")).otherwise(valid)


def without_citations(answer: Column) -> Column:
    """A refusal without citations and with single spaces; other answers as they are."""
    bare = strip(F.regexp_replace(F.regexp_replace(answer, r"\[\d+\]", ""), " +", " "))
    return F.when(is_refusal(answer), bare).otherwise(answer)


def figure_tags(text: Column) -> Column:
    """[FIGURE: name | page] tags as name@page."""
    names = F.regexp_extract_all(text, F.lit(r"\[FIGURE:\s*([^|\]]+?)\s*\|\s*(\d+)\]"), F.lit(1))
    pages = F.regexp_extract_all(text, F.lit(r"\[FIGURE:\s*([^|\]]+?)\s*\|\s*(\d+)\]"), F.lit(2))
    return F.zip_with(names, pages, lambda n, p: F.concat(n, F.lit("@"), p))


def safe_name(name: Column, most: int = 255) -> Column:
    """The last part of a path: no control characters or double dots, other than letters, digits, _, - and space as _, suffix in lower case."""
    base = F.regexp_replace(strip(F.element_at(F.split(F.regexp_replace(name, "/+$", ""), "/"), -1)), r"[\x00-\x1f\x7f-\x9f]", "")
    base = F.replace(F.replace(base, F.lit(".."), F.lit("")), F.lit("\\"), F.lit(""))
    suffix = F.lower(F.regexp_extract(base, r"^.+(\.[^.]+)$", 1))
    stem = strip(F.regexp_replace(F.substring(base, F.lit(1), F.length(base) - F.length(suffix)), r"[^a-zA-Z0-9_\- ]", "_"))
    stem = F.when(stem == "", "document").otherwise(stem)
    return F.concat(F.substring(stem, F.lit(1), F.greatest(F.lit(10), most - F.length(suffix))), suffix)


def pages_of(text: Column) -> Column:
    """array<struct<page, text>> of a text with [Page n] tags; what stands before the first tag is page 0."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"\[Page (\d{1,6})\]"), F.lit(1)), lambda x: x.cast("int"))
    texts = F.transform(F.split(text, r"\[Page \d{1,6}\]"), lambda x: F.trim(x))
    rows = F.zip_with(F.concat(F.array(F.lit(0)), numbers), texts, lambda p, t: F.struct(p.alias("page"), t.alias("text")))
    return F.filter(rows, lambda r: F.length(r["text"]) > 0)
