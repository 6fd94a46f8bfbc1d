"""Template explanations of anomalies as column expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import PAGE_PATTERNS
from .scoring import severity_label


def percent_deviation(value: Column, expected: Column) -> Column:
    return F.when(expected != 0, 100 * (value - expected) / F.abs(expected))


def spaced(c: Column) -> Column:
    return F.replace(c, F.lit("_"), F.lit(" "))


def titled(c: Column) -> Column:
    """Letters after anything that is no letter are capitals, all others small."""
    marked = F.regexp_replace(spaced(c), r"([^\p{L}])", "$1\u0001 ")
    return F.replace(F.initcap(marked), F.lit("\u0001 "), F.lit(""))


def amount(c: Column, digits: int = 2) -> Column:
    """With thousands separators, halves to even on the exact binary value."""
    return F.format_number(c, digits)


def fixed(c: Column, digits: int) -> Column:
    return F.replace(amount(c, digits), F.lit(","), F.lit(""))


def _say(*parts) -> Column:
    """Texts and columns in a row; null as soon as one column is."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def middle(low: Column, high: Column) -> Column:
    return (low + high) / 2


def deviation(rows_value: Column, low: Column, high: Column) -> Column:
    """Percent from the middle of the expected range, the ratio first, so that halves round alike; 0 where the middle is 0."""
    mid = middle(low, high)
    return F.coalesce(F.when(mid != 0, (rows_value - mid) / F.abs(mid) * 100), F.lit(0.0))


# --- fixed values: the documented sentences; columns are those of explain() ------------------------------------


def what_happened() -> Column:
    c = F.col
    rose = c("value") > middle(c("expected_min"), c("expected_max"))
    pct = F.abs(deviation(c("value"), c("expected_min"), c("expected_max")))
    return _say(
        "**What Happened:** On ", F.date_format("at", "MMMM dd, yyyy"), " at ", F.date_format("at", "HH:mm"), ", ", titled(c("metric")), " ",
        F.when(rose, "increased").otherwise("decreased"), " to ", amount(c("value")), ", which is a ", severity_label(c("severity")), "-severity ",
        spaced(c("kind")), ". This represents a ", fixed(pct, 1), "% ", F.when(rose, "increase").otherwise("decrease"),
        " from the expected range of ", amount(c("expected_min")), " – ", amount(c("expected_max")), ".",
    )


def where_it_happened() -> Column:
    pairs = F.transform(F.map_entries("dimensions"), lambda e: _say(titled(e["key"]), ": ", e["value"]))
    return F.when(F.size(F.coalesce(F.map_keys("dimensions"), F.array())) > 0, _say("**Where:** This anomaly was concentrated in ", F.array_join(pairs, ", "), "."))



def _named(c: Column, other: str = "Unknown") -> Column:
    return F.coalesce(c, F.lit(other))


def _listed(name: str, n: int, head: str, line, join: str = "; ", end: str = ".") -> Column:
    """head and the first n entries of an array column, null if there is none."""
    return F.when(F.size(F.coalesce(F.col(name), F.array())) > 0, _say(head, F.array_join(F.transform(F.slice(F.col(name), 1, n), line), join), end))


def why_it_happened() -> Column:
    at = F.col("change_point.detected_at")
    parts = F.concat_ws(
        "\n",
        F.when(F.col("hypothesis") != "", _say("**Why:** ", F.col("hypothesis"))),
        _listed("drivers", 3, "**Primary Drivers:** ", lambda d: _say(_named(d["segment"]), " (", fixed(d["contribution"], 1), "% contribution)")),
        _listed("correlations", 3, "**Correlated Metrics:** ", lambda x: _say(titled(_named(x["metric"])), " (r=", fixed(x["coefficient"], 2), ")")),
        F.when(at != "", _say("**Change Point:** A behavioral shift was detected at ", at, " (confidence: ", fixed(100 * F.coalesce("change_point.confidence", F.lit(0.0)), 0), "%).")),
    )
    none = "**Why:** Insufficient evidence to determine a definitive root cause. Consider reviewing recent operational changes or external factors."
    return F.when(parts == "", none).otherwise(parts)


def recommendations() -> Column:
    """array<string> by kind, first driver, first correlation and severity."""
    kind, metric = F.col("kind"), spaced(F.col("metric"))
    driver, other = F.try_element_at("drivers", F.lit(1))["segment"], F.try_element_at("correlations", F.lit(1))["metric"]
    return F.array_compact(F.array(
        F.when(kind == "drop", _say("Investigate the cause of the ", metric, " decline in affected segments."))
        .when(kind == "spike", _say("Verify whether the ", metric, " spike is genuine or caused by data quality issues.")),
        F.when(driver != "", _say("Focus investigation on the ", driver, " segment.")),
        F.when(other != "", _say("Monitor ", spaced(other), " as it shows strong correlation with this anomaly.")),
        F.when(F.col("severity") > 0.7, "Set up alerts for this metric to detect recurrence early."),
        F.lit("Review this finding with domain experts for business context."),
    ))


def summary() -> Column:
    """One line; without drivers the anomaly is only detected."""
    start = _say(severity_label(F.col("severity")), "-severity ", F.col("kind"))
    driver = F.coalesce(F.try_element_at("drivers", F.lit(1))["segment"], F.lit(""))
    driven = _say(start, " in ", titled(F.col("metric")), ", primarily driven by ", driver, ".")
    return F.when(F.size(F.coalesce(F.col("drivers"), F.array())) > 0, driven).otherwise(_say(start, " detected in ", titled(F.col("metric")), "."))


def evidence() -> Column:
    """array<string>: the value, up to three drivers, up to two correlations."""
    c = F.col
    value = _say("Observed value: ", amount(c("value")), " (expected: ", amount(c("expected_min")), " – ", amount(c("expected_max")), ")")
    drivers = F.transform(F.slice("drivers", 1, 3), lambda d: _say("Driver: ", _named(d["segment"], ""), " contributed ", fixed(d["contribution"], 1), "%"))
    others = F.transform(F.slice("correlations", 1, 2), lambda x: _say("Correlation: ", _named(x["metric"], ""), " (r=", fixed(x["coefficient"], 2), ")"))
    none = F.array().cast("array<string>")
    return F.concat(F.array(value), F.coalesce(drivers, none), F.coalesce(others, none))


def prompt_text() -> Column:
    """What a language model would be asked, by sections; those without facts are left out. context, if any, has (text, score) passages."""
    c = F.col
    pct = deviation(c("value"), c("expected_min"), c("expected_max"))
    dims = F.array_join(F.transform(F.map_entries("dimensions"), lambda e: _say(e["key"], "=", e["value"])), ", ")
    change = c("change_point")
    lines = (
        F.lit("Please explain this business anomaly:\n"), F.lit("## Anomaly Data"), _say("- Metric: ", c("metric")),
        _say("- Timestamp: ", F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss")), _say("- Observed Value: ", amount(c("value"))),
        _say("- Expected Range: ", amount(c("expected_min")), " – ", amount(c("expected_max"))),
        _say("- Percentage Deviation: ", F.when(pct >= 0, "+").otherwise(""), fixed(pct, 1), "%"), _say("- Type: ", c("kind")),
        _say("- Severity: ", fixed(c("severity"), 2), " (0-1 scale)"), _say("- Confidence: ", fixed(c("confidence"), 1), "%"),
        F.when(F.size(F.coalesce(F.map_keys("dimensions"), F.array())) > 0, _say("- Affected Segments: ", dims)),
        F.lit("\n## Root Cause Analysis"), _say("- Hypothesis: ", F.coalesce("hypothesis", F.lit(""))),
        _say("- Analysis Confidence: ", fixed(c("cause_confidence"), 2)),
        _listed("drivers", 5, "\n### Primary Drivers:\n", lambda d: _say("  - ", _named(d["segment"]), ": ", fixed(d["contribution"], 1), "% contribution (baseline ratio: ", fixed(F.coalesce(d["baseline_ratio"], F.lit(1.0)), 2), ")"), "\n", ""),
        _listed("correlations", 5, "\n### Correlated Metrics:\n", lambda x: _say("  - ", _named(x["metric"]), ": correlation=", fixed(x["coefficient"], 3), ", p-value=", fixed(F.coalesce(x["p_value"], F.lit(1.0)), 4)), "\n", ""),
        F.when(change.isNotNull(), _say(
            "\n### Change Point: Detected at ", _named(change["detected_at"], "N/A"), "\n  - Confidence: ", fixed(F.coalesce(change["confidence"], F.lit(0.0)), 2),
            "\n  - Before mean: ", amount(F.coalesce(change["before_mean"], F.lit(0.0))), ", After mean: ", amount(F.coalesce(change["after_mean"], F.lit(0.0))))),
        _listed("context", 3, "\n## Business Context (from knowledge base):\n", lambda d: _say("  [", fixed(F.coalesce(d["score"], F.lit(0.0)), 2), "] ", F.substring(_named(d["text"], ""), 1, 300)), "\n", ""),
        _say("\nAudience: ", c("audience"), " stakeholders. ", F.when(c("wants_recommendations"), "Include actionable recommendations.").otherwise("")),
    )
    return F.concat_ws("\n", *lines)


#: Words that open the list of recommendations, characters that mark its items, characters an item must exceed, items kept.
RECOMMENDATION_WORDS, ITEM_MARKS, ITEM_CHARS, MOST_ITEMS = "recommendation|next step|action", "[0-9.\\-•*) ]", 10, 5
# ----------------------------------------------------------------------------------------------------------------

#: Types of what explain() and prompt() need, for rows without them.
CAUSES = {
    "hypothesis": "string", "cause_confidence": "double", "drivers": "array<struct<segment:string,contribution:double,baseline_ratio:double>>",
    "correlations": "array<struct<metric:string,coefficient:double,p_value:double>>",
    "change_point": "struct<detected_at:string,confidence:double,before_mean:double,after_mean:double>",
    "dimensions": "map<string,string>", "confidence": "double", "context": "array<struct<text:string,score:double>>",
}


def _complete(rows: DataFrame) -> DataFrame:
    rows = rows.withColumns({n: F.lit(None).cast(t) for n, t in CAUSES.items() if n not in rows.columns})
    defaults = {"audience": F.lit("business"), "wants_recommendations": F.lit(True)}
    return rows.withColumns({n: c for n, c in defaults.items() if n not in rows.columns})


def explain(rows: DataFrame) -> DataFrame:
    """(anomaly_id, explanation, summary, recommendations, evidence) of anomalies with their causes.

    rows: anomaly_id, metric, kind, at, value, expected_min, expected_max,
    severity, and of CAUSES what is known. Sections without facts are left out,
    without any cause the explanation says so. wants_recommendations false leaves the list out.
    """
    rows = _complete(rows)
    wanted = F.when(F.col("wants_recommendations"), recommendations()).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("_wanted", wanted)
    numbered = F.array_join(F.transform("_wanted", lambda r, i: _say("  ", (i + 1).cast("string"), ". ", r)), "\n")
    sections = F.concat_ws("\n\n", what_happened(), where_it_happened(), why_it_happened())
    return rows.select(
        "anomaly_id", F.concat(sections, F.when(F.size("_wanted") > 0, _say("\n\nRecommended Actions:\n", numbered)).otherwise("")).alias("explanation"),
        summary().alias("summary"), F.col("_wanted").alias("recommendations"), evidence().alias("evidence"),
    )


def prompt(rows: DataFrame) -> DataFrame:
    """(anomaly_id, prompt) of the same rows as explain(); audience and context are optional."""
    return _complete(rows).select("anomaly_id", prompt_text().alias("prompt"))


def usage(requests: DataFrame) -> DataFrame:
    """(total, answered, fallbacks, errors, tokens, mean_millis) of requests (outcome 'model', 'template' or 'error', tokens, millis)."""
    is_ = lambda o: F.count_if(F.col("outcome") == o)
    return requests.agg(
        F.count("*").alias("total"), is_("model").alias("answered"), is_("template").alias("fallbacks"), is_("error").alias("errors"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.round(F.avg("millis"), 2).alias("mean_millis"),
    )


def context_query(metric: Column, kind: Column, dimensions: Column, question: Column | None = None) -> Column:
    """Search text for an anomaly: 'metric: m', each dimension as 'name: value', 'type: t', the question; what is missing or empty is left out."""
    said = lambda head, c: F.when(c != "", _say(head, c))
    pairs = F.array_join(F.transform(F.map_entries(dimensions), lambda e: _say(e["key"], ": ", e["value"])), " ")
    asked = [] if question is None else [said("", question)]
    return F.concat_ws(" ", said("metric: ", metric), said("", pairs), said("type: ", kind), *asked)


def extract_recommendations(text: Column) -> Column:
    """array<string>: list items of free text after a line that speaks of recommendations, next steps or actions.

    Such a line (itself no item) opens the list, a line that begins with ** closes
    it. Items lose their marks and must be longer than ITEM_CHARS; MOST_ITEMS are kept. Null text gives none.
    """
    none = F.array().cast("array<string>")

    def step(s: Column, line: Column) -> Column:
        opens = F.lower(line).rlike(RECOMMENDATION_WORDS)
        closes = s["inside"] & line.startswith("**") & ~line.startswith("**-")
        item = F.trim(F.regexp_replace(line, f"^{ITEM_MARKS}+", ""))
        is_item = s["inside"] & ~opens & ~closes & (F.length(item) > ITEM_CHARS)
        items = F.when(is_item, F.concat(s["items"], F.array(item))).otherwise(s["items"])
        return F.struct((opens | (s["inside"] & ~closes)).alias("inside"), items.alias("items"))

    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    start = F.struct(F.lit(False).alias("inside"), none.alias("items"))
    return F.coalesce(F.slice(F.aggregate(lines, start, step, lambda s: s["items"]), 1, MOST_ITEMS), none)


# --- fixed values: words and patterns of the documented follow-up rules ---------------------------------------
PRONOUNS = frozenset("it its this that these those they them such".split())
FIGURE_ASKED = re.compile(
    r"\b(the\s+(?:photo|image|picture|diagram|figure|chart|graph|plot|table|schematic)|(?:show|send|provide|give|display)\s+(?:me\s+)?(?:the\s+)?"
    r"(?:photo|image|picture|diagram|figure|chart|graph|plot|it|them))\b"
)
SHORT_WORDS = 7
TOPIC_NOISE = (
    r"^(what is|explain|tell me about|how does|why is|describe|send me|provide me|show me|give me|display|crop|preview)\s+",
    r"\b(?:on\s+)?(?:page|pg|p\.?|pno|page\s*no|page\s*number)\s*[:#\-]?\s*\d+\b",
    r"^(?:the\s+)?(?:pic|pics|picture|pictures|photo|photos|image|images|diagram|diagrams|figure|figures|chart|graph|roi|screenshot|crop|snippet)\s+(?:of|from|in)\s+",
    r"\b(?:the\s+)?(?:pic|pics|picture|pictures|photo|photos|image|images|roi|screenshot|snippet)\b",
)
# ----------------------------------------------------------------------------------------------------------------
PAGES, NOISE = [re.compile(p) for p in PAGE_PATTERNS], [re.compile(p, re.I) for p in TOPIC_NOISE]


def words_of(text: str) -> set[str]:
    return set(re.findall(r"\w+", text.lower()))


def page_of(text: str) -> int | None:
    numbers = (int(m[1]) for p in PAGES if (m := p.search(text)))
    return next((n for n in numbers if 1 <= n <= 10_000), None)


def topic_of(text: str) -> str:
    """What a question is about: without its opening words, pages and figure words."""
    for noise in NOISE:
        text = noise.sub("", text).strip("?. ")
    return " ".join(text.split())


def rewrite_follow_up(query: str, history: list[tuple[str, str]]) -> str:
    """A query that leans on the turns before it (role, text), with their page and the topic of the last question that adds words.

    It leans on them if it holds a pronoun, asks for a figure, or is short and asks why, how or what about.
    """
    own, low = words_of(query), query.lower()
    leans = own & PRONOUNS or "the same" in low or FIGURE_ASKED.search(low)
    if not history or not (leans or len(own) <= SHORT_WORDS and ({"why", "how"} & own or "what about" in low)):
        return query
    past = [(role, text.strip()) for role, text in reversed(history) if text.strip() and text.strip() != query]
    page = next((n for _, text in past if (n := page_of(text))), None)
    topics = (topic_of(text) for role, text in past if role == "user")
    topic = next((t for t in topics if len(t) > 2 and not words_of(t) <= own), "")
    out = query.rstrip("?.")
    if page and page_of(query) is None:
        out += f" on page {page}"
    if topic and topic.lower() not in low:
        out += f" regarding {topic}"
    return out.strip() if out != query.rstrip("?.") else query


def rewrite_follow_ups(turns: DataFrame, last: int = 4) -> DataFrame:
    """(conv_id, turn, query) of user turns, rewritten from up to `last` turns before each."""
    past = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-last, -1)
    rows = turns.withColumn("history", F.collect_list(F.struct("role", "text")).over(past)).where("role = 'user'")

    @F.pandas_udf("string")
    def run(query: pd.Series, history: pd.Series) -> pd.Series:
        return pd.Series([rewrite_follow_up(q or "", [(x["role"], x["text"] or "") for x in h]) for q, h in zip(query, history, strict=True)])

    return rows.select("conv_id", "turn", run("text", "history").alias("query"))
