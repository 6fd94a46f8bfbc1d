"""Explanations, prompts, recommendations and search texts, branch by branch."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lakesignal.operators import explain, figures

ROW = {
    "anomaly_id": 1, "metric": "net_revenue", "kind": "drop", "at": dt.datetime(2024, 5, 1, 10, 0), "value": 1234.5, "expected_min": 2000.0,
    "expected_max": 3000.0, "severity": 0.75, "confidence": 88.25, "cause_confidence": 0.6, "dimensions": {"sales_region": "West"}, "hypothesis": "Outage.",
    "drivers": [{"segment": "West", "contribution": 61.25, "baseline_ratio": 0.5}, {"segment": None, "contribution": 20.0, "baseline_ratio": None}],
    "correlations": [{"metric": "order_count", "coefficient": 0.875, "p_value": 0.0123}],
    "change_point": {"detected_at": "2024-04-28", "confidence": 0.9, "before_mean": 2500.0, "after_mean": 1200.0},
}
DDL = "anomaly_id int, metric string, kind string, at timestamp, value double, expected_min double, expected_max double, severity double, " + ", ".join(
    f"{n} {t}" for n, t in explain.CAUSES.items() if n != "context"
)


def row(spark, **changes):
    values = ROW | changes
    return spark.createDataFrame([tuple(values[f.split(" ")[0]] for f in DDL.split(", ") if " " in f and f.split(" ")[0] in values)], DDL)


def explained(spark, **changes):
    return explain.explain(row(spark, **changes)).first()


def test_whole_explanation(spark):
    r = explained(spark)
    assert r.explanation == (
        "**What Happened:** On May 01, 2024 at 10:00, Net Revenue decreased to 1,234.50, which is a Critical-severity drop. "
        "This represents a 50.6% decrease from the expected range of 2,000.00 – 3,000.00.\n\n"
        "**Where:** This anomaly was concentrated in Sales Region: West.\n\n"
        "**Why:** Outage.\n**Primary Drivers:** West (61.2% contribution); Unknown (20.0% contribution).\n"
        "**Correlated Metrics:** Order Count (r=0.88).\n"
        "**Change Point:** A behavioral shift was detected at 2024-04-28 (confidence: 90%).\n\n"
        "Recommended Actions:\n  1. Investigate the cause of the net revenue decline in affected segments.\n"
        "  2. Focus investigation on the West segment.\n  3. Monitor order count as it shows strong correlation with this anomaly.\n"
        "  4. Set up alerts for this metric to detect recurrence early.\n  5. Review this finding with domain experts for business context."
    )
    assert r.summary == "Critical-severity drop in Net Revenue, primarily driven by West."
    assert r.evidence == [
        "Observed value: 1,234.50 (expected: 2,000.00 – 3,000.00)", "Driver: West contributed 61.2%", "Driver:  contributed 20.0%", "Correlation: order_count (r=0.88)",
    ]


def test_without_causes(spark):
    r = explained(spark, dimensions=None, hypothesis="", drivers=[], correlations=None, change_point=None, kind="spike", value=4000.0, severity=0.1)
    assert "increased to 4,000.00, which is a Low-severity spike. This represents a 60.0% increase" in r.explanation
    assert "**Where:**" not in r.explanation and "**Why:** Insufficient evidence to determine a definitive root cause." in r.explanation
    assert r.summary == "Low-severity spike detected in Net Revenue."
    assert r.recommendations == [
        "Verify whether the net revenue spike is genuine or caused by data quality issues.", "Review this finding with domain experts for business context.",
    ]


@pytest.mark.parametrize(
    ("changes", "part"),
    [
        ({"expected_min": -5.0, "expected_max": 5.0}, "a 0.0% increase from the expected range of -5.00 – 5.00"),
        ({"kind": "contextual_drop"}, "Critical-severity contextual drop."),
        ({"severity": 0.4}, "High-severity"), ({"severity": 0.2}, "Medium-severity"), ({"metric": "it's 2nd_sale"}, "It'S 2Nd Sale decreased"),
        ({"change_point": {"detected_at": "", "confidence": 0.9, "before_mean": 1.0, "after_mean": 1.0}}, "(r=0.88).\n\nRecommended"),
        ({"drivers": None}, "**Why:** Outage.\n**Correlated"),
    ],
)
def test_branches(spark, changes, part):
    assert part in explained(spark, **changes).explanation


def test_no_recommendations_on_request(spark):
    r = explain.explain(row(spark).withColumn("wants_recommendations", F.lit(False))).first()
    assert "Recommended Actions" not in r.explanation and r.recommendations == []


def test_prompt_sections(spark):
    full = row(spark).withColumn("context", F.array(*(F.struct(F.lit(t).alias("text"), F.lit(s).alias("score")) for t, s in (("y" * 400, 0.5), ("b", 0.25), ("c", 0.1), ("d", 0.0)))))
    text = explain.prompt(full).first().prompt
    assert text == (
        "Please explain this business anomaly:\n\n## Anomaly Data\n- Metric: net_revenue\n- Timestamp: 2024-05-01T10:00:00\n- Observed Value: 1,234.50\n"
        "- Expected Range: 2,000.00 – 3,000.00\n- Percentage Deviation: -50.6%\n- Type: drop\n- Severity: 0.75 (0-1 scale)\n- Confidence: 88.2%\n"
        "- Affected Segments: sales_region=West\n\n## Root Cause Analysis\n- Hypothesis: Outage.\n- Analysis Confidence: 0.60\n\n"
        "### Primary Drivers:\n  - West: 61.2% contribution (baseline ratio: 0.50)\n  - Unknown: 20.0% contribution (baseline ratio: 1.00)\n\n"
        "### Correlated Metrics:\n  - order_count: correlation=0.875, p-value=0.0123\n\n"
        "### Change Point: Detected at 2024-04-28\n  - Confidence: 0.90\n  - Before mean: 2,500.00, After mean: 1,200.00\n\n"
        f"## Business Context (from knowledge base):\n  [0.50] {'y' * 300}\n  [0.25] b\n  [0.10] c\n\n"
        "Audience: business stakeholders. Include actionable recommendations."
    )
    bare = explain.prompt(row(spark, dimensions=None, drivers=None, correlations=None, change_point=None, value=2750.0)).first().prompt
    assert "+10.0%" in bare and "###" not in bare and "Segments" not in bare and "Context" not in bare


def test_context_query(spark):
    q = lambda m, k, d, ask: spark.range(1).select(explain.context_query(F.lit(m), F.lit(k), d, ask).alias("q")).first().q
    dims = F.create_map(F.lit("b"), F.lit("1"), F.lit("a"), F.lit("2"))
    assert q("sales", "drop", dims, F.lit("Why?")) == "metric: sales b: 1 a: 2 type: drop Why?"
    assert q("", None, F.lit(None).cast("map<string,string>"), None) == ""


@pytest.mark.parametrize(
    ("text", "items"),
    [
        ("Intro item line\n**Recommendations**\n- check the feeds\n2. call the owner\n* short\n", ["check the feeds", "call the owner"]),
        ("Next steps\n(1) wait and see it\n**Evidence**\n- a line of evidence", ["(1) wait and see it"]),
        ("take ACTION now:\n**- bold item stays in\nplain line is an item", ["**- bold item stays in", "plain line is an item"]),
        ("recommendation\n" + "\n".join(f"- item number {i}" for i in range(9)), [f"item number {i}" for i in range(5)]),
        ("no opening line\n- never an item", []), ("", []), (None, []),
        ("Recommendations:\n- first long item\nThese actions too\n- second long item", ["first long item", "second long item"]),
    ],
)
def test_recommendations_of_free_text(spark, text, items):
    df = spark.createDataFrame([(text,)], "t string")
    want = [i.removeprefix("**- ") for i in items]  # marks at the start go
    assert df.select(explain.extract_recommendations(F.col("t"))).first()[0] == want


def test_figure_class_and_shape(spark):
    rows = [(0.0451, 14.0, 10.0), (0.045, 10.0, 13.0), (0.0151, 10.0, 9.5), (0.015, 0.0, 5.0), (0.0, 13.0, 10.0)]
    df = spark.createDataFrame(rows, "e double, w double, h double")
    got = [tuple(r) for r in df.select(figures.figure_class(F.col("e")), figures.aspect(F.col("w"), F.col("h"))).collect()]
    assert got == [
        (figures.SCHEMATIC, "1.4:1 (Landscape)"), (figures.CHART, "1:1.3 (Portrait)"), (figures.CHART, "1.05:1 (Standard)"),
        (figures.PHOTO, "1:1 (Square)"), (figures.PHOTO, "1.30:1 (Standard)"),
    ]


def test_deviation_takes_the_ratio_first(spark):
    """-52.45 % of the middle is a little less in doubles if the ratio comes first, as in the documented formula."""
    from pyspark.sql import functions as F

    low, high = F.lit(156000.0), F.lit(250000.0)
    got = spark.range(1).select(explain.fixed(explain.deviation(F.lit(96526.5), low, high), 1), explain.deviation(F.lit(1.0), F.lit(0.0), F.lit(0.0))).first()
    assert tuple(got) == ("-52.4", 0.0)
