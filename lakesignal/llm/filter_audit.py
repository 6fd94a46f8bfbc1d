"""How a chain of filters interacts: what each keeps, removes and repeats in every order, from one CUBE.

Each document gets a flag for each filter that it fails. Equal (part, flags,
labels) are counted, and a CUBE over part and flags sums the counts: a grouping
set whose flags are all false counts the survivors of that subset of filters.
Joining each subset with the one that has a filter more gives what that filter
removes there, and every order of the filters is a path through such pairs.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations, permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, computed, settle, table

#: Filter letters, in the order of their bits.
FILTERS = "ABCDE"
LEAST_WORDS = 200
#: Percentages: least share of distinct words, largest share of capitals.
LEAST_DISTINCT, MOST_CAPITALS = 50, 2
SYMBOLS = "[#$%&*|]"
MEASURES = ["docs", "good", "toxic"]


def text_flags(text: Column, words: Column) -> dict[str, Column]:
    """Failure conditions of the filters that look at one text; text is not null, words its words."""
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * F.size(words),
        "C": 100 * capitals > MOST_CAPITALS * F.length(text),
        "D": text.rlike(SYMBOLS),
    }


def failures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, fails_A ... fails_E, good, toxic) of every document.

    Null texts are empty, null parts the empty string. E holds where a smaller id
    has the same text (compared by SHA-256); rows without an id never fail E and
    make no other row fail it, rows of one id don't make each other fail. Several
    labels of an id count as good or toxic if one of them says so. Other columns
    of docs are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("body"))
    rows = computed(rows, "words", F.array_remove(F.split("body", SPACES), ""))
    rows = rows.select("id", "part", F.sha2(F.col("body").cast("binary"), 256).alias("digest"), *(c.alias(f"fails_{k}") for k, c in text_flags(F.col("body"), F.col("words")).items()))
    rows = settle(rows, "audit-rows")

    # The first row of each text, found by its id: no key is shared by the rows of a text.
    first = rows.where(F.col("id").isNotNull()).groupBy("digest").agg(F.min("id").alias("id")).withColumn("is_first", F.lit(True))
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id"))
    marks = marks.agg(*(F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(k) for k, c in (("good", "quality"), ("toxic", "toxic"))))
    repeats = F.col("id").isNotNull() & F.col("is_first").isNull()
    rows = rows.join(first, ["id", "digest"], "left").join(marks, "id", "left")
    return rows.select(
        "part", *(f"fails_{k}" for k in "ABCD"), repeats.alias("fails_E"), *(F.coalesce(k, F.lit(False)).alias(k) for k in ("good", "toxic"))
    )


def survivors(failed: DataFrame, filters: str = FILTERS, part_col: str = "part") -> DataFrame:
    """(part, subset, docs, good, toxic): what stays in each part after every subset of the filters.

    subset is a bit mask, bit i for filters[i]. Subsets that nothing survives are rows of zeros.
    """
    flags = [f"fails_{k}" for k in filters]
    counts = [F.count("*"), F.sum(F.col("good").cast("long")), F.sum(F.col("toxic").cast("long"))]
    counted = failed.groupBy(part_col, *flags).agg(*(c.alias(m) for c, m in zip(counts, MEASURES, strict=True)))
    chosen = reduce(lambda a, b: a + b, ((1 - F.grouping(f).cast("int")) * (1 << i) for i, f in enumerate(flags)))
    cube = counted.cube(part_col, *flags).agg(
        *(F.sum(m).alias(m) for m in MEASURES), chosen.alias("subset"), F.grouping(part_col).alias("whole")
    )
    clean = reduce(lambda a, b: a & b, (~F.coalesce(F.col(f), F.lit(False)) for f in flags))
    stays = cube.where((F.col("whole") == 0) & clean).select(F.col(part_col).alias("part"), "subset", *MEASURES)
    subsets = F.explode(F.sequence(F.lit(0), F.lit((1 << len(filters)) - 1)))
    every = counted.select(F.col(part_col).alias("part")).distinct().select("part", subsets.alias("subset"))
    return every.join(stays, ["part", "subset"], "left").select("part", "subset", *(F.coalesce(m, F.lit(0)).alias(m) for m in MEASURES))


def pairs_of(filters: str = FILTERS) -> list[tuple]:
    """(filter, subset before, subset after, orders in which the filter comes right after that subset)."""
    n, out = len(filters), []
    for i, name in enumerate(filters):
        others = [j for j in range(n) if j != i]
        for size in range(n):
            for chosen in combinations(others, size):
                before = sum(1 << j for j in chosen)
                out.append((name, before, before | 1 << i, factorial(size) * factorial(n - 1 - size)))
    return out


def orders_of(filters: str = FILTERS) -> list[tuple]:
    """(filter_order, step, filter, subset before) of every step of every order."""
    bit = {k: 1 << i for i, k in enumerate(filters)}
    return [("".join(p), s + 1, k, sum(bit[x] for x in p[:s])) for p in permutations(filters) for s, k in enumerate(p)]


def audit(failed: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Every part, filter order and step of failures(): what the step's filter keeps, removes and repeats.

    A part without documents has no row, an empty table gives none; zeros are
    rows. Work after the first count is a row for each part, subset and order,
    whatever the number of documents.
    """
    spark = failed.sparkSession
    stays = settle(survivors(failed, filters), "audit-subsets")
    few = F.broadcast(spark.createDataFrame(pairs_of(filters), "filter string, before int, after int, orders long"))
    before = stays.select("part", F.col("subset").alias("before"), *(F.col(m).alias(f"{m}_before") for m in MEASURES))
    after = stays.select("part", F.col("subset").alias("after"), *MEASURES)
    step = before.join(few, "before").join(after, ["part", "after"])
    removed = F.col("docs_before") - F.col("docs")
    everything = (1 << len(filters)) - 1
    of_filter = step.groupBy("part", "filter").agg(
        F.sum(F.when(F.col("before") == 0, removed)).alias("failing"),
        F.sum(F.when(F.col("after") == everything, removed)).alias("unique_fails"),
        F.sum(F.col("orders") * removed).alias("shapley"),
    )
    step = step.select(
        "part", "filter", "before", F.col("docs").alias("kept"), removed.alias("removed"),
        (F.col("good_before") - F.col("good")).alias("good_lost"), (F.col("toxic_before") - F.col("toxic")).alias("toxic_lost"),
    )
    order = F.broadcast(spark.createDataFrame(orders_of(filters), "filter_order string, step int, filter string, before int"))
    return step.join(of_filter, ["part", "filter"]).join(order, ["filter", "before"]).select(
        "part", "filter_order", "step", "kept", "removed", (F.col("failing") - F.col("removed")).alias("redundant"),
        "unique_fails", "good_lost", "toxic_lost", "shapley",
    )


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    """The five filters of FILTERS over all documents, by source, in all 120 orders.

    Null texts are empty, a null source is the part ''; repeated rows count each, very long texts are one row's
    work; an empty table gives no row. See failures() for ties and missing ids.
    """
    return audit(failures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), l AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), m AS (
  SELECT t, min(doc_id) AS lowest FROM d GROUP BY t
), f AS (
  SELECT d.part, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic,
         map(['A', 'B', 'C', 'D', 'E'],
             [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
              100 * length(regexp_replace(d.t, '[^A-Z]', '', 'g')) > 2 * length(d.t),
              regexp_matches(d.t, '[#$%&*|]'), coalesce(d.doc_id > m.lowest, false)]) AS fails
  FROM d JOIN m ON d.t = m.t LEFT JOIN l ON d.doc_id = l.doc_id
), g AS (
  SELECT part, good, toxic, fails, count(*) AS n FROM f GROUP BY ALL
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT [a.x, b.x, c.x, d.x, e.x] AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT o, CAST(step AS INTEGER) AS step, o[step] AS x, o[:step - 1] AS before FROM orders, range(1, 6) s(step)
), seen AS (
  SELECT g.part, s.o, s.step, s.x, g.n, g.good, g.toxic, g.fails[s.x] AS failing,
         len(list_filter(s.before, lambda b: g.fails[b])) > 0 AS gone,
         len(list_filter(map_values(g.fails), lambda v: v)) = 1 AS alone
  FROM g, steps s
), counts AS (
  SELECT part, o, step, x,
         coalesce(sum(n) FILTER (WHERE NOT failing AND NOT gone), 0) AS kept,
         coalesce(sum(n) FILTER (WHERE failing AND NOT gone), 0) AS removed,
         coalesce(sum(n) FILTER (WHERE failing AND gone), 0) AS redundant,
         coalesce(sum(n) FILTER (WHERE failing AND alone), 0) AS unique_fails,
         coalesce(sum(n) FILTER (WHERE failing AND NOT gone AND good), 0) AS good_lost,
         coalesce(sum(n) FILTER (WHERE failing AND NOT gone AND toxic), 0) AS toxic_lost
  FROM seen GROUP BY part, o, step, x
)
SELECT part, array_to_string(o, '') AS filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM counts
"""
