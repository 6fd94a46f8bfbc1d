"""Quality rules: base thresholds, then a decision list learned from labelled documents.

Text statistics are SQL functions over each row. Sequential covering grows
threshold conjunctions over the statistics of a bounded labelled sample, prunes
them on held-back rows and emits them as an ordered conditional expression.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, SPACES, computed, fresh, labelled, let

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Labelled documents that the rules are learned from, at most.
SAMPLE_ROWS = 20_000
#: Of the rows that a rule rejects, this share must be labelled 0.
MIN_PRECISION = 0.97
MAX_RULES, MAX_CONDITIONS, CUTS = 12, 3, 32

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RATIOS = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "repeats_per_word": ("n_repeat_words", "n_words"),
    "distinct_per_word": ("n_distinct", "n_words"),
    "chars_per_word": ("word_chars", "n_words"),
    "upper_per_char": ("n_upper", "word_chars"),
    "cries_per_word": ("n_cries", "n_words"),
    "stops_per_word": ("n_stops", "n_words"),
    "digits_per_char": ("n_digits", "word_chars"),
    "dup_lines_per_line": ("n_dup_lines", "n_lines"),
    "words_per_line": ("n_words", "n_lines"),
}


def repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window which the text holds twice or more.

    Windows compare by a 64-bit hash. Sorting (hash, place) brings equal
    windows together; the sorted places of those then cover min(3, gap) words each.
    """

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            twin = F.filter(
                s, lambda x, k: (F.get(s, k + 1)["h"] == x["h"]) | (F.get(s, k - 1)["h"] == x["h"])
            )
            return F.sort_array(F.transform(twin, lambda x: x["i"]))

        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("at"))
        return F.aggregate(
            let(pairs, places),
            start,
            lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["at"])).alias("n"), p.alias("at")),
            lambda a: a["n"],
        )

    size = F.size(words)
    hashes = F.transform(
        F.sequence(F.lit(0), size - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    )
    return F.when(size < 3, F.lit(0).cast("long")).otherwise(let(hashes, covered))


def _left(text: Column, pattern: str) -> Column:
    """Characters of text that the pattern does not remove."""
    return F.length(F.regexp_replace(text, pattern, "")).cast("long")


def with_stats(docs: DataFrame, name: str, text_col: str = "text") -> DataFrame:
    """docs with a struct column `name` of the counts and ratios of each whole text."""
    words, text = fresh(docs, "words"), F.coalesce(F.col(text_col), F.lit(""))
    docs = computed(docs, words, F.array_remove(F.split(text, SPACES), ""))
    w = F.col(words)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    line_counts = let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d")))
    counts = F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.translate(text, SPACE_CHARS, "")).cast("long").alias("word_chars"),
        _left(text, r"[^#*$%&|<>]+").alias("n_symbols"),
        repeated_words(w).alias("n_repeat_words"),
        F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
        _left(text, r"\P{Lu}+").alias("n_upper"),
        _left(text, r"[^!?]+").alias("n_cries"),
        _left(text, r"[^.]+").alias("n_stops"),
        _left(text, r"[^0-9]+").alias("n_digits"),
        line_counts.alias("lines"),
    )

    def ratios(c: Column) -> Column:
        n_lines = c["lines"]["n"].cast("long")
        values = {k: c[k] for k in ("n_words", "word_chars", "n_symbols", "n_repeat_words", "n_distinct")}
        values |= {k: c[k] for k in ("n_upper", "n_cries", "n_stops", "n_digits")}
        values |= {"n_lines": n_lines, "n_dup_lines": n_lines - c["lines"]["d"]}
        return F.struct(
            *(values[k].alias(k) for k in COUNTS),
            *(F.try_divide(values[a], values[b]).cast("double").alias(k) for k, (a, b) in RATIOS.items()),
        )

    return computed(docs, name, let(counts, ratios)).drop(words)


def base_failed(stats: Column, min_words: int = MIN_WORDS, max_percent: int = MAX_REPEAT_PERCENT) -> Column:
    return (stats["n_words"] < min_words) | (100 * stats["n_repeat_words"] > max_percent * stats["n_words"])


@dataclass
class Rule:
    """Rejects where all conditions (statistic, '>=' or '<=', threshold) hold; counts are those of the sample."""

    conditions: list[tuple[str, str, float]]
    rejected: int = 0
    good_rejected: int = 0

    def column(self, stats: Column) -> Column:
        tests = [stats[k] >= v if op == ">=" else stats[k] <= v for k, op, v in self.conditions]
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return F.coalesce(out, F.lit(False))


@dataclass
class DecisionList:
    rules: list[Rule] = field(default_factory=list)

    def kept(self, stats: Column) -> Column:
        """The ordered conditional expression: the first rule that fits rejects."""
        out = None
        for r in self.rules:
            out = F.when(r.column(stats), F.lit(False)) if out is None else out.when(r.column(stats), F.lit(False))
        return F.lit(True) if out is None else out.otherwise(F.lit(True))

    def __str__(self) -> str:
        lines = [" and ".join(f"{k} {op} {v:.4g}" for k, op, v in r.conditions) for r in self.rules]
        return "\n".join(f"reject if {x}  # {r.rejected} rows, {r.good_rejected} good" for x, r in zip(lines, self.rules, strict=True))


def _masks(values: list[float | None], cuts: list[float]) -> dict[tuple[str, float], int]:
    """Row sets as integers: a bit for each row whose value passes the test."""
    order = sorted((i for i, v in enumerate(values) if v is not None), key=values.__getitem__)
    known = sum(1 << i for i in order)
    out, below, at = {}, 0, 0
    for c in cuts:
        while at < len(order) and values[order[at]] < c:
            below |= 1 << order[at]
            at += 1
        upto, j = below, at
        while j < len(order) and values[order[j]] == c:
            upto |= 1 << order[j]
            j += 1
        out[">=", c], out["<=", c] = known & ~below, upto
    return out


def learn(rows: list[tuple], names: list[str]) -> DecisionList:
    """Sequential covering over rows (statistics..., label): conjunctions that find label 0.

    Two thirds of the rows grow a rule by information gain, the rest prune it;
    a rule is kept if MIN_PRECISION of all rows that it newly rejects are
    labelled 0. Without rows of both labels the list is empty.
    """
    bad = sum(1 << i for i, r in enumerate(rows) if r[-1] == 0)
    everything = (1 << len(rows)) - 1
    if not bad or bad == everything:
        return DecisionList()
    grow = sum(1 << i for i in range(len(rows)) if i % 3)
    tests: list[tuple[tuple[str, str, float], int]] = []
    for k, name in enumerate(names):
        cuts = set()
        for label in (0, 1):
            own = sorted(r[k] for r in rows if r[-1] == label and r[k] is not None)
            cuts |= {own[(len(own) - 1) * q // CUTS] for q in range(CUTS + 1)} if own else set()
        tests += [((name, op, c), m) for (op, c), m in _masks([r[k] for r in rows], sorted(cuts)).items()]

    def worth(cover: int) -> float:
        p, n = (cover & bad & ~grow).bit_count(), (cover & ~bad & ~grow).bit_count()
        return (p - n) / (p + n) if p + n else -1.0

    found, left = [], everything
    least = max(3, bad.bit_count() // 200)
    while len(found) < MAX_RULES and (left & bad).bit_count() >= least:
        cover, chosen = left, []
        while len(chosen) < MAX_CONDITIONS and (cover & ~bad & grow):
            p0, n0 = (cover & bad & grow).bit_count(), (cover & ~bad & grow).bit_count()
            best = (0.0, None, 0)
            for test, m in tests:
                p = (cover & m & bad & grow).bit_count()
                if p:
                    n = (cover & m & ~bad & grow).bit_count()
                    best = max(best, (p * (log2(p / (p + n)) - log2(p0 / (p0 + n0))), test, m), key=lambda x: x[0])
            if best[1] is None:
                break
            chosen.append(best[1:])
            cover &= best[2]
        pruned = True
        while pruned and len(chosen) > 1:
            pruned = False
            for i in range(len(chosen) - 1, -1, -1):
                rest, wide = chosen[:i] + chosen[i + 1 :], left
                for _, m in rest:
                    wide &= m
                if worth(wide) >= worth(cover):
                    chosen, cover, pruned = rest, wide, True
                    break
        n_bad, n_all = (cover & bad).bit_count(), cover.bit_count()
        if not chosen or n_bad < least or n_bad < MIN_PRECISION * n_all:
            break
        found.append(Rule([t for t, _ in chosen], n_all, n_all - n_bad))
        left &= ~cover
    return DecisionList(found)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DecisionList:
    """Learn a decision list from at most SAMPLE_ROWS labelled documents that pass the base thresholds.

    Only statistics of the text are learned from, no other column.
    """
    sample = labelled(labels, SAMPLE_ROWS)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = with_stats(texts.join(F.broadcast(sample), "id"), "stats")
    rows = rows.where(~base_failed(F.col("stats"))).select("id", *(F.col(f"stats.{k}") for k in RATIOS), "label")
    got = sorted(tuple(r) for r in rows.collect())
    return learn([r[1:] for r in got], list(RATIOS))


def quality_rules(docs: DataFrame, rules: DecisionList, name: str = "quality_rules", text_col: str = "text") -> DataFrame:
    """docs with a struct column `name`: the statistics, base_failed and kept.

    kept is false where base_failed, else the first fitting rule rejects. A
    null or empty text has no words: counts 0, ratios null, base_failed. Rows
    are judged one by one, so repeated rows all stay; other columns pass
    through untouched, whatever their names.
    """
    stats = fresh(docs, "stats")
    out = with_stats(docs, stats, text_col)
    s = F.col(stats)
    failed = base_failed(s)
    kept = F.when(failed, F.lit(False)).otherwise(rules.kept(s))
    fields = [s[k].alias(k) for k in [*COUNTS, *RATIOS]]
    return out.withColumn(name, F.struct(*fields, failed.alias("base_failed"), kept.alias("kept"))).drop(stats)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules learned from labels keep, with their own columns."""
    name = fresh(docs, "verdict")
    judged = quality_rules(docs, fit(docs, labels), name)
    return judged.where(F.col(name)["kept"]).drop(name)


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Every document's counts, base verdict and learned verdict."""
    from .common import table

    docs = table(spark, sf_dir, "documents")
    rules = fit(docs, table(spark, sf_dir, "labels"))
    out = quality_rules(docs.select("doc_id", "text"), rules)
    q = F.col("quality_rules")
    return out.select("doc_id", *(q[k].alias(k) for k in [*COUNTS, "base_failed", "kept"]))
