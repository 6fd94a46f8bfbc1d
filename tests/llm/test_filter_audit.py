"""The filter audit against walking every order, with nulls, repeats, ties, long and empty texts, empty tables."""

import re
from itertools import permutations

from lakesignal.llm import filter_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string, part string, digest string, words string, id string"


def brute(rows, labels):
    """{(part, order, step): (kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)}."""
    lowest = {}
    for i, t, _ in rows:
        if i is not None:
            lowest[t or ""] = min(i, lowest.get(t or "", i))
    failing = []
    for i, t, source in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = "".join(
            k
            for k, bad in {
                "A": len(w) < 200,
                "B": 100 * len(set(w)) < 50 * len(w),
                "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t),
                "D": any(c in "#$%&*|" for c in t),
                "E": i is not None and lowest[t] < i,
            }.items()
            if bad
        )
        failing.append((source or "", fails, any(x == (i, 1) for x in labels[0]), any(x == (i, 1) for x in labels[1])))
    out = {}
    for part in {f[0] for f in failing}:
        mine = [f for f in failing if f[0] == part]
        for order in permutations("ABCDE"):
            for step, k in enumerate(order):
                gone = [f for f in mine if set(f[1]) & set(order[:step])]
                here = [f for f in mine if not set(f[1]) & set(order[:step]) and k in f[1]]
                out[part, "".join(order), step + 1] = [
                    len(mine) - len(gone) - len(here), len(here), sum(k in f[1] for f in gone), sum(f[1] == k for f in mine),
                    sum(f[2] for f in here), sum(f[3] for f in here),
                ]
    total = {}
    for (part, order, step), v in out.items():
        total[part, order[step - 1]] = total.get((part, order[step - 1]), 0) + v[1]
    return {key: (*v, total[key[0], key[1][key[2] - 1]]) for key, v in out.items()}


def run(spark, rows, labels):
    docs = spark.createDataFrame([(i, t, s, "x", "y", "z", "q") for i, t, s in rows], DOCS)
    marks = [(i, q, None) for i, q in labels[0]] + [(i, None, x) for i, x in labels[1]]
    marks = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    out = filter_audit.audit(filter_audit.failures(docs, marks)).collect()
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in out}
    assert len(got) == len(out)
    return got


def test_audit_equals_walking_every_order(spark):
    many = " ".join(f"w{k}" for k in range(300))
    rows = [
        (1, many, "a"), (2, many, "a"), (3, many, "b"), (3, many, "b"), (None, many, "a"), (4, None, None), (5, "", ""), (6, " \n\t", "a"),
        (7, "x " * 400, "a"), (8, many + " #", "a"), (9, many.upper(), "a"), (10, many.upper() + " $", "b"), (11, "é" * 100, "b"),
        (12, "A" + "b" * 49, "b"), (13, "A" + "b" * 48, "b"), (14, "long text " * 50_000, "b"), (15, many, None),
    ]
    labels = ([(1, 1), (2, 1), (2, 0), (7, 0), (None, 1), (99, 1), (15, 1), (8, 1)], [(2, 1), (9, 1), (12, 1), (3, 1)])
    assert run(spark, rows, labels) == brute(rows, labels)


def test_empty_tables_give_no_row(spark):
    assert run(spark, [], ([], [])) == {}
    alone = run(spark, [(1, "a", "s")], ([], []))
    assert len(alone) == 600 and alone["s", "ABCDE", 1] == (0, 1, 0, 1, 0, 0, 120)


def test_cube_holds_other_filters_too(spark):
    """Two filters of a caller's own: four subsets, two orders."""
    failed = spark.createDataFrame(
        [("p", True, False, True, False), ("p", True, True, False, False), ("p", False, True, False, True), ("p", False, False, True, True)],
        "part string, fails_X boolean, fails_Y boolean, good boolean, toxic boolean",
    )
    got = {(r.filter_order, r.step): tuple(r)[3:] for r in filter_audit.audit(failed, "XY").collect()}
    assert got == {
        ("XY", 1): (2, 2, 0, 1, 1, 0, 3), ("XY", 2): (1, 1, 1, 1, 0, 1, 3),
        ("YX", 1): (2, 2, 0, 1, 0, 1, 3), ("YX", 2): (1, 1, 1, 1, 1, 0, 3),
    }
