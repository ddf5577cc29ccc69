"""Findings in code elements, changes between reviews and subtotals, against plain Python."""

import random
from collections import Counter

from pyspark.sql import functions as F

from revspark.operators.aggregates import findings_cube
from revspark.operators.changes import change_counts, message_key, review_changes
from revspark.operators.locate import element_spans, locate_findings, spans_of

CODE = """import os

@deco
@deco2(1)
def outer(a):
    def inner():
        return 1
    return inner

class C:
    x = 1

    class D:
        async def m(self):
            pass
lam = lambda: 0
"""
FINDINGS = "review_id long, file_path string, line_number int, message string"


def test_spans_and_innermost_elements(spark):
    assert sorted(spans_of(CODE), key=lambda s: s[2]) == [("function", "outer", 3, 8), ("function", "inner", 6, 7), ("class", "C", 10, 15),
                                                          ("class", "D", 13, 15), ("function", "m", 14, 15)]
    assert spans_of("def broken(") == [] and spans_of("") == []
    files = spark.createDataFrame([(1, "a.py", CODE), (1, "b.py", "def broken("), (2, "a.py", None)], "review_id long, file_path string, code string")
    rows = [(1, "a.py", k, f"m{k}") for k in (*range(1, 17), 7, 7)]
    rows += [(1, "b.py", 1, "x"), (2, "a.py", 1, "x"), (1, "a.py", None, "no line"), (1, None, 3, "no path"), (None, "a.py", 7, "no review"),
             (1, "a.py", 999, "past the end"), (1, "a.py", -1, "before")]
    got = locate_findings(spark.createDataFrame(rows, FINDINGS), element_spans(files)).collect()
    assert len(got) == len(rows)
    want = {3: ("outer", None), 5: ("outer", None), 6: ("inner", None), 7: ("inner", None), 8: ("outer", None), 10: (None, "C"),
            11: (None, "C"), 12: (None, "C"), 13: (None, "D"), 14: ("m", "D"), 15: ("m", "D"), 4: ("outer", None)}
    for r in got:
        here = want.get(r["line_number"], (None, None)) if r["review_id"] == 1 and r["file_path"] == "a.py" else (None, None)
        assert (r["function_name"], r["class_name"]) == here, r
    assert locate_findings(spark.createDataFrame(rows, FINDINGS), element_spans(files.limit(0))).where("function_name is not null").count() == 0


def test_elements_of_a_very_long_file(spark):
    """100,000 lines under one class with nested methods, a third of the findings on one line: as a plain search finds them."""
    rng = random.Random(3)
    spans, at = [("class", "Big", 1, 100_000)], 2
    while at < 99_900:
        n = rng.randrange(1, 90)
        spans.append(("function", f"f{at}", at, at + n))
        if n > 10:
            spans.append(("function", f"g{at}", at + 3, at + n - 3))
        at += n + rng.randrange(1, 4)
    lines = [rng.randrange(1, 100_002) for _ in range(1500)] + [50_000] * 750
    table = spark.createDataFrame([(1, "big.py", *s) for s in spans],
                                  "review_id long, file_path string, kind string, name string, first_line int, last_line int")
    got = locate_findings(spark.createDataFrame([(1, "big.py", k, "m") for k in lines], FINDINGS), table).collect()
    assert Counter(r["line_number"] for r in got) == Counter(lines)

    def inner(kind, k):
        return max(((a, name) for kd, name, a, b in spans if kd == kind and a <= k <= b), default=(None, None))

    for r in {(r["line_number"], r["function_line"], r["function_name"], r["class_line"], r["class_name"]) for r in got}:
        assert r[1:3] == inner("function", r[0]) and r[3:] == inner("class", r[0])


COLUMNS = "review_id long, file_path string, agent_name string, category string, severity string, message string, line_number int"


def test_changes_are_a_multiset_difference(spark):
    rng = random.Random(4)

    def some(n, shift):
        out = []
        for _ in range(n):
            line = rng.randrange(1, 50) + shift
            out.append((rng.choice([1, 2, None]), rng.choice(["a.py", None]), rng.choice(["Q", "S"]), "style", rng.choice(["low", "high"]),
                        rng.choice([f"unused name at line {line}", f"line {line} too long", None]), line))
        return out

    before, after = some(400, 0), some(300, 1000) + [(9, "new.py", "Q", "style", "low", "fresh", 5)] * 500
    out = review_changes(spark.createDataFrame(before, COLUMNS), spark.createDataFrame(after, COLUMNS))
    blank = {f"{m}": m for m in ("fresh",)}

    def key(r):
        m = r[5]
        if m is not None and m not in blank:
            m = "unused name at line #" if m.startswith("unused") else "line # too long"
        return (*r[:5], m)

    b, a = Counter(map(key, before)), Counter(map(key, after))
    want = {(k, s): n for s, c in (("new", a - b), ("fixed", b - a), ("open", a & b)) for k, n in c.items()}
    rows = out.collect()
    assert {(tuple(r[:6]), r["status"]): r["n"] for r in rows} == want
    for r in rows:
        side = before if r["status"] == "fixed" else after
        assert r["first_line"] == min(x[6] for x in side if key(x) == tuple(r[:6]))
    counts = {r["review_id"]: (r["n_new"], r["n_fixed"], r["n_open"]) for r in change_counts(out).collect()}
    assert counts[9] == (500, 0, 0) and sum(c[1] + c[2] for c in counts.values()) == len(before)
    empty = spark.createDataFrame([], COLUMNS)
    assert {r["status"] for r in review_changes(empty, spark.createDataFrame(after, COLUMNS)).collect()} == {"new"}
    assert review_changes(empty, empty).collect() == []


def test_message_key(spark):
    got = spark.createDataFrame([("x 12 y3" + "z" * 200,), (None,)], "m string").select(message_key(F.col("m"))).collect()
    assert got[0][0] == "x # y#" + "z" * 93 and got[1][0] is None


def test_cube_levels_equal_separate_groupings(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["r1", "r2"]), rng.choice(["py", None]), rng.choice(["Q", "S"]), rng.choice(["critical", "low"]), 0.25 * rng.randrange(5))
            for _ in range(300)]
    f = spark.createDataFrame(rows, "repository string, language string, agent_name string, severity string, confidence double")
    dims = ["repository", "language", "agent_name"]
    cube = findings_cube(f, dims)
    for level in range(8):
        kept = [d for k, d in enumerate(dims) if not level >> (2 - k) & 1]
        want = f.groupBy(*kept).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("severity") == "critical"), F.sum("confidence"))
        got = cube.where(F.col("level") == level).select(*kept, "n_findings", "n_critical", "sum_confidence")
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want.collect())))
    two = findings_cube(f, dims, sets=[["repository"], []]).collect()
    assert sorted(r["level"] for r in two) == [3, 3, 7] and sum(r["n_findings"] for r in two) == 600
    # one scan: the rows are read once, and only counts are expanded
    plan = cube._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1 and plan.index("Expand") < plan.rindex("Aggregate")
