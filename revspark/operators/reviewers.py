"""Reviewers: quality, security, testing; rule scan; union with isolation; extension.

A reviewer is a function ``(inputs: ReviewInputs) -> findings DataFrame``.
The built-in three run in fixed order (agent_ord 0, 1, 2); user reviewers are
appended after them (E1/E2).  Their outputs are unioned (U1) — a reviewer that
raises while its plan is built contributes no rows and is listed in
``failures`` (U2).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import Column, DataFrame
import pandas as pd
from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revspark.functions.text import fill, splitlines
from revspark.operators.isolation import Child
from revspark.operators.normalize import (ai_findings, quality_findings, security_findings, to_findings)
from revspark.schemas import DEFAULT_AGENTS, FINDING_COLUMNS, SECURITY_FALLBACK_EXPLANATION

# ---------------------------------------------------------------------------
# FIXED VALUES — test-file patterns and testing-rule texts
# ---------------------------------------------------------------------------

# A path is a test file when any of these (unanchored) patterns is found in it.
TEST_FILE_PATTERNS = [r"test_.*\.py$", r".*_test\.py$", r"tests?/.*\.py$", r".*_spec\.py$"]

R1_MESSAGE = "Function '{name}' has high complexity ({c}) and should have comprehensive tests"
R1_SUGGESTION = "Create tests covering all {c} paths through this function"
R2_MESSAGE = "Function '{name}' has {n} arguments - ensure all parameter combinations are tested"
R2_SUGGESTION = "Consider testing boundary values and invalid inputs for each parameter"
R3_MESSAGE = "Code contains error handling - ensure exception paths are tested"
R3_SUGGESTION = "Add tests that trigger each exception handler and verify error behavior"
R4_MESSAGE = "Loop structure detected - consider testing boundary conditions"
R4_SUGGESTION = "Test with empty collections, single items, and large collections"
R5_MESSAGE = "Test file appears to have no assertions"
R5_SUGGESTION = "Add assertions to verify expected behavior"
R6_MESSAGE = "Test file has functions that don't follow test naming convention"
R6_SUGGESTION = "Prefix test functions with 'test_' for pytest discovery"

FILE_KEY = ["review_id", "file_path"]
# The kinds of code elements that the testing rules read.
RULE_KINDS = ("function", "async_function", "loop", "file")


def is_test_file(path: Column) -> Column:
    """any of the four patterns found anywhere in the path (what may stand before it need not be matched)."""
    return path.rlike("|".join(f"(?:{p.removeprefix('.*')})" for p in TEST_FILE_PATTERNS))


# ---------------------------------------------------------------------------
# Inputs
# ---------------------------------------------------------------------------

@dataclass
class ReviewInputs:
    """The tables a review reads.  Only ``files`` is required.

    files(review_id, file_path, code[, total_lines])
    raw_findings: scanner rows (S4-S7 output)
    ai_responses(review_id, file_path, agent_name, response): stored model answers
        to the per-file analysis prompts
    suggestions(review_id, file_path, agent_name, prompt_key, response, error):
        stored answers to the per-finding prompts (J1/J2), keyed by the finding's
        prompt key
    elements: code_elements (X); computed from files when absent
    scan_rules: rule table for J8 (list of tuples); none -> no rule scan
    """
    files: DataFrame
    raw_findings: DataFrame | None = None
    ai_responses: DataFrame | None = None
    suggestions: DataFrame | None = None
    elements: DataFrame | None = None
    scan_rules: list | None = None

    def get_elements(self) -> DataFrame:
        """The syntax-tree elements of ``files``.  With stored model answers the
        testing reviewer reads them twice (rules, failed-parse exclusion), so
        they are then checkpointed once instead of parsed twice."""
        if self.elements is None:
            from revspark.operators.structure import extract_elements
            self.elements = extract_elements(self.files, checkpoint=self.ai_responses is not None, kinds=RULE_KINDS)
        return self.elements


def _responses_for(inputs: ReviewInputs, agent: str) -> DataFrame | None:
    if inputs.ai_responses is None:
        return None
    return inputs.ai_responses.filter(F.col("agent_name") == agent)


# ---------------------------------------------------------------------------
# J8 rule scan
# ---------------------------------------------------------------------------

def rule_scan(files: DataFrame, rules) -> DataFrame:
    """Per-line regex rules -> scanner rows (tool ``scan``).

    ``rules`` = [(rule_id, regex, category, severity, owasp, confidence)].  The
    rule table is a handful of literals, so it is compiled into the projection
    (one ``rlike`` per rule) instead of being joined; only matching lines leave
    the map stage.  ``item_ord`` orders hits by line, then rule.
    """
    cand = files.select(*FILE_KEY, F.posexplode(splitlines(F.col("code"))).alias("_pos", "line"))
    hits = F.array(*[F.when(F.col("line").rlike(rx), F.struct(
        F.lit(i).alias("rule_ord"), F.lit(rid).alias("rule_id"), F.lit(cat).alias("category"),
        F.lit(sev).alias("severity"), F.lit(owasp).alias("owasp_category"), F.lit(conf).alias("confidence")))
        for i, (rid, rx, cat, sev, owasp, conf) in enumerate(rules)])
    x = cand.select(*FILE_KEY, (F.col("_pos") + 1).alias("line_number"), "line",
                    F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("h"))
    item = F.col("line_number").cast("long") * len(rules) + F.col("h.rule_ord")
    return x.select(*FILE_KEY, "line_number", item.alias("item_ord"), F.col("h.*"), F.col("line").alias("code_snippet"))


def scan_findings(scan: DataFrame, agent_ord: int = 1, source_ord: int = 1) -> DataFrame:
    """Rule-scan rows -> SecurityAgent findings (after bandit rows in order)."""
    return to_findings(scan.select(
        *FILE_KEY, "item_ord", "line_number", "severity", "category",
        F.concat(F.lit("Rule "), F.col("rule_id"), F.lit(" matched")).alias("message"),
        F.lit("").alias("suggestion"), "rule_id", "code_snippet", "owasp_category", "confidence"),
        "SecurityAgent", agent_ord, source_ord)


# ---------------------------------------------------------------------------
# Built-in reviewers
# ---------------------------------------------------------------------------

def with_fallback(static: DataFrame, ai: DataFrame) -> DataFrame:
    """AI findings only for files with no static finding, appended after them."""
    return static.unionByName(ai.join(static.select(*FILE_KEY).distinct(), FILE_KEY, "left_anti"))


def _enriched(static: DataFrame, inputs: ReviewInputs, kind: str, fallback) -> DataFrame:
    """Key every finding by its prompt (the +-5 line context from the
    file text, J7), attach the stored answers, keep the canonical columns."""
    from revspark.operators.enrich import enrich, with_context
    from revspark.operators.prompts import finding_prompts
    keyed = finding_prompts(with_context(static, inputs.files, 5, "colon"), kind)
    return enrich(keyed, inputs.suggestions, fallback=fallback).select(*FINDING_COLUMNS)


def quality_reviewer(inputs: ReviewInputs, agent_ord: int = 0) -> DataFrame:
    static = None
    if inputs.raw_findings is not None:
        static = quality_findings(inputs.raw_findings, agent_ord)
        if inputs.suggestions is not None:
            static = _enriched(static, inputs, "suggestion", None)
    resp = _responses_for(inputs, "QualityAgent")
    ai = ai_findings(resp, "QualityAgent", agent_ord, 9) if resp is not None else None
    if static is None:
        return ai if ai is not None else empty_findings(inputs.files)
    return with_fallback(static, ai) if ai is not None else static


def security_reviewer(inputs: ReviewInputs, agent_ord: int = 1) -> DataFrame:
    parts = []
    if inputs.raw_findings is not None:
        parts.append(security_findings(inputs.raw_findings, agent_ord))
    if inputs.scan_rules:
        parts.append(scan_findings(rule_scan(inputs.files, inputs.scan_rules), agent_ord))
    static = None
    for p in parts:
        static = p if static is None else static.unionByName(p)
    if static is not None and inputs.suggestions is not None:
        static = _enriched(static, inputs, "explanation", SECURITY_FALLBACK_EXPLANATION)
    resp = _responses_for(inputs, "SecurityAgent")
    ai = ai_findings(resp, "SecurityAgent", agent_ord, 9) if resp is not None else None
    out = [d for d in (static, ai) if d is not None]
    if not out:
        return empty_findings(inputs.files)
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def testing_findings(files: DataFrame | None, elements: DataFrame, responses: DataFrame | None = None,
                     agent_ord: int = 2) -> DataFrame:
    """R1-R7 on code elements; AI items appended; failed parses skip the file.

    One narrow pass: every element row yields its candidate findings (function
    rows R1/R2, loop rows R4, the per-file summary row R3/R5/R6) as an array
    that is exploded — no shuffle, no join, the elements are read once.  A row
    yields two candidates at most, so the array has two places; the empty ones
    go after the generator, since a higher-order function (``filter``) would
    evaluate the whole array outside generated code.
    ``files`` is not read (the per-file facts travel on the summary rows); it
    stays in the signature for symmetry with the other reviewers.
    """
    test = F.col("_test")  # matched once a row: the generator does not take the expression in
    kind = F.col("kind")
    name = F.col("name")
    fn_ok = kind.isin("function", "async_function") & ~test & ~(name.startswith("__") & name.endswith("__"))
    src_fn = F.when(kind == "function", 0).otherwise(1)
    is_file = (kind == "file") & ~F.coalesce(F.col("parse_failed"), F.lit(True))

    def cand(source_ord, item_ord, line, sev, cat, msg, sug, conf):
        return F.struct(
            F.lit(source_ord).cast("int").alias("source_ord") if isinstance(source_ord, int)
            else source_ord.cast("int").alias("source_ord"),
            item_ord.cast("long").alias("item_ord"), line.cast("int").alias("line_number"),
            F.lit(sev).alias("severity"), F.lit(cat).alias("category"),
            (msg if not isinstance(msg, str) else F.lit(msg)).alias("message"),
            (sug if not isinstance(sug, str) else F.lit(sug)).alias("suggestion"),
            F.lit(conf).alias("confidence"))

    called = F.coalesce(name, F.lit("null"))
    walk, one, zero = F.col("walk_ord").cast("long"), F.lit(1), F.lit(0)
    # R1, R3, R4 and R5 exclude one another by kind and by the path, and so do R2 and R6
    cands = F.array(
        F.when(fn_ok & (F.col("complexity") > 5), cand(
            src_fn, walk * 2, F.col("line"), "medium", "low_coverage",
            fill(R1_MESSAGE, name=called, c=F.col("complexity")), fill(R1_SUGGESTION, c=F.col("complexity")), "0.80"))
        .when((kind == "loop") & ~test, cand(3, walk, F.col("line"), "info", "edge_case", R4_MESSAGE, R4_SUGGESTION, "0.60"))
        .when(is_file & ~test & F.col("has_error_handling"),
              cand(2, zero, one, "low", "edge_case", R3_MESSAGE, R3_SUGGESTION, "0.75"))
        .when(is_file & test & F.col("no_assertions"),
              cand(4, zero, one, "high", "test_quality", R5_MESSAGE, R5_SUGGESTION, "0.85")),
        F.when(fn_ok & (F.col("n_args") > 3), cand(
            src_fn, walk * 2 + 1, F.col("line"), "low", "missing_test",
            fill(R2_MESSAGE, name=called, n=F.col("n_args")), R2_SUGGESTION, "0.70"))
        .when(is_file & test & F.col("has_public_function") & ~F.col("has_test_function"),
              cand(5, zero, one, "medium", "test_quality", R6_MESSAGE, R6_SUGGESTION, "0.90")))
    rules = (elements.withColumn("_test", is_test_file(F.col("file_path"))).select(*FILE_KEY, F.explode(cands).alias("c"))
             .where(F.col("c").isNotNull()).select(*FILE_KEY, "c.*"))
    out = to_findings(rules, "TestingAgent", agent_ord)
    if responses is not None:
        failed = elements.filter((kind == "file") & F.col("parse_failed")).select(*FILE_KEY)
        ai = ai_findings(responses, "TestingAgent", agent_ord, 9).join(failed, FILE_KEY, "left_anti")
        out = out.unionByName(ai)
    return out


def testing_reviewer(inputs: ReviewInputs, agent_ord: int = 2) -> DataFrame:
    return testing_findings(inputs.files, inputs.get_elements(), _responses_for(inputs, "TestingAgent"),
                            agent_ord)


def empty_findings(like: DataFrame) -> DataFrame:
    from revspark.schemas import FINDINGS
    none = like.sparkSession.createDataFrame([], FINDINGS)
    return none.withColumn("review_id", F.col("review_id").cast(like.schema["review_id"].dataType)) \
        if isinstance(like.schema["review_id"].dataType, T.StringType) else none


# ---------------------------------------------------------------------------
# Reviewer registry, U1 / U2: union with isolation
# ---------------------------------------------------------------------------

@dataclass
class Reviewer:
    """A named reviewer.  ``fn(inputs, agent_ord) -> findings``; the output is
    normalised (F4) and schema-checked when it is unioned."""
    name: str
    description: str
    fn: Callable[..., DataFrame]


@dataclass
class FileReviewer:
    """A reviewer given as a plain Python function of one file, ``review(file_path, code) -> [finding dict]``.

    It runs on the workers, file by file.  A file on which it raises yields one error row instead of findings, so
    the other files, and the other reviewers' findings for that file, are not lost.

    With ``seconds`` (a file) or ``memory_mb`` it runs in a child process of the worker, one a task: a review that takes
    longer or more memory, or ends its process, yields an error row as well, and the next file gets a new process.
    """
    name: str
    description: str
    review: Callable[[str, str], list]
    seconds: float | None = None
    memory_mb: int | None = None


_FILE_ITEM = T.StructType([
    T.StructField("item_ord", T.LongType()), T.StructField("line_number", T.IntegerType()),
    T.StructField("severity", T.StringType()), T.StructField("category", T.StringType()),
    T.StructField("message", T.StringType()), T.StructField("suggestion", T.StringType()),
    T.StructField("confidence", T.DoubleType()), T.StructField("error", T.StringType())])


def file_caller(reviewer: FileReviewer):
    """(call, close): ``call(file_path, code) -> (item tuples, error)``, in a child process where the reviewer has limits."""
    review, names = reviewer.review, _FILE_ITEM.names[1:-1]

    def items_of(path, code):
        return [tuple(x.get(n) for n in names) for x in review(path, code)]

    def here(path, code):
        try:
            return items_of(path, code), None
        except Exception as e:  # noqa: BLE001 - the reviewer's own code, isolated by file
            return None, f"{type(e).__name__}: {e}"

    if reviewer.seconds is None and reviewer.memory_mb is None:
        return here, lambda: None
    child = Child(items_of, reviewer.seconds, reviewer.memory_mb)
    return child.call, child.close


def file_rows(call, review_id, path, code) -> list[tuple]:
    """The rows of a file: one for each finding, or one with the error."""
    items, error = call(path, code)
    if error is not None:
        return [(review_id, path, 0, *[None] * (len(_FILE_ITEM) - 2), error)]
    return [(review_id, path, k, *x, None) for k, x in enumerate(items, 1)]


def _file_items(files: DataFrame, reviewer: FileReviewer) -> DataFrame:
    """(review_id, file_path, item fields, error): findings of every file, or the reason why there are none."""
    def run(batches):
        call, close = file_caller(reviewer)
        try:
            for b in batches:
                rows = [row for x in zip(b["review_id"], b["file_path"], b["code"]) for row in file_rows(call, *x)]
                out = pd.DataFrame(rows, columns=["review_id", "file_path", *_FILE_ITEM.names])
                yield out.astype({"line_number": "Int32", "item_ord": "int64", "confidence": "float64"})
        finally:
            close()

    schema = T.StructType([files.schema["review_id"], files.schema["file_path"], *_FILE_ITEM.fields])
    from revspark.session import small_batches, write_once
    # findings and errors both read it, and a reviewer need not give the same answer twice
    with small_batches(files.sparkSession):
        return write_once(files.select(*FILE_KEY, "code").mapInPandas(run, schema), "file-items")


BUILTIN = {
    "QualityAgent": quality_reviewer,
    "SecurityAgent": security_reviewer,
    "TestingAgent": testing_reviewer,
}


@dataclass
class ReviewerSet:
    """Ordered reviewers; an empty set means the three defaults."""
    reviewers: list = field(default_factory=list)

    def __post_init__(self):
        if not self.reviewers:
            self.reviewers = [Reviewer(n, d, BUILTIN[n]) for n, d in DEFAULT_AGENTS]

    def add(self, reviewer: Reviewer) -> None:
        self.reviewers.append(reviewer)

    def remove(self, name: str) -> bool:
        for i, r in enumerate(self.reviewers):
            if r.name == name:
                self.reviewers.pop(i)
                return True
        return False

    def list(self) -> list[tuple[str, str]]:
        return [(r.name, r.description) for r in self.reviewers]

    def names(self) -> list[str]:
        return [r.name for r in self.reviewers]


def run_reviewers(inputs: ReviewInputs, reviewers: ReviewerSet | None = None):
    """U1 + U2: union every reviewer's findings in reviewer order.

    Returns ``(findings, failures)`` where failures lists reviewers whose plan
    could not be built (they contribute no rows; the review still completes).
    Building a plan runs no Spark job, but for reviewers that run file by file
    (their answers are written once); what Spark itself raises, other than a
    plan that does not resolve, is no reviewer's failure and is raised again.
    """
    run = run_isolated(inputs, reviewers)
    return run.findings, run.failures


@dataclass
class ReviewerRun:
    findings: DataFrame          # of all reviewers, in their order
    failures: list               # (reviewer, reason) of those whose plan could not be built
    file_errors: DataFrame       # (review_id, file_path, agent_name, reason) of reviewers that failed on a file


def run_isolated(inputs: ReviewInputs, reviewers: ReviewerSet | None = None) -> ReviewerRun:
    """:func:`run_reviewers` with the errors by file of reviewers that run file by file."""
    reviewers = reviewers or ReviewerSet()
    out, errors, failures = None, None, []
    for i, r in enumerate(reviewers.reviewers):
        try:
            if isinstance(r, FileReviewer):
                items = _file_items(inputs.files, r)
                df = items.filter(F.col("error").isNull()).drop("error")
                bad = items.filter(F.col("error").isNotNull()).select(
                    *FILE_KEY, F.lit(r.name).alias("agent_name"), F.col("error").alias("reason"))
                errors = bad if errors is None else errors.unionByName(bad)
            else:
                df = r.fn(inputs, i)
            df = _conform(df, r.name, i)
        except Exception as e:  # noqa: BLE001 - isolation is the point
            if isinstance(e, (PySparkException, Py4JError)) and not isinstance(e, AnalysisException):
                raise
            failures.append((r.name, f"{type(e).__name__}: {e}"))
            continue
        out = df if out is None else out.unionByName(df)
    if errors is None:
        errors = inputs.files.select(*FILE_KEY, F.lit("").alias("agent_name"), F.lit("").alias("reason")).limit(0)
    return ReviewerRun(out if out is not None else empty_findings(inputs.files), failures, errors)


def _conform(df: DataFrame, name: str, agent_ord: int) -> DataFrame:
    missing = [c for c in ("review_id", "file_path", "line_number", "severity", "category", "message",
                           "confidence") if c not in df.columns]
    if missing:
        raise ValueError(f"reviewer {name} output lacks {missing}")
    if list(df.columns) == FINDING_COLUMNS:
        return df
    if "item_ord" not in df.columns:
        # an order that follows from the rows, the same in every run
        df = df.withColumn("item_ord", F.xxhash64("line_number", "severity", "category", "message", "confidence"))
    return to_findings(df.withColumn("agent_name", F.lit(name)), agent_ord=agent_ord)
