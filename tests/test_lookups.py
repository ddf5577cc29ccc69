from pyspark.sql import functions as F

from revspark.functions import lookups as L


def one(spark, expr, values, typ="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {typ}")
    return [r[0] for r in df.select(expr(F.col("x"))).collect()]


def test_ruff_severity_first_letter(spark):
    got = one(spark, L.ruff_severity, ["E501", "F401", "w291", "B006", "S101", "UP001", "X1", "", None])
    assert got == ["high", "critical", "medium", "high", "high", "medium", "medium", "medium", "medium"]


def test_pylint_severity(spark):
    got = one(spark, L.pylint_severity, ["error", "FATAL", "warning", "convention", "refactor", "information", "x"])
    assert got == ["critical", "critical", "high", "low", "medium", "info", "medium"]


def test_quality_category_exact_before_prefix(spark):
    got = one(spark, L.quality_category, ["PLR0801", "PLR0913", "PLR0914", "E501", "W291", "R0801",
                                          "C901", "C9011", "C0114", "N802", "F401", ""])
    assert got == ["duplication", "complexity", "code_smell", "style", "style", "code_smell",
                   "complexity", "complexity", "maintainability", "naming", "code_smell", "code_smell"]


def test_quality_severity_prefix_order(spark):
    got = one(spark, L.quality_severity, ["E1", "F1", "W1", "C1", "R1", "N1", "PLR0913", "B006", "S101"])
    assert got == ["high", "critical", "medium", "low", "medium", "low", "medium", "medium", "medium"]


def test_bandit_maps(spark):
    assert one(spark, L.bandit_severity, ["HIGH", "MEDIUM", "LOW", "high", None]) == \
        ["critical", "high", "medium", "high", "high"]
    assert one(spark, L.bandit_owasp, ["B105", "B104", "B311", "B999"]) == \
        ["A07:2021-Auth Failures", "A04:2021-Insecure Design", "A02:2021-Cryptographic Failures",
         "A03:2021-Injection"]
    assert one(spark, L.bandit_category, ["B608", "B404", "B999"]) == ["sql_injection", "insecure_import",
                                                                          "injection"]
    assert [float(v) for v in one(spark, L.bandit_confidence, ["HIGH", "MEDIUM", "LOW", "x"])] == \
        [0.95, 0.75, 0.5, 0.75]


def test_infer_owasp(spark):
    assert one(spark, L.infer_owasp, ["XSS", "hardcoded_secret", "authorization", "other"]) == \
        ["A03:2021-Injection", "A07:2021-Auth Failures", "A01:2021-Broken Access Control", "A03:2021-Injection"]


def test_normalize_language(spark):
    assert one(spark, L.normalize_language, [" PY ", "JS", "go", "cpp", "Rust", "haskell", " ts "]) == \
        ["python", "javascript", "golang", "c++", "rust", "haskell", "typescript"]


def test_detect_language(spark):
    df = spark.createDataFrame([
        ("a/b.PY", ""), ("x.R", ""), ("x.tsx", ""), ("Makefile", "#!/usr/bin/env python\nx"),
        ("run", "#!/bin/bash\necho"), ("s", "import os\ndef f(): pass"), ("t", "function f() { let x }"),
        ("u", "hello"), ("v.cs", ""), ("w.hpp", "")], "p string, c string")
    got = [r[0] for r in df.select(L.detect_language(F.col("p"), F.col("c"))).collect()]
    assert got == ["python", "r", "typescript", "python", "shell", "python", "javascript", "unknown",
                   "csharp", "cpp"]


def test_severity_rank(spark):
    assert one(spark, L.severity_rank, ["critical", "high", "medium", "low", "info", "bogus"]) == [0, 1, 2, 3, 4, 5]
