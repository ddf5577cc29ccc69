"""Code-table lookups: rule code / tool label -> shared vocabulary.

Every lookup is a native expression generated from an ordered list of pairs —
a literal-map lookup for exact tables, one map lookup per key length for
first-prefix tables, a CASE chain for short or non-string tables: JVM-side,
inside whole-stage codegen, no join and no UDF, and the input is evaluated once
so generated code stays small.  The tables are FIXED VALUES (they must equal
the behaviour being reproduced) and are written out plainly in their natural
order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from revspark.schemas import COMPLEXITY_WEIGHTS, SEVERITIES

# ---------------------------------------------------------------------------
# FIXED VALUES — tool code tables
# ---------------------------------------------------------------------------

# ruff: severity by the first letter of the code (upper-cased).
RUFF_SEVERITY_BY_LETTER = [
    ("E", "high"), ("F", "critical"), ("W", "medium"), ("C", "low"), ("N", "low"),
    ("I", "low"), ("B", "high"), ("A", "medium"), ("S", "high"), ("T", "low"),
    ("P", "medium"), ("R", "medium"), ("U", "medium"),
]

# pylint: severity by lower-cased message type.
PYLINT_SEVERITY_BY_TYPE = [
    ("error", "critical"), ("fatal", "critical"), ("warning", "high"),
    ("convention", "low"), ("refactor", "medium"), ("information", "info"),
]

# Quality reviewer: category by exact code, else first matching prefix in this
# order, else code_smell.
QUALITY_CATEGORY = [
    ("C901", "complexity"), ("PLR0911", "complexity"), ("PLR0912", "complexity"),
    ("PLR0913", "complexity"), ("PLR0915", "complexity"),
    ("N801", "naming"), ("N802", "naming"), ("N803", "naming"), ("N806", "naming"),
    ("C0103", "naming"),
    ("E", "style"), ("W", "style"), ("C0301", "style"), ("C0303", "style"),
    ("R", "code_smell"), ("PLR", "code_smell"),
    ("C0114", "maintainability"), ("C0115", "maintainability"), ("C0116", "maintainability"),
    ("PLR1714", "duplication"), ("PLR0801", "duplication"),
]

# Quality reviewer: severity by first matching prefix in this order, else medium.
QUALITY_SEVERITY = [
    ("E", "high"), ("F", "critical"), ("W", "medium"), ("C", "low"), ("R", "medium"),
    ("N", "low"), ("PL", "medium"),
]

# bandit: severity label -> severity (case-sensitive), else high.
BANDIT_SEVERITY = [("HIGH", "critical"), ("MEDIUM", "high"), ("LOW", "medium")]

# bandit: confidence label -> confidence, else 0.75.
BANDIT_CONFIDENCE = [("HIGH", "0.95"), ("MEDIUM", "0.75"), ("LOW", "0.50")]

# bandit: category by test id, else injection.
BANDIT_CATEGORY = [
    ("B608", "sql_injection"),
    ("B105", "hardcoded_secret"), ("B106", "hardcoded_secret"), ("B107", "hardcoded_secret"),
    ("B403", "insecure_import"), ("B404", "insecure_import"), ("B405", "insecure_import"),
    ("B406", "insecure_import"), ("B407", "insecure_import"), ("B408", "insecure_import"),
    ("B409", "insecure_import"), ("B410", "insecure_import"),
    ("B303", "cryptography"), ("B304", "cryptography"), ("B305", "cryptography"),
    ("B324", "cryptography"),
    ("B102", "injection"), ("B103", "injection"), ("B609", "injection"), ("B610", "injection"),
    ("B611", "injection"), ("B701", "injection"), ("B702", "injection"), ("B703", "injection"),
]

# bandit: OWASP class by test id, else A03.  B105/B106/B107 are listed twice in
# the behaviour being reproduced; the later entry (A07) is the effective one, so
# the table holds the effective value.
BANDIT_OWASP = [
    ("B501", "A01:2021-Broken Access Control"), ("B502", "A01:2021-Broken Access Control"),
    ("B503", "A01:2021-Broken Access Control"),
    ("B303", "A02:2021-Cryptographic Failures"), ("B304", "A02:2021-Cryptographic Failures"),
    ("B305", "A02:2021-Cryptographic Failures"), ("B311", "A02:2021-Cryptographic Failures"),
    ("B324", "A02:2021-Cryptographic Failures"),
    ("B102", "A03:2021-Injection"), ("B103", "A03:2021-Injection"), ("B608", "A03:2021-Injection"),
    ("B609", "A03:2021-Injection"), ("B610", "A03:2021-Injection"), ("B611", "A03:2021-Injection"),
    ("B701", "A03:2021-Injection"), ("B702", "A03:2021-Injection"), ("B703", "A03:2021-Injection"),
    ("B104", "A04:2021-Insecure Design"),
    ("B105", "A07:2021-Auth Failures"), ("B106", "A07:2021-Auth Failures"),
    ("B107", "A07:2021-Auth Failures"),
    ("B108", "A05:2021-Security Misconfiguration"), ("B110", "A05:2021-Security Misconfiguration"),
    ("B112", "A05:2021-Security Misconfiguration"), ("B201", "A05:2021-Security Misconfiguration"),
    ("B403", "A06:2021-Vulnerable Components"), ("B404", "A06:2021-Vulnerable Components"),
    ("B405", "A06:2021-Vulnerable Components"), ("B406", "A06:2021-Vulnerable Components"),
    ("B407", "A06:2021-Vulnerable Components"), ("B408", "A06:2021-Vulnerable Components"),
    ("B409", "A06:2021-Vulnerable Components"), ("B410", "A06:2021-Vulnerable Components"),
]
DEFAULT_OWASP = "A03:2021-Injection"

# Finding category (lower-cased) -> OWASP class, else A03.
OWASP_BY_CATEGORY = [
    ("sql_injection", "A03:2021-Injection"), ("xss", "A03:2021-Injection"),
    ("injection", "A03:2021-Injection"), ("hardcoded_secret", "A07:2021-Auth Failures"),
    ("authentication", "A07:2021-Auth Failures"),
    ("authorization", "A01:2021-Broken Access Control"),
    ("cryptography", "A02:2021-Cryptographic Failures"),
    ("insecure_import", "A06:2021-Vulnerable Components"),
]

# Requested language aliases (after lower + strip).
LANGUAGE_ALIASES = [
    ("py", "python"), ("js", "javascript"), ("ts", "typescript"), ("rb", "ruby"),
    ("rs", "rust"), ("go", "golang"), ("java", "java"), ("cpp", "c++"), ("c", "c"),
]

# Language by file extension (checked on the lower-cased path; ".R" can never
# match a lower-cased path and is kept only as listed).
LANGUAGE_BY_EXTENSION = [
    (".py", "python"), (".pyw", "python"), (".pyi", "python"),
    (".js", "javascript"), (".jsx", "javascript"), (".ts", "typescript"), (".tsx", "typescript"),
    (".java", "java"), (".rb", "ruby"), (".go", "go"), (".rs", "rust"),
    (".cpp", "cpp"), (".cc", "cpp"), (".cxx", "cpp"), (".c", "c"), (".h", "c"), (".hpp", "cpp"),
    (".cs", "csharp"), (".php", "php"), (".swift", "swift"), (".kt", "kotlin"), (".kts", "kotlin"),
    (".scala", "scala"), (".r", "r"), (".R", "r"), (".sql", "sql"),
    (".sh", "shell"), (".bash", "shell"), (".zsh", "shell"),
    (".yml", "yaml"), (".yaml", "yaml"), (".json", "json"), (".xml", "xml"),
    (".html", "html"), (".htm", "html"), (".css", "css"), (".scss", "scss"), (".sass", "sass"),
    (".less", "less"), (".md", "markdown"), (".markdown", "markdown"),
]


# ---------------------------------------------------------------------------
# CASE builders
# ---------------------------------------------------------------------------

def _lit(v):
    return v if isinstance(v, Column) else F.lit(v)


def map_lookup(col: Column, pairs, default) -> Column:
    """Exact-match table as a literal map lookup (first key wins).

    ``col`` is referenced once, so a large input expression (another lookup, a
    parsed field) is not copied into every branch the way a CASE chain does."""
    seen, flat = set(), []
    for k, v in pairs:
        if k in seen:
            continue
        seen.add(k)
        flat += [F.lit(k), v if isinstance(v, Column) else F.lit(v)]
    found = F.try_element_at(F.create_map(*flat), col)
    return found if default is None else F.coalesce(found, _lit(default))


def case_exact(col: Column, pairs, default) -> Column:
    """``CASE col WHEN k1 THEN v1 ... ELSE default END`` (first key wins).

    Tables with string keys and literal values are looked up in a literal map
    (the input is evaluated once); other tables stay a CASE chain."""
    if len(pairs) >= 3 and all(isinstance(k, str) and not isinstance(v, Column) for k, v in pairs):
        return map_lookup(col, pairs, default)
    expr = None
    for k, v in pairs:
        cond = col == F.lit(k)
        expr = F.when(cond, _lit(v)) if expr is None else expr.when(cond, _lit(v))
    return expr.otherwise(_lit(default)) if expr is not None else _lit(default)


def case_prefix(col: Column, pairs, default, exact_first: bool = False) -> Column:
    """First key (in list order) that ``col`` starts with; exact match optional first.

    Compact form: for each distinct key length L one literal-map lookup of the
    first L characters yields (position in the list, value); the smallest
    position wins (``least`` skips misses).  The expression size grows with the
    number of distinct key lengths, not with the number of keys.
    """
    by_len: dict[int, dict] = {}
    for i, (k, v) in enumerate(pairs):
        by_len.setdefault(len(k), {}).setdefault(k, (i, v))
    cands = []
    for n, table in sorted(by_len.items()):
        flat = []
        for k, (i, v) in table.items():
            flat += [F.lit(k), F.struct(F.lit(i).alias("i"), _lit(v).alias("v"))]
        cands.append(F.try_element_at(F.create_map(*flat), F.substring(col, 1, n)))
    best = (F.least(*cands) if len(cands) > 1 else cands[0])["v"]
    if exact_first:
        return F.coalesce(map_lookup(col, pairs, None), best, _lit(default))
    return F.coalesce(best, _lit(default))


# ---------------------------------------------------------------------------
# M1 .. M12, T12
# ---------------------------------------------------------------------------

def ruff_severity(code: Column) -> Column:
    """M1: severity from the first letter of a ruff code; empty/other -> medium."""
    letter = F.upper(F.substring(F.coalesce(code, F.lit("")), 1, 1))
    return case_exact(letter, RUFF_SEVERITY_BY_LETTER, "medium")


def pylint_severity(msg_type: Column) -> Column:
    """M2: severity from the pylint message type; other -> medium."""
    return case_exact(F.lower(F.coalesce(msg_type, F.lit(""))), PYLINT_SEVERITY_BY_TYPE, "medium")


def quality_category(rule: Column) -> Column:
    """M3: exact code, then first prefix in table order, else code_smell."""
    return case_prefix(F.coalesce(rule, F.lit("")), QUALITY_CATEGORY, "code_smell", exact_first=True)


def quality_severity(rule: Column) -> Column:
    """M4: first prefix in table order, else medium."""
    return case_prefix(F.coalesce(rule, F.lit("")), QUALITY_SEVERITY, "medium")


def bandit_severity(label: Column) -> Column:
    """M6: HIGH/MEDIUM/LOW (case-sensitive) -> critical/high/medium, else high."""
    return case_exact(label, BANDIT_SEVERITY, "high")


def bandit_category(test_id: Column) -> Column:
    """M7."""
    return case_exact(test_id, BANDIT_CATEGORY, "injection")


def bandit_owasp(test_id: Column) -> Column:
    """M8."""
    return case_exact(test_id, BANDIT_OWASP, DEFAULT_OWASP)


def bandit_confidence(label: Column) -> Column:
    """M9: confidence as DECIMAL(3,2)."""
    return case_exact(label, BANDIT_CONFIDENCE, "0.75").cast("decimal(3,2)")


def infer_owasp(category: Column) -> Column:
    """OWASP class from a finding category (lower-cased)."""
    return case_exact(F.lower(category), OWASP_BY_CATEGORY, DEFAULT_OWASP)


def normalize_language(lang: Column) -> Column:
    """Lower + strip (Unicode whitespace) + alias."""
    norm = F.regexp_replace(F.lower(lang), r"^[\s\u001c-\u001f\u0085\p{Z}]+|[\s\u001c-\u001f\u0085\p{Z}]+$", "")
    return F.when(lang.isNull(), F.lit(None)).otherwise(case_exact(norm, LANGUAGE_ALIASES, norm))


def detect_language(path: Column, code: Column) -> Column:
    """Last extension of the lower-cased path, then shebang, then content."""
    ext = F.regexp_extract(F.lower(path), r"(\.[^.]*)$", 1)
    by_ext = case_exact(ext, LANGUAGE_BY_EXTENSION, F.lit(None).cast("string"))
    first_line = F.substring_index(code, "\n", 1)
    shebang = (F.when(~code.startswith("#!/"), F.lit(None))
               .when(first_line.contains("python"), F.lit("python"))
               .when(first_line.contains("node") | first_line.contains("js"), F.lit("javascript"))
               .when(first_line.contains("ruby"), F.lit("ruby"))
               .when(first_line.contains("bash") | first_line.contains("sh"), F.lit("shell")))
    content = (F.when(code.contains("def ") & code.contains("import "), F.lit("python"))
               .when(code.contains("function ")
                     & (code.contains("const ") | code.contains("let ") | code.contains("var ")),
                     F.lit("javascript")))
    has_code = code.isNotNull() & (F.length(code) > 0)
    return F.coalesce(by_ext,
                      F.when(has_code, F.coalesce(shebang, content)),
                      F.lit("unknown"))


def severity_rank(sev: Column) -> Column:
    """Critical 0 .. info 4, unknown 5."""
    return case_exact(sev, [(s, i) for i, s in enumerate(SEVERITIES)], 5).cast("int")


def severity_weight(sev: Column, weights, default) -> Column:
    return case_exact(sev, weights, default)


def complexity_weight(sev: Column) -> Column:
    return case_exact(sev, COMPLEXITY_WEIGHTS, 0)
