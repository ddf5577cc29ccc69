"""Text expressions used by the jobs (T1-T10), all native Columns.

No Python UDF: every function returns a Column that stays inside whole-stage
codegen.  Notes on semantics live next to each function.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from revspark.functions.lookups import case_exact

# Line breaks recognised by Python's str.splitlines (FIXED VALUES).
LINE_BREAK_REGEX = r"\r\n|[\n\r\u000B\f\u001c-\u001e\u0085\u2028\u2029]"
# The breaks other than "\n": text without any of them splits on a literal "\n".
RARE_BREAKS = "\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029"
# Characters Python's str.strip / str.rstrip remove: derived by rule from
# str.isspace (no whitespace code point lies above U+3000).
PY_WHITESPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
# Same set as a regex class (used where a regex is needed anyway).
_WS = "[\\s\\u001c-\\u001f\\u0085\\p{Z}]"

# Severity icons for finding reports and review comments (FIXED VALUES).
MARKDOWN_ICONS = [("critical", "\U0001F534"), ("high", "\U0001F7E0"), ("medium", "\U0001F7E1"),
                  ("low", "\U0001F535"), ("info", "⚪")]
MARKDOWN_ICON_DEFAULT = "⚪"
COMMENT_ICONS = [("critical", "\U0001F6A8"), ("high", "⚠️"), ("medium", "\U0001F4DD"),
                 ("low", "\U0001F4A1"), ("info", "ℹ️")]
COMMENT_ICON_DEFAULT = "\U0001F4DD"

# Output text formats (FIXED VALUES).  {name} marks a value; everything else is
# literal text.  Optional parts are added only when their value is non-empty.
MARKDOWN_HEAD = ("### {icon} {SEVERITY}: {category}\n\n**File:** `{file_path}` (line {line})\n\n"
                 "**Issue:** {message}\n\n")
MARKDOWN_SUGGESTION = "**Suggestion:** {suggestion}\n\n"
MARKDOWN_SNIPPET = "```python\n{code_snippet}\n```\n\n"
MARKDOWN_RULE = "_Rule: {rule_id}_\n"
MARKDOWN_OWASP = "_OWASP: {owasp}_\n"
COMMENT_HEAD = "{icon} **{SEVERITY}** - {category}\n\n{message}\n\n"
COMMENT_SUGGESTION = "**Suggestion:** {suggestion}\n"
COMMENT_RULE = "\n_Rule: {rule_id}_"
REVIEW_SUMMARY_NONE = "Code review completed for {file_path}. No issues found. Score: {score}/100"
REVIEW_SUMMARY = "Code review completed for {file_path}. Found {n} issues ({parts} severity). Score: {score}/100"
REVIEW_SUMMARY_AI = "{summary}\n\n{ai}"
PR_SUMMARY_NONE = "✅ Code review completed for PR #{number}: {title}\nNo issues found. Score: {score}/100"
PR_SUMMARY = ("Code review completed for PR #{number}: {title}\nFound {n} issues ({parts} severity).\n"
              "Score: {score}/100")
PR_NOT_FOUND = "Could not fetch PR #{number} from {repo}"
PR_ERROR = "Error reviewing PR: {error}"
AGENT_SUMMARY = "Found {parts} severity issues"
SEVERITY_PART = "{n} {severity}"
SEVERITY_PARTS_SEPARATOR = ", "


def fill(template: str, **values) -> Column:
    """A text template as one native ``concat``: literal pieces and the given
    Columns (or strings) in place of ``{name}``."""
    import re
    pieces = []
    for i, part in enumerate(re.split(r"\{(\w+)\}", template)):
        if i % 2 == 0:
            if part:
                pieces.append(F.lit(part))
        else:
            v = values[part]
            pieces.append(F.lit(v) if isinstance(v, str) else v.cast("string"))
    return F.concat(*pieces)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` (a Column -> Column
    function).  Higher-order expressions are not de-duplicated by the
    optimizer, so a value used several times is bound through a one-element
    ``transform`` instead of being recomputed."""
    return F.element_at(F.transform(F.array(value), body), 1)


def where_computed(df, cond: Column):
    """``df.filter(cond)`` for a condition on an already computed, expensive
    column (parsed JSON, decoded text).  A plain Filter is pushed below the
    projection that computes the column and the expression is then evaluated
    twice; a 0-or-1 row generator is not pushed, so the value is computed once.
    """
    return df.select("*", F.explode(F.when(cond, F.array(F.lit(True)))).alias("_keep")).drop("_keep")


def splitlines(text) -> Column:
    """Python ``str.splitlines()`` as an array<string>.

    Split on every recognised break, then drop the one empty element a final
    break leaves behind (``"a\\n"`` -> ``["a"]``, ``""`` -> ``[]``).  Text
    holding no break other than ``\\n`` takes the literal split (no regex).
    """
    def parts(t):
        plain = F.length(F.translate(t, RARE_BREAKS, "")) == F.length(t)
        return F.when(plain, F.split(t, "\n", -1)).otherwise(F.split(t, LINE_BREAK_REGEX, -1))

    def drop_last_empty(p):
        return F.when(F.element_at(p, -1) == F.lit(""), F.slice(p, 1, F.size(p) - 1)).otherwise(p)

    return F.when(_c(text).isNull(), F.lit(None)).otherwise(
        let(let(_c(text), parts), drop_last_empty))


def rstrip(text) -> Column:
    return F.rtrim(_c(text), F.lit(PY_WHITESPACE))


def strip(text) -> Column:
    return F.btrim(_c(text), F.lit(PY_WHITESPACE))


def sanitize(text) -> Column:
    """Drop NUL, CRLF/CR -> LF, rstrip each line, rejoin, end with one LF."""
    t = F.translate(F.replace(F.translate(_c(text), "\u0000", ""), F.lit("\r\n"), F.lit("\n")), "\r", "\n")
    joined = F.array_join(F.transform(splitlines(t), lambda x: rstrip(x)), "\n")

    def finish(j):
        return F.when((F.length(j) > 0) & ~j.endswith("\n"), F.concat(j, F.lit("\n"))).otherwise(j)

    return F.when(_c(text).isNull(), F.lit(None)).otherwise(let(joined, finish))


def truncate(text, max_length: int = 500, suffix: str = "...") -> Column:
    """Cut to ``max_length`` characters including the suffix."""
    if len(suffix) > max_length:
        raise ValueError("suffix longer than max_length")
    t = _c(text)
    keep = max_length - len(suffix)
    return F.when(F.length(t) <= max_length, t).otherwise(
        F.concat(F.substring(t, 1, keep), F.lit(suffix)))


def context_lines(lines: Column, line_number: Column, k: int, style: str = "bar") -> Column:
    """T4: the numbered block of +-k lines around ``line_number`` (1-based).

    ``style='bar'``: ``">>> "``/4 spaces + ``%4d | line``;
    ``style='colon'``: ``">>> "``/4 spaces + ``n: line``.  Clipped at file ends.
    ``lines`` is the T1 array of the file; only the slice is touched.
    """
    def block(ls):
        start0 = F.greatest(F.lit(0), line_number - F.lit(k + 1))        # 0-based
        end0 = F.least(F.size(ls), line_number + F.lit(k))                # exclusive
        n = F.greatest(end0 - start0, F.lit(0))
        window = F.slice(ls, start0 + 1, n)

        def fmt(x, i):
            num = start0 + i + 1
            marker = F.when(num == line_number, F.lit(">>> ")).otherwise(F.lit("    "))
            if style == "bar":
                body = F.format_string("%4d | %s", num, x)
            else:
                body = F.format_string("%d: %s", num, x)
            return F.concat(marker, body)

        return F.array_join(F.transform(window, fmt), "\n")

    return let(lines, block)


def finding_markdown(severity, category, file_path, line_number, message,
                     suggestion, code_snippet, rule_id, owasp) -> Column:
    """T5: one finding as a Markdown block."""
    icon = case_exact(_c(severity), MARKDOWN_ICONS, MARKDOWN_ICON_DEFAULT)
    return F.concat(
        fill(MARKDOWN_HEAD, icon=icon, SEVERITY=F.upper(_c(severity)), category=_c(category),
             file_path=_c(file_path), line=_c(line_number), message=_c(message)),
        _opt(suggestion, MARKDOWN_SUGGESTION, "suggestion"),
        _opt(code_snippet, MARKDOWN_SNIPPET, "code_snippet"),
        _opt(rule_id, MARKDOWN_RULE, "rule_id"),
        _opt(owasp, MARKDOWN_OWASP, "owasp"))


def finding_comment(severity, category, message, suggestion, rule_id) -> Column:
    """One finding as a pull-request comment body."""
    icon = case_exact(_c(severity), COMMENT_ICONS, COMMENT_ICON_DEFAULT)
    return F.concat(
        fill(COMMENT_HEAD, icon=icon, SEVERITY=F.upper(_c(severity)), category=_c(category), message=_c(message)),
        _opt(suggestion, COMMENT_SUGGESTION, "suggestion"),
        _opt(rule_id, COMMENT_RULE, "rule_id"))


def _opt(col, template: str, name: str) -> Column:
    c = _c(col)
    return F.when(c.isNotNull() & (F.length(c) > 0), fill(template, **{name: c})).otherwise(F.lit(""))


def format_score(score: Column) -> Column:
    """Python's ``str(float)`` for a score rounded to one decimal (0.0 .. 100.0)."""
    return F.format_string("%.1f", score)


def severity_list(n_critical, n_high, n_medium, n_low) -> Column:
    """``"1 critical, 2 high"``: non-zero counts only; info is never listed."""
    def part(n, word):
        return F.when(_c(n) > 0, fill(SEVERITY_PART, n=_c(n), severity=word))
    return F.concat_ws(SEVERITY_PARTS_SEPARATOR, part(n_critical, "critical"), part(n_high, "high"),
                       part(n_medium, "medium"), part(n_low, "low"))


def review_summary(file_path, n_findings, n_critical, n_high, n_medium, n_low,
                   score, ai_text=None) -> Column:
    """The review summary line; optional model text after a blank line."""
    base = F.when(
        _c(n_findings) == 0,
        fill(REVIEW_SUMMARY_NONE, file_path=_c(file_path), score=format_score(_c(score))),
    ).otherwise(
        fill(REVIEW_SUMMARY, file_path=_c(file_path), n=_c(n_findings),
             parts=severity_list(n_critical, n_high, n_medium, n_low), score=format_score(_c(score))))
    if ai_text is None:
        return base
    ai = _c(ai_text)
    return F.when((_c(n_findings) > 0) & ai.isNotNull() & (F.length(ai) > 0),
                  fill(REVIEW_SUMMARY_AI, summary=base, ai=ai)).otherwise(base)


def pr_summary(pr_number, title, n_findings, n_critical, n_high, n_medium, n_low, score) -> Column:
    """The pull-request summary text."""
    t = F.coalesce(_c(title), F.lit(""))
    return F.when(
        _c(n_findings) == 0,
        fill(PR_SUMMARY_NONE, number=_c(pr_number), title=t, score=format_score(_c(score))),
    ).otherwise(
        fill(PR_SUMMARY, number=_c(pr_number), title=t, n=_c(n_findings),
             parts=severity_list(n_critical, n_high, n_medium, n_low), score=format_score(_c(score))))


def parse_pr_ref(ref) -> Column:
    """``owner/repo#n`` or a GitHub pull-request URL -> struct(owner, repo, pr_number).

    The shorthand is tried first (on the stripped text); otherwise a scheme is
    added when missing, the host must contain "github" and the path must be
    ``/owner/repo/pull/<int>``.  Anything else -> NULL.
    """
    r = _c(ref)
    s = strip(r)
    short_re = r"^([^/]+)/([^#]+)#([0-9]+)$"
    is_short = s.rlike(short_re)
    url = F.when(r.startswith("http://") | r.startswith("https://"), r) \
        .otherwise(F.concat(F.lit("https://"), r))
    host = F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    parts = F.split(F.regexp_replace(path, "^/+|/+$", ""), "/", -1)
    num = F.try_element_at(parts, F.lit(4)).try_cast("int")
    url_ok = (host.contains("github") & (F.size(parts) >= 4)
              & (F.try_element_at(parts, F.lit(3)) == "pull") & num.isNotNull())
    short = F.struct(F.regexp_extract(s, short_re, 1).alias("owner"),
                     F.regexp_extract(s, short_re, 2).alias("repo"),
                     F.regexp_extract(s, short_re, 3).try_cast("int").alias("pr_number"))
    full = F.struct(F.try_element_at(parts, F.lit(1)).alias("owner"),
                    F.try_element_at(parts, F.lit(2)).alias("repo"),
                    num.alias("pr_number"))
    return F.when(r.isNull(), F.lit(None)).when(is_short, short).when(url_ok, full)


def prompt_key(system, user) -> Column:
    """A stable cache key for a (system, user) prompt pair."""
    return F.sha2(F.concat_ws("\u0000", _c(system), _c(user)), 256)
