"""Turning tool rows and model items into canonical findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revspark.functions import lookups as L
from revspark.schemas import AI_DEFAULTS, CATEGORIES, FINDING_COLUMNS, SEVERITIES


def _col_or(df: DataFrame, name: str, default) -> Column:
    if name in df.columns:
        return F.col(name)
    return default if isinstance(default, Column) else F.lit(default)


def coerce_severity(c: Column) -> Column:
    """Lower-cased severity if it is in the vocabulary, else medium (input read once)."""
    return L.map_lookup(F.lower(c), [(v, v) for v in SEVERITIES], "medium")


def coerce_category(c: Column) -> Column:
    """Lower-cased category if it is in the vocabulary, else other (input read once)."""
    return L.map_lookup(F.lower(c), [(v, v) for v in CATEGORIES], "other")


def to_findings(df: DataFrame, agent_name: str | None = None, agent_ord: int | None = None,
                source_ord: int | None = None) -> DataFrame:
    """F4 + F6: canonical finding rows.

    Severity and category are matched lower-cased against the vocabularies
    (unknown -> ``medium`` / ``other``); ``end_line_number`` below the start
    line is raised to it; ``severity_rank`` is derived; the result has exactly
    the canonical column order.  ``review_id`` is a long, or stays a string.
    """
    line = F.col("line_number").cast("int")
    end = _col_or(df, "end_line_number", F.lit(None).cast("int")).cast("int")
    sev = coerce_severity(F.col("severity"))
    out = df.select(
        (F.col("review_id") if isinstance(df.schema["review_id"].dataType, T.StringType)
         else F.col("review_id").cast("long")).alias("review_id"),
        F.col("file_path"),
        (F.lit(agent_ord) if agent_ord is not None else F.col("agent_ord")).cast("int").alias("agent_ord"),
        (F.lit(source_ord) if source_ord is not None else _col_or(df, "source_ord", 0)).cast("int")
        .alias("source_ord"),
        F.col("item_ord").cast("long").alias("item_ord"),
        line.alias("line_number"),
        F.when(end.isNotNull() & line.isNotNull() & (end < line), line).otherwise(end)
        .alias("end_line_number"),
        _col_or(df, "column", F.lit(None).cast("int")).cast("int").alias("column"),
        sev.alias("severity"),
        L.severity_rank(sev).alias("severity_rank"),
        coerce_category(F.col("category")).alias("category"),
        F.col("message"),
        F.coalesce(_col_or(df, "suggestion", ""), F.lit("")).alias("suggestion"),
        (F.lit(agent_name) if agent_name is not None else F.col("agent_name")).alias("agent_name"),
        _col_or(df, "rule_id", F.lit(None).cast("string")).cast("string").alias("rule_id"),
        _col_or(df, "code_snippet", F.lit(None).cast("string")).cast("string").alias("code_snippet"),
        _col_or(df, "owasp_category", F.lit(None).cast("string")).cast("string").alias("owasp_category"),
        # as given: validation sees every digit; what is no number is NULL, which validation rejects
        F.col("confidence").try_cast("double").alias("confidence"),
    )
    return out.select(*FINDING_COLUMNS)


def finding_reject_reason(df: DataFrame) -> Column:
    """the first broken rule of a finding row, NULL when valid."""
    conf = F.col("confidence").cast("double")  # NaN is greater than any number
    return (F.when(F.col("file_path").isNull() | (F.length("file_path") < 1), F.lit("file_path empty"))
            .when(F.col("line_number").isNull() | (F.col("line_number") < 1), F.lit("line_number < 1"))
            .when(F.col("end_line_number").isNotNull() & (F.col("end_line_number") < 1),
                  F.lit("end_line_number < 1"))
            .when(F.col("column").isNotNull() & (F.col("column") < 0), F.lit("column < 0"))
            .when(F.col("message").isNull() | (F.length("message") < 1), F.lit("message empty"))
            .when(F.col("agent_name").isNull() | (F.length("agent_name") < 1), F.lit("agent_name empty"))
            .when(conf.isNull() | (conf < 0) | (conf > 1), F.lit("confidence outside 0..1")))


def validate_findings(df: DataFrame):
    """split into (valid findings, rejects with ``reason``)."""
    x = df.withColumn("reason", finding_reject_reason(df))
    return x.filter(F.col("reason").isNull()).drop("reason"), x.filter(F.col("reason").isNotNull())


# ---------------------------------------------------------------------------
# Static tool rows -> findings
# ---------------------------------------------------------------------------

def quality_findings(raw: DataFrame, agent_ord: int = 0) -> DataFrame:
    """M3-M5: ruff/pylint rows -> QualityAgent findings (ruff before pylint).

    rule_id ``tool:code``; severity and category from the reviewer's own code
    tables (the tool severity is not used); confidence 0.90; the fix message is
    the suggestion; column and end line are not carried over.
    """
    q = raw.filter(F.col("tool").isin("ruff", "pylint"))
    code = F.coalesce(F.col("rule_code"), F.lit(""))
    return to_findings(q.select(
        "review_id", "file_path",
        F.when(F.col("tool") == "ruff", 0).otherwise(1).alias("source_ord"),
        "item_ord", "line_number",
        L.quality_severity(code).alias("severity"),
        L.quality_category(code).alias("category"),
        "message",
        F.coalesce(F.col("suggestion"), F.lit("")).alias("suggestion"),
        F.concat(F.col("tool"), F.lit(":"), code).alias("rule_id"),
        F.lit(None).cast("string").alias("code_snippet"),
        F.lit("0.90").alias("confidence"),
    ), "QualityAgent", agent_ord)


def security_findings(raw: DataFrame, agent_ord: int = 1) -> DataFrame:
    """M6-M9: bandit rows -> SecurityAgent findings with OWASP class."""
    b = raw.filter(F.col("tool") == "bandit")
    tid = F.coalesce(F.col("rule_code"), F.lit(""))
    return to_findings(b.select(
        "review_id", "file_path", F.lit(0).alias("source_ord"), "item_ord", "line_number",
        L.bandit_severity(F.col("tool_severity")).alias("severity"),
        L.bandit_category(tid).alias("category"),
        "message",
        F.lit("").alias("suggestion"),
        F.concat(F.lit("bandit:"), tid).alias("rule_id"),
        F.col("code_snippet"),
        L.bandit_owasp(tid).alias("owasp_category"),
        L.bandit_confidence(F.col("tool_confidence")).alias("confidence"),
    ), "SecurityAgent", agent_ord)


# ---------------------------------------------------------------------------
# Model items -> findings, all-or-nothing per call
# ---------------------------------------------------------------------------

def _field(item: Column, key: str) -> Column:
    """The item's value for ``key`` as VARIANT: SQL NULL when absent,
    a variant null when the JSON holds an explicit null."""
    return F.try_variant_get(item, f"$.{key}", "variant")


def _is_string(v: Column) -> Column:
    return F.schema_of_variant(v) == F.lit("STRING")


def _agent_defaults(agent):
    """(severity, category, confidence, is_security) for a reviewer given by
    name (literal) or by a column holding the name (per row)."""
    if isinstance(agent, str):
        sev, cat, conf = AI_DEFAULTS[agent]
        return F.lit(sev), F.lit(cat), F.lit(conf), F.lit(agent == "SecurityAgent")
    pairs = list(AI_DEFAULTS.items())
    return (L.case_exact(agent, [(a, d[0]) for a, d in pairs], "medium"),
            L.case_exact(agent, [(a, d[1]) for a, d in pairs], "code_smell"),
            L.case_exact(agent, [(a, d[2]) for a, d in pairs], "0.70"),
            agent == F.lit("SecurityAgent"))


def item_checks(item: Column, agent) -> tuple[dict, Column]:
    """Field values (with the reviewer's defaults) and the validity of one item.

    ``agent`` is a reviewer name, or a Column with the name per row (one pass
    over the responses of every reviewer)."""
    sev_d, cat_d, conf, is_sec = _agent_defaults(agent)
    is_obj = F.schema_of_variant(item).startswith("OBJECT")
    sev_v, cat_v = _field(item, "severity"), _field(item, "category")
    msg_v, sug_v, line_v = _field(item, "message"), _field(item, "suggestion"), _field(item, "line_number")
    own_v = _field(item, "owasp_category")

    def str_or_default(v, d):
        return F.when(v.isNull(), d).otherwise(F.try_variant_get(v, "$", "string"))

    sev = str_or_default(sev_v, sev_d)
    cat = str_or_default(cat_v, cat_d)
    msg = str_or_default(msg_v, F.lit(""))
    sug = str_or_default(sug_v, F.lit(""))
    line_dec = F.try_variant_get(line_v, "$", "decimal(38,6)")
    line = F.when(line_v.isNull(), F.lit(1)).otherwise(line_dec.try_cast("int"))
    line_ok = line_v.isNull() | (line_dec.isNotNull() & (line_dec == F.floor(line_dec))
                                 & (line_dec >= 1) & (line_dec <= 2147483647))
    ok = (is_obj
          & (sev_v.isNull() | _is_string(sev_v))
          & (cat_v.isNull() | _is_string(cat_v))
          & (sug_v.isNull() | _is_string(sug_v))
          & msg_v.isNotNull() & _is_string(msg_v) & (F.length(msg) > 0)
          & line_ok)
    own_s = F.try_variant_get(own_v, "$", "string")
    own_truthy = own_v.isNotNull() & ~F.is_variant_null(own_v) & ~(_is_string(own_v) & (F.length(own_s) == 0))
    # only the security reviewer reads (and validates) an OWASP class
    ok = ok & (~is_sec | ~own_truthy | _is_string(own_v))
    fields = {"severity": sev, "category": cat, "message": msg, "suggestion": sug,
              "line_number": line, "confidence": conf,
              "owasp_category": F.when(is_sec, F.when(own_truthy, own_s).otherwise(L.infer_owasp(cat)))}
    return fields, F.coalesce(ok, F.lit(False))


def ai_findings(responses: DataFrame, agent: str | None, agent_ord: int | None, source_ord: int,
                text_col: str = "response", keep_bad: bool = False, agent_ords: dict | None = None) -> DataFrame:
    """F7 + F8 + S11: responses(review_id, file_path[, agent_name], response) -> findings.

    One response row is one model call.  Its items are checked *before* they
    are exploded (``forall`` over the array), so the all-or-nothing rule needs
    no shuffle: one bad item drops every item of that call.  With ``agent=None``
    the reviewer comes from each row's ``agent_name`` (defaults per row,
    ``agent_ords`` maps names to reviewer order) — one pass for all reviewers.

    A call's answer may come in several rows with a ``part`` number: ordinals
    then run on through the parts and one bad item drops the items of all of
    them (one window over the call's parts; without ``part`` there is no shuffle).
    """
    from revspark.functions.text import let
    from revspark.schemas import DEFAULT_AGENTS
    from revspark.sources.responses import response_items

    who = agent if agent is not None else F.col("agent_name")
    keys = ["review_id", "file_path"] + (["agent_name"] if agent is None else [])
    items = response_items(F.col(text_col))

    def pack(its):
        ok = F.coalesce(F.forall(its, lambda it: item_checks(it, who)[1]), F.lit(False))
        return F.struct(F.when(ok | F.lit(keep_bad), its).alias("items"), ok.alias("ok"))

    def row(it, i):
        fields, ok = item_checks(it, who)
        return F.struct((i + 1).cast("long").alias("item_ord"), *[v.alias(k) for k, v in fields.items()],
                        ok.alias("item_ok"))

    # The items are parsed once; a rejected batch carries no array, so the
    # generator emits nothing for it (no Filter to push below the parse).  The
    # item fields are extracted inside the generator, so later projections
    # read plain columns instead of re-extracting them from the VARIANT.
    parted = "part" in responses.columns
    y = responses.select(*keys, *(["part"] if parted else []), let(items, pack).alias("_p"))
    ok, before = F.col("_p.ok"), F.lit(0).cast("long")
    if parted:
        call = Window.partitionBy(*keys)
        ok = F.bool_and("_p.ok").over(call)
        before = F.coalesce(F.sum(F.greatest(F.size("_p.items"), F.lit(0))).over(
            call.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    y = (y.select(*keys, "_p", ok.alias("batch_ok"), before.alias("_before"))
         .select(*keys, "batch_ok", "_before", F.inline(F.transform(
             F.when(F.col("batch_ok") | F.lit(keep_bad), F.col("_p.items")), row)))
         .withColumn("item_ord", F.col("item_ord") + F.col("_before")).drop("_before"))
    if keep_bad:
        return y
    y = y.drop("batch_ok", "item_ok")
    if agent is not None:
        return to_findings(y, agent, agent_ord, source_ord)
    ords = agent_ords or {n: i for i, (n, _) in enumerate(DEFAULT_AGENTS)}
    y = y.withColumn("agent_ord", L.case_exact(F.col("agent_name"), list(ords.items()), None).cast("int"))
    return to_findings(y, None, None, source_ord)
