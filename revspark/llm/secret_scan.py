r"""Secret scan with multipart credential linking, in DataFrame functions only.

Three strong kinds are always reported: assignments (`assign`), access keys (`access`) and long hex runs (`hex`). Three
weak kinds, login names (`login`), 40-character keys (`key`) and service addresses (`endpoint`), say little alone. They
are reported only where complementary parts meet: the scope of an identifier (an access key or a login name) reaches
`SCOPE` characters to both sides of its start and ends at an empty line; an identifier with a secret (an assignment, a
hex run or a key) that starts in its scope is linked to it, and an endpoint is linked where its identifier has a secret.
The link is an interval join: identifiers are dealt to the fixed-width cells that their scope meets, other parts to the
cell of their start, so a row meets only the few parts of one cell, however long its text or hot its source.

Spans are kind:start:end in code points, end exclusive.

Defined cases: a null or empty text has no spans; repeated rows and ids give a row each (equal rows share their links); a very
long text takes time linear in its length and parts, and only its spans are carried; spans of equal start stand in the
order of their kinds; an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revspark.llm.common import materialise

#: FIXED VALUES: patterns of the strong kinds, the group that must be long and its least length.
STRONG = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),  # runs are taken whole, so shorter ones can be left out at once
}
#: Patterns of the weak kinds.
WEAK = {
    "login": (r"""(?i:user(?:_?name)?|login|account_id|client_id|access_key_id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]+)""", 1, 3),
    "key": (r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/_-])", 0, 40),
    "endpoint": (r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?", 0, 10),
}
KINDS = [*STRONG, *WEAK]
SCOPE = 300
#: Items of an array that are put together at once.
STRETCH = 256
PLACEHOLDER = "[REDACTED]"

_SPAN = "struct<s:int,k:int,e:int>"
_NO_SPANS = f"cast(array() as array<{_SPAN}>)"


def spans_of(text: Column, kind: str) -> Column:
    """Array of (s, k, e): the matches of one kind, leftmost and without overlaps, those too short left out.

    The text is split at the matches; lengths of the pieces and matches before one add up to its start.
    """
    pattern, group, least = (STRONG | WEAK)[kind]
    k = KINDS.index(kind)
    pairs = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
                       F.regexp_extract_all(text, F.lit(pattern), F.lit(group)),
                       lambda m, g: F.struct(F.length(m).alias("m"), F.length(g).alias("g")))
    parts = F.zip_with(F.transform(F.split(text, pattern, -1), F.length), pairs,
                       lambda gap, p: F.struct(gap.alias("gap"), p.alias("p")))

    def step(at: Column, x: Column) -> tuple[Column, Column, Column]:
        s = at + x["gap"]
        e = s + F.coalesce(x["p"]["m"], F.lit(0))
        span = F.struct(s.cast("int").alias("s"), F.lit(k).alias("k"), e.cast("int").alias("e"))
        return e, x["p"]["g"] >= least, span

    return F.when(text.rlike(pattern), running(parts, F.expr(_NO_SPANS), step)).otherwise(F.expr(_NO_SPANS))


def bound(value: Column, use) -> Column:
    """use(value) with `value` evaluated once."""
    return F.transform(F.array(value), use)[0]


def running(parts: Column, none: Column, step) -> Column:
    """Array of the items that a pass over `parts` (at least one) yields. none: the empty array of items.

    step(at, part) gives the next place, whether there is an item, and the item; the place starts at 0. Items are
    appended in stretches, as an append copies what is there: a text of many parts takes time linear in them.
    """

    def inner(acc: Column, x: Column) -> Column:
        at, has, item = step(acc["at"], x)
        return F.struct(at.cast("int").alias("at"), F.when(has, F.array_append(acc["found"], item)).otherwise(acc["found"]).alias("found"))

    def whole(held: Column) -> Column:
        def outer(acc: Column, k: Column) -> Column:
            one = F.aggregate(F.slice(held, k * STRETCH + 1, F.lit(STRETCH)), F.struct(acc["at"].alias("at"), none.alias("found")), inner)
            return bound(one, lambda g: F.struct(g["at"].alias("at"), F.array_append(acc["found"], g["found"]).alias("found")))

        last = F.floor((F.size(held) - 1) / STRETCH).cast("int")
        start = F.struct(F.lit(0).alias("at"), F.slice(F.array(none), 1, 0).alias("found"))
        return F.aggregate(F.sequence(F.lit(0), last), start, outer, lambda acc: F.flatten(acc["found"]))

    return bound(parts, whole)


def joined(spans: Column) -> Column:
    """kind:start:end of spans in their order, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1),
                                                                  x["s"].cast("string"), x["e"].cast("string"))), ",")


def located(docs: DataFrame) -> DataFrame:
    """(doc_id, key, strong, weak, breaks) of every row: sorted spans, and where empty lines start if there are weak
    parts. `key` is the text's SHA-256."""
    text = F.coalesce("text", F.lit(""))
    strong = F.array_sort(F.concat(*(spans_of(text, k) for k in STRONG)))
    weak = F.concat(*(spans_of(text, k) for k in WEAK))
    found = docs.select("doc_id", F.sha2(text, 256).alias("key"), strong.alias("strong"), weak.alias("weak"), text.alias("t"))
    pieces = F.transform(F.split("t", "\n\n", -1), lambda p: F.length(p) + 2)
    none = F.expr("cast(array() as array<int>)")
    ends = running(pieces, none, lambda at, n: (at + n, F.lit(True), at + n))
    return found.select("doc_id", "key", "strong", "weak", F.when(F.size("weak") > 0, ends).otherwise(none).alias("breaks"))


def linked(rows: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc_id, key, linked): the weak spans of each (doc_id, key) that have their complements in scope."""
    some = rows.where(F.size("weak") > 0).dropDuplicates(["doc_id", "key"])
    parts = some.select("doc_id", "key", F.explode(F.concat("strong", "weak")).alias("x"))
    ends = some.select("doc_id", "key", F.explode("breaks").alias("s"))
    # a part's block is the number of empty lines that end at or before its start, counted over its text's sorted parts
    both = parts.select("doc_id", "key", F.col("x.s").alias("s"), "x").union(
        ends.select("doc_id", "key", "s", F.lit(None).cast("struct<s:int,k:int,e:int>").alias("x")))
    so_far = Window.partitionBy("doc_id", "key").orderBy("s").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    block = F.sum(F.when(F.col("x").isNull(), 1).otherwise(0)).over(so_far)
    parts = both.withColumn("block", block).where(F.col("x").isNotNull()).drop("s")
    n = {k: F.lit(KINDS.index(k)) for k in KINDS}
    is_id = F.col("x.k").isin(KINDS.index("access"), KINDS.index("login"))
    ids = parts.where(is_id).select(
        F.col("doc_id").alias("d"), F.col("key").alias("h"), F.col("block").alias("b"), F.col("x").alias("id"),
        F.explode(F.sequence(F.floor((F.col("x.s") - scope) / scope), F.floor((F.col("x.s") + scope) / scope))).alias("c"))
    other = parts.where(~is_id).withColumn("cell", F.floor(F.col("x.s") / scope))
    near = ids.join(other, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("key")) & (F.col("b") == F.col("block"))
                    & (F.col("c") == F.col("cell")) & (F.abs(F.col("x.s") - F.col("id.s")) <= scope))
    # of one identifier at most 2 * scope parts start in its scope
    whole = (near.groupBy("d", "h", "id").agg(F.collect_set("x").alias("xs"))
             .where(F.exists("xs", lambda x: x["k"] != n["endpoint"])))
    weak = F.filter(F.array_append("xs", F.col("id")), lambda x: x["k"] >= len(STRONG))
    return (whole.select("d", "h", F.explode(weak).alias("x")).groupBy("d", "h")
            .agg(F.collect_set("x").alias("linked")).select(F.col("d").alias("doc_id"), F.col("h").alias("key"), "linked"))


def with_links(rows: DataFrame, links: DataFrame) -> DataFrame:
    l = links.select(F.col("doc_id").alias("d"), F.col("key").alias("h"), "linked")
    out = rows.join(l, rows.doc_id.eqNullSafe(l.d) & (rows.key == l.h), "left")
    return out.select(rows["*"], F.array_sort(F.concat("strong", F.coalesce("linked", F.expr(_NO_SPANS)))).alias("all"))


def secret_scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Per row of `docs`: the contract's columns and n_linked, the number of weak spans reported."""
    rows = materialise(located(docs), "secrets")
    out = with_links(rows, linked(rows, scope))
    count = lambda k: F.size(F.filter("strong", lambda x: x["k"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return out.select("doc_id", *(count(k) for k in STRONG), F.sha2(joined(F.col("strong")), 256).alias("base_sha256"),
                      joined(F.col("all")).alias("spans"), (F.size("all") - F.size("strong")).cast("long").alias("n_linked"))


def redacted(text: Column, spans: Column) -> Column:
    """`text` with every maximal run of overlapping spans (sorted by start) replaced by the placeholder."""
    end = F.length(text)
    last = F.array(F.struct(end.alias("s"), F.lit(0).alias("k"), end.alias("e")))

    def step(at: Column, x: Column) -> tuple[Column, Column, Column]:
        return F.greatest(at, x["e"]), x["s"] >= at, F.struct(at.alias("a"), x["s"].alias("b"))

    def pieces(some: Column) -> Column:
        # places are counted from the start of the stretch, as finding one takes time linear in it
        first = some[0]["a"]
        part = F.substring(text, first + 1, F.element_at(some, -1)["b"] - first)
        return bound(part, lambda t: F.array_join(F.transform(some, lambda g: F.substring(t, g["a"] - first + 1, g["b"] - g["a"])), PLACEHOLDER))

    def whole(held: Column) -> Column:
        ks = F.sequence(F.lit(0), F.floor((F.size(held) - 1) / STRETCH).cast("int"))
        return F.array_join(F.transform(ks, lambda k: bound(F.slice(held, k * STRETCH + 1, F.lit(STRETCH)), pieces)), PLACEHOLDER)

    kept = running(F.concat(spans, last), F.expr("cast(array() as array<struct<a:int,b:int>>)"), step)
    return F.when(F.size(spans) > 0, bound(kept, whole)).otherwise(text)


def redact(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """`docs` with every reported span replaced by a placeholder and n_chars brought up to date; same rows and columns."""
    rows = located(docs)
    links = linked(materialise(rows.where(F.size("weak") > 0), "secrets"), scope)
    text = F.coalesce("text", F.lit(""))
    l = links.select(F.col("doc_id").alias("__d"), F.col("key").alias("__h"), F.col("linked").alias("__l"))
    strong = F.array_sort(F.concat(*(spans_of(text, k) for k in STRONG)))
    full = docs.withColumns({"__key": F.sha2(text, 256), "__s": strong})
    full = full.join(l, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__key") == F.col("__h")), "left")
    spans = F.array_sort(F.concat("__s", F.coalesce("__l", F.expr(_NO_SPANS))))
    full = full.withColumn("__all", spans).withColumn("__new", F.when(F.col("text").isNotNull(), redacted(F.col("text"), F.col("__all"))))
    out = {"text": F.col("__new"), "n_chars": F.when(F.size("__all") > 0, F.length("__new").cast("long")).otherwise(F.col("n_chars"))}
    return full.select(*(out[c].alias(c) if c in out else F.col(c) for c in docs.columns))
