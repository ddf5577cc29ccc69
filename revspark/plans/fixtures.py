"""V1-V7: views that make the driver's tables stand in for review inputs.

Each view is a DataFrame built from the parquet tables (so its size grows with
the tables), plus the same derivation as SQL text (``SQL_V*``) for oracle
queries in another engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revspark.session import ship_package, table_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # timestamps in the tables are wall-clock UTC (TIMESTAMP_NTZ); casts and
    # windows over them are defined in UTC
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ship_package(spark)
    return spark.read.parquet(table_path(sf_dir, name))


def spread(df: DataFrame, rows: int, per_task: int = 10_000) -> DataFrame:
    """The ``rows`` rows of ``df`` over many tasks, for work that is heavy by row: a file of narrow rows has few splits."""
    most = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // (5 * per_task)))
    return df.repartition(max(1, min(most, -(-rows // per_task))))


def by_key(df: DataFrame, rows: int, key: str, per_task: int = 100_000) -> DataFrame:
    """``df`` by ``key`` in so many partitions that a task's sort does not grow with ``rows``; a few are left to Spark."""
    conf, n = df.sparkSession.conf, -(-rows // per_task)
    if n <= df.sparkSession.sparkContext.defaultParallelism:
        return df
    return df.repartition(max(n, int(conf.get("spark.sql.shuffle.partitions"))), key)


def _case(col, pairs, default=None):
    expr = None
    for k, v in pairs:
        expr = F.when(col == k, F.lit(v)) if expr is None else expr.when(col == k, F.lit(v))
    return expr.otherwise(F.lit(default)) if default is not None else expr


# ---------------------------------------------------------------------------
# V1 files: prose with a comment line, a blank line, CRLF and trailing spaces
# ---------------------------------------------------------------------------

def v1_files(spark, sf_dir) -> DataFrame:
    return v1_from_documents(table(spark, sf_dir, "documents"))


def v1_from_documents(d: DataFrame) -> DataFrame:
    """V1 from a documents DataFrame (batch or stream)."""
    ext = _case(F.col("doc_id") % 6, [(0, ".py"), (1, ".js"), (2, ".go"), (3, ".R"), (4, ".cc")], "")
    path = F.concat(F.lit("src/"), F.col("source"), F.lit("/"),
                    F.when(F.col("doc_id") % 4 == 0, F.lit("test_")).otherwise(F.lit("mod_")),
                    F.col("doc_id").cast("string"), ext)
    code = F.concat(F.lit("# "), F.col("lang"), F.lit("\n\n"), F.col("text"), F.lit("  \r\n"),
                    F.repeat(F.lit("\n"), (F.col("doc_id") % 3).cast("int")))
    return d.select(F.col("doc_id").alias("review_id"), path.alias("file_path"), code.alias("code"))


def v6_files(spark, sf_dir) -> DataFrame:
    """V6: the V1 files and the pages as files; some pages get a line that the import and the SQL rule hit."""
    p = F.col("page_id")
    code = F.concat(F.when(p % 5 == 0, F.lit("  import pickle\n")).otherwise(F.lit("")), F.col("html"),
                    F.when(p % 7 == 0, F.lit("\nSELECT a FROM b WHERE c")).otherwise(F.lit("")))
    pages = table(spark, sf_dir, "pages").select((-1 - p).alias("review_id"), F.concat(
        F.lit("pages/"), p.cast("string"), F.lit(".html")).alias("file_path"), code.alias("code"))
    return v1_files(spark, sf_dir).unionByName(pages)


SQL_V6_PAGES = """v6p as (select -1 - page_id as review_id, concat('pages/', cast(page_id as varchar), '.html') as file_path,
  string_split(concat(case when page_id % 5 = 0 then '  import pickle' || chr(10) else '' end, html,
    case when page_id % 7 = 0 then chr(10) || 'SELECT a FROM b WHERE c' else '' end), chr(10)) as ls from pages),
v6l as (select review_id, file_path, unnest(ls) as line, unnest(range(1, len(ls) + 1)) as line_number from v6p)"""

SQL_V1 = """v1 as (select doc_id as review_id,
  concat('src/', source, '/', case when doc_id % 4 = 0 then 'test_' else 'mod_' end, cast(doc_id as varchar),
         case doc_id % 6 when 0 then '.py' when 1 then '.js' when 2 then '.go' when 3 then '.R' when 4 then '.cc' else '' end) as file_path,
  concat('# ', lang, chr(10), chr(10), text, '  ', chr(13), chr(10), repeat(chr(10), cast(doc_id % 3 as int))) as code
from documents)"""


# ---------------------------------------------------------------------------
# V2 findings (60,000 rows at sf0.01 with real duplicates)
# ---------------------------------------------------------------------------

V2_ORDER = ["ord1", "ord2", "ord3", "ord4"]


def v2_findings(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("review_id"),
        F.concat(F.lit("src/mod_"), (F.col("l_partkey") % 7).cast("string"), F.lit(".py")).alias("file_path"),
        (1 + F.col("l_suppkey") % 3).cast("int").alias("line_number"),
        _case(F.col("l_partkey") % 5, [(0, "critical"), (1, "high"), (2, "medium"), (3, "low")], "info")
        .alias("severity"),
        _case(F.col("l_suppkey") % 4, [(0, "style"), (1, "sql_injection"), (2, "missing_test")], "complexity")
        .alias("category"),
        _case(F.col("l_suppkey") % 3, [(0, "QualityAgent"), (1, "SecurityAgent")], "TestingAgent")
        .alias("agent_name"),
        _case(F.col("l_linenumber") % 2, [(0, "issue A")], "issue B").alias("message"),
        ((F.lit(50) + F.lit(5) * (F.col("l_quantity").cast("int") % 11)).cast("decimal(5,2)") / 100)
        .cast("decimal(3,2)").alias("confidence"),
        F.col("l_linenumber").alias("ord1"), F.col("l_partkey").alias("ord2"),
        F.col("l_suppkey").alias("ord3"), F.col("l_quantity").alias("ord4"),
    ).withColumn("severity_rank", _sev_rank(F.col("severity")))


def _sev_rank(c):
    return _case(c, [("critical", 0), ("high", 1), ("medium", 2), ("low", 3), ("info", 4)], 5).cast("int")


def v2_total_lines(review_id):
    """Line count stand-in for V2 files (A5 size factor)."""
    return (F.lit(80) + review_id % 200).cast("int")


SQL_V2 = """v2 as (select l_orderkey as review_id, concat('src/mod_', cast(l_partkey % 7 as varchar), '.py') as file_path,
  cast(1 + l_suppkey % 3 as int) as line_number,
  case l_partkey % 5 when 0 then 'critical' when 1 then 'high' when 2 then 'medium' when 3 then 'low' else 'info' end as severity,
  case l_suppkey % 4 when 0 then 'style' when 1 then 'sql_injection' when 2 then 'missing_test' else 'complexity' end as category,
  case l_suppkey % 3 when 0 then 'QualityAgent' when 1 then 'SecurityAgent' else 'TestingAgent' end as agent_name,
  case l_linenumber % 2 when 0 then 'issue A' else 'issue B' end as message,
  cast(cast(50 + 5 * (cast(l_quantity as int) % 11) as decimal(5,2)) / 100 as decimal(3,2)) as confidence,
  l_linenumber as ord1, l_partkey as ord2, l_suppkey as ord3, l_quantity as ord4,
  case l_partkey % 5 when 0 then 0 when 1 then 1 when 2 then 2 when 3 then 3 else 4 end as severity_rank
from lineitem)"""

# Keep-best dedup of V2 (W1) as SQL.
SQL_V2_DEDUP = """k as (select * from (select *,
    row_number() over (partition by review_id, file_path, line_number, substring(message, 1, 100)
                       order by confidence desc, ord1, ord2, ord3, ord4) as rn_,
    count(*) over (partition by review_id, file_path, line_number, substring(message, 1, 100)) as n_duplicates,
    min(ord1) over (partition by review_id, file_path, line_number, substring(message, 1, 100)) as m1_
  from v2) t where rn_ = 1)"""


# ---------------------------------------------------------------------------
# V3 scanner rows (flat); JSON reports are built from them and parsed back
# ---------------------------------------------------------------------------

def v3_scanner_rows(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    s3 = F.col("l_suppkey") % 3
    tool = _case(s3, [(0, "ruff"), (1, "pylint")], "bandit")
    ruff = _case(F.col("l_partkey") % 8, [(0, "E501"), (1, "F401"), (2, "PLR0913"), (3, "PLR0914"),
                                          (4, "B006"), (5, "N802"), (6, "C901")], "UP001")
    pylint = _case(F.col("l_partkey") % 5, [(0, "C0301"), (1, "W0612"), (2, "E1101"), (3, "R0801")], "I0011")
    bandit = _case(F.col("l_partkey") % 6, [(0, "B608"), (1, "B105"), (2, "B311"), (3, "B404"),
                                            (4, "B104")], "B999")
    return li.select(
        F.col("l_orderkey").alias("review_id"),
        F.concat(F.lit("src/mod_"), (F.col("l_partkey") % 7).cast("string"), F.lit(".py")).alias("file_path"),
        tool.alias("tool"),
        F.when(s3 == 0, ruff).when(s3 == 1, pylint).otherwise(bandit).alias("rule_code"),
        _case(F.col("l_partkey") % 5, [(0, "convention"), (1, "warning"), (2, "error"), (3, "refactor")],
              "information").alias("pylint_type"),
        _case(F.col("l_linenumber") % 4, [(0, "HIGH"), (1, "MEDIUM"), (2, "LOW")], "UNDEFINED")
        .alias("tool_severity"),
        F.col("l_quantity").cast("int").alias("line_number"),
        "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").alias("l_quantity"),
    )


SQL_V3 = """v3 as (select l_orderkey as review_id, concat('src/mod_', cast(l_partkey % 7 as varchar), '.py') as file_path,
  case l_suppkey % 3 when 0 then 'ruff' when 1 then 'pylint' else 'bandit' end as tool,
  case l_suppkey % 3
    when 0 then case l_partkey % 8 when 0 then 'E501' when 1 then 'F401' when 2 then 'PLR0913' when 3 then 'PLR0914'
                                   when 4 then 'B006' when 5 then 'N802' when 6 then 'C901' else 'UP001' end
    when 1 then case l_partkey % 5 when 0 then 'C0301' when 1 then 'W0612' when 2 then 'E1101' when 3 then 'R0801' else 'I0011' end
    else case l_partkey % 6 when 0 then 'B608' when 1 then 'B105' when 2 then 'B311' when 3 then 'B404' when 4 then 'B104' else 'B999' end
  end as rule_code,
  case l_partkey % 5 when 0 then 'convention' when 1 then 'warning' when 2 then 'error' when 3 then 'refactor' else 'information' end as pylint_type,
  case l_linenumber % 4 when 0 then 'HIGH' when 1 then 'MEDIUM' when 2 then 'LOW' else 'UNDEFINED' end as tool_severity,
  cast(l_quantity as int) as line_number, l_linenumber, l_partkey, l_suppkey, l_quantity
from lineitem)"""


def v3_raw(spark, sf_dir) -> DataFrame:
    """V3 rows with per-(file, tool) item order and every tool field filled."""
    from pyspark.sql import Window
    v = v3_scanner_rows(spark, sf_dir)
    w = Window.partitionBy("review_id", "file_path", "tool").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return v.select(
        "review_id", "file_path", "tool", F.row_number().over(w).cast("long").alias("item_ord"),
        "rule_code", "pylint_type",
        F.concat(F.lit("msg "), F.col("rule_code"), F.lit(" at "), F.col("line_number").cast("string"))
        .alias("message"),
        "line_number", (F.col("l_linenumber") - 1).cast("int").alias("column"),
        (F.col("line_number") + 2 - F.col("l_linenumber")).cast("int").alias("end_line_number"),
        "tool_severity",
        _case(F.col("l_partkey") % 3, [(0, "HIGH"), (1, "LOW")], "MEDIUM").alias("tool_confidence"),
        F.when(F.col("l_partkey") % 4 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("Fix "), F.col("rule_code"))).alias("suggestion"),
        F.concat(F.lit("x = "), F.col("l_partkey").cast("string")).alias("code_snippet"),
        F.concat(F.lit("sym_"), (F.col("l_suppkey") % 10).cast("string")).alias("symbol"),
        F.concat(F.lit("test_"), F.col("rule_code")).alias("test_name"),
        F.array(F.col("line_number"), (F.col("line_number") + 1)).alias("line_range"),
        (F.col("l_partkey") % 100).cast("int").alias("cwe_id"),
    )


SQL_V3_RAW = SQL_V3 + """,
v3r as (select review_id, file_path, tool,
  cast(row_number() over (partition by review_id, file_path, tool order by l_linenumber, l_partkey, l_suppkey, l_quantity) as bigint) as item_ord,
  rule_code, pylint_type, concat('msg ', rule_code, ' at ', cast(line_number as varchar)) as message,
  line_number, cast(l_linenumber - 1 as int) as "column", cast(line_number + 2 - l_linenumber as int) as end_line_number,
  tool_severity,
  case l_partkey % 3 when 0 then 'HIGH' when 1 then 'LOW' else 'MEDIUM' end as tool_confidence,
  case when l_partkey % 4 = 0 then null else concat('Fix ', rule_code) end as suggestion,
  concat('x = ', cast(l_partkey as varchar)) as code_snippet,
  concat('sym_', cast(l_suppkey % 10 as varchar)) as symbol,
  concat('test_', rule_code) as test_name,
  cast(l_partkey % 100 as int) as cwe_id
from v3)"""


# ---------------------------------------------------------------------------
# V4 pull requests and their files
# ---------------------------------------------------------------------------

def v4_order():
    """The order of a PR's files."""
    from pyspark.sql import Window
    return Window.partitionBy("pr_key").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


def v4_pr_files(spark, sf_dir) -> DataFrame:
    # joined, numbered and grouped by one column of one name: the rows are shuffled once
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pr_key"), "o_orderpriority", "o_custkey")
    lines = table(spark, sf_dir, "lineitem")
    li = lines.select(F.col("l_orderkey").alias("pr_key"), "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                      "l_linestatus", "l_returnflag")
    j = o.join(by_key(li, lines.count(), "pr_key"), "pr_key")
    return j.select(
        "pr_key", (1 + F.col("pr_key")).cast("int").alias("pr_number"),
        F.col("o_orderpriority").alias("title"), "o_custkey",
        F.concat(F.lit("src/f_"), F.col("l_partkey").cast("string"),
                 F.when(F.col("l_linestatus") == "F", F.lit(".py")).otherwise(F.lit(".js"))).alias("filename"),
        _case(F.col("l_returnflag"), [("A", "added"), ("N", "modified")], "removed").alias("status"),
        F.col("l_quantity").cast("int").alias("additions"),
        "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        F.row_number().over(v4_order()).cast("long").alias("file_ord"))


def v4_lists(spark, sf_dir, item, part_size: int) -> DataFrame:
    """(pr_key, part, json): the JSON lists of ``item``, ``part_size`` files of a PR in each, in the files' order.  A list's
    first file takes the next ones from the window that numbered them: no second grouping, no sort within a list."""
    v = v4_pr_files(spark, sf_dir).withColumn("item", F.to_json(item))
    later = [F.lead("item", k).over(v4_order()).alias(f"item_{k}") for k in range(1, part_size)]
    first = v.select("pr_key", "file_ord", "item", *later).where((F.col("file_ord") - 1) % part_size == 0)
    items = F.concat_ws(",", "item", *[f"item_{k}" for k in range(1, part_size)])
    return first.select("pr_key", ((F.col("file_ord") - 1) / part_size).cast("long").alias("part"),
                        F.concat(F.lit("["), items, F.lit("]")).alias("json"))


SQL_V4 = """v4 as (select o_orderkey as pr_key, cast(1 + o_orderkey as int) as pr_number, o_orderpriority as title, o_custkey,
  concat('src/f_', cast(l_partkey as varchar), case l_linestatus when 'F' then '.py' else '.js' end) as filename,
  case l_returnflag when 'A' then 'added' when 'N' then 'modified' else 'removed' end as status,
  cast(l_quantity as int) as additions, l_linenumber, l_partkey, l_suppkey,
  cast(row_number() over (partition by o_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) as bigint) as file_ord
from orders join lineitem on l_orderkey = o_orderkey)"""


# ---------------------------------------------------------------------------
# V5 submissions / prompt requests (event stream)
# ---------------------------------------------------------------------------

def v5_events(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("submission_id"), F.col("ts").cast("timestamp").alias("ts"),
                    F.col("user_id").alias("client"),
                    F.concat(F.col("user_id").cast("string"), F.lit("/"), F.col("event_type")).alias("prompt_key"))


# ---------------------------------------------------------------------------
# V6 rule table (scan rules keyed to scanner ids)
# ---------------------------------------------------------------------------

# (rule_id, regex, category, severity, owasp, confidence) — regexes valid in
# both Java and RE2.
SCAN_RULES = [
    ("bandit:B105", 'token = "[0-9a-f]{40}"', "hardcoded_secret", "high",
     "A07:2021-Auth Failures", "0.75"),
    ("scan:XSS", "<script>", "xss", "high", "A03:2021-Injection", "0.70"),
    ("bandit:B608", "(?i)select .+ from .+ where", "sql_injection", "high", "A03:2021-Injection", "0.75"),
    ("bandit:B403", r"^\s*import pickle", "insecure_import", "medium",
     "A06:2021-Vulnerable Components", "0.75"),
]


# ---------------------------------------------------------------------------
# V7 generated Python source with closed-form answers
# ---------------------------------------------------------------------------

def v7_code_expr():
    pk, size = F.col("p_partkey"), F.col("p_size")
    args = F.substring(F.lit("a0, a1, a2, a3, a4, a5"), 1, (4 * (1 + pk % 6) - 2).cast("int"))
    body_if = F.repeat(F.lit("    if a0:\n        pass\n"), (size % 8).cast("int"))
    body_for = F.when(size % 3 == 0, F.lit("    for i in a0:\n        pass\n")).otherwise(F.lit(""))
    # extension: a try block with a boolean operator every 4th part, a class
    # with one sync and one async method every 5th part
    body_try = F.when(pk % 4 == 0, F.lit("    try:\n        x = a0 and a0 or a0\n"
                                          "    except ValueError:\n        pass\n")).otherwise(F.lit(""))
    cls = F.when(pk % 5 == 0, F.concat(F.lit("class C_"), pk.cast("string"),
                                       F.lit(":\n    def m(self, a, b, c, d):\n        return a\n"
                                             "    async def am(self):\n        while a0:\n            pass\n")))\
        .otherwise(F.lit(""))
    broken = F.when(pk % 50 == 0, F.lit("def broken(")).otherwise(F.lit(""))
    return F.concat(F.lit("def f_"), pk.cast("string"), F.lit("("), args, F.lit("):\n"),
                    body_if, body_for, body_try, F.lit("    return a0\n"), cls, broken)


def v7_files(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    pk, size = F.col("p_partkey"), F.col("p_size")
    return spread(p, p.count()).select(
        pk.alias("review_id"),
        F.concat(F.lit("src/part_"), pk.cast("string"), F.lit(".py")).alias("file_path"),
        v7_code_expr().alias("code"),
        (1 + pk % 6).cast("int").alias("n_args"),
        (1 + size % 8 + F.when(size % 3 == 0, 1).otherwise(0)
         + F.when(pk % 4 == 0, 3).otherwise(0)).cast("int").alias("complexity"))


SQL_V7 = """v7 as (select p_partkey as review_id, concat('src/part_', cast(p_partkey as varchar), '.py') as file_path,
  cast(1 + p_partkey % 6 as int) as n_args,
  cast(1 + p_size % 8 + case when p_size % 3 = 0 then 1 else 0 end + case when p_partkey % 4 = 0 then 3 else 0 end as int) as complexity,
  p_partkey % 50 = 0 as broken, p_partkey % 5 = 0 as has_class, p_size % 3 = 0 as has_for, p_partkey % 4 = 0 as has_try,
  p_size
from part)"""
