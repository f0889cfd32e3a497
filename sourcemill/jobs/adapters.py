"""The driver's tables seen as the tables of this library, each with the same view in SQL.

Every function takes (spark, sf_dir) and reads whole tables; SQL holds the common table
expressions of the same names for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EXTENSIONS = ("css", "go", "js", "odin", "py", "rs", "ts", "zig", "tsx")
BRACKETS = {"click": "(", "view": ")", "purchase": "[", "error": "]", "signup": "{"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: file_id, path, source."""
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % 9 + 1).cast("int"))
    path = F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit("."), ext)
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), path.alias("path"), F.col("text").alias("source"))


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a sequence in each user's file: file_id, idx (by time), kind, k (from props), value."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("file_id"), F.row_number().over(order).cast("long").alias("idx"), F.col("event_type").alias("kind"), k.alias("k"))


def brackets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """steps as brackets: file_id, idx, text."""
    text = F.create_map(*[F.lit(x) for kv in BRACKETS.items() for x in kv])[F.col("kind")]
    return steps(spark, sf_dir).select("file_id", "idx", text.alias("text"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ASCII words of documents as tokens."""
    return words_of(files(spark, sf_dir))


def words_of(files: DataFrame) -> DataFrame:
    """The ASCII words of files as tokens: file_id, idx, offset and length in bytes, kind by its first letter.

    Words and the stretches between them alternate; idx counts both.
    """
    from ..operators.batches import letter_runs

    return letter_runs(files).select("file_id", "idx", "offset", "length", F.when(F.col("upper"), "name").otherwise("word").alias("kind"))


def bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """signup steps as bindings of a file's top scope: file_id, binding, scope, name, offset, dead_zone_end, class."""
    s = steps(spark, sf_dir).where("kind = 'signup'")
    return s.select("file_id", F.col("idx").alias("binding"), F.lit(0).alias("scope"), F.concat(F.lit("n"), F.col("k") % 10).alias("name"), F.col("idx").alias("offset"),
                    (F.col("idx") + F.col("k") % 7).alias("dead_zone_end"), F.when(F.col("k") % 2 == 0, "import").otherwise("variable").alias("class"))


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """click steps as references: file_id, ref, scope, name, offset, context."""
    s = steps(spark, sf_dir).where("kind = 'click'")
    return s.select("file_id", F.col("idx").alias("ref"), F.lit(0).alias("scope"), F.concat(F.lit("n"), F.col("k") % 10).alias("name"), F.col("idx").alias("offset"), F.when(F.col("k") % 3 == 0, "store").otherwise("load").alias("context"))


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """l_orderkey, l_linenumber and l_partkey of lineitem, each once, dealt by order to tasks whose number grows with the table."""
    from ..operators.session import tasks_for

    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return li.repartition(tasks_for(li), "l_orderkey").distinct()


def next_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst: each part and the part of the line after its first line, in order of order and line; null at the end of an order."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    li = order_lines(spark, sf_dir).withColumn("dst", F.lead("l_partkey").over(order))
    first = li.groupBy(F.col("l_partkey").alias("src")).agg(F.min_by("dst", F.struct("l_orderkey", "l_linenumber")).alias("dst"))
    return first


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return next_part(spark, sf_dir).select("src", F.lit(0).alias("fact"), "dst")


def part_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"))


def scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations and customers as nested scopes of a region's file: file_id, scope, parent, dynamic."""
    n = table(spark, sf_dir, "nation")
    c = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    top = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("file_id"), F.lit(0).cast("long").alias("scope"), F.lit(None).cast("long").alias("parent"), F.lit(False).alias("dynamic"))
    mid = n.select(F.col("n_regionkey").cast("long"), (F.col("n_nationkey") + 1).cast("long"), F.lit(0).cast("long"), F.col("n_nationkey") % 7 == 0)
    low = c.select(F.col("n_regionkey").cast("long"), (F.col("c_custkey") + 1000).cast("long"), (F.col("n_nationkey") + 1).cast("long"), F.lit(False))
    return top.union(mid).union(low)


def line_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import lint

    return lint.line_findings(files(spark, sf_dir), width=100, banned=("idiot",))


def placed_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sentence of documents that begins a line as a finding with offset, length, rule, severity and applicability."""
    from ..operators.lines import explode_lines

    lines = explode_lines(files(spark, sf_dir))
    n = F.octet_length(F.regexp_extract("text", r"^([^ ]*)", 1)).cast("long")
    code = F.when(F.col("text").rlike(r"^[A-Z][a-z]?[ .]"), "S001").when(F.char_length("text") > 100, "S002").otherwise("S003")
    f = lines.where("text <> ''").select("file_id", (F.col("file_id") * 1000000 + F.col("line")).alias("finding_id"), F.col("start").alias("offset"), n.alias("length"), code.alias("code"), F.col("line").cast("long").alias("arrival"))
    f = f.withColumns({
        "rule": F.concat(F.lit("rule-"), F.lower("code")), "severity": F.when(F.col("code") == "S002", "error").otherwise("warning"),
        "message": F.concat(F.lit("sentence of kind "), "code"), "applicability": F.when(F.col("code") == "S001", "safe").when(F.col("code") == "S002", "unsafe"),
    })
    return f.join(files(spark, sf_dir).select("file_id", "path"), "file_id")


def marks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """steps as (findings, directives): view is a finding, error a disable, signup an enable, purchase a line directive, all at their idx."""
    s = steps(spark, sf_dir).withColumn("code", F.concat(F.lit("K"), F.col("k") % 5))
    findings = s.where("kind = 'view'").select("file_id", (F.col("file_id") * 1000000 + F.col("idx")).alias("finding_id"), F.col("idx").alias("line"), "code")
    kind = F.when(F.col("kind") == "error", "disable").when(F.col("kind") == "signup", "enable").otherwise("line")
    d = s.where("kind in ('error', 'signup', 'purchase')")
    d = d.select("file_id", F.col("idx").alias("directive"), kind.alias("kind"), F.when(F.col("kind") == "purchase", F.col("idx") + 2).otherwise(F.col("idx")).alias("line"), F.col("idx").alias("first"), F.array("code").alias("codes"), (F.col("k") % 50 == 0).alias("wildcard"))
    return findings, d


SQL = {
    "files": "files AS (SELECT doc_id AS file_id, source || '/' || lang || '/doc_' || doc_id || '.' || ['css','go','js','odin','py','rs','ts','zig','tsx'][doc_id % 9 + 1] AS path, text AS source FROM documents)",
    "raw": "raw AS (SELECT file_id, path, source, unnest(string_split(source, chr(10))) AS raw, generate_subscripts(string_split(source, chr(10)), 1) - 1 AS line, len(string_split(source, chr(10))) AS n FROM files)",
    "lines": "lines AS (SELECT file_id, line, start, start + octet_length(encode(raw)) AS \"end\", raw AS text FROM (SELECT *, CAST(coalesce(sum(octet_length(encode(raw)) + 1) OVER (PARTITION BY file_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM raw))",
    "steps": "steps AS (SELECT user_id AS file_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS idx, event_type AS kind, CAST(regexp_extract(props, '(\\d+)', 1) AS INT) AS k FROM events)",
    "brackets": "brackets AS (SELECT file_id, idx, CASE kind WHEN 'click' THEN '(' WHEN 'view' THEN ')' WHEN 'purchase' THEN '[' WHEN 'error' THEN ']' ELSE '{' END AS text FROM steps)",
    "words": "words AS (SELECT file_id, i AS idx, \"offset\", octet_length(encode(w)) AS length, CASE WHEN regexp_matches(w, '^[A-Z]') THEN 'name' ELSE 'word' END AS kind FROM (SELECT *, CAST(coalesce(sum(octet_length(encode(w))) OVER (PARTITION BY file_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM (SELECT file_id, unnest(p) AS w, generate_subscripts(p, 1) - 1 AS i FROM (SELECT file_id, regexp_extract_all(source, '([A-Za-z]+|[^A-Za-z]+)', 1) AS p FROM files))) WHERE regexp_matches(w, '^[A-Za-z]'))",
    "bindings": "bindings AS (SELECT file_id, idx AS binding, 0 AS scope, 'n' || (k % 10) AS name, idx AS \"offset\", idx + k % 7 AS dead_zone_end, CASE WHEN k % 2 = 0 THEN 'import' ELSE 'variable' END AS class FROM steps WHERE kind = 'signup')",
    "refs": "refs AS (SELECT file_id, idx AS ref, 0 AS scope, 'n' || (k % 10) AS name, idx AS \"offset\", CASE WHEN k % 3 = 0 THEN 'store' ELSE 'load' END AS context FROM steps WHERE kind = 'click')",
    "bound": "bound AS (SELECT r.*, (SELECT max(b.binding) FROM bindings b WHERE b.file_id = r.file_id AND b.name = r.name AND b.\"offset\" <= r.\"offset\") AS binding FROM refs r)",
    "next_part": "next_part AS (SELECT l_partkey AS src, arg_min(struct_pack(d := dst), l_orderkey * 100 + l_linenumber).d AS dst FROM (SELECT *, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem)) GROUP BY l_partkey)",
    "scopes": "scopes AS (SELECT r_regionkey AS file_id, 0 AS scope, NULL AS parent, false AS dynamic FROM region UNION ALL SELECT n_regionkey, n_nationkey + 1, 0, n_nationkey % 7 = 0 FROM nation UNION ALL SELECT n_regionkey, c_custkey + 1000, n_nationkey + 1, false FROM customer JOIN nation ON c_nationkey = n_nationkey)",
    "placed": "placed AS (SELECT f.*, 'rule-' || lower(code) AS rule, CASE WHEN code = 'S002' THEN 'error' ELSE 'warning' END AS severity, 'sentence of kind ' || code AS message, CASE code WHEN 'S001' THEN 'safe' WHEN 'S002' THEN 'unsafe' END AS applicability FROM (SELECT l.file_id, files.path, l.file_id * 1000000 + l.line AS finding_id, l.start AS \"offset\", octet_length(encode(regexp_extract(l.text, '^([^ ]*)', 1))) AS length, CASE WHEN regexp_matches(l.text, '^[A-Z][a-z]?[ .]') THEN 'S001' WHEN length(l.text) > 100 THEN 'S002' ELSE 'S003' END AS code, l.line AS arrival, l.line + 1 AS \"row\", 1 AS \"column\", l.line + 1 AS end_row, 1 + length(regexp_extract(l.text, '^([^ ]*)', 1)) AS end_column, l.text AS line_text FROM lines l JOIN files ON files.file_id = l.file_id WHERE l.text <> '') f)",
    "marks": "findings AS (SELECT file_id, file_id * 1000000 + idx AS finding_id, idx AS line, 'K' || (k % 5) AS code FROM steps WHERE kind = 'view'), directives AS (SELECT file_id, idx AS directive, CASE kind WHEN 'error' THEN 'disable' WHEN 'signup' THEN 'enable' ELSE 'line' END AS kind, CASE WHEN kind = 'purchase' THEN idx + 2 ELSE idx END AS line, idx AS first, 'K' || (k % 5) AS code, k % 50 = 0 AS wildcard FROM steps WHERE kind IN ('error', 'signup', 'purchase'))",
}


def sql(*names: str, recursive: bool = False) -> str:
    """WITH and the named table expressions, without the comma after the last."""
    return ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(SQL[n] for n in names)
