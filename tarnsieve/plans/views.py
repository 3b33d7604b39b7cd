"""Relations made of the star schema's tables with the very same SQL in Spark and in DuckDB: findings, ranges, baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnsieve.operators.findings import fingerprint

FINDINGS_SQL = """SELECT CASE l_returnflag WHEN 'A' THEN 'complexity.cyclomatic' WHEN 'N' THEN 'size.function-length' ELSE CASE l_linestatus WHEN 'F' THEN 'security.shell-command' ELSE 'design.god-function' END END AS rule_id,
  CASE l_returnflag WHEN 'A' THEN 'complexity' WHEN 'N' THEN 'size' ELSE CASE l_linestatus WHEN 'F' THEN 'security' ELSE 'design' END END AS pillar,
  CASE WHEN l_quantity >= 40 THEN 'error' WHEN l_quantity >= 15 THEN 'warning' ELSE 'advisory' END AS severity,
  CASE WHEN l_linenumber <= 2 THEN 'low' WHEN l_linenumber <= 4 THEN 'medium' ELSE 'high' END AS confidence,
  concat('pkg', CAST(l_partkey % 50 AS VARCHAR(20)), '/f', CAST(l_partkey AS VARCHAR(20)), CASE WHEN l_partkey % 3 = 0 THEN '_test.go' ELSE '.go' END) AS file,
  CAST(CASE WHEN l_quantity = 50 THEN 0 ELSE l_linenumber * 10 END AS INT) AS line, CAST(l_linenumber * 10 + floor(l_quantity) AS INT) AS end_line, CAST(l_suppkey % 5 AS INT) AS col,
  concat('F', CAST(l_suppkey % 7 AS VARCHAR(20))) AS symbol, concat('quantity <', CAST(CAST(floor(l_quantity) AS INT) AS VARCHAR(20)), '> & "more"') AS message, CAST(floor(l_quantity) AS BIGINT) AS metric FROM lineitem"""
#: The rules of FINDINGS_SQL.
RULES = ["complexity.cyclomatic", "design.god-function", "security.shell-command", "size.function-length"]
#: Lines of files that changed, by orders.
CHANGED_SQL = """SELECT concat('pkg', CAST(o_custkey % 50 AS VARCHAR(20)), '/f', CAST(o_custkey AS VARCHAR(20)), CASE WHEN o_custkey % 3 = 0 THEN '_test.go' ELSE '.go' END) AS file,
  CAST(o_orderkey % 60 AS INT) AS first, CAST(o_orderkey % 60 + o_orderkey % 4 AS INT) AS last FROM orders"""

_JSON = "CAST(to_json({'ruleId': rule_id, 'file': file, 'line': line, 'column': col, 'endLine': end_line, 'symbol': symbol, 'message': message}) AS VARCHAR)"
for _char, _code in (("<", "003c"), (">", "003e"), ("&", "0026")):
    _JSON = f"replace({_JSON}, '{_char}', concat(chr(92), 'u{_code}'))"
FINGERPRINT_SQL = f"substr(sha256({_JSON}), 1, 16)"
FINGERPRINTED_SQL = f"SELECT *, {FINGERPRINT_SQL} AS fingerprint FROM ({FINDINGS_SQL})"
#: Reviewed findings, as often as they are there, and entries that no finding has any more.
BASELINE_SQL = f"SELECT rule_id, file, fingerprint FROM ({FINGERPRINTED_SQL}) WHERE metric % 4 = 0 UNION ALL SELECT DISTINCT rule_id, file, 'stale' AS fingerprint FROM ({FINDINGS_SQL}) WHERE metric % 25 = 0"
PENALTY_SQL = "CASE severity WHEN 'advisory' THEN 1 WHEN 'warning' THEN CASE confidence WHEN 'low' THEN 4 WHEN 'medium' THEN 6 ELSE 8 END ELSE CASE confidence WHEN 'low' THEN 15 WHEN 'medium' THEN 22 ELSE 30 END END"
GRADE_SQL = "CASE WHEN {0} >= 90 THEN 'A' WHEN {0} >= 80 THEN 'B' WHEN {0} >= 70 THEN 'C' WHEN {0} >= 60 THEN 'D' ELSE 'F' END"


def spread(scan: DataFrame) -> DataFrame:
    """A plain scan of fewer parts than there are cores, as a file of one row group is, dealt out to all of them by its first column.

    Columns and filters still reach the file. A table of many row groups is left as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores, scan.columns[0]) if scan.rdd.getNumPartitions() < cores else scan


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def view(spark: SparkSession, sf_dir: str, sql: str, source: str) -> DataFrame:
    """The SQL over one table, without a name in the catalog."""
    return spark.sql(sql.replace(f"FROM {source}", "FROM {source}"), source=table(spark, sf_dir, source))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings view as the operators take findings, fingerprints by fingerprint()."""
    x = view(spark, sf_dir, FINDINGS_SQL, "lineitem")
    return x.withColumns({"fingerprint": fingerprint(), "underlying": F.lit(None).cast("array<string>"), "metadata": F.create_map().cast("map<string,string>")})


def changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, CHANGED_SQL, "orders")


def baseline(f: DataFrame) -> DataFrame:
    """BASELINE_SQL of findings."""
    stale = f.where("metric % 25 = 0").select("rule_id", "file", F.lit("stale").alias("fingerprint")).distinct()
    return f.where("metric % 4 = 0").select("rule_id", "file", "fingerprint").unionByName(stale)
