"""Findings over findings: functions both large and complex, files with many kinds of findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnsieve.rules.base import Rule, add

GOD = Rule("design.god-function", "God function", "design", "advisory", "high", "composite", ("size", "complexity"), tags=("composite",), remediation="Split the function; then look again.")
HOTSPOT = Rule("design.hotspot-file", "Hotspot", "maintainability", "advisory", "medium", "composite", thresholds={"minFindings": 3, "minPillars": 2}, tags=("composite",), remediation="Look at the file as a whole.")
for _r in (GOD, HOTSPOT):
    add(_r)


def _evidence() -> list:
    line = F.min(F.when(F.col("line") > 0, F.col("line")))
    return [F.sort_array(F.collect_set(F.when(F.col("rule_id") != "", F.col("rule_id")))).alias("rule_ids"), F.sort_array(F.collect_set(F.when(F.col("fingerprint") != "", F.col("fingerprint")))).alias("underlying"), line.alias("primary_line")]


def _raw(x: DataFrame, rule: Rule, message, symbol, **metadata) -> DataFrame:
    pairs = [F.lit("ruleIds"), F.to_json("rule_ids"), F.lit("primaryLine"), F.col("primary_line").cast("string")]
    for k, c in metadata.items():
        pairs += [F.lit(k), c]
    kept = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())
    none = F.lit(None)
    return x.select(F.lit(rule.id).alias("rule_id"), message.alias("message"), "file", none.cast("int").alias("line"), none.cast("int").alias("col"), none.cast("int").alias("end_line"), symbol.alias("symbol"), kept.alias("metadata"), none.cast("long").alias("metric"), F.when(F.size("underlying") > 0, F.col("underlying")).alias("underlying"))


def god_functions(findings: DataFrame) -> DataFrame:
    """One finding for each (file, symbol) with findings of both size and complexity."""
    x = findings.where((F.col("file") != "") & (F.col("symbol") != "") & F.col("pillar").isin("size", "complexity"))
    n = lambda p: F.count_if(F.col("pillar") == p)
    x = x.groupBy("file", "symbol").agg(n("size").alias("n_size"), n("complexity").alias("n_complexity"), *_evidence()).where("n_size > 0 and n_complexity > 0")
    return _raw(x, GOD, F.concat(F.lit("function "), F.col("symbol"), F.lit(" combines size and complexity findings")), F.col("symbol"), sizeFindings=F.col("n_size").cast("string"), complexityFindings=F.col("n_complexity").cast("string"))


def hotspots(findings: DataFrame, min_findings: int = 3, min_pillars: int = 2) -> DataFrame:
    """One finding for each file with enough findings of enough pillars, design aside."""
    x = findings.where((F.col("file") != "") & (F.col("pillar") != "design")).groupBy("file").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("pillar")).alias("pillars"), *_evidence())
    x = x.where((F.col("n") >= min_findings) & (F.size("pillars") >= min_pillars))
    return _raw(x, HOTSPOT, F.lit("file has findings across multiple quality pillars"), F.lit(""), findings=F.col("n").cast("string"), pillars=F.to_json("pillars"))
