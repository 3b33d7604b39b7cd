"""Findings as lines and structs of the report formats, made in columns; documents are put together by sinks.report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _escape(c: Column, prop: bool = False) -> Column:
    for a, b in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A"), *(((":", "%3A"), (",", "%2C")) if prop else ())):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def annotation() -> Column:
    """A workflow command for a finding; end line only beyond the line."""
    level = F.when(F.col("severity").isin("error", "warning"), F.col("severity")).otherwise("notice")
    placed = F.coalesce("line", F.lit(0)) > 0
    number = lambda name, c, on: F.when(placed & on, F.concat(F.lit(f",{name}="), F.col(c).cast("string"))).otherwise("")
    return F.concat(F.lit("::"), level, F.lit(" file="), _escape(F.col("file"), True), number("line", "line", F.lit(True)), number("endLine", "end_line", F.col("end_line") > F.col("line")), number("col", "col", F.col("col") > 0), F.lit(",title="), _escape(F.col("rule_id"), True), F.lit("::"), _escape(F.col("message")))


def text_line() -> Column:
    at = F.when(F.coalesce("line", F.lit(0)) > 0, F.concat(F.lit(":"), F.col("line").cast("string"), F.when(F.col("col") > 0, F.concat(F.lit(":"), F.col("col").cast("string"))).otherwise(""))).otherwise("")
    return F.concat("file", at, F.lit(" ["), "severity", F.lit("] "), "rule_id", F.lit(": "), "message")


def rule_index(rules: DataFrame) -> DataFrame:
    """rule_id -> rule_index in order of ids; rules is a catalogue, so one small partition."""
    return rules.select("rule_id", (F.row_number().over(Window.orderBy("rule_id")) - 1).alias("rule_index"))


def sarif_results(findings: DataFrame, index: DataFrame) -> DataFrame:
    """result: one struct for each finding. index is joined by broadcast: a row a rule."""
    x = findings.join(F.broadcast(index), "rule_id", "left")
    placed = F.coalesce("line", F.lit(0)) > 0
    positive = lambda c: F.when(F.col(c) > 0, F.col(c))
    region = F.when(placed, F.struct(F.col("line").alias("startLine"), positive("col").alias("startColumn"), positive("end_line").alias("endLine")))
    uri = F.regexp_replace(F.translate("file", "\\", "/"), r"^\./", "")
    where = F.array(F.struct(F.struct(F.struct(uri.alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation")))
    level = F.when(F.col("severity").isin("error", "warning"), F.col("severity")).otherwise("note")
    return x.select(F.struct(F.col("rule_id").alias("ruleId"), F.col("rule_index").alias("ruleIndex"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), where.alias("locations"), F.struct(F.col("fingerprint").alias("primary")).alias("partialFingerprints")).alias("result"))
