"""Schemas of the relations, and the small dimensions: pillars, severities, bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a rule says before definitions are joined to it.
RAW = "rule_id string, message string, file string, line int, col int, end_line int, symbol string, metadata map<string,string>, metric bigint, underlying array<string>"
FINDINGS = RAW + ", severity string, confidence string, pillar string, secondary_pillars array<string>, remediation string, fingerprint string"
BASELINE = "rule_id string, file string, fingerprint string"
CHANGED = "file string, first int, last int"
DIAGNOSTICS = "stage string, message string, file string, line int, col int, severity string"

#: Pillars of the summary; design is counted elsewhere.
SUMMARY_PILLARS = tuple("complexity dead-code documentation maintainability modernisation naming security sensitive-data size test-quality".split())
BINS = tuple("1-5 6-10 11-15 16-20 21+".split())
RANK = {s: i for i, s in enumerate("advisory warning error".split())}


def severity_rank(c: Column) -> Column:
    return F.when(c == "error", 2).when(c == "warning", 1).when(c == "advisory", 0)


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")


def dimension(spark: SparkSession, name: str, values) -> DataFrame:
    """A table of a few known values."""
    return spark.createDataFrame([(v,) for v in values], f"{name} string")
