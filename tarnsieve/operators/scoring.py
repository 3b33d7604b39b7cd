"""Scores of findings: pillars, files, the composite, coverage, the histogram of complexity, counts, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnsieve import schema
from tarnsieve.operators.findings import counted, penalty

OFFENDERS = 5


def _number(c: Column) -> Column:
    return F.coalesce(c, F.lit(0)).cast("long")


def pillar_details(findings: DataFrame) -> DataFrame:
    """pillar, score, grade, findings, advisory, warning, error, penalty of pillars that have findings that count."""
    n = lambda s: F.count_if(F.col("severity") == s).alias(s)
    x = findings.where(counted()).withColumn("p", penalty()).groupBy("pillar").agg(F.count("*").alias("findings"), n("advisory"), n("warning"), n("error"), F.sum("p").alias("penalty"))
    x = x.withColumn("score", F.greatest(F.lit(0).cast("long"), F.lit(100) - F.col("penalty")))
    return x.select("pillar", "score", schema.grade(F.col("score")).alias("grade"), "findings", "advisory", "warning", "error", F.col("penalty").cast("double").alias("penalty"))


def composite(details: DataFrame) -> DataFrame:
    """One row: the mean of the contributing pillars' scores, rounded down; 100 if none contributes."""
    x = details.agg(F.expr("coalesce(sum(score) div count(*), 100)").alias("composite"), F.count("*").alias("n"), F.sort_array(F.collect_list("pillar")).alias("contributing_pillars"))
    few = F.concat(F.lit("driven by "), F.col("n").cast("string"), F.when(F.col("n") == 1, " pillar").otherwise(" pillars"), F.lit("; others have nothing above their thresholds"))
    caveat = F.when(F.col("n") == 0, "nothing that counts was found").when(F.col("n") <= 2, few)
    return x.select("composite", schema.grade(F.col("composite")).alias("grade"), "contributing_pillars", caveat.alias("caveat"))


def file_scores(findings: DataFrame) -> DataFrame:
    """file, penalty, findings, grade, max_cyclomatic (null without a finding of that rule)."""
    x = findings.where(counted()).withColumn("p", penalty()).groupBy("file").agg(F.sum("p").alias("penalty"), F.count("*").alias("findings"), F.max(F.when(F.col("rule_id") == "complexity.cyclomatic", F.col("metric"))).alias("max_cyclomatic"))
    return x.select("file", "penalty", "findings", schema.grade(F.greatest(F.lit(0).cast("long"), F.lit(100) - F.col("penalty"))).alias("grade"), "max_cyclomatic")


def top_offenders(findings: DataFrame, n: int = OFFENDERS) -> DataFrame:
    """The n files of the highest penalties (a top-k without a full sort)."""
    return file_scores(findings).orderBy(F.desc("penalty"), "file").limit(n)


def histogram(findings: DataFrame) -> DataFrame:
    """bin, n: findings of complexity.cyclomatic by their complexity, with bins that have none."""
    m = F.col("metric")
    own = F.when(m <= 5, "1-5").when(m <= 10, "6-10").when(m <= 15, "11-15").when(m <= 20, "16-20").otherwise("21+")
    x = findings.where((F.col("rule_id") == "complexity.cyclomatic") & m.isNotNull()).groupBy(own.alias("b")).agg(F.count("*").alias("k"))
    return schema.dimension(findings.sparkSession, "bin", schema.BINS).join(F.broadcast(x), F.col("bin") == F.col("b"), "left").select("bin", _number(F.col("k")).alias("n"))  # at most five rows


def severity_counts(findings: DataFrame) -> DataFrame:
    """severity, n for the three severities, whether found or not."""
    x = findings.groupBy("severity").agg(F.count("*").alias("k")).withColumnRenamed("severity", "s")
    return schema.dimension(findings.sparkSession, "severity", schema.RANK).join(F.broadcast(x), F.col("severity") == F.col("s"), "left").select("severity", _number(F.col("k")).alias("n"))  # at most a row a severity


def pillar_counts(findings: DataFrame) -> DataFrame:
    """pillar, n of the pillars that are there, design too."""
    return findings.groupBy("pillar").agg(F.count("*").alias("n"))


def top_rules(findings: DataFrame, n: int = 10) -> DataFrame:
    """The n rules that found most, ties by id."""
    return findings.groupBy("rule_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rule_id").limit(n)


def pillar_summary(findings: DataFrame) -> DataFrame:
    """A row for each of the ten pillars of the summary; those without findings have 100 and A."""
    d = pillar_details(findings).withColumnRenamed("pillar", "d_pillar")
    x = schema.dimension(findings.sparkSession, "pillar", schema.SUMMARY_PILLARS).join(F.broadcast(d), F.col("pillar") == F.col("d_pillar"), "left")  # a row a pillar
    return x.select("pillar", F.coalesce("grade", F.lit("A")).alias("grade"), F.coalesce(F.col("score").cast("double"), F.lit(100.0)).alias("score"), F.lit(True).alias("applicable"), *(_number(F.col(c)).alias(c) for c in ("findings", "advisory", "warning", "error")), F.coalesce("penalty", F.lit(0.0)).alias("penalty"))


def exit_code(findings: DataFrame, diagnostics: int, fail_on: str) -> DataFrame:
    """exit_code: 2 with any diagnostic; else 1 if a finding is at least as severe as fail_on (none: never); else 0."""
    if fail_on not in (*schema.RANK, "none"):
        raise ValueError(f"no such threshold: {fail_on}")
    if diagnostics:
        return findings.sparkSession.sql("select 2 as exit_code")
    hit = F.lit(False) if fail_on == "none" else schema.severity_rank(F.col("severity")) >= schema.RANK[fail_on]
    return findings.agg(F.coalesce(F.max(F.when(hit, 1).otherwise(0)), F.lit(0)).alias("exit_code"))


def exit_codes(findings: DataFrame, gates: list[str]) -> DataFrame:
    """fail_on, exit_code of several gates by one aggregate over the findings."""
    rank = F.coalesce(F.max(schema.severity_rank(F.col("severity"))), F.lit(-1))
    codes = [F.struct(F.lit(g).alias("fail_on"), F.when(F.lit(g != "none") & (F.col("rank") >= schema.RANK.get(g, 0)), 1).otherwise(0).alias("exit_code")) for g in gates]
    return findings.agg(rank.alias("rank")).select(F.explode(F.array(*codes)).alias("c")).select("c.fail_on", "c.exit_code")


def displayed(findings: DataFrame, rules=(), pillars=(), without_rules=(), without_pillars=()) -> DataFrame:
    """Findings that a display filter leaves; it never takes part in scores."""
    x = findings
    if rules:
        x = x.where(F.col("rule_id").isin(*rules))
    if pillars:
        x = x.where(F.col("pillar").isin(*pillars))
    if without_rules:
        x = x.where(~F.col("rule_id").isin(*without_rules))
    if without_pillars:
        x = x.where(~F.col("pillar").isin(*without_pillars))
    return x
