"""Baselines and changed lines: which findings stay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["rule_id", "file", "fingerprint"]


def kept(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings that the baseline doesn't name. Both sides may be large: the join's strategy is left to the optimizer's sizes."""
    return findings.join(baseline.select(*KEY), KEY, "left_anti").select(*findings.columns)


def suppressed(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    return findings.join(baseline.select(*KEY), KEY, "left_semi").select(*findings.columns)


def stale(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Distinct entries that no finding has."""
    return baseline.select(*KEY).distinct().join(findings.select(*KEY), KEY, "left_anti")


def baseline_counts(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """One row: entries, suppressed findings, kept findings, stale entries; findings and entries are joined once."""
    f = findings.groupBy(*KEY).agg(F.count("*").alias("n"))
    b = baseline.select(*KEY).distinct().withColumn("listed", F.lit(True))
    x = f.join(b, KEY, "full")
    n = F.coalesce("n", F.lit(0))
    listed = F.coalesce("listed", F.lit(False))
    return x.agg(F.count_if(listed).alias("entries"), F.coalesce(F.sum(F.when(listed, n)), F.lit(0)).alias("suppressed"), F.coalesce(F.sum(F.when(~listed, n)), F.lit(0)).alias("kept"), F.count_if(listed & F.col("n").isNull()).alias("stale"))


def entries(findings: DataFrame) -> DataFrame:
    """A baseline of findings, in the order in which it is written; repeats stay."""
    return findings.select(*KEY).orderBy("file", "rule_id", "fingerprint")


def on_changed_lines(findings: DataFrame, changed: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Findings whose lines meet a changed range of their file; those without a line stay if the file changed at all.

    changed: file, first, last. files: all changed files (with deletions alone too), by default those of changed.
    """
    whole = F.lit(files is None).alias("whole")
    c = changed.select(F.col("file").alias("c_file"), "first", "last", whole)
    if files is not None:
        none = F.lit(None).cast("int")
        c = c.unionByName(files.select(F.col("file").alias("c_file"), none.alias("first"), none.alias("last"), F.lit(True).alias("whole")))
    # one join for both kinds of findings, each of which is then shuffled once
    placed = F.coalesce("line", F.lit(0)) > 0
    last = F.greatest(F.col("line"), F.coalesce("end_line", F.lit(0)))
    inside = placed & (F.col("line") <= F.col("last")) & (last >= F.col("first"))
    return findings.join(c, (F.col("file") == F.col("c_file")) & (inside | (~placed & F.col("whole"))), "left_semi")


def without_orphans(findings: DataFrame) -> DataFrame:
    """Without composites none of whose evidence is left. A finding is a composite if it names evidence (even none)."""
    composite = F.col("underlying").isNotNull()
    base = findings.where(~composite)
    mine = findings.where(composite)
    alive = mine.select(*KEY, F.explode("underlying").alias("fp")).join(base.select(F.col("fingerprint").alias("fp")).where("fp <> ''"), "fp", "left_semi").select(*KEY).distinct()
    return base.unionByName(mine.join(alive, KEY, "left_semi").select(*findings.columns))
