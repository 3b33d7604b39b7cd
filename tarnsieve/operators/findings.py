"""Findings: definitions joined to what rules say, calibration, fingerprints, order, penalties."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnsieve.rules.base import Rule

_ESCAPED = {chr(c): f"\\u{c:04x}" for c in (0x3C, 0x3E, 0x26, 0x2028, 0x2029)}
_CONTROL = ["000B", "000E", "000F", *(f"001{x}" for x in "ABCDEF")]


def _escaped(json: Column) -> Column:
    """json with the escapes of a strict writer; nearly all texts end after one look or three replacements."""
    common = json
    for a, b in _ESCAPED.items():
        if ord(a) < 128:
            common = F.replace(common, F.lit(a), F.lit(b))
    rare = common
    for a, b in _ESCAPED.items():
        if ord(a) >= 128:
            rare = F.replace(rare, F.lit(a), F.lit(b))
    for x in _CONTROL:
        # not where the backslash is itself escaped
        rare = F.regexp_replace(rare, rf"(?<!\\)((?:\\\\)*)\\u{x}", rf"$1\\u{x.lower()}")
    odd = json.contains("\\u00") | json.contains("\u2028") | json.contains("\u2029")
    plain = ~(json.contains("<") | json.contains(">") | json.contains("&"))
    return F.when(odd, rare).when(plain, json).otherwise(common)


def fingerprint() -> Column:
    """The first 16 hex digits of SHA-256 of a finding's identity as compact JSON; severity and metadata aren't part of it."""
    number = lambda c: F.coalesce(F.col(c), F.lit(0))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    identity = F.struct(text("rule_id").alias("ruleId"), text("file").alias("file"), number("line").alias("line"), number("col").alias("column"), number("end_line").alias("endLine"), text("symbol").alias("symbol"), text("message").alias("message"))
    # an array of one: what makes the text isn't copied into every condition
    json = F.get(F.transform(F.array(F.to_json(identity)), _escaped), F.lit(0))
    return F.substring(F.sha2(json, 256), 1, 16)


def definitions(spark, rules: Iterable[Rule], severities: dict[str, str] | None = None) -> DataFrame:
    """The catalogue as a table: a row a rule, so it may always be broadcast."""
    rows = [(r.id, (severities or {}).get(r.id, r.severity), r.confidence, r.pillar, list(r.secondary), r.remediation) for r in rules]
    return spark.createDataFrame(rows, "d_rule string, d_severity string, d_confidence string, d_pillar string, d_secondary array<string>, d_remediation string")


def enrich(raw: DataFrame, rules: DataFrame) -> DataFrame:
    """raw (RAW) with severity, confidence, pillar, secondary pillars, remediation and fingerprint; findings of unknown rules are dropped.

    A test file's size findings whose configured severity is warning become advisory of medium confidence.
    """
    x = raw.join(F.broadcast(rules), F.col("rule_id") == F.col("d_rule"))
    eased = F.col("rule_id").isin("size.file-length", "size.function-length") & (F.col("d_severity") == "warning") & (F.coalesce(F.col("metadata")["testFile"], F.lit("false")) == "true")
    x = x.withColumns({
        "severity": F.when(eased, "advisory").otherwise(F.col("d_severity")),
        "confidence": F.when(eased, "medium").otherwise(F.col("d_confidence")),
        "pillar": F.col("d_pillar"), "secondary_pillars": F.col("d_secondary"), "remediation": F.col("d_remediation"), "fingerprint": fingerprint(),
    })
    return x.drop("d_rule", "d_severity", "d_confidence", "d_pillar", "d_secondary", "d_remediation")


#: The total order of findings, for sinks.
ORDER = ("file", "line", "col", "rule_id", "message", "fingerprint")


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy("file", F.coalesce("line", F.lit(0)), F.coalesce("col", F.lit(0)), "rule_id", "message", "fingerprint")


def penalty() -> Column:
    """What a finding costs: 1, 8 or 30 by severity, half of it at low and three quarters at medium confidence, rounded down, 1 at least."""
    table = {"advisory": (1, 1, 1), "warning": (4, 6, 8), "error": (15, 22, 30)}
    out = F.lit(0).cast("long")
    for severity, (low, medium, high) in table.items():
        by = F.when(F.col("confidence") == "low", low).when(F.col("confidence") == "medium", medium).otherwise(high)
        out = F.when(F.col("severity") == severity, by.cast("long")).otherwise(out)
    return out


def counted() -> Column:
    """Whether a finding counts in scores: those of the rules design.* don't."""
    return ~F.col("rule_id").startswith("design.")
