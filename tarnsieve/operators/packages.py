"""Rules over packages: group-bys of what parsing tells of each file (plans.parse.FACTS)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnsieve.rules.base import Rule, add

COMMENT = Rule("docs.package-comment", "Package comment", "documentation", "advisory", "high", "project", remediation="Say in one file what the package is for.")
UNDERSCORE = Rule("naming.package-underscore", "Underscore in a package name", "naming", "advisory", "high", "project", tags=("go-style",), remediation="Use one short word.")
UNUSED = Rule("dead-code.unused-private-function", "Unused function", "dead-code", "advisory", "medium", "project", tags=("dead-code", "cross-file"), remediation="Delete the function if nothing uses it.")
RECEIVER = Rule("naming.receiver-consistency", "Receivers differ", "naming", "advisory", "medium", "project", options={"inspectGroup": "both", "allowMixed": []}, tags=("go-style", "naming"), remediation="Use one receiver name and form for a type.")
for _r in (COMMENT, UNDERSCORE, UNUSED, RECEIVER):
    add(_r)


def _raw(x: DataFrame, rule_id: str, message: Column, line: Column, col: Column | int = 0, symbol: Column | str = "", file: str = "file") -> DataFrame:
    c = lambda v: v if isinstance(v, Column) else F.lit(v)
    none = F.lit(None)
    return x.select(F.lit(rule_id).alias("rule_id"), message.alias("message"), F.col(file).alias("file"), line.cast("int").alias("line"), c(col).cast("int").alias("col"), F.lit(0).alias("end_line"), c(symbol).alias("symbol"), F.create_map().cast("map<string,string>").alias("metadata"), none.cast("long").alias("metric"), none.cast("array<string>").alias("underlying"))


def _quoted(c) -> Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


def package_comments(facts: DataFrame) -> DataFrame:
    """Packages of which no file has a package comment, at their first file; packages of external tests alone are let off."""
    x = facts.groupBy("dir", "package").agg(F.min("path").alias("file"), F.bool_or("has_doc").alias("doc"), F.bool_or(~F.col("is_test")).alias("code"))
    x = x.where(~F.col("doc") & (F.col("code") | ~F.col("package").endswith("_test")))
    return _raw(x, COMMENT.id, F.concat(F.lit("package "), "package", F.lit(" has no package comment")), F.lit(1))


def package_underscores(facts: DataFrame) -> DataFrame:
    """Packages with an underscore in their names, at their first file, but for x_test in test files."""
    external = F.col("is_test") & F.col("package").rlike("^[^_]+_test$")
    x = facts.where(F.col("package").contains("_") & ~external).groupBy("dir", "package").agg(F.min("path").alias("file"), F.min_by("package_line", "path").alias("line"))
    return _raw(x, UNDERSCORE.id, F.concat(F.lit("package name "), _quoted("package"), F.lit(" contains an underscore")), F.col("line"))


def package_summaries(facts: DataFrame, applies: Column, min_lines: int) -> DataFrame:
    """The rubric's part over packages: summaries that are missing or too short."""
    x = facts.where(applies).groupBy("dir", "package").agg(F.min("path").alias("file"), F.max("doc_lines").alias("n"), F.bool_or(~F.col("is_test")).alias("code"))
    x = x.where((F.col("n") < min_lines) & (F.col("code") | ~F.col("package").endswith("_test")))
    short = F.concat(F.lit("package summary has "), F.col("n").cast("string"), F.lit(f" non-empty lines, below required {min_lines} lines"))
    return _raw(x, "docs.comment-rubric", F.when(F.col("n") > 0, short).otherwise("package summary is missing"), F.lit(1))


def unused_functions(facts: DataFrame) -> DataFrame:
    """Functions in lower case whose name occurs once in their package, unless the package reflects."""
    pkg = ["dir", "package"]
    named = facts.select(*pkg, F.explode("names").alias("n")).groupBy(*pkg, F.col("n.name").alias("name")).agg(F.sum("n.n").alias("uses")).where("uses <= 1").drop("uses")
    own = facts.select(*pkg, F.col("path").alias("file"), F.explode("privates").alias("f")).withColumn("name", F.col("f.name"))
    reflects = facts.where("reflects").select(*pkg).distinct()
    x = own.join(named, [*pkg, "name"], "left_semi").join(reflects, pkg, "left_anti")
    message = F.concat(F.lit("private function "), _quoted("name"), F.lit(" is not referenced in package "), _quoted("package"))
    return _raw(x, UNUSED.id, message, F.col("f.line"), F.col("f.col"), F.col("name"))


def receivers(facts: DataFrame, allow_mixed: list[str] | None = None, inspect: str = "both") -> DataFrame:
    """Methods whose receiver differs in name or form from what most methods of the type in the directory have; ties go to the smallest."""
    mode = inspect.strip().lower()
    key = ["dir", "type"]
    m = facts.select("dir", F.col("path").alias("file"), F.explode("methods").alias("m")).select("dir", "file", *(F.col(f"m.{c}").alias(c) for c in ("type", "name", "form", "symbol", "line", "col")))

    def dominant(of: str) -> DataFrame:
        n = m.where(F.col(of) != "").groupBy(*key, of).agg(F.count("*").alias("n"))
        return n.groupBy(*key).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(of).alias("v")))["v"].alias(f"top_{of}"), F.count("*").alias(f"kinds_{of}"))

    w = m.join(dominant("name"), key, "left").join(dominant("form"), key, "left")
    off_name = F.lit(mode != "pointer") & (F.coalesce("kinds_name", F.lit(0)) > 1) & (F.col("name") != "") & (F.col("name") != F.col("top_name"))
    off_form = F.lit(mode != "name") & (F.col("kinds_form") > 1) & (F.col("form") != F.col("top_form")) & ~F.col("type").isin(*(allow_mixed or [""]))
    x = w.withColumns({"off_name": F.coalesce(off_name, F.lit(False)), "off_form": F.coalesce(off_form, F.lit(False))}).where("off_name or off_form")

    def says(of: str) -> Column:
        return F.concat(F.lit(f"receiver {of} "), _quoted(of), F.lit(f" differs from dominant receiver {of} "), _quoted(f"top_{of}"), F.lit(" for type "), _quoted("type"))

    both = F.concat(F.lit("receiver for type "), _quoted("type"), F.lit(" differs from dominant convention"))
    message = F.when(F.col("off_name") & F.col("off_form"), both).when(F.col("off_name"), says("name")).otherwise(says("form"))
    return _raw(x, RECEIVER.id, message, F.col("line"), F.col("col"), F.col("symbol"))
