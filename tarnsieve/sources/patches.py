"""Unified diffs without context as tables: which lines of which files changed."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def from_git(root: str, base: str, paths: list[str] | None = None) -> str:
    """The patch of root's tree against base, as text."""
    if not base:
        raise ValueError("a diff needs a base")
    return subprocess.run(["git", "-C", root, *"diff --relative --no-ext-diff --unified=0".split(), base, "--", *(paths or ["."])], capture_output=True, text=True, errors="replace", check=True).stdout


def hunks(patches: DataFrame) -> DataFrame:
    """patches (patch_id, text) -> patch_id, file, first, last; a file of deletions alone has a row with nulls.

    The file of a hunk is the last "+++" line before it; /dev/null stands for none. Each row is read by itself, whatever
    other rows have its patch_id: no shuffle, and a task holds one patch at a time.
    """
    sections = F.filter(F.split(F.concat(F.lit("\n"), F.col("text")), r"\n(?=\+\+\+ )", -1), lambda s: s.startswith("+++ "))
    part = lambda line, g: F.regexp_extract(line, r"^@@ -[\d,]+ [+](\d+),?(\d*) @@", g)

    def span(line):
        n = F.when(part(line, 2) == "", 1).otherwise(part(line, 2).cast("int"))
        first = F.when(part(line, 1) != "", part(line, 1).cast("int"))
        return F.struct(first.alias("first"), (first + n - 1).alias("last"))

    def section(s):
        named = F.trim(F.substring_index(F.substring(s, 5, 2147483647), "\n", 1))
        spans = F.filter(F.transform(F.filter(F.split(s, "\n", -1), lambda x: x.startswith("@@ ")), span), lambda x: x["last"] >= x["first"])
        return F.struct(F.when(named == "/dev/null", "").otherwise(F.regexp_replace(named, "^b/", "")).alias("file"), spans.alias("spans"))

    named = patches.select("patch_id", F.filter(F.transform(sections, section), lambda s: s["file"] != "").alias("s"))
    none = F.lit(None).cast("int")
    names = lambda some: F.transform(F.filter("s", lambda s: (F.size(s["spans"]) > 0) == F.lit(some)), lambda s: s["file"])
    row = lambda file, first, last: F.struct(file.alias("file"), first.alias("first"), last.alias("last"))
    spans = F.flatten(F.transform("s", lambda s: F.transform(s["spans"], lambda x: row(s["file"], x["first"], x["last"]))))
    empty = F.transform(F.array_except(names(False), names(True)), lambda f: row(f, none, none))
    return named.select("patch_id", F.inline(F.concat(spans, empty)))


def changed(spark: SparkSession, patch: str) -> tuple[DataFrame, DataFrame]:
    """Changed ranges (file, first, last) and changed files (file) of one patch."""
    h = hunks(spark.createDataFrame([(0, patch)], "patch_id int, text string"))
    return h.where("first is not null").select("file", "first", "last"), h.select("file").distinct()
