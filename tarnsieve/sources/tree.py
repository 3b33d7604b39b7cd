"""Discovery of files: a walk that prunes as it goes on a local tree, and the same rules over a table of paths."""

from __future__ import annotations

import os
import posixpath
import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnsieve.functions.paths import PatternError, matches_any, path_regex, segment_regex
from tarnsieve.shared import BROADCAST_BYTES, sized

VCS = frozenset([".svn", ".hg", ".git"])
_METADATA = frozenset([".github", ".codex", ".claude", ".agents"])
FALLBACK = {"node_modules": "dependency", "vendor": "dependency", "coverage": "build-output", "build": "build-output", "dist": "build-output", ".vscode": "local-tooling", ".idea": "local-tooling"}
_TEXT = frozenset(".txt .env .xml .ini .toml .yml .yaml .json".split())


@dataclass(frozen=True)
class IgnoreRule:
    regex: str
    negated: bool
    dirs_only: bool


def ignore_rules(text: str) -> tuple[list[IgnoreRule], bool]:
    """The rules of an ignore file, and whether some line couldn't be read."""
    out, bad = [], False
    for line in text.split("\n"):
        line = re.sub(r"((?:\\\\)*(?:\\[ \t])?)[ \t]*$", r"\1", line.removesuffix("\r")) if line.endswith((" ", "\t", "\r")) else line
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line[1:] if negated or line.startswith(("\\!", "\\#")) else line
        anchored = line.startswith("/")
        line = line[1:] if anchored else line
        dirs = line.endswith("/")
        line = line[:-1] if dirs else line
        try:
            if not line:
                raise PatternError("empty")
            out.append(IgnoreRule(ignore_regex(line, anchored or "/" in line), negated, dirs))
        except PatternError:
            bad = True
    return out, bad


def ignore_regex(pattern: str, anchored: bool) -> str:
    """An expression over paths relative to the ignore file's folder; ** is any depth, at the end at least one segment."""
    parts = pattern.split("/")
    out = "^" if anchored else "^(?:.*/)?"
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if part == "**":
            out += ".+" if last else "(?:[^/]+/)*"
        else:
            out += segment_regex(part) + ("" if last else "/")
    return out + "$"


def dir_reason(parts: list[str], fallback: bool) -> str | None:
    for p in parts:
        if p in VCS:
            return "vcs"
        if p in _METADATA:
            return "non-application-metadata"
    return next((FALLBACK[p] for p in parts if p in FALLBACK), None) if fallback else None


def file_type(path: str) -> str | None:
    base = posixpath.basename(path)
    ext = ("." + base.rpartition(".")[2].lower()) if "." in base else ""
    return "go" if ext == ".go" else "text" if ext in _TEXT or base.startswith(".env") else None


def generated_go(lines: str | Iterable[str]) -> bool:
    """Whether comments before the package clause say that a tool wrote the file; no line behind it is asked for."""
    for line in (x.strip() for x in (lines.split("\n") if isinstance(lines, str) else lines)):
        if line:
            if line.startswith("package ") or not line.startswith(("//", "/*", "*")):
                return False
            if "code generated" in line.lower() and "do not edit" in line.lower():
                return True
    return False


@dataclass
class Found:
    files: dict[str, tuple[str, str]] = field(default_factory=dict)  # path -> (absolute path, type)
    skipped: set[tuple[str, str]] = field(default_factory=set)
    missing: set[str] = field(default_factory=set)


class Walk:
    def __init__(self, root: str, ignore: list[str], include_ignored: bool):
        self.root, self.ignore, self.all = os.path.abspath(root), ignore, include_ignored
        self.rules: dict[str, tuple[list[IgnoreRule], bool] | None] = {}
        self.found = Found()

    def load(self, folder: str) -> list[IgnoreRule] | None:
        if folder not in self.rules:
            try:
                with open(os.path.join(self.root, folder, ".gitignore"), encoding="utf-8", errors="replace") as f:
                    self.rules[folder] = ignore_rules(f.read())
            except OSError:
                self.rules[folder] = None
        known = self.rules[folder]
        return known[0] if known else None

    def verdict(self, rel: str, is_dir: bool) -> bool:
        """The last rule that matches decides, from the root's file down."""
        parts, out = rel.split("/"), False
        for i in range(len(parts)):
            for rule in self.load("/".join(parts[:i])) or ():
                if (is_dir or not rule.dirs_only) and re.match(rule.regex, "/".join(parts[i:]), re.S):
                    out = not rule.negated
        return out

    def ignored(self, rel: str, is_dir: bool) -> bool:
        """A path is ignored if it or any folder above it is."""
        parts = rel.split("/")
        return self.verdict(rel, is_dir) or any(self.verdict("/".join(parts[:i]), True) for i in range(len(parts) - 1, 0, -1))

    def fallback(self, rel: str) -> bool:
        parts = rel.split("/")[:-1]
        return all(self.load("/".join(parts[:i])) is None and self.rules["/".join(parts[:i])] is None for i in range(len(parts) + 1))

    def enter(self, rel: str) -> bool:
        reason = None
        if not self.all and not rel.startswith("..") and self.ignored(rel, True):
            reason = "gitignored"
        elif matches_any(self.ignore, rel):
            reason = "config-ignore"
        elif not self.all:
            reason = dir_reason(rel.split("/"), self.fallback(rel))
        if reason:
            self.found.skipped.add((rel, reason))
        return reason is None

    def file(self, path: str, rel: str) -> None:
        reason = None
        kind = file_type(rel)
        if not self.all and not rel.startswith("..") and self.ignored(rel, False):
            reason = "gitignored"
        elif matches_any(self.ignore, rel):
            reason = "config-ignore"
        elif not self.all and _METADATA & set(rel.split("/")[:-1]):
            reason = "non-application-metadata"
        elif kind == "go" and not self.all:
            with open(path, encoding="utf-8", errors="replace") as f:
                reason = "generated" if generated_go(f) else None
        if reason:
            self.found.skipped.add((rel, reason))
        elif kind:
            self.found.files.setdefault(rel, (path, kind))

    def visit(self, name: str) -> None:
        path = os.path.normpath(os.path.join(self.root, name))
        if not os.path.exists(path):
            self.found.missing.add(posixpath.normpath(name.replace(os.sep, "/")))
            return
        show = lambda p: p if (r := os.path.relpath(p, self.root).replace(os.sep, "/")).startswith("..") else r
        if os.path.isfile(path):
            self.file(path, show(path))
            return
        if path != self.root and not self.enter(show(path)):
            return
        for folder, dirs, names in os.walk(path):
            dirs[:] = sorted(d for d in dirs if self.enter(show(os.path.join(folder, d))))
            for n in sorted(names):
                self.file(os.path.join(folder, n), show(os.path.join(folder, n)))


def discover(root: str, inputs: list[str] | None = None, ignore: list[str] | None = None, include_ignored: bool = False) -> Found:
    """Files below inputs (relative to root), what was skipped and why, and inputs that don't exist."""
    w = Walk(root, ignore or [], include_ignored)
    for name in inputs or ["."]:
        w.visit(name)
    for folder, known in w.rules.items():
        if known and known[1] and not include_ignored:
            w.found.skipped.add((posixpath.join(folder, ".gitignore"), "gitignore-parse-error"))
    return w.found


def read(spark: SparkSession, found: Found) -> DataFrame:
    """path, type, text of the files found; executors read them, so root must be on storage that they share."""
    rows = [(p, a if "://" in a else "file://" + a, k) for p, (a, k) in found.files.items()]
    names = spark.createDataFrame(rows, "path string, uri string, type string")
    if not rows:
        return names.select("path", "type", F.lit("").alias("text"))
    data = spark.read.format("binaryFile").load([u for _, u, _ in rows]).select(F.regexp_replace("path", "^file:/+", "file:///").alias("uri"), F.decode("content", "UTF-8").alias("text"))
    return names.join(data, "uri").select("path", "type", "text")


# over a table of paths


def type_of(path: Column) -> Column:
    base = F.element_at(F.split(path, "/"), -1)
    ext = F.lower(F.regexp_extract(base, r"(\.[^.]*)$", 1))
    return F.when(ext == ".go", "go").when(ext.isin(*sorted(_TEXT)) | base.startswith(".env"), "text")


def folder_reason(path: Column, fallback: Column) -> Column:
    """Why the folder of a file isn't walked, by its segments: the first that says so, always before fallback."""
    parts = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    has = lambda names: F.arrays_overlap(parts, F.array(*[F.lit(x) for x in sorted(names)]))
    first = F.try_element_at(F.filter(parts, lambda p: p.isin(*sorted(VCS | _METADATA))), F.lit(1))
    loose = F.try_element_at(F.filter(parts, lambda p: p.isin(*sorted(FALLBACK))), F.lit(1))
    reasons = F.create_map(*[F.lit(x) for kv in sorted(FALLBACK.items()) for x in kv])
    return F.when(has(VCS | _METADATA), F.when(first.isin(*sorted(VCS)), "vcs").otherwise("non-application-metadata")).when(fallback, reasons[loose])


def config_ignored(path: Column, ignore: list[str] | None) -> Column:
    """Whether the configuration leaves a path out."""
    hidden = F.lit(False)
    for p in ignore or []:
        prefix = p.removesuffix("/**") if p.endswith("/**") else None
        hidden = hidden | (((path == prefix) | path.startswith(f"{prefix}/")) if prefix else path.rlike(path_regex(p)))
    return hidden


def classify(paths: DataFrame, ignore: list[str] | None = None) -> DataFrame:
    """path -> path, type, reason: what discovery would do with a table of file paths of a tree without ignore files.

    type and reason null: neither scanned nor reported.
    """
    reason = F.coalesce(folder_reason(F.col("path"), F.lit(True)), F.when(config_ignored(F.col("path"), ignore), "config-ignore"))
    return paths.select("path", F.when(reason.isNull(), type_of(F.col("path"))).alias("type"), reason.alias("reason"))


def ancestors(path: Column) -> Column:
    """The folders above a path from the root ("") down."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def gitignored(paths: DataFrame, rules: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """path, is_dir -> path, is_dir, ignored, by ignore files given as a table (dir, position, regex, negated, dirs_only).

    Each path and each folder above it is matched against the rules of the folders above that; the last one that
    matches decides (the deepest folder, then the latest position), and a path is ignored if it or a folder above is.
    Rules up to limit bytes are broadcast, and paths are then shuffled once; rules are counted, so they should be cut() or cheap.
    """
    # one key of both: a constant is_dir would be taken out of the partitioning, and each step would shuffle again
    # (a number of parts, since paths are small before they are exploded: by their size they would all be put into a few tasks)
    n = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    p = paths.select(F.struct("path", "is_dir").alias("p")).repartition(n, "p").distinct()
    path = F.col("p.path")
    each = p.select("p", F.explode(F.array_append(F.filter(ancestors(path), lambda a: a != ""), path)).alias("candidate"))
    each = each.withColumn("as_dir", F.col("p.is_dir") | (F.col("candidate") != path))
    hosts = each.select("*", F.explode(ancestors(F.col("candidate"))).alias("dir"))
    r = sized(rules.select(F.col("dir").alias("r_dir"), "position", "regex", "negated", "dirs_only"), limit)
    rel = F.when(F.col("dir") == "", F.col("candidate")).otherwise(F.expr("substring(candidate, length(dir) + 2)"))
    # a left join keeps paths without a rule, which then needn't be joined to the verdicts
    hit = hosts.join(r, (F.col("dir") == F.col("r_dir")) & (F.col("as_dir") | ~F.col("dirs_only")) & F.rlike(rel, F.col("regex")), "left")
    place = F.length("dir").cast("long") * (1 << 32) + F.col("position")
    verdict = hit.groupBy("p", "candidate").agg(F.max_by(~F.col("negated"), place).alias("v"))
    return verdict.groupBy("p").agg(F.coalesce(F.bool_or("v"), F.lit(False)).alias("ignored")).select("p.path", "p.is_dir", "ignored")


def nearest(files: DataFrame, modules: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """files with go_version of the nearest module file above them (dir, version); the nearest decides even without a version.

    modules are counted (sized()), so they should be cut() or cheap.
    """
    above = files.select("path", F.explode(ancestors(F.col("path"))).alias("dir"))
    m = sized(modules.select("dir", "version"), limit)
    best = above.join(m, "dir").groupBy("path").agg(F.max_by(F.struct("version"), F.length("dir")).alias("v"))
    parts = F.regexp_extract(F.col("v.version"), r"^(\d+)\.(\d+)", 1), F.regexp_extract(F.col("v.version"), r"^(\d+)\.(\d+)", 2)
    version = F.when(parts[1] != "", F.struct(parts[0].cast("int").alias("major"), parts[1].cast("int").alias("minor")))
    return files.join(best.select("path", version.alias("go_version")), "path", "left")


def go_directive(text: Column) -> Column:
    """The version that a module file asks for, by its first go line; null without one."""
    v = F.regexp_extract(text, r"(?m)^[ \t]*go[ \t]+(\S+)", 1)
    return F.when(v != "", v)
