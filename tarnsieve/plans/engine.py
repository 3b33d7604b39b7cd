"""The scan of a project from discovery to the report's relations."""

from __future__ import annotations

import os
import time
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnsieve import schema
from tarnsieve.config import Config
from tarnsieve.functions.paths import path_regex
from tarnsieve.operators import composites, findings as fnd, packages, scoring, secrets, suppression
from tarnsieve.plans import parse
from tarnsieve.rules.base import CATALOGUE
from tarnsieve.shared import cut as persist
from tarnsieve.sources import baselines, patches, storage, tree


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def analyse_files(files: DataFrame, config: Config | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """files (path, type, text[, go_version]) -> findings (schema.FINDINGS), diagnostics (schema.DIAGNOSTICS), parsed files.

    Each file is parsed once. Rules that aren't active have no part in the plan.
    """
    config = config or Config()
    spark = files.sparkSession
    active = config.active()
    options = {r: config.options(r) for r in active}
    units = {r: o for r, o in options.items() if o.rule.kind == "unit"}
    # plain text is for the one unit rule that reads it
    parsed = persist(parse.parsed(files, units))
    facts = parsed.where("package is not null")
    raw = [parse.raw_findings(parsed)]
    wanted = {r.removeprefix("sensitive-data.") for r in active if CATALOGUE[r].kind == "lines"}
    if wanted:
        shown = reduce(lambda a, b: a | b, (F.col("path").rlike(path_regex(p)) for p in config.secret_previews)) if config.secret_previews else None
        fine = files.join(parsed.where("error is not null").select("path"), "path", "left_anti")
        raw.append(secrets.scan(fine, wanted, shown))
    if packages.COMMENT.id in active:
        raw.append(packages.package_comments(facts))
    if packages.UNDERSCORE.id in active:
        raw.append(packages.package_underscores(facts))
    if packages.UNUSED.id in active:
        raw.append(packages.unused_functions(facts))
    if packages.RECEIVER.id in active:
        o = options[packages.RECEIVER.id]
        raw.append(packages.receivers(facts, o["allowMixed"], o["inspectGroup"]))
    rubric = options.get("docs.comment-rubric")
    if rubric and rubric["requirePackageSummary"]:
        match = lambda ps: reduce(lambda a, b: a | b, (F.col("path").rlike(path_regex(p)) for p in ps)) if ps else None
        inside, outside = match(rubric["includePaths"]), match(rubric["excludePaths"])
        applies = (inside if inside is not None else F.lit(True)) & (~outside if outside is not None else F.lit(True)) & (~F.col("is_test") if rubric["ignoreTests"] else F.lit(True))
        raw.append(packages.package_summaries(facts, applies, rubric.threshold("minPackageCommentLines")))
    rules = fnd.definitions(spark, (CATALOGUE[r] for r in active), config.severities)
    base = persist(fnd.enrich(_union(raw), rules))
    more = []
    if composites.GOD.id in active:
        more.append(composites.god_functions(base))
    if composites.HOTSPOT.id in active:
        o = options[composites.HOTSPOT.id]
        more.append(composites.hotspots(base, o.threshold("minFindings"), o.threshold("minPillars")))
    findings = base.unionByName(fnd.enrich(_union(more), rules)) if more else base
    wrong = parsed.where("error is not null").select("path", F.explode("errors").alias("e"))
    diagnostics = wrong.select(F.lit("parse").alias("stage"), F.col("e.message").alias("message"), F.col("path").alias("file"), F.col("e.line").alias("line"), F.col("e.col").alias("col"), F.lit("error").alias("severity"))
    return findings, diagnostics, parsed


@dataclass
class Report:
    """The relations of one scan. Aggregates are of all findings that baseline and diff left; displayed is what sinks list."""

    findings: DataFrame
    displayed: DataFrame
    diagnostics: DataFrame
    files: int
    skipped: list[tuple[str, str]]
    missing: list[str]
    exit_code: int
    rules: list[str]
    inputs: list[str]
    counts: dict[str, int] = field(default_factory=dict)
    score: dict = field(default_factory=dict)
    baseline: dict | None = None
    diff: dict | None = None
    seconds: float = 0.0


class Engine:
    def __init__(self, spark: SparkSession, root: str = ".", config: Config | None = None):
        self.spark, self.root, self.config = spark, os.path.abspath(root), config or Config()

    def analyse(self, inputs: list[str] | None = None, *, baseline: str | None = None, diff: str | None = None, fail_on: str | None = None, command: str = "analyse", include_ignored: bool = False, display: dict | None = None) -> Report:
        """Discovery, parsing, rules, baseline, changed lines, scores, gate, display filter, in this order."""
        began = time.monotonic()
        for kind, known in (("rules", CATALOGUE), ("without_rules", CATALOGUE)):
            for r in (display or {}).get(kind, ()):
                if r not in known:
                    raise ValueError(f"no such rule: {r}")
        found = tree.discover(self.root, inputs, self.config.ignore, include_ignored)
        files = tree.read(self.spark, found)
        files = tree.nearest(files, self._modules(found))
        findings, diagnostics, _ = analyse_files(files, self.config)
        extra = [("source", f"no such path: {m}", m, None, None, "error") for m in found.missing]
        said_baseline = said_diff = None
        if baseline:
            try:
                entries = baselines.load(self.spark, baseline)
            except (OSError, baselines.BaselineError) as e:
                extra.append(("baseline", str(e), baseline, None, None, "error"))
            else:
                said_baseline = suppression.baseline_counts(findings, entries).first().asDict()
                findings = suppression.kept(findings, entries)
        if diff:
            ranges, changed = patches.changed(self.spark, patches.from_git(self.root, diff, inputs))
            before = findings.count()
            findings = persist(suppression.without_orphans(suppression.on_changed_lines(findings, ranges, changed)))
            said_diff = {"base": diff, "filtered": before - findings.count(), "files": [r.file for r in changed.orderBy("file").collect()]}
        if extra:
            diagnostics = diagnostics.unionByName(self.spark.createDataFrame(extra, schema.DIAGNOSTICS))
        findings = persist(findings)
        details = scoring.pillar_details(findings)
        score = scoring.composite(details).first().asDict()
        score |= {"pillars": [r.asDict() for r in details.orderBy("pillar").collect()], "offenders": [r.asDict() for r in scoring.top_offenders(findings).collect()], "histogram": {r.bin: r.n for r in scoring.histogram(findings).collect()}}
        code = scoring.exit_code(findings, diagnostics.limit(1).count(), fail_on or self.config.fail_on(command)).first()[0]
        shown = scoring.displayed(findings, **(display or {}))
        counts = {r.severity: r.n for r in scoring.severity_counts(findings).collect()}
        return Report(findings, shown, diagnostics, len(found.files), sorted(found.skipped), sorted(found.missing), code, sorted(self.config.active()), inputs or ["."], counts, score, said_baseline, said_diff, time.monotonic() - began)

    def stored(self, uri: str, include_ignored: bool = False) -> dict[str, DataFrame]:
        """findings, diagnostics, files and skipped of a tree on storage that all executors reach, as tables: nothing is walked or gathered here."""
        files, skipped = storage.discover(self.spark, uri, self.config.ignore, include_ignored)
        files = persist(files)
        findings, diagnostics, _ = analyse_files(files, self.config)
        return {"findings": findings, "diagnostics": diagnostics, "files": files.select("path", "type"), "skipped": skipped}

    def _modules(self, found: tree.Found) -> DataFrame:
        """Versions of module files in the folders of Go files and above, up to the root."""
        folders = {""}
        for path in found.files:
            parts = path.split("/")[:-1]
            folders |= {"/".join(parts[:i]) for i in range(len(parts) + 1)}
        rows = []
        for folder in sorted(folders):
            try:
                with open(os.path.join(self.root, folder, "go.mod"), encoding="utf-8", errors="replace") as f:
                    words = next((w for w in (line.split() for line in f) if len(w) > 1 and w[0] == "go"), None)
                rows.append((folder, words[1] if words else None))
            except OSError:
                pass
        return self.spark.createDataFrame(rows, "dir string, version string")

    def write_baseline(self, path: str, inputs: list[str] | None = None) -> int:
        """Writes the findings as reviewed; refuses while files can't be parsed."""
        report = self.analyse(inputs)
        if report.diagnostics.limit(1).count():
            raise RuntimeError("there are diagnostics; a baseline needs a clean scan")
        return baselines.write(report.findings, path)

    def rules(self) -> DataFrame:
        """The catalogue as configured."""
        active = self.config.active()
        rows = [(r.id, r.pillar, self.config.severities.get(r.id, r.severity), r.confidence, r.title, r.id in active, {k: float(v) for k, v in r.thresholds.items()}, list(r.tags), r.capability, list(r.secondary), r.remediation) for r in sorted(CATALOGUE.values(), key=lambda r: r.id)]
        return self.spark.createDataFrame(rows, "id string, pillar string, severity string, confidence string, title string, enabled boolean, thresholds map<string,double>, tags array<string>, capability string, secondary_pillars array<string>, remediation string")


