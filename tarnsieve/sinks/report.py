"""Reports of a scan as documents. Findings are made into lines or structs by executors; a document's frame is made here."""

from __future__ import annotations

import html
import json
from collections.abc import Iterator

from pyspark.sql import functions as F

from tarnsieve.operators import scoring
from tarnsieve.operators.findings import ordered
from tarnsieve.plans.engine import Report
from tarnsieve.rules.base import CATALOGUE
from tarnsieve.sinks import formats

_SARIF = "https://" + "/".join(("json.schemastore.org", "sarif-2.1.0.json"))
ANALYSIS_ID, SUMMARY_ID = "tarnsieve.analysis.v1", "tarnsieve.summary.v1"
FORMATS = tuple("github html json markdown md sarif summary-json text".split())


def _stream(df, column: str) -> Iterator:
    """Rows of one column in order, a partition at a time on the driver."""
    for row in df.toLocalIterator():
        yield row[column]


def _diagnostics(r: Report) -> list[dict]:
    return [{k: v for k, v in d.asDict().items() if v is not None} for d in r.diagnostics.orderBy("file", "line", "stage", "message").collect()]


def document(r: Report, findings: bool = True) -> dict:
    """The report as one value; with findings it holds them all, so it is for scans that a person reads."""
    doc = {
        "schemaVersion": ANALYSIS_ID,
        "summary": {"filesScanned": r.files, "filesSkipped": len(r.skipped), "findings": sum(r.counts.values()), "countsBySeverity": r.counts, "exitCode": r.exit_code},
        "score": r.score, "baseline": r.baseline, "diff": r.diff, "diagnostics": _diagnostics(r),
    }
    if findings:
        doc["findings"] = [json.loads(x) for x in _stream(ordered(r.displayed).select(finding_json().alias("j")), "j")]
        doc["rules"], doc["paths"] = r.rules, {"inputs": r.inputs, "skipped": [{"path": p, "reason": why} for p, why in r.skipped], "missing": r.missing}
    return doc


def finding_json():
    """A finding as JSON, without what is empty."""
    positive = lambda c: F.when(F.col(c) > 0, F.col(c))
    location = F.when(F.coalesce("line", F.lit(0)) > 0, F.struct(F.col("line"), positive("col").alias("column"), positive("end_line").alias("endLine")))
    full = lambda c: F.when(F.size(c) > 0, F.col(c))
    return F.to_json(F.struct(F.col("rule_id").alias("ruleId"), "message", "file", location.alias("location"), F.when(F.col("symbol") != "", F.col("symbol")).alias("symbol"), "severity", "confidence", "pillar", full("secondary_pillars").alias("secondaryPillars"), "remediation", full("metadata").alias("metadata"), full("underlying").alias("underlyingFingerprints"), "fingerprint"))


def write_table(r: Report, path: str) -> None:
    """All findings as a folder of JSON lines, written by executors: the form for large scans."""
    r.displayed.select(finding_json().alias("value")).write.text(path)


def as_json(r: Report, findings: bool = True) -> str:
    return json.dumps(document(r, findings), indent=2, ensure_ascii=False) + "\n"


def as_text(r: Report) -> str:
    out = [f"score: {r.score['composite']} / 100 ({r.score['grade']})", f"files: {r.files} scanned, {len(r.skipped)} skipped ({sum(w == 'gitignored' for _, w in r.skipped)} by ignore files)", "findings: " + ", ".join(f"{r.counts.get(s, 0)} {s}" for s in ("error", "warning", "advisory"))]
    out += [f"{d.get('file', '')}:{d.get('line', 0)}:{d.get('col', 0)} [{d['stage']}] {d['message']}" for d in _diagnostics(r)]
    out += _stream(ordered(r.displayed).select(formats.text_line().alias("t")), "t")
    return "\n".join([*out, f"exit: {r.exit_code}", ""])


def as_github(r: Report) -> str:
    return "".join(f"{x}\n" for x in _stream(ordered(r.displayed).select(formats.annotation().alias("t")), "t"))


def as_sarif(r: Report) -> str:
    rules = [{"id": i, "name": CATALOGUE[i].title, "shortDescription": {"text": CATALOGUE[i].title}, "help": {"text": CATALOGUE[i].remediation}, "properties": {"pillar": CATALOGUE[i].pillar, "tags": list(CATALOGUE[i].tags)}} for i in r.rules]
    index = r.findings.sparkSession.createDataFrame([(x, i) for i, x in enumerate(r.rules)], "rule_id string, rule_index int")
    results = [json.loads(x) for x in _stream(formats.sarif_results(ordered(r.displayed), index).select(F.to_json("result").alias("j")), "j")]
    return json.dumps({"$schema": _SARIF, "version": "2.1.0", "runs": [{"results": results, "tool": {"driver": {"name": "tarnsieve", "rules": rules}}}]}, indent=2, ensure_ascii=False) + "\n"


def pillars(r: Report) -> list[dict]:
    """The ten pillars of the summary, those with most findings first."""
    return [x.asDict() for x in scoring.pillar_summary(r.findings).orderBy(F.desc("findings"), "pillar").collect()]


def duration(seconds: float) -> str:
    """A scan's time in plain signs: <1ms, 245ms, 3.4s, 2m 5.0s."""
    if seconds < 0.001:
        return "<1ms"
    if seconds < 1:
        return f"{int(seconds * 1000)}ms"
    return f"{seconds:.1f}s" if seconds < 60 else f"{int(seconds // 60)}m {seconds % 60:.1f}s"


def as_rules_json(rules) -> str:
    """The catalogue as configured."""
    names = {"enabled": "defaultEnabled", "secondary_pillars": "secondaryPillars"}
    rows = [{names.get(k, k): v for k, v in r.asDict().items() if v not in ([], {}, "")} for r in rules]
    return json.dumps({"schemaVersion": ANALYSIS_ID, "rules": rows}, indent=2, ensure_ascii=False)


def as_summary(r: Report, top: int = 10, paths: list[str] | None = None) -> str:
    rows = pillars(r)
    width = max(len(x["pillar"]) for x in rows)
    out = [f"score: {r.score['composite']} / 100  grade: {r.score['grade']}", f"score coverage: {', '.join(r.score['contributing_pillars']) or 'none'}"]
    out += [f"score caveat: {r.score['caveat']}"] * bool(r.score["caveat"])
    out += ["severity:", *(f"  {s:<8} {r.counts.get(s, 0)}" for s in ("error", "warning", "advisory")), "pillars:"]
    out += [f"  {x['pillar']:<{width}} {x['grade']} {x['score']:6.2f} findings={x['findings']} advisory={x['advisory']} warning={x['warning']} error={x['error']}" for x in rows]
    out += ["top rules:", *(f"  {x.n:4d}  {x.rule_id}" for x in scoring.top_rules(r.displayed, top).collect())]
    out += ["top offenders:", *(f"  {x['file']}  penalty={x['penalty']}  findings={x['findings']}  grade={x['grade']}" for x in r.score["offenders"][:top])]
    if sum(r.counts.values()) and r.baseline is None:
        inputs = " ".join(paths or ["."])
        out += [f"fresh start: python -m tarnsieve analyse --generate-baseline tarnsieve-baseline.json {inputs}", f"then scan with: python -m tarnsieve analyse --baseline tarnsieve-baseline.json {inputs}"]
    return "\n".join([*out, f"duration: {duration(r.seconds)}", f"exit: {r.exit_code}", ""])


def as_summary_json(r: Report) -> str:
    return json.dumps({"schemaVersion": SUMMARY_ID, "pillars": pillars(r)}, indent=2) + "\n"


def _cell(x) -> str:
    return str(x).replace("|", "\\|").replace("\n", " ")


def as_markdown(r: Report) -> str:
    shown = {x.severity: x.n for x in scoring.severity_counts(r.displayed).collect()}
    out = ["# Code quality", "", f"Score {r.score['composite']} / 100, grade {r.score['grade']}.", "", "| " + " | ".join(f"{s}: {shown[s]}" for s in ("error", "warning", "advisory")) + " |", "", "| severity | rule | file | line | symbol | message | fingerprint |", "|" + "---|" * 7]
    row = F.struct("severity", "rule_id", "file", F.coalesce("line", F.lit(0)).alias("line"), "symbol", "message", "fingerprint")
    out += ["| " + " | ".join(map(_cell, x)) + " |" for x in _stream(ordered(r.displayed).select(row.alias("r")), "r")]
    out += ["", "Most frequent:", "", *(f"- {x.rule_id}: {x.n}" for x in scoring.top_rules(r.displayed, 5).collect()), ""]
    return "\n".join(out)


_STYLE = "body{font:14px sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:.2em .5em;text-align:left}.error{color:#a00}.warning{color:#a60}"
_FILTER = "<input id=q placeholder=filter><script>q.oninput=()=>document.querySelectorAll('#f tr').forEach(r=>r.hidden=!r.textContent.includes(q.value))</script>"
EDITORS = {"none": None, "vscode": "vscode://file/{path}:{line}", "phpstorm": "phpstorm://open?file={path}&line={line}"}


def as_html(r: Report, interactive: bool = False, editor: str = "none", root: str = "") -> str:
    """One page without anything from elsewhere; everything that comes from the scan is escaped."""
    e = lambda x: html.escape(str(x))
    table = lambda head, rows, id="": f"<table id='{id}'><thead><tr>{''.join(f'<th>{e(h)}</th>' for h in head)}</tr></thead><tbody>{''.join(rows)}</tbody></table>"
    cells = lambda xs: "<tr>" + "".join(f"<td>{e(x)}</td>" for x in xs) + "</tr>"

    def finding(x) -> str:
        at = f"{e(x['file'])}:{x['line']}"
        if link := EDITORS[editor]:
            at = f"<a href='{e(link.format(path=f'{root}/{x['file']}' if root else x['file'], line=x['line']))}'>{at}</a>"
        return f"<tr class='{e(x['severity'])}'><td>{e(x['severity'])}</td><td>{e(x['rule_id'])}</td><td>{at}</td><td>{e(x['message'])}</td></tr>"

    shown = {x.severity: x.n for x in scoring.severity_counts(r.displayed).collect()}
    rows = (finding(x) for x in _stream(ordered(r.displayed).select(F.struct("severity", "rule_id", "file", F.coalesce("line", F.lit(0)).alias("line"), "message").alias("r")), "r"))
    parts = [
        f"<h1>Score {e(r.score['composite'])} / 100, {e(r.score['grade'])}</h1><p>{r.files} files, {len(r.skipped)} skipped, exit {r.exit_code}</p>",
        table(["error", "warning", "advisory"], [cells([shown[s] for s in ("error", "warning", "advisory")])]),
        table(["stage", "file", "message"], [cells([d["stage"], d.get("file", ""), d["message"]]) for d in _diagnostics(r)]) if r.diagnostics.limit(1).count() else "",
        "<h2>Pillars</h2>" + table(["pillar", "grade", "score", "findings"], [cells([x["pillar"], x["grade"], x["score"], x["findings"]]) for x in pillars(r)]),
        "<h2>Files</h2>" + table(["file", "penalty", "findings", "grade"], [cells([x["file"], x["penalty"], x["findings"], x["grade"]]) for x in r.score["offenders"]]),
        "<h2>Complexity</h2>" + table(["bin", "findings"], [cells(x) for x in r.score["histogram"].items()]),
        "<h2>Findings</h2>" + (_FILTER if interactive else "") + table(["severity", "rule", "place", "message"], rows, "f"),
    ]
    return f"<!doctype html><html><head><meta charset='utf-8'><title>Code quality</title><style>{_STYLE}</style></head><body>{''.join(parts)}</body></html>\n"


def render(r: Report, form: str, interactive: bool = False, editor: str = "none", root: str = "") -> str:
    if form not in FORMATS:
        raise ValueError(f"no such format: {form}")
    return {"text": as_text, "json": as_json, "summary-json": lambda x: as_json(x, False), "sarif": as_sarif, "github": as_github, "markdown": as_markdown, "md": as_markdown, "html": lambda x: as_html(x, interactive, editor, root)}[form](r)
