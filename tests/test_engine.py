import json
import subprocess

import pytest

from tarnsieve import config as cfg
from tarnsieve import serve
from tarnsieve.__main__ import main
from tarnsieve.plans.engine import Engine
from tarnsieve.sinks import report as sinks
from tarnsieve.sources import baselines, storage, tree
from tarnsieve.sources.tree import discover, generated_go, ignore_rules

HOT = "package spot\n\n\nfunc Hot(a, b bool) int {\n\tif a {\n\t\treturn 1\n\t}\n\tif b {\n\t\treturn 2\n\t}\n\treturn 3\n}\n"
SECRET = "AKIA" + "Z9" * 8


@pytest.fixture
def project(tmp_path):
    def put(name, text):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)

    put("hot.go", "// Package spot is.\n" + HOT[: len("package spot\n")] + HOT[len("package spot\n\n") :])
    put("bad/x.go", "package")
    put("gen/x.go", "// Code generated by y. DO NOT EDIT.\npackage gen\n")
    put("vendor/v.go", "package v\n")
    put("conf.env", f"key {SECRET}\n")
    put("note.md", "nothing\n")
    put("old/go.mod", "module x\n\ngo 1.20\n")
    put(".tarnsieve.yaml", "rules:\n  size.function-length:\n    threshold: 4\n  complexity.cyclomatic:\n    threshold: 2\n")
    return tmp_path


def test_scan(spark, project):
    r = Engine(spark, str(project), cfg.load_auto(str(project))).analyse()
    assert r.files == 4 and ("gen/x.go", "generated") in r.skipped and ("vendor", "dependency") in r.skipped
    ids = {x.rule_id for x in r.findings.collect()}
    assert ids == set("size.function-length complexity.cyclomatic sensitive-data.aws-access-key design.hotspot-file docs.exported-symbol-comment design.god-function".split())
    assert r.exit_code == 2 and [x.file for x in r.diagnostics.collect()] == ["bad/x.go"]
    assert r.score["histogram"]["1-5"] == 1 and r.score["offenders"][0]["file"] == "conf.env"
    for form in sinks.FORMATS:
        out = sinks.render(r, form)
        assert SECRET not in out and out.endswith("\n")
    assert "AKIAZ9...Z9Z9" in sinks.render(r, "json")
    doc = json.loads(sinks.render(r, "json"))
    assert [f["file"] for f in doc["findings"]] == sorted(f["file"] for f in doc["findings"])
    sarif = json.loads(sinks.render(r, "sarif"))["runs"][0]
    assert all(sarif["tool"]["driver"]["rules"][x["ruleIndex"]]["id"] == x["ruleId"] for x in sarif["results"])
    assert "findings" not in json.loads(sinks.render(r, "summary-json"))
    assert "top rules:" in sinks.as_summary(r) and len(json.loads(sinks.as_summary_json(r))["pillars"]) == 10


def test_baseline_display_and_gate(spark, project, capsys):
    (project / "bad/x.go").unlink()
    root = ["--root", str(project)]
    assert main(["analyse", *root], spark) == 1
    assert main(["analyse", *root, "--fail-on", "none"], spark) == 0
    out = str(project / "b.txt")
    assert main(["baseline", *root, "--out", out], spark) == 0
    assert main(["analyse", *root, "--baseline", out], spark) == 0
    engine = Engine(spark, str(project), cfg.load_auto(str(project)))
    r = engine.analyse(baseline=out)
    assert r.findings.count() == 0 and r.baseline["stale"] == 0 and r.baseline["suppressed"] == r.baseline["entries"] == 6
    shown = engine.analyse(display={"pillars": ["size"]})
    assert shown.displayed.count() == 1 and shown.findings.count() == 6 and shown.exit_code == 1
    assert main(["analyse", *root, "--rules", "no.rule"], spark) == 2
    assert main(["analyse", *root, "missing.go"], spark) == 2
    capsys.readouterr()
    assert main(["list-rules", *root], spark) == 0 and len(capsys.readouterr().out.splitlines()) == 64


def test_diff(spark, project):
    git = lambda *a: subprocess.run(["git", "-C", str(project), "-c", "user.name=x", "-c", "user.email=x@x", *a], check=True, capture_output=True)
    (project / "bad/x.go").unlink()
    git("init", "-q")
    git("add", "-A")
    git("commit", "-qm", "x")
    (project / "conf.env").write_text(f"key {SECRET}\nmore {SECRET[::-1]}AKIA{'B' * 16}\n")
    r = Engine(spark, str(project), cfg.load_auto(str(project))).analyse(diff="HEAD")
    assert [(x.file, x.line) for x in r.findings.collect()] == [("conf.env", 2)] and r.diff["files"] == ["conf.env"]


def test_baseline_files_are_strict():
    good = {"schemaVersion": baselines.SCHEMA_ID, "findings": [{"ruleId": "a", "file": "b", "fingerprint": "c"}]}
    assert baselines.parse(json.dumps(good)) == [("a", "b", "c")]
    for bad in ({**good, "schemaVersion": "x"}, {**good, "more": 1}, {**good, "findings": [{"ruleId": "a", "file": "", "fingerprint": "c"}]}, {**good, "findings": [{"ruleId": "a", "file": "b", "fingerprint": "c", "x": 1}]}, [1]):
        with pytest.raises(baselines.BaselineError):
            baselines.parse(json.dumps(bad))


def test_discovery(tmp_path):
    for name in ("a.go", "b.log", "keep.log", "sub/b.go", "sub/c.tmp.json", "out/x.go", "build/y.go", ".env.x", "x/.github/z.go", "in/deep/k.txt"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("x")
    (tmp_path / ".gitignore").write_text("*.log\n!keep.log\nout/\n[bad\n")
    (tmp_path / "sub/.gitignore").write_text("*.tmp.json\n")
    f = discover(str(tmp_path), ["."], ["in/**"])
    assert sorted(f.files) == [".env.x", "a.go", "build/y.go", "sub/b.go"]
    assert {("out", "gitignored"), ("b.log", "gitignored"), ("sub/c.tmp.json", "gitignored"), ("in", "config-ignore"), ("x/.github", "non-application-metadata"), (".gitignore", "gitignore-parse-error")} <= f.skipped
    everything = discover(str(tmp_path), [".", "nowhere"], ["in/**"], True)
    assert "out/x.go" in everything.files and everything.missing == {"nowhere"} and ("in", "config-ignore") in everything.skipped


@pytest.mark.parametrize("text, path, is_dir, ignored", [
    ("a", "x/a", False, True), ("/a", "x/a", False, False), ("a/b", "x/a/b", False, False), ("**/b", "x/a/b", False, True), ("a/**", "a/x/y", False, True), ("a/**", "a", True, False),
    ("a/**/z", "a/z", False, True), ("a/", "a", False, False), ("a/", "a", True, True), ("a\nb\n!a", "a", False, False), ("\\!a", "!a", False, True), ("\\#a", "#a", False, True), ("# c", "# c", False, False),
    ("a ", "a", False, True), ("a\\ ", "a ", False, True), ("[a-c].x", "b.x", False, True), ("[^a].x", "a.x", False, False), ("?.x", "a.x", False, True), ("a*", "x/abc", False, True),
])
def test_ignore_rules(tmp_path, text, path, is_dir, ignored):
    (tmp_path / ".gitignore").write_text(text)
    assert tree.Walk(str(tmp_path), [], False).verdict(path, is_dir) is ignored
    assert ignore_rules(text)[1] is False


def test_generated():
    assert generated_go("// Code generated by x. DO NOT EDIT.\npackage p\n") and not generated_go("package p\n// code generated do not edit\n") and not generated_go("x\n")


def test_config():
    text = """
schemaVersion: tarnsieve.config.v1  # ours
paths:
  ignore:
    - "gen/**"
rules:
  size.file-length: {}
  complexity.cyclomatic:
    threshold: 9
    severity: error
  documentation.package-comment:
    enabled: false
selection:
  pillars: [complexity, size, documentation]
  excludeRules: [complexity.npath]
minimumSeverity:
  analyse: error
"""
    c = cfg.from_dict(cfg.parse_yaml(text))
    assert c.ignore == ["gen/**"] and c.options("complexity.cyclomatic").threshold("maxComplexity") == 9 and c.fail_on("analyse") == "error" and c.fail_on("report") == "none"
    active = c.active()
    assert "docs.package-comment" not in active and "complexity.npath" not in active and "size.file-length" in active and "security.weak-crypto" not in active
    again = cfg.from_dict(cfg.parse_yaml(cfg.render(c)))
    assert again.active() == active and again.severities["complexity.cyclomatic"] == "error"


@pytest.mark.parametrize("text", [
    "rules:\n  no.rule: {}", "rules:\n  size.file-length:\n    threshold: 0", "rules:\n  naming.contextual-generic:\n    threshold: 3", "rules:\n  size.file-length:\n    options:\n      x: 1",
    "selection:\n  pillars: [nope]", "more: 1", "paths:\n  ignore: [/abs]", "paths:\n  ignore: [\"a/**/b\"]", "minimumSeverity:\n  analyse: huge", "schemaVersion: other", "a: 1\na: 2", "- x", "a:\n\t- b",
])
def test_config_fails_closed(text):
    with pytest.raises(cfg.ConfigError):
        cfg.from_dict(cfg.parse_yaml(text))


def test_stream(spark, tmp_path):
    from tarnsieve.streaming.watch import arriving, watch

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.go").write_text("package a\n\nfunc f() { return; g() }\n")
    for _ in range(2):
        watch(arriving(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.where("rule_id = 'dead-code.unreachable-code'").count() == 1


def test_generated_header_of_any_length(tmp_path):
    long = "// license\n" * 20_000 + "// Code generated by y. DO NOT EDIT.\npackage gen\n"
    (tmp_path / "a.go").write_text(long)
    (tmp_path / "b.go").write_text("// license\n" * 20_000 + "package gen\n// Code generated by y. DO NOT EDIT.\n")
    found = discover(str(tmp_path))
    assert ("a.go", "generated") in found.skipped and set(found.files) == {"b.go"}


@pytest.mark.parametrize("include", [False, True])
@pytest.mark.parametrize("root_ignore", ["*.log\n!keep.log\nout/\n/only.txt\n[\n", None])
def test_discovery_by_executors(spark, tmp_path, root_ignore, include):
    """The tables hold what the walk finds; skipped files are told one by one."""
    names = "a.go b.log keep.log only.txt sub/only.txt out/x.go sub/c.tmp.json sub/b.go vendor/v.go vendor/.gitignore build/y.yaml .git/config .github/w.yml x/.claude/y.json .env.local note.md in/z.go gen.go deep/er/q.toml sub/go.mod".split()
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_text({"gen.go": "// Code generated. DO NOT EDIT.\npackage g\n", "sub/go.mod": "module m\ngo 1.21.3\n", "vendor/.gitignore": "*.tmp\n"}.get(n, "package p\n" if n.endswith(".go") else "x"))
    (tmp_path / "sub/.gitignore").write_text("*.tmp.json\n")
    if root_ignore:
        (tmp_path / ".gitignore").write_text(root_ignore)
    want = discover(str(tmp_path), ignore=["in/**"], include_ignored=include)
    files, skipped = storage.discover(spark, str(tmp_path), ["in/**"], include)
    got = {r.path: r for r in files.collect()}
    # the walk doesn't enter .git either way; with everything included both do
    assert {p: k for p, (_, k) in want.files.items()} == {p: r.type for p, r in got.items()}
    assert got["sub/b.go"].go_version.minor == 21 and got["a.go"].go_version is None and got["a.go"].text == "package p\n"
    reasons = {r.path: r.reason for r in skipped.collect()}
    for path, why in want.skipped:
        assert any((p == path or p.startswith(path + "/")) and w == why for p, w in reasons.items()), (path, why)
    assert not set(reasons) & set(got)


def test_a_stored_tree(spark, project):
    r = Engine(spark, str(project), cfg.load_auto(str(project)))
    stored, walked = r.stored("file://" + str(project)), r.analyse()
    key = lambda d: sorted((x.file, x.rule_id, x.fingerprint) for x in d.collect())
    assert key(stored["findings"]) == key(walked.findings) and stored["files"].count() == walked.files
    assert [x.file for x in stored["diagnostics"].collect()] == ["bad/x.go"]


def test_flat_configuration_and_aliases():
    c = cfg.from_dict({"select": ["size-file-length", "documentation-package-comment"], "selection": {"rules": ["docs.package-comment"], "tiers": ["x"]}, "excludeRules": ["naming-get-prefix"], "ignorePaths": ["b/**"], "paths": {"ignore": ["a/**", "b/**"]}, "acceptedAbbreviations": ["id"], "sensitiveData": {"previewAllowlist": ["c/**"]}, "allowlists": {"secretPreviews": ["d/**"]}, "minimumGoVersion": 1.22})
    assert c.select == ["docs.package-comment", "size.file-length", "docs.package-comment"] or set(c.select) == {"docs.package-comment", "size.file-length"}
    assert c.ignore == ["a/**", "b/**"] and c.secret_previews == ["c/**", "d/**"] and c.exclude_rules == ["naming.get-prefix"] and c.abbreviations == ["id"] and c.go_version == "1.22"
    assert c.active() == {"docs.package-comment", "size.file-length"}
    for bad in ({"select": ["no-rule"]}, {"minimumGoVersion": "go1"}, {"sensitiveData": {"x": 1}}, {"selection": {"tiers": [1]}}):
        with pytest.raises(cfg.ConfigError):
            cfg.from_dict(bad)


def test_catalogue_is_validated():
    from tarnsieve.rules.base import CATALOGUE, Rule, add, valid

    assert all(valid(r) is r for r in CATALOGUE.values())
    for wrong in (Rule("Bad", "t", "size"), Rule("a.b", "", "size"), Rule("a.b", "t", "sizes"), Rule("a.b", "t", "size", "bad"), Rule("a.b", "t", "size", confidence="sure"), Rule("a.b", "t", "size", secondary=("x",)), Rule("a.b", "t", "size", capability="magic"), Rule("a.b", "t", "size", thresholds={"": 1})):
        with pytest.raises(ValueError):
            add(wrong)


def test_command_line_forms(spark, project, capsys):
    (project / "bad/x.go").unlink()
    root = ["--root", str(project)]
    assert main(["list-rules", "--format", "json", *root], spark) == 0
    rules = json.loads(capsys.readouterr().out)["rules"]
    assert len(rules) == 64 and all(r["capability"] == "parser" and "defaultEnabled" in r for r in rules)
    assert main(["list-rules", *root], spark) == 0 and "\tparser\t" in capsys.readouterr().out
    out = str(project / "b.json")
    for more in (["--baseline", out], ["--diff", "HEAD"], ["--rules", "size.file-length"]):
        assert main(["analyse", *root, "--generate-baseline", out, *more], spark) == 2
    assert main(["analyse", *root, "--generate-baseline", out], spark) == 0
    assert main(["analyse", *root, "--baseline", out], spark) == 0
    capsys.readouterr()
    assert main(["summary", *root], spark) == 1 and "fresh start: " in (said := capsys.readouterr().out) and "duration: " in said
    assert main(["summary", *root, "--baseline", out], spark) == 0 and "fresh start" not in capsys.readouterr().out
    page = str(project / "r.html")
    assert main(["report", *root, "--interactive", "--editor", "vscode", "--out", page], spark) == 0
    with open(page) as f:
        text = f.read()
    assert "placeholder=filter" in text and f"vscode://file/{project}/hot.go" in text


def test_durations():
    assert [sinks.duration(x) for x in (0.0001, 0.2456, 3.44, 125.04)] == ["<1ms", "245ms", "3.4s", "2m 5.0s"]


def test_dashboard(spark, project):
    import threading
    from urllib.error import HTTPError
    from urllib.parse import urlencode
    from urllib.request import Request, urlopen

    (project / "bad/x.go").unlink()
    d = serve.Defaults(root=str(project), editor="vscode")
    s = serve.server(spark, d, port=0)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{s.server_address[1]}"

    def get(path):
        with urlopen(at + path, timeout=100) as r:
            return r.read().decode()

    try:
        form = get("/?paths=%3Cb%3E")
        assert f"value='{project}'" in form and "&lt;b&gt;" in form and "<option selected>none</option>" in form
        page = get("/scan?" + urlencode({"failOn": "error", "interactive": "1"}))
        assert "exit 1, " in page and "--fail-on error" in page and "placeholder=filter" in page and SECRET not in page and "vscode://file/" in page
        assert "exit 0, " in get("/scan")
        assert "exit 2, " in get("/scan?config=none.yaml")
        for path, method, code in (("/x", "GET", 404), ("/scan", "POST", 405), ("/", "DELETE", 405)):
            with pytest.raises(HTTPError) as e:
                urlopen(Request(at + path, method=method), timeout=20)
            assert e.value.code == code
        d.timeout = 0.001
        assert "exit 124, " in get("/scan")
    finally:
        s.shutdown()
        s.server_close()


def test_dashboard_stays_at_home(spark, project):
    assert [serve.loopback(h) for h in ("127.0.0.1", "::1", "localhost", "127.9.9.9", "0.0.0.0", "example.org")] == [True] * 4 + [False] * 2
    with pytest.raises(ValueError, match="loopback"):
        serve.server(spark, serve.Defaults(), "0.0.0.0", 0)
    assert main(["dashboard", "--host", "0.0.0.0", "--root", str(project)], spark) == 2
    s = serve.Defaults(root=str(project), diff=True, paths=["a", "b c"], baseline="b.json", include_ignored=True, fail_on="error").asked("noConfig=1&paths=x")
    assert serve.command_of(s) == f"python -m tarnsieve analyse --format html --root {project} --no-config --baseline b.json --diff HEAD --include-ignored --fail-on error x"
