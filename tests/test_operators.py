import pytest

from tarnsieve import schema
from tarnsieve.operators import composites, findings as fnd, packages, scoring, secrets, suppression
from tarnsieve.plans.parse import parsed
from tarnsieve.rules.base import CATALOGUE, name_tokens
from tarnsieve.sources import patches

GOLDEN = [
    ("complexity.cyclomatic", "complex.go", 5, 0, 50, "Risky", "function cyclomatic complexity is 22, above threshold 20", "be37c390cfcd524d"),
    ("complexity.cyclomatic", "composite.go", 4, 0, 11, "Hot", "function cyclomatic complexity is 3, above threshold 2", "d8293925f32a0f34"),
    ("size.function-length", "composite.go", 4, 0, 11, "Hot", "function has 8 code lines, above threshold 4", "6c2b61fff900ee69"),
    ("docs.exported-symbol-comment", "composite.go", 4, 0, 0, "Hot", 'exported function "Hot" has no doc comment', "470a3d967e37e18b"),
    ("design.god-function", "composite.go", None, None, None, "Hot", "function Hot combines size and complexity findings", "4a10c037e95fba2e"),
    ("design.hotspot-file", "composite.go", None, None, None, None, "file has findings across multiple quality pillars", "c8f0761928502c92"),
]


def raw(spark, rows):
    """(rule_id, message, file, line, col, end_line, symbol[, metadata[, metric]])"""
    full = [(*r[:7], *(r[7:] or ({},)), *((None,) if len(r) < 9 else ()), None) for r in rows]
    return spark.createDataFrame(full, schema.RAW)


def enriched(spark, rows):
    return fnd.enrich(raw(spark, rows), fnd.definitions(spark, CATALOGUE.values()))


def test_golden_fingerprints(spark):
    rows = enriched(spark, [(r, m, f, a, b, c, s) for r, f, a, b, c, s, m, _ in GOLDEN]).select("rule_id", "file", "fingerprint").collect()
    assert {tuple(r) for r in rows} == {(g[0], g[1], g[7]) for g in GOLDEN}


def test_fingerprint_escapes(spark):
    import hashlib

    x = enriched(spark, [("size.file-length", 'a<b>&" \x1f\u2028', "é", 1, 0, 0, "")]).first()
    text = '{"ruleId":"size.file-length","file":"é","line":1,"column":0,"endLine":0,"symbol":"","message":"a\\u003cb\\u003e\\u0026\\" \\u001f\\u2028"}'
    assert x.fingerprint == hashlib.sha256(text.encode()).hexdigest()[:16]


def test_composite_fixture_scores_94(spark):
    base = enriched(spark, [(r, m, f, a, b, c, s) for r, f, a, b, c, s, m, _ in GOLDEN[1:4]]).withColumn("confidence", fnd.F.col("confidence"))
    more = fnd.enrich(composites.god_functions(base).unionByName(composites.hotspots(base)), fnd.definitions(spark, CATALOGUE.values()))
    got = {r.rule_id: r for r in more.collect()}
    assert got["design.god-function"].fingerprint == GOLDEN[4][7] and got["design.hotspot-file"].fingerprint == GOLDEN[5][7]
    assert got["design.god-function"].underlying == sorted(g[7] for g in GOLDEN[1:3]) and got["design.hotspot-file"].metadata["primaryLine"] == "4"
    whole = base.unionByName(more)
    # the hotspot counts under maintainability, but design rules cost nothing
    row = scoring.composite(scoring.pillar_details(whole)).first()
    assert (row.composite, row.grade, row.contributing_pillars) == (94, "A", ["complexity", "documentation", "size"])


def test_nothing_found(spark):
    none = enriched(spark, [])
    assert tuple(scoring.composite(scoring.pillar_details(none)).first()) == (100, "A", [], "nothing that counts was found")
    assert {tuple(r) for r in scoring.severity_counts(none).collect()} == {("error", 0), ("warning", 0), ("advisory", 0)}
    assert scoring.exit_code(none, 0, "advisory").first()[0] == 0 and scoring.exit_code(none, 3, "none").first()[0] == 2
    assert {r.score for r in scoring.pillar_summary(none).collect()} == {100.0}


def test_tests_are_eased(spark):
    rows = [("size.file-length", "m", "a_test.go", 1, 0, 0, "", {"testFile": "true"}), ("size.file-length", "m", "a.go", 1, 0, 0, "")]
    assert {r.file: (r.severity, r.confidence) for r in enriched(spark, rows).collect()} == {"a_test.go": ("advisory", "medium"), "a.go": ("warning", "high")}
    harder = fnd.enrich(raw(spark, rows), fnd.definitions(spark, CATALOGUE.values(), {"size.file-length": "error"}))
    assert {r.severity for r in harder.collect()} == {"error"}


@pytest.mark.parametrize("severity, penalties", [("advisory", (1, 1, 1)), ("warning", (4, 6, 8)), ("error", (15, 22, 30))])
def test_penalties(spark, severity, penalties):
    df = spark.createDataFrame([(severity, c) for c in ("low", "medium", "high")], "severity string, confidence string")
    assert tuple(r[0] for r in df.select(fnd.penalty()).collect()) == penalties


def test_baseline_identities(spark):
    f = enriched(spark, [("size.file-length", f"m{i % 3}", "a.go", 1, 0, 0, "") for i in range(7)])
    b = f.where("message = 'm0'").select(*suppression.KEY).limit(1).unionByName(spark.createDataFrame([("x", "y", "z")] * 2, schema.BASELINE))
    c = suppression.baseline_counts(f, b).first()
    assert (c.entries, c.suppressed, c.kept, c.stale) == (2, 3, 4, 1)
    assert suppression.kept(f, b).count() == 4 and suppression.suppressed(f, b).count() == 3


def test_changed_lines(spark):
    patch = "diff --git a/x b/x\n--- a/a.go\n+++ b/a.go\n@@ -1 +5,2 @@\n+x\n@@ -9,2 +20,0 @@\n--- a/b.go\n+++ b/b.go\n@@ -1,3 +0,0 @@\n--- a/c.go\n+++ /dev/null\n@@ -1 +1 @@\n"
    ranges, files = patches.changed(spark, patch)
    assert [tuple(r) for r in ranges.collect()] == [("a.go", 5, 6)] and {r[0] for r in files.collect()} == {"a.go", "b.go"}
    f = enriched(spark, [("size.file-length", m, file, line, 0, end, "") for m, file, line, end in [("in", "a.go", 6, 0), ("span", "a.go", 1, 5), ("off", "a.go", 7, 9), ("none", "b.go", None, None), ("line", "b.go", 3, 0), ("gone", "c.go", None, None)]])
    assert {r.message for r in suppression.on_changed_lines(f, ranges, files).collect()} == {"in", "span", "none"}


def test_orphans(spark):
    f = enriched(spark, [("size.file-length", "m", "a.go", 1, 0, 0, "")])
    fp = f.first().fingerprint
    mark = lambda n, u: f.withColumn("message", fnd.F.lit(n)).withColumn("underlying", fnd.F.array(*[fnd.F.lit(x) for x in u]).cast("array<string>")).withColumn("fingerprint", fnd.F.lit(n))
    left = suppression.without_orphans(f.unionByName(mark("kept", [fp, "x"])).unionByName(mark("orphan", ["x"])).unionByName(mark("empty", [])))
    assert {r.message for r in left.collect()} == {"m", "kept"}


def files(spark, rows):
    return spark.createDataFrame(rows, "path string, text string")


def test_secrets_by_line(spark):
    key = "AKIA" + "A" * 16
    text = "\n".join([key, f"// {key}", f"/* {key}", key, f"*/ {key}", f"x {key} #nosec", f"{key} //nolint:gosec", f"{key} //nolint:other", f"/* a */ {key}", f"/* {key} */", f"{key} {key}"])
    got = secrets.scan(files(spark, [("a.go", text), ("null", None), ("empty", "")]), {"aws-access-key"}).collect()
    assert sorted(r.line for r in got) == [1, 5, 8, 9, 11]
    assert {r.metadata["preview"] for r in got} == {"AKIAAA...AAAA"}


def test_secrets_kinds(spark):
    local, remote = "postgres" + "://u:change_me@localhost:5432/x", "postgres" + "://u:change_me@far.example:5432/x"
    rows = [("a", local), ("b", remote), ("c", "api_" + "key: 'abcdefghij0123456789x'"), ("d", "my_api_" + "key: 'abcdefghij0123456789x'"), ("e", "// pass" + "word=abcdefghij0123456789")]
    got = {(r.file, r.rule_id.split(".")[1]) for r in secrets.scan(files(spark, rows)).collect()}
    assert got == {("b", "connection-string"), ("c", "secret-pattern"), ("e", "secret-pattern")}
    both = '{"type": "service_account",\n"k": "-----BEGIN ' + 'PRIVATE KEY-----"}'
    got = secrets.scan(files(spark, [("k.json", both), ("l.json", both.split("\n")[0])])).collect()
    assert {(r.file, r.rule_id.split(".")[1], r.line) for r in got} == {("k.json", "gcp-service-account", 1), ("k.json", "private-key", 2)}


def test_packages(spark):
    rows = [
        ("a/x.go", "package a\n\nfunc (t *T) A() {}\nfunc (t *T) B() {}\nfunc (x T) C() {}\nfunc helper() {}\nfunc used() { used() }\n"),
        ("a/y.go", "// Package a is.\npackage a\n"),
        ("b/x_test.go", "package b_test\n"),
        ("c/x.go", "package c\nimport \"reflect\"\nfunc helper() {}\nvar _ = reflect.TypeOf\n"),
        ("d_e/x.go", "package d_e\n"),
        ("bad.go", "package"),
        ("t.txt", "text"),
    ]
    facts = parsed(files(spark, rows), {})
    assert [(r.path, r.error.line) for r in facts.where("error is not null").collect()] == [("bad.go", 1)]
    facts = facts.where("package is not null")
    assert {r.file for r in packages.package_comments(facts).collect()} == {"c/x.go", "d_e/x.go"}
    assert [r.file for r in packages.package_underscores(facts).collect()] == ["d_e/x.go"]
    assert [(r.file, r.symbol) for r in packages.unused_functions(facts).collect()] == [("a/x.go", "helper")]
    assert [(r.symbol, r.message) for r in packages.receivers(facts).collect()] == [("C", 'receiver for type "T" differs from dominant convention')]
    assert [r.message for r in packages.receivers(facts, ["T"]).collect()] == ['receiver name "x" differs from dominant receiver name "t" for type "T"']
    assert packages.receivers(facts, ["T"], "pointer").count() == 0
    assert {r.file for r in packages.package_summaries(facts, fnd.F.lit(True), 1).collect()} == {"c/x.go", "d_e/x.go"}


def test_identifier_tokens_agree(spark):
    import random

    from tarnsieve.functions.text import identifier_tokens

    r = random.Random(3)
    names = ["".join(r.choice("aBcDé9_") for _ in range(r.randint(1, 12))) for _ in range(500)] + ["HTTPServer2Go", "userID", "_"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [x.t for x in df.select(identifier_tokens(fnd.F.col("n")).alias("t")).collect()] == [name_tokens(n) for n in names]


def test_hostile_files_don_t_end_a_scan(spark):
    deep = "package p\nfunc f() bool { return " + "a || " * 40_000 + "a }\n"
    rows = [("deep.go", "package p\nfunc f() { x = " + "(" * 20_000), ("chain.go", deep), ("good.go", "package p\nfunc f() { return; g() }\n")]
    facts = parsed(files(spark, rows)).collect()
    said = {r.path: r.error.message if r.error else None for r in facts}
    assert "nesting" in said["deep.go"] and said["good.go"] is None and said["chain.go"] in (None, "exceeded max nesting depth")


def test_rare_signs_in_fingerprints(spark):
    """The escapes of a strict JSON writer, in texts that hold the rare ones, the common ones, both or none."""
    import hashlib
    import json

    signs = ["plain", "<a> & b", "\u2028", "x\u2029<", "\x0b\x0e\x1f", "\x1a>&", "back\\u000B slash", '"q"', "é"]
    d = spark.createDataFrame([(s,) for s in signs], "message string").selectExpr("'r' as rule_id", "'f' as file", "1 as line", "2 as col", "3 as end_line", "'s' as symbol", "message")
    def want(s):
        text = json.dumps({"ruleId": "r", "file": "f", "line": 1, "column": 2, "endLine": 3, "symbol": "s", "message": s}, ensure_ascii=False, separators=(",", ":"))
        for c in "<>&\u2028\u2029":
            text = text.replace(c, f"\\u{ord(c):04x}")
        return hashlib.sha256(text.encode()).hexdigest()[:16]
    assert {r.message: r.fp for r in d.select("message", fnd.fingerprint().alias("fp")).collect()} == {s: want(s) for s in signs}
