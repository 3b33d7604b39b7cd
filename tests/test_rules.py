import pytest

from tarnsieve.operators import composites, packages, secrets  # noqa: F401  they fill the catalogue
from tarnsieve.plans.gotext import CONF
from tarnsieve.plans.snippets import SNIPPETS, source_of
from tarnsieve.plans.parse import default_rules, unit, unit_findings
from tarnsieve.rules.base import CATALOGUE, Options


def found(path, text, version=(1, 20), rules=None):
    return unit_findings(unit(path, text, version), rules or default_rules())


def ids(*a, **k):
    return {f["rule_id"] for f in found(*a, **k)}


def test_catalogue():
    assert len(CATALOGUE) == 64
    kinds = [r.kind for r in CATALOGUE.values()]
    assert (kinds.count("unit"), kinds.count("lines"), kinds.count("project"), kinds.count("composite")) == (45, 13, 4, 2)


@pytest.mark.parametrize("kind, imports, body, told", SNIPPETS)
def test_snippets(kind, imports, body, told):
    """Findings whole: rule, place, symbol and message."""
    rules = default_rules() | {r: Options(CATALOGUE[r], {}, o) for r, o in CONF.items()}
    out = found({"test": "s/f_test.go", "conf": "c/f.go"}.get(kind, "s/f.go"), source_of(kind, imports, body), rules=rules)
    assert sorted((f["rule_id"], f["line"], f["col"], f["symbol"], f["message"]) for f in out) == sorted(told) and all(f["end_line"] == 0 for f in out)


def only(rule, **thresholds):
    return {rule: Options(CATALOGUE[rule], thresholds)}


@pytest.mark.parametrize("body, cyclomatic, cognitive, npath, nesting", [
    ("", 1, 0, 1, 0),
    ("if a && b || c {}", 4, 3, 4, 1),
    ("if a {} else if b {} else {}", 3, 2, 3, 1),
    ("switch x { case 1: case 2: default: }", 3, 1, 3, 1),
    ("switch x { case 1: return }", 2, 1, 2, 1),
    ("select { case <-c: default: }", 3, 1, 2, 1),
    ("for i := 0; i < n && ok; i++ { if a { return } }", 4, 4, 4, 2),
    ("l: for { if a {} }", 3, 0, 3, 0),
    ("f(func() { if a {} })", 1, 0, 1, 0),
    ("if err != nil { return }; if err != nil { return }", 3, 2, 3, 1),
    ("if a { os.Exit(1) }; if b {}", 3, 2, 3, 1),
])
def test_metrics(body, cyclomatic, cognitive, npath, nesting):
    from tarnsieve.rules import metrics

    fn = unit("a.go", f"package p\nfunc f() {{ {body} }}\n").functions[0].Body
    assert metrics.cyclomatic(fn) == cyclomatic
    assert metrics.cognitive(fn.List, 0) == cognitive
    assert sum(metrics.npath(fn.List)) == npath
    assert metrics.nesting(fn.List, 0) == nesting


def test_npath_saturates():
    from tarnsieve.rules import metrics

    fn = unit("a.go", "package p\nfunc f() { " + "if a {}; " * 100 + "}\n").functions[0].Body
    assert metrics.npath(fn.List)[0] == metrics.CAP


def test_lengths_count_code_and_spare_tables():
    body = "func F() {\n" + "\t// c\n" * 20 + "\tx()\n" * 6 + "}\n"
    r = only("size.function-length", maxLines=7)
    (f,) = found("a.go", "package p\n\n" + body, rules=r)
    assert f["message"] == "function has 8 code lines, above threshold 7" and (f["line"], f["end_line"]) == (3, 30)
    assert not found("a.go", "package p\n\n//nolint:funlen\n" + body, rules=r)
    table = "func F() {\n\ttests := []int{\n" + "\t\t1,\n" * 20 + "\t}\n\tx()\n}\n"
    assert not found("a_test.go", "package p\n" + table, rules=r)
    assert found("a.go", "package p\n" + table, rules=r)


def test_paths_and_headers_excuse():
    text = source_of("go", "net/http", "var c = http.Client{}")
    assert ids("a.go", text) and not ids("testdata/a.go", text) and not ids("x/examples/a.go", text)
    panic = source_of("go", "", 'func f() { panic("no") }')
    assert not ids("cmd/a.go", panic) and not ids("a.go", panic.replace("package s", "package main"))
    assert not ids("a.go", "// Code generated by x. DO NOT EDIT.\n" + source_of("go", "", "func f() { for { defer g() } }"))


def test_parallel_capture_needs_an_old_module():
    text = next(source_of(*s[:3]) for s in SNIPPETS if any(f[0].endswith("range-capture") for f in s[3]))
    assert ids("a_test.go", text, version=(1, 21)) and not ids("a_test.go", text, version=(1, 22)) and not ids("a_test.go", text, version=None)


def test_rubric_and_settings():
    o = Options(CATALOGUE["docs.comment-rubric"], {}, {"requireFunctionComments": True, "minWordsBeyondSymbol": 2})
    text = "package p\n\n// Open the open.\nfunc Open() {}\n\n// Open reads whole files.\nfunc (a A) Open() {}\n"
    assert [f["symbol"] for f in found("a.go", text, rules={"docs.comment-rubric": o})] == ["Open"]
    c = Options(CATALOGUE["docs.config-field-comment"], {}, {"includePaths": ["cfg/**"]})
    text = "package p\ntype C struct {\n\tA int\n\tB int // how many there are\n\tc int\n}\n"
    assert [f["symbol"] for f in found("cfg/a.go", text, rules={"docs.config-field-comment": c})] == ["C.A"]
    assert not found("a.go", text, rules={"docs.config-field-comment": c})


def test_suppressions_in_text_and_neighbours():
    rule = only("docs.suppression-without-rationale")
    assert len(found("a.env", "nolint\nx\n#nosec G101\n", rules=rule)) == 2
    assert not found("a.env", "#nosec G101\n# reason: it is a sample\n", rules=rule)
    assert not found("a.go", "package p\n\n// reason: it is fine here\n//nolint:x\nvar a = 1\n", rules=rule)
    assert not found("vendor/a.env", "nolint\n", rules=rule)


def test_columns_are_bytes():
    (f,) = [x for x in found("a.go", 'package p\n\nfunc f() { é(); tmp := 1 }\n') if x["rule_id"] == "naming.identifier-quality"]
    assert (f["line"], f["col"]) == (3, 18)
