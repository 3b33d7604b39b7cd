"""Test quality."""

from __future__ import annotations

import re

from tarnsieve.goparse.syntax import Node, inspect, walk
from tarnsieve.rules.base import Unit, called_name, calls, fields, hit, name_of, pairs, selector, string_of, symbol_of, unit_rule, unquote
from tarnsieve.rules.maintain import range_names

_ASSERTIONS = {"/".join(("github.com", "stretchr", "testify", x)): x for x in ("require", "assert")} | {"github.com/onsi/gomega": "gomega", "gotest.tools/v3/assert": "assert", "gotest.tools/v3/assert/cmp": "cmp"}


class Scope:
    """Names of the testing package in a file, and of its handles in functions."""

    def __init__(self, u: Unit):
        self.packages: set[str] = set()
        self.assertions: set[str] = set()
        for spec in u.tree.Imports:
            path, name = unquote(spec.Path.Value), spec.Name.Name if spec.Name is not None else None
            if path == "testing" and name != "_":
                self.packages.add(name or "testing")
            elif path in _ASSERTIONS and name not in (".", "_"):
                self.assertions.add(name or _ASSERTIONS[path])

    def kind(self, x: Node | None, kinds: str = "TBF") -> str | None:
        """T, B or F of a type of the testing package."""
        s = selector(x)
        name = s[1] if s and s[0] in self.packages else name_of(x) if "." in self.packages else None
        return name if name and name in tuple(kinds) else None

    def handle(self, t: Node, helpers: bool = False) -> str | None:
        """The kind of a parameter's type if it is a test's handle: a pointer, or with helpers the interface."""
        if t.kind == "StarExpr":
            return self.kind(t.X)
        if helpers:
            s = selector(t)
            if (s and s[0] in self.packages and s[1] == "TB") or ("." in self.packages and name_of(t) == "TB"):
                return "TB"
        return None

    def names(self, typ: Node, parent: frozenset[str] = frozenset(), helpers: bool = False) -> frozenset[str]:
        """Handles within a function: the parent's, without names that its parameters hide, and its own."""
        out = set(parent)
        for f in fields(typ.Params):
            own = {n.Name for n in f.Names} - {"_"}
            out = out | own if self.handle(f.Type, helpers) else out - own
        return frozenset(out)

    def runnable(self, fn: Node) -> bool:
        if fn.Recv is not None or fields(fn.Type.Results):
            return False
        m = re.match(r"(Test|Benchmark|Fuzz)(.?)", fn.Name.Name)
        params = fields(fn.Type.Params)
        if not m or m[2].islower() or len(params) != 1 or len(params[0].Names) > 1:
            return False
        return self.handle(params[0].Type) == m[1][0]

    def fails(self, body: Node, names: frozenset[str]) -> bool:
        """Whether something below calls a failure method of a handle or hands one to an assertion."""
        local = set(names)
        for n in walk(body, "FuncLit"):
            for a, b, _ in pairs(n):
                made = (b.kind == "UnaryExpr" and b.Op == "&" and b.X.kind == "CompositeLit" and self.kind(b.X.Type)) or (b.kind == "CallExpr" and name_of(b.Fun) == "new" and len(b.Args) == 1 and self.kind(b.Args[0]))
                if made and (name := name_of(a)) and name != "_":
                    local.add(name)
        found = False

        def visit(n: Node):
            nonlocal found
            if found:
                return False
            if n.kind == "FuncLit":
                found = self.fails(n.Body, self.names(n.Type, frozenset(local)))
                return False
            if n.kind == "CallExpr":
                s = selector(n.Fun)
                if s and s[0] in local and re.fullmatch(r"(?:Error|Fatal)f?|Fail(?:Now)?", s[1]):
                    found = True
                elif any(name_of(a) in local for a in n.Args):
                    found = bool(re.match(r"(?:Assert|Require|Expect|Must|Check)[A-Z]", called_name(n))) or bool(s and s[0] in self.assertions)
            return not found

        inspect(body, visit)
        return found


def _tests(u: Unit) -> Scope | None:
    return Scope(u) if u.tree is not None and u.is_test else None


@unit_rule("test-quality.empty-test", "Empty test", "test-quality", "advisory", "high", tags=("tests",), remediation="Test what the name says, or drop it.")
def empty_test(u: Unit, o):
    scope = _tests(u)
    for fn in u.functions if scope else ():
        if scope.runnable(fn) and (fn.Body is None or not fn.Body.List):
            yield hit(u, f"test {fn.Name.Name} has an empty body", fn.Name.pos, symbol=fn.Name.Name)


@unit_rule("test-quality.no-failure-path", "Test can't fail", "test-quality", tags=("tests",), remediation="Assert something.")
def no_failure_path(u: Unit, o):
    scope = _tests(u)
    for fn in u.functions if scope else ():
        if scope.runnable(fn) and fn.Body is not None and fn.Body.List:
            names = scope.names(fn.Type)
            if not names or not scope.fails(fn.Body, names):
                yield hit(u, f"test {fn.Name.Name} has no path that calls a testing failure method", fn.Name.pos, symbol=fn.Name.Name)


@unit_rule("test-quality.helper-missing-t-helper", "Helper not marked", "test-quality", tags=("tests",), remediation="Call Helper first.")
def helper_unmarked(u: Unit, o):
    scope = _tests(u)
    for fn in u.functions if scope else ():
        if fn.Body is None or scope.runnable(fn):
            continue
        names = scope.names(fn.Type, helpers=True)
        marked = any(n.kind == "CallExpr" and (s := selector(n.Fun)) and s[0] in names and s[1] == "Helper" for n in walk(fn.Body, "FuncLit"))
        if names and not marked and scope.fails(fn.Body, names):
            yield hit(u, f"test helper {fn.Name.Name} can fail without calling Helper", fn.Name.pos, symbol=fn.Name.Name)


@unit_rule("test-quality.parallel-range-capture", "Parallel test captures a loop variable", "test-quality", tags=("tests",), remediation="Copy the variable, or move to Go 1.22.")
def parallel_capture(u: Unit, o):
    scope = _tests(u)
    if scope is None or u.go_version is None or u.go_version >= (1, 22):
        return
    for fn in u.functions:
        for loop in walk(fn.Body):
            names = range_names(loop) if loop.kind == "RangeStmt" else []
            shadowed: set[str] = set()
            for s in loop.Body.List if names else ():
                if s.kind == "AssignStmt" and s.Tok == ":=" and len(s.Lhs) == len(s.Rhs):
                    shadowed |= {name_of(a) for a, b, _ in pairs(s) if name_of(a) and name_of(a) == name_of(b)}
                for n in walk(s):
                    if n.kind == "CallExpr" and n.Fun.kind == "SelectorExpr" and n.Fun.Sel.Name == "Run":
                        lit = next((a for a in n.Args if a.kind == "FuncLit"), None)
                        if lit is None:
                            continue
                        handles = scope.names(lit.Type)
                        if any(x.kind == "CallExpr" and (q := selector(x.Fun)) and q[0] in handles and q[1] == "Parallel" for x in walk(lit.Body)):
                            used = min((v for v in names if v not in shadowed and _uses(lit, v)), default=None)
                            if used:
                                yield hit(u, f'parallel subtest captures range variable "{used}"', n.pos, variable=used)


def _uses(lit: Node, name: str) -> bool:
    declared = {n.Name for f in fields(lit.Type.Params) for n in f.Names}
    for n in walk(lit.Body, "FuncLit"):
        if n.kind == "AssignStmt" and n.Tok == ":=":
            declared |= {name_of(x) for x in n.Lhs}
        elif n.kind == "ValueSpec":
            declared |= {x.Name for x in n.Names}
        elif n.kind == "Ident" and n.Name == name and name not in declared:
            return True
    return False


@unit_rule("test-quality.fatal-in-goroutine", "Fatal call in a goroutine", "test-quality", "advisory", "high", tags=("tests",), remediation="Report to the test's own goroutine.")
def fatal_in_goroutine(u: Unit, o):
    scope = _tests(u)
    if scope is None or u.generated or not scope.packages:
        return

    def below(body: Node, names: frozenset[str], symbol: str):
        out = []

        def visit(n: Node):
            if n.kind == "FuncLit":
                out.extend(below(n.Body, scope.names(n.Type, names), symbol))
                return False
            if n.kind == "GoStmt" and n.Call.Fun.kind == "FuncLit":
                lit = n.Call.Fun
                mine = scope.names(lit.Type, names)
                call = next((x for x in walk(lit.Body, "FuncLit") if x.kind == "CallExpr" and (s := selector(x.Fun)) and s[0] in mine and s[1] in ("FailNow", "Fatalf", "Fatal")), None)
                if call is not None:
                    out.append(hit(u, "testing fatal call runs inside a goroutine", call.pos, symbol=symbol, call=u.slice(call.Fun)))
            return True

        inspect(body, visit)
        return out

    for fn in u.functions:
        names = scope.names(fn.Type)
        if fn.Body is not None and names:
            yield from below(fn.Body, names, symbol_of(fn))


@unit_rule("test-quality.tempdir-misuse", "Temporary directory by hand", "test-quality", "advisory", "high", tags=("tests",), remediation="Use TempDir of the test.")
def tempdir(u: Unit, o):
    scope = _tests(u)
    if scope is None or u.generated or not scope.packages:
        return
    os_, ioutil = u.imports("os", "os"), u.imports("io/ioutil", "ioutil")

    def below(body: Node, names: frozenset[str], symbol: str):
        out = []

        def visit(n: Node):
            if n.kind == "FuncLit":
                out.extend(below(n.Body, scope.names(n.Type, names, True), symbol))
                return False
            if names and n.kind == "CallExpr" and n.Args and string_of(n.Args[0]) == "":
                call = "os.MkdirTemp" if calls(n, os_, "MkdirTemp") else "ioutil.TempDir" if calls(n, ioutil, "TempDir") else None
                if call:
                    out.append(hit(u, "test creates a temp directory without t.TempDir cleanup", n.pos, symbol=symbol, call=call))
            return True

        inspect(body, visit)
        return out

    for fn in u.functions:
        names = scope.names(fn.Type, helpers=True)
        if fn.Body is not None and names:
            yield from below(fn.Body, names, symbol_of(fn))


@unit_rule("test-quality.sleep-in-test", "Sleep in a test", "test-quality", "advisory", "high", tags=("tests", "flake"), remediation="Wait for what you wait for.")
def sleep_in_test(u: Unit, o):
    packages = u.imports("time", "time") if u.tree is not None and u.is_test and not u.generated else set()
    for fn in u.functions if packages else ():
        for n in walk(fn.Body):
            if calls(n, packages, "Sleep"):
                yield hit(u, "test calls time.Sleep; replace with explicit synchronisation", n.pos, symbol=symbol_of(fn), call="time.Sleep")


@unit_rule("test-quality.skipped-test", "Skipped test", "test-quality", tags=("tests",), remediation="Run it, or track why not elsewhere.")
def skipped_test(u: Unit, o):
    scope = _tests(u)
    if scope is None:
        return
    regions = []
    for n in u.nodes:
        if n.kind in ("IfStmt", "ForStmt", "RangeStmt", "SwitchStmt", "TypeSwitchStmt", "SelectStmt"):
            regions.append((n.Body.pos, n.Body.end))
            if n.kind == "IfStmt" and n.Else is not None:
                regions.append((n.Else.pos, n.Else.end))

    def below(body: Node, names: frozenset[str]):
        out = []

        def visit(n: Node):
            if n.kind == "FuncLit":
                out.extend(below(n.Body, scope.names(n.Type, names)))
                return False
            if n.kind == "CallExpr" and (s := selector(n.Fun)) and s[0] in names and s[1] in ("SkipNow", "Skipf", "Skip"):
                debt = any(w in (string_of(a) or "").lower() for a in n.Args for w in ("wip", "hack", "xxx", "fixme", "todo"))
                if debt or not any(a <= n.pos and n.end <= b for a, b in regions):
                    out.append(hit(u, "test contains a skip call", n.pos))
            return True

        inspect(body, visit)
        return out

    for fn in u.functions:
        if fn.Body is not None:
            yield from below(fn.Body, scope.names(fn.Type))
