"""Maintainability and modernisation."""

from __future__ import annotations

from tarnsieve.goparse.syntax import Node, walk
from tarnsieve.rules.base import Unit, called_name, calls, hit, is_bootstrap, name_of, pairs, selector, string_of, symbol_of, unit_rule


@unit_rule("maintainability.ignored-error", "Ignored error", "maintainability", tags=("errors",), remediation="Handle the error or say why it can't matter.")
def ignored_error(u: Unit, o):
    if u.tree is None:
        return
    errors, fmt = u.imports("errors", "errors"), u.imports("fmt", "fmt")

    def evidence(x: Node) -> str:
        s = selector(x)
        name = name_of(x) or (s[1] if s else "")
        if name.lower().endswith(("err", "error")):
            return "selector" if s else "identifier"
        return "error-constructor" if calls(x, errors, "New") or calls(x, fmt, "Errorf") else ""

    for n in u.nodes:
        if n.kind == "AssignStmt" and len(n.Lhs) == len(n.Rhs):
            for target, value, _ in pairs(n):
                if name_of(target) == "_" and (why := evidence(value)):
                    yield hit(u, "error value is assigned to the blank identifier", target.pos, expression=u.slice(value), evidence=why)


@unit_rule("maintainability.context-todo-production", "Context left open", "maintainability", "advisory", "high", tags=("context",), remediation="Take the context from the caller.")
def context_todo(u: Unit, o):
    if u.tree is not None and u.production and (packages := u.imports("context", "context")):
        for n in u.nodes:
            if calls(n, packages, "TODO"):
                yield hit(u, "context.TODO used in production code", n.pos, call=u.slice(n.Fun))


@unit_rule("maintainability.production-panic", "Panic in a library", "maintainability", tags=("errors",), remediation="Return an error.")
def production_panic(u: Unit, o):
    if u.tree is None or not u.production or u.tree.Name.Name == "main" or is_bootstrap(u.path):
        return
    for fn in u.functions:
        name = fn.Name.Name
        if fn.Body is None or name in ("init", "main", "Defaults") or name.startswith("Must"):
            continue
        for n in walk(fn.Body, "FuncLit"):
            if n.kind == "CallExpr" and name_of(n.Fun) == "panic" and n.Args:
                x = n.Args[0]
                if string_of(x) is not None or (x.kind == "CallExpr" and called_name(x) in ("Sprintf", "Errorf", "New")):
                    yield hit(u, "production code calls panic with a literal message", n.pos, symbol=symbol_of(fn))


@unit_rule("maintainability.defer-in-loop", "Defer in a loop", "maintainability", "advisory", "high", tags=("lifecycle",), remediation="Give the loop's body a function of its own.")
def defer_in_loop(u: Unit, o):
    if u.tree is None or u.generated:
        return

    def inside(stmts: list[Node], looping: bool):
        for s in stmts:
            k = s.kind
            if k == "DeferStmt" and looping:
                yield s
            elif k in ("ForStmt", "RangeStmt"):
                yield from inside(s.Body.List, True)
            elif k == "IfStmt":
                yield from inside(s.Body.List, looping)
                if s.Else is not None and s.Else.kind == "BlockStmt":
                    yield from inside(s.Else.List, looping)
            elif k in ("SwitchStmt", "TypeSwitchStmt", "SelectStmt"):
                for clause in s.Body.List:
                    yield from inside(clause.Body, looping)

    for fn in u.functions:
        for s in inside(fn.Body.List, False) if fn.Body is not None else ():
            yield hit(u, "defer inside loop delays cleanup until function return", s.pos, symbol=symbol_of(fn))


@unit_rule("maintainability.log-fatal-library", "Library ends the process", "maintainability", "advisory", "high", tags=("errors", "lifecycle"), remediation="Return an error and let the command decide.")
def log_fatal(u: Unit, o):
    if u.tree is None or not u.production or u.tree.Name.Name == "main" or is_bootstrap(u.path) or u.generated:
        return
    log, os_ = u.imports("log", "log"), u.imports("os", "os")
    for fn in u.functions:
        for n in walk(fn.Body):
            if calls(n, os_, "Exit") or calls(n, log, "Fatal", "Fatalf", "Fatalln"):
                yield hit(u, "library code terminates the process instead of returning an error", n.pos, symbol=symbol_of(fn), call=u.slice(n.Fun))


def range_names(n: Node) -> list[str]:
    return [x for x in dict.fromkeys((name_of(n.Key), name_of(n.Value))) if x and x != "_"]


@unit_rule("maintainability.loop-variable-address", "Address of a loop variable", "maintainability", tags=("loops",), remediation="Take the address of the element.")
def loop_variable_address(u: Unit, o):
    if u.tree is None or u.generated:
        return
    for fn in u.functions:
        for loop in walk(fn.Body):
            if loop.kind != "RangeStmt" or not (names := range_names(loop)):
                continue
            for n in walk(loop.Body, "FuncLit", "RangeStmt"):
                if n.kind == "ReturnStmt":
                    found = [(x, "return") for x in n.Results]
                elif n.kind == "AssignStmt":
                    found = [(b, "store") for a, b, _ in pairs(n) if a.kind in ("SelectorExpr", "IndexExpr", "StarExpr")]
                elif n.kind == "SendStmt":
                    found = [(n.Value, "send")]
                elif n.kind == "CallExpr" and name_of(n.Fun) == "append":
                    found = [(x, "append") for x in n.Args[1:]]
                else:
                    continue
                for x, how in found:
                    if x.kind == "UnaryExpr" and x.Op == "&" and name_of(x.X) in names:
                        yield hit(u, f'range variable "{x.X.Name}" address escapes the iteration', x.pos, symbol=symbol_of(fn), variable=x.X.Name, context=how)


_IOUTIL = {"WriteFile": "os", "TempFile": "os.CreateTemp", "TempDir": "os.MkdirTemp", "ReadFile": "os", "ReadAll": "io", "NopCloser": "io", "Discard": "io"}


@unit_rule("modernisation.ioutil-deprecated", "Deprecated package", "modernisation", "advisory", "high", options={"minimumGoVersion": "1.16"}, tags=("go-style",), remediation="Use what took its place in io and os.")
def ioutil_deprecated(u: Unit, o):
    if u.tree is not None and (packages := u.imports("io/ioutil", "ioutil")):
        for n in u.nodes:
            s = selector(n)
            if s and s[0] in packages and s[1] in _IOUTIL:
                new = _IOUTIL[s[1]]
                yield hit(u, "io/ioutil API has a modern replacement", n.pos, api=f"{s[0]}.{s[1]}", replacement=new if "." in new else f"{new}.{s[1]}")
