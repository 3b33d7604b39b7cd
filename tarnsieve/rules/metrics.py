"""Size, complexity and dead code."""

from __future__ import annotations

import re

from tarnsieve.goparse.syntax import Node, walk
from tarnsieve.rules.base import Unit, declared_symbol, field_count, hit, name_of, selector, symbol_of, unit_rule

_LOOPS = ("ForStmt", "RangeStmt")
_SWITCHES = ("SwitchStmt", "TypeSwitchStmt", "SelectStmt")
CAP = 2**31 - 1


@unit_rule("size.file-length", "Long file", "size", "warning", "high", thresholds={"maxLines": 500}, remediation="Move what belongs together into files of its own.")
def file_length(u: Unit, o):
    most = o.threshold("maxLines")
    if u.tree is not None and u.line_count > most:
        yield hit(u, f"file has {u.line_count} lines, above threshold {most}", line=most + 1, lines=u.line_count, threshold=most, **({"testFile": True} if u.is_test else {}))


def _suppressed(doc) -> bool:
    for c in doc.comments if doc else ():
        text = c.text.removeprefix("//").strip()
        if text == "nolint":
            return True
        if text.startswith("nolint:") and {x.strip() for x in re.split(r"[ \t/]", text[7:], maxsplit=1)[0].split(",")} & {"funlen", "all"}:
            return True
    return False


def _fixtures(u: Unit, fn: Node) -> set[int]:
    """Lines of literals that are tables of test cases."""
    out: set[int] = set()
    for n in walk(fn.Body):
        if n.kind in ("AssignStmt", "ValueSpec"):
            for target, value in zip(n.Lhs if n.kind == "AssignStmt" else n.Names, n.Rhs if n.kind == "AssignStmt" else n.Values):
                if value.kind == "CompositeLit" and value.Type is not None and value.Type.kind in ("ArrayType", "Ellipsis"):
                    named = (name_of(target) or "").lower() in ("rows", "fixtures", "cases", "tests")
                    if named or (value.Type.Elt is not None and value.Type.Elt.kind == "StructType"):
                        out |= set(range(u.line(value.Lbrace), u.line(value.Rbrace) + 1))
    return out


@unit_rule("size.function-length", "Long function", "size", "warning", "high", thresholds={"maxLines": 80}, remediation="Give steps of the function names of their own.")
def function_length(u: Unit, o):
    if u.tree is None:
        return
    most = o.threshold("maxLines")
    quiet = {declared_symbol(f) for f in u.functions if _suppressed(f.Doc)}
    last = {declared_symbol(f): f for f in u.functions}
    for fn in u.functions:
        first, end, symbol = u.line(fn.pos), u.line(fn.end), declared_symbol(fn)
        raw = end - first + 1
        if raw <= most or symbol in quiet:
            continue
        code = u.code_lines
        n = sum(x in code for x in range(first, end + 1)) or raw
        if n <= most:
            continue
        more = {}
        if u.is_test:
            more["testFile"] = True
            table = len(_fixtures(u, last[symbol]) & code) if last[symbol].Body is not None else 0
            if table:
                n -= table
                more["tableFixtureLines"] = table
        if n > most:
            yield hit(u, f"function has {n} code lines, above threshold {most}", fn.pos, column=False, end=end, symbol=symbol, lines=n, threshold=most, rawLines=raw, **more)


@unit_rule("size.parameter-count", "Many parameters", "size", "advisory", "high", thresholds={"maxParameters": 8}, remediation="Pass a struct of options.")
def parameter_count(u: Unit, o):
    most = o.threshold("maxParameters")
    for fn in u.functions if u.tree else ():
        n = field_count(fn.Type.Params)
        if n > most:
            yield hit(u, f"function has {n} parameters, above threshold {most}", fn.pos, column=False, end=u.line(fn.end), symbol=symbol_of(fn), parameters=n, threshold=most)


def booleans(x: Node | None) -> int:
    return sum(n.kind == "BinaryExpr" and n.Op in ("&&", "||") for n in walk(x))


def cyclomatic(body: Node) -> int:
    total = 1
    for n in walk(body, "FuncLit"):
        k = n.kind
        total += k in ("IfStmt", "CommClause", *_LOOPS) or (k == "CaseClause" and bool(n.List)) or (k == "BinaryExpr" and n.Op in ("&&", "||"))
    return total


def nesting(stmts: list[Node], depth: int) -> int:
    best = depth
    for s in stmts:
        k = s.kind
        if k == "IfStmt":
            best = max(best, nesting(s.Body.List, depth + 1))
            if s.Else is not None:
                best = max(best, nesting(s.Else.List, depth + 1) if s.Else.kind == "BlockStmt" else nesting([s.Else], depth))
        elif k in _LOOPS:
            best = max(best, nesting(s.Body.List, depth + 1))
        elif k in _SWITCHES:
            best = max(best, depth + 1, *(nesting(c.Body, depth + 1) for c in s.Body.List))
        elif k == "BlockStmt":
            best = max(best, nesting(s.List, depth))
    return best


def cognitive(stmts: list[Node], depth: int) -> int:
    total = 0
    for s in stmts:
        k = s.kind
        if k == "IfStmt":
            total += 1 + depth + booleans(s.Cond) + cognitive(s.Body.List, depth + 1)
            if s.Else is not None:
                total += cognitive(s.Else.List, depth + 1) if s.Else.kind == "BlockStmt" else cognitive([s.Else], depth)
        elif k in _LOOPS:
            total += 1 + depth + (booleans(s.Cond) if k == "ForStmt" else 0) + cognitive(s.Body.List, depth + 1)
        elif k in _SWITCHES:
            total += 1 + depth + sum(cognitive(c.Body, depth + 1) for c in s.Body.List)
        elif k == "BlockStmt":
            total += cognitive(s.List, depth)
    return total


def _exits(x: Node) -> bool:
    if x.kind != "CallExpr":
        return False
    if name_of(x.Fun) == "panic":
        return True
    s = selector(x.Fun)
    return s is not None and (s in (("os", "Exit"), ("runtime", "Goexit")) or (s[0] == "log" and re.fullmatch(r"(?:Fatal|Panic)(?:f|ln)?", s[1]) is not None))


def npath(stmts: list[Node]) -> tuple[int, int]:
    """Paths that go on and paths that end, both up to CAP."""
    on, ended = 1, 0
    for s in stmts:
        a, b = _npath(s)
        ended = min(CAP, ended + min(CAP, on * b))
        on = min(CAP, on * a)
    return on, ended


def _npath(s: Node) -> tuple[int, int]:
    k = s.kind
    if k == "ReturnStmt" or (k == "ExprStmt" and _exits(s.X)):
        return 0, 1
    if k == "IfStmt":
        a, b = npath(s.Body.List)
        c, d = (1, 0) if s.Else is None else _npath(s.Else)
        return min(CAP, a + c + booleans(s.Cond)), min(CAP, b + d)
    if k in _LOOPS:
        a, b = npath(s.Body.List)
        return min(CAP, a + 1 + (booleans(s.Cond) if k == "ForStmt" else 0)), b
    if k in _SWITCHES:
        parts = [npath(c.Body) for c in s.Body.List]
        a, b = min(CAP, sum(p[0] for p in parts)), min(CAP, sum(p[1] for p in parts))
        if k != "SelectStmt" and all(c.List for c in s.Body.List):
            a = min(CAP, a + 1)
        if not a and not b:
            a = 1
        return min(CAP, a + (booleans(s.Tag) if k == "SwitchStmt" else 0)), b
    if k == "BlockStmt":
        return npath(s.List)
    return _npath(s.Stmt) if k == "LabeledStmt" else (1, 0)


def _metric(id: str, title: str, threshold: tuple[str, int], what: str, key: str, measure, remediation: str, **more):
    @unit_rule(id, title, "complexity", "warning", "high", thresholds=dict([threshold]), remediation=remediation, **more)
    def check(u: Unit, o):
        most = o.threshold(threshold[0])
        for fn in u.functions if u.tree else ():
            if fn.Body is not None and (n := measure(fn.Body)) > most:
                yield hit(u, f"function {what} is {n}, above threshold {most}", fn.pos, column=False, end=u.line(fn.end), symbol=symbol_of(fn), **{key: n}, threshold=most)

    return check


_metric("complexity.cyclomatic", "Many branches", ("maxComplexity", 20), "cyclomatic complexity", "complexity", cyclomatic, "Split decisions that don't depend on each other.")
_metric("complexity.cognitive", "Hard to follow", ("maxComplexity", 35), "cognitive complexity", "complexity", lambda b: cognitive(b.List, 0), "Return early; flatten what is nested.", tags=("metric",))
_metric("complexity.npath", "Many paths", ("maxComplexity", 1024), "NPath complexity", "complexity", lambda b: min(CAP, sum(npath(b.List))), "Let tables decide instead of nested switches.", tags=("metric",))
_metric("complexity.nesting-depth", "Deep nesting", ("maxDepth", 5), "nesting depth", "depth", lambda b: nesting(b.List, 0), "Return early, or name the inner part.")


@unit_rule("dead-code.empty-block", "Empty block", "dead-code", remediation="Remove the block or fill it.")
def empty_block(u: Unit, o):
    for n in u.nodes if u.tree else ():
        if n.kind in ("IfStmt", *_LOOPS, *_SWITCHES) and not n.Body.List:
            yield hit(u, "empty control-flow block", n.Body.Lbrace)


def _terminal(s: Node) -> str:
    if s.kind == "ReturnStmt":
        return "return"
    if s.kind == "BranchStmt" and s.Tok != "fallthrough":
        return s.Tok
    return "panic" if s.kind == "ExprStmt" and s.X.kind == "CallExpr" and name_of(s.X.Fun) == "panic" else ""


@unit_rule("dead-code.unreachable-code", "Unreachable code", "dead-code", "advisory", "high", tags=("control-flow",), remediation="Remove the statement, or move it up.")
def unreachable(u: Unit, o):
    for block in u.nodes if u.tree else ():
        if block.kind != "BlockStmt":
            continue
        after = ""
        for s in block.List:
            if s.kind == "LabeledStmt":
                after = ""
            if after and s.kind not in ("EmptyStmt", "LabeledStmt"):
                yield hit(u, f"statement is unreachable after {after}", s.pos, after=after)
            else:
                after = _terminal(s) or after


