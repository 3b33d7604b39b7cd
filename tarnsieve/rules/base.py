"""What the rules over one file share: the file as a unit, the catalogue of rules, helpers over syntax trees."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property
from typing import Any

from tarnsieve.goparse.lexer import CommentGroup, Source, Token
from tarnsieve.goparse.syntax import Node, walk

SEVERITIES = ("advisory", "warning", "error")
PILLARS = tuple("size complexity documentation sensitive-data security test-quality naming maintainability dead-code modernisation design".split())


@dataclass(frozen=True)
class Rule:
    id: str
    title: str
    pillar: str
    severity: str = "advisory"
    confidence: str = "medium"
    #: unit: over one file; project: over packages; composite: over findings; lines: over lines of text
    kind: str = "unit"
    secondary: tuple[str, ...] = ()
    thresholds: dict[str, float] = field(default_factory=dict)
    options: dict[str, Any] = field(default_factory=dict)
    tags: tuple[str, ...] = ()
    remediation: str = ""
    #: What a rule needs of a file: its syntax (or lines), types, single assignments or the flow of data.
    capability: str = "parser"
    check: Callable | None = None


#: rule id -> Rule, all of them.
CATALOGUE: dict[str, Rule] = {}


CONFIDENCES, CAPABILITIES = ("low", "medium", "high"), ("parser", "type", "ssa", "dataflow")
RULE_ID = re.compile(r"[a-z][a-z0-9]*(?:-[a-z0-9]+)*(?:\.[a-z0-9]+(?:-[a-z0-9]+)*)+")


def valid(rule: Rule) -> Rule:
    """The rule; fails on whatever a catalogue can't hold."""
    checks = [
        (RULE_ID.fullmatch(rule.id), "id"), (rule.title.strip(), "title"), (rule.pillar in PILLARS, "pillar"), (set(rule.secondary) <= set(PILLARS), "secondary pillars"), (rule.severity in SEVERITIES, "severity"),
        (rule.confidence in CONFIDENCES, "confidence"), (rule.capability in CAPABILITIES, "capability"), (all(rule.thresholds.keys()), "threshold names"), (all(rule.options.keys()), "option names"),
    ]
    for fine, what in checks:
        if not fine:
            raise ValueError(f"rule {rule.id!r} has no valid {what}")
    return rule


def add(rule: Rule) -> None:
    if valid(rule).id in CATALOGUE:
        raise ValueError(f"two rules have the id {rule.id}")
    CATALOGUE[rule.id] = rule


def unit_rule(id: str, title: str, pillar: str, severity: str = "advisory", confidence: str = "medium", **more):
    def register(check):
        add(Rule(id, title, pillar, severity, confidence, check=check, **more))
        return check

    return register


@dataclass
class Options:
    """A rule's thresholds and options as configured; what isn't falls back to the catalogue."""

    rule: Rule
    thresholds: dict[str, float] = field(default_factory=dict)
    options: dict[str, Any] = field(default_factory=dict)
    abbreviations: tuple[str, ...] = ()

    def threshold(self, name: str) -> int:
        v = self.thresholds.get(name, 0)
        return int(v) if v and v > 0 else int(self.rule.thresholds[name])

    def __getitem__(self, name: str):
        v = self.options.get(name)
        default = self.rule.options[name]
        if v is None or (isinstance(default, bool) and not isinstance(v, bool)) or (isinstance(default, (list, dict)) and (type(v) is not type(default) or (not v and default))):
            return default
        return v


@dataclass
class Unit:
    path: str
    text: str
    tree: Node | None = None
    source: Source | None = None
    tokens: list[Token] = field(default_factory=list)
    go_version: tuple[int, int] | None = None

    @cached_property
    def is_test(self) -> bool:
        return self.path.endswith("_test.go")

    @cached_property
    def production(self) -> bool:
        return is_production(self.path)

    @cached_property
    def generated(self) -> bool:
        return generated_header(self.text)

    @cached_property
    def line_count(self) -> int:
        return count_lines(self.text)

    @cached_property
    def functions(self) -> list[Node]:
        return [d for d in self.tree.Decls if d.kind == "FuncDecl"]

    @cached_property
    def nodes(self) -> list[Node]:
        return list(walk(self.tree))

    @cached_property
    def code_lines(self) -> set[int]:
        return {self.source.line(t.pos) for t in self.tokens if t.kind != "EOF"}

    def line(self, pos: int) -> int:
        return self.source.line(pos)

    def slice(self, node: Node) -> str:
        return self.text[node.pos : node.end]

    def imports(self, path: str, default: str) -> set[str]:
        """Names under which a package is used."""
        out = set()
        for spec in self.tree.Imports:
            if unquote(spec.Path.Value) == path:
                name = default if spec.Name is None else spec.Name.Name
                if name not in (".", "_"):
                    out.add(name)
        return out


def hit(u: Unit, message: str, pos: int | None = None, *, line: int = 0, column: bool = True, end: int = 0, symbol: str = "", **metadata) -> dict:
    """A finding at an offset, or at a line without a column."""
    if pos is not None:
        line = u.source.line(pos)
    return {"message": message, "line": line, "column": u.source.column(pos) if pos is not None and column else 0, "end_line": end, "symbol": symbol, "metadata": metadata}


def count_lines(text: str) -> int:
    return text.count("\n") + (bool(text) and not text.endswith("\n"))


def generated_header(text: str) -> bool:
    return any("Code generated" in x or "DO NOT EDIT" in x for x in text.split("\n", 10)[:10])


def is_production(path: str) -> bool:
    clean = "/" + path.replace("\\", "/")
    return not path.endswith("_test.go") and not any(x in clean for x in ("/example/", "/examples/", "/testdata/"))


def is_bootstrap(path: str) -> bool:
    return "/cmd/" in "/" + path.replace("\\", "/")


_ESCAPE = re.compile(r"\\(?:x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|U([0-9a-fA-F]{8})|([0-7]{3})|(.))", re.S)
_SIMPLE = {"a": "\a", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v", "\\": "\\", "'": "'", '"': '"'}


def unquote(literal: str) -> str:
    """The value of a string or rune literal."""
    if literal[:1] == "`":
        return literal[1:-1].replace("\r", "")
    return _ESCAPE.sub(lambda m: _SIMPLE.get(m[5], m[5]) if m[5] else chr(int(m[1] or m[2] or m[3], 16) if not m[4] else int(m[4], 8)), literal[1:-1])


def string_of(x: Node | None) -> str | None:
    return unquote(x.Value) if x is not None and x.kind == "BasicLit" and x.Kind in ("string", "char") else None


def name_of(x: Node | None) -> str | None:
    return x.Name if x is not None and x.kind == "Ident" else None


def selector(x: Node | None) -> tuple[str | None, str] | None:
    """(receiver's name or None, selected name) of a selector expression."""
    return (name_of(x.X), x.Sel.Name) if x is not None and x.kind == "SelectorExpr" else None


def calls(x: Node, packages: set[str], *names: str) -> bool:
    """Whether x is a call of one of the names of packages."""
    s = selector(x.Fun) if x.kind == "CallExpr" else None
    return s is not None and s[0] in packages and s[1] in names


def called_name(x: Node) -> str:
    return name_of(x.Fun) or (x.Fun.Sel.Name if x.Fun.kind == "SelectorExpr" else "")


def exported(name: str) -> bool:
    return name[:1].isupper()


def receiver_base(fn: Node) -> str | None:
    """The receiver's type name, if it is a plain or a pointer to a plain one."""
    if fn.Recv is None or not fn.Recv.List:
        return None
    t = fn.Recv.List[0].Type
    return name_of(t.X if t.kind == "StarExpr" else t)


def symbol_of(fn: Node) -> str:
    base = receiver_base(fn)
    return f"{base}.{fn.Name.Name}" if base else fn.Name.Name


def declared_symbol(fn: Node) -> str:
    """As symbol_of, but methods of generic types have a prefix too."""
    if fn.Recv is None or not fn.Recv.List:
        return fn.Name.Name
    return f"{receiver_base(fn) or 'receiver'}.{fn.Name.Name}"


def has_doc(group: CommentGroup | None) -> bool:
    return group is not None and bool(group.text().strip())


def parents_of(root: Node) -> dict[int, Node]:
    return {id(c): n for n in walk(root) for c in n.children()}


def contains(root: Node, target: Node) -> bool:
    return root.pos <= target.pos and target.end <= root.end and any(n is target for n in walk(root))


def pairs(n: Node) -> Iterator[tuple[Node, Node, int]]:
    """(target, value, index) of an assignment or a declaration of values; none for other nodes."""
    if n.kind == "AssignStmt":
        yield from ((a, b, i) for i, (a, b) in enumerate(zip(n.Lhs, n.Rhs)))
    elif n.kind == "ValueSpec":
        yield from ((a, b, i) for i, (a, b) in enumerate(zip(n.Names, n.Values)))


def fields(listed: Node | None) -> list[Node]:
    return listed.List if listed is not None else []


def field_count(listed: Node | None) -> int:
    return sum(len(f.Names) or 1 for f in fields(listed))



def name_tokens(name: str) -> list[str]:
    """Words of an identifier: cut at _, lower or digit before upper, between letters and digits, and before the last capital of a run that lower case follows."""
    out, start = [], 0
    for i, c in enumerate(name):
        if c == "_":
            out.append(name[start:i])
            start = i + 1
        elif i > start:
            p = name[i - 1]
            if ((p.islower() or p.isdigit()) and c.isupper()) or (p.isalpha() and c.isdigit()) or (p.isdigit() and c.isalpha()) or (p.isupper() and c.isupper() and name[i + 1 : i + 2].islower()):
                out.append(name[start:i])
                start = i
    out.append(name[start:])
    return [x for x in out if x]


def letter_tokens(text: str) -> list[str]:
    """Words of letters in lower case, cut where lower turns to upper and before the last capital of a run."""
    out, start = [], 0
    for i, c in enumerate(text):
        if not c.isalpha():
            out.append(text[start:i])
            start = i + 1
        elif i > start and ((text[i - 1].islower() and c.isupper()) or (text[i - 1].isupper() and c.isupper() and text[i + 1 : i + 2].islower())):
            out.append(text[start:i])
            start = i
    out.append(text[start:])
    return [x.lower() for x in out if x]


def first_word(text: str, words: tuple[str, ...] | frozenset[str]) -> str | None:
    return next((t for t in letter_tokens(text) if t in words), None)
