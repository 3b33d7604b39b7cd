"""Tokens and comments of a Go file, by the language specification: one compiled pattern, semicolons inserted at line ends."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

KEYWORDS = frozenset(
    "type switch struct select return range package map interface import if goto go func for fallthrough else defer default continue const chan case break var".split()
)
_ENDS_LINE = frozenset(["ident", "int", "float", "imag", "char", "string", "return", "fallthrough", "continue", "break", "++", "--", ")", "]", "}"])
#: Operators that are no beginning of a longer one.
_ALONE = frozenset("()[]{},;~")
_OPEN = re.compile(r"\(*")
_TOKEN = re.compile(
    r"""(?P<space>[ \t\r]+)
|(?P<newline>\n)
|(?P<line>//[^\n]*)
|(?P<block>/\*.*?\*/)
|(?P<ident>[^\W\d]\w*)
|(?P<imag>(?:0[xX][\da-fA-F_]*(?:\.[\da-fA-F_]*)?(?:[pP][+-]?[\d_]+)?|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*)?\.?\d[\d_]*(?:[eE][+-]?[\d_]+)?)i)
|(?P<float>0[xX][\da-fA-F_]*\.?[\da-fA-F_]*[pP][+-]?[\d_]+|\d[\d_]*\.(?:\d[\d_]*)?(?:[eE][+-]?[\d_]+)?|\d[\d_]*[eE][+-]?[\d_]+|\.\d[\d_]*(?:[eE][+-]?[\d_]+)?)
|(?P<int>0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|\d[\d_]*)
|(?P<char>'(?:\\(?:x[\da-fA-F]{2}|u[\da-fA-F]{4}|U[\da-fA-F]{8}|[0-7]{3}|[abfnrtv\\'])|[^'\\\n])')
|(?P<string>"(?:\\.|[^"\\\n])*"|`[^`]*`)
|(?P<op><<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[-+*/%&|^<>=!()\[\]{},;.:~])
""",
    re.X | re.S,
)


class GoSyntaxError(Exception):
    def __init__(self, line: int, column: int, message: str):
        super().__init__(f"{line}:{column}: {message}")
        self.line, self.column, self.message = line, column, message
        #: All errors of the file, this one first.
        self.all = [self]


@dataclass(slots=True)
class Token:
    kind: str
    text: str
    pos: int
    lead: "CommentGroup | None" = None


@dataclass(slots=True)
class Comment:
    text: str
    pos: int


@dataclass(slots=True)
class CommentGroup:
    comments: list[Comment] = field(default_factory=list)

    def text(self) -> str:
        """Without markers and directives, lines trimmed at their ends, blank lines collapsed."""
        lines: list[str] = []
        for c in self.comments:
            if c.text.startswith("/*"):
                lines += c.text[2:-2].split("\n")
            elif c.text[2:3] == " ":
                lines.append(c.text[3:])
            elif not re.match(r"(?:line |extern |export |[a-z0-9]+:[a-z0-9])", c.text[2:]):
                lines.append(c.text[2:])
        out: list[str] = []
        for line in (x.rstrip() for x in lines):
            if line or (out and out[-1]):
                out.append(line)
        while out and not out[-1]:
            out.pop()
        return "\n".join([*out, ""]) if out else ""


class Source:
    """Text with positions: lines from 1, columns in bytes from 1."""

    def __init__(self, text: str):
        self.text = text
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self.plain = text.isascii()

    def line(self, pos: int) -> int:
        return bisect_right(self.starts, pos)

    def column(self, pos: int) -> int:
        start = self.starts[self.line(pos) - 1]
        return pos - start + 1 if self.plain else len(self.text[start:pos].encode("utf-8", "surrogatepass")) + 1

    def fail(self, pos: int, message: str) -> GoSyntaxError:
        return GoSyntaxError(self.line(pos), self.column(pos), message)


def scan(source: Source) -> tuple[list[Token], list[CommentGroup]]:
    """All tokens, each with the comment group right above it, ending in EOF; and all groups."""
    text, at, n = source.text, 0, len(source.text)
    tokens: list[Token] = []
    groups: list[CommentGroup] = []
    pending: list[Comment] = []
    match = _TOKEN.match

    def flush(pos: int) -> CommentGroup | None:
        """Groups the comments before a token; the last of them if it ends on the line above pos."""
        if not pending:
            return None
        end = source.line(tokens[-1].pos) if tokens else -1
        gap = 0 if tokens and source.line(pending[0].pos) == end else 1
        group = CommentGroup()
        trailing = gap == 0
        for c in pending:
            start = source.line(c.pos)
            if group.comments and start > end + gap:
                groups.append(group)
                group, gap, trailing = CommentGroup(), 1, False
            group.comments.append(c)
            end = source.line(c.pos + len(c.text) - 1)
        groups.append(group)
        pending.clear()
        return group if not trailing and end + 1 == source.line(pos) else None

    def newline(pos: int) -> None:
        if tokens and tokens[-1].kind in _ENDS_LINE:
            tokens.append(Token(";", "\n", pos))

    while at < n:
        c = text[at]
        if c in _ALONE:
            tokens.append(Token(c, c, at, flush(at) if pending else None))
            at += 1
            if c == "(" and text.startswith("(", at):
                begin, at = at, _OPEN.match(text, at).end()
                tokens += [Token("(", "(", i) for i in range(begin, at)]
            continue
        if c == " " or c == "\n" or c == "\t":
            if c == "\n":
                newline(at)
            at += 1
            continue
        m = match(text, at)
        if not m:
            raise source.fail(at, {'"': "string literal not terminated", "`": "raw string literal not terminated", "'": "rune literal not terminated", "/": "comment not terminated"}.get(c, f"illegal character U+{ord(c):04X}"))
        kind, value = m.lastgroup, m.group()
        if kind == "newline":
            newline(at)
        elif kind == "line":
            pending.append(Comment(value.rstrip("\r"), at))
        elif kind == "block":
            if "\n" in value:
                newline(at)
            pending.append(Comment(value, at))
        elif kind != "space":
            if kind == "ident" and value in KEYWORDS:
                kind = value
            elif kind == "op":
                kind = value
                if value == "/" and text.startswith("/*", at):
                    raise source.fail(at, "comment not terminated")
            tokens.append(Token(kind, value, at, flush(at) if pending else None))
        at = m.end()
    newline(n)
    lead = flush(n)
    tokens.append(Token("EOF", "", n, lead))
    return tokens, groups
