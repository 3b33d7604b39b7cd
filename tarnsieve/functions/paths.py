"""Path patterns: a trailing /** is a prefix; * and ? match within one segment, [classes] one character; anything else is equality."""

from __future__ import annotations

import posixpath
import re
from functools import cache


class PatternError(ValueError):
    """A pattern that can't be used."""


@cache
def segment_regex(pattern: str) -> str:
    """A glob as an expression in which * and ? don't cross a slash; the same text is valid for Python, Java and RE2."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "\\":
            if i >= len(pattern):
                raise PatternError(f"{pattern!r} ends in a backslash")
            out += re.escape(pattern[i])
            i += 1
        elif c == "[":
            negated = pattern[i : i + 1] == "^"
            i += negated
            body = ""
            while True:
                if i >= len(pattern):
                    raise PatternError(f"{pattern!r} has an open class")
                if pattern[i] == "]" and body:
                    break
                if pattern[i] == "\\":
                    i += 1
                    if i >= len(pattern):
                        raise PatternError(f"{pattern!r} has an open class")
                    body += "\\" + pattern[i]
                elif pattern[i] == "-" and body and pattern[i + 1 : i + 2] not in ("]", ""):
                    body += "-"
                else:
                    body += "\\" + pattern[i] if pattern[i] in "[]^-&~" else pattern[i]
                i += 1
            i += 1
            out += f"[{'^' if negated else ''}{body}]"
        else:
            out += re.escape(c)
    return out


def path_regex(pattern: str) -> str:
    """The whole-path expression of a pattern."""
    pattern = pattern.removeprefix("./")
    if pattern.endswith("/**"):
        return "^" + re.escape(pattern[:-3]) + "(?:/.*)?$"
    try:
        glob = segment_regex(pattern)
    except PatternError:
        return "^" + re.escape(posixpath.normpath(pattern)) + "$"
    return f"^(?:{glob}|{re.escape(posixpath.normpath(pattern))})$"


@cache
def _compiled(pattern: str) -> re.Pattern:
    return re.compile(path_regex(pattern), re.S)


def matches(pattern: str, path: str) -> bool:
    return _compiled(pattern).match(posixpath.normpath(path.removeprefix("./"))) is not None


def matches_any(patterns, path: str) -> bool:
    return any(matches(p, path) for p in patterns)


def validate(pattern: str) -> None:
    """Raises PatternError unless the pattern is relative, stays inside, and has ** at its end alone."""
    if not pattern or pattern.startswith("/"):
        raise PatternError(f"{pattern!r} must be a relative path")
    clean = posixpath.normpath(pattern)
    if clean in (".", "..") or clean.startswith("../"):
        raise PatternError(f"{pattern!r} leaves the project")
    if "**" in pattern and not pattern.endswith("/**"):
        raise PatternError(f"{pattern!r} may have ** only as its last segment")
    segment_regex(pattern.removesuffix("/**") if pattern.endswith("/**") else pattern)
