"""Security, as far as the syntax of one file tells."""

from __future__ import annotations

import re

from tarnsieve.goparse.syntax import Node, walk
from tarnsieve.rules.base import Unit, called_name, calls, contains, fields, first_word, hit, name_of, pairs, parents_of, selector, string_of, symbol_of, unit_rule

_SHELLS = frozenset("pwsh.exe pwsh powershell.exe powershell cmd.exe cmd zsh bash sh".split())


def _bodies(u: Unit):
    return (fn for fn in u.functions if fn.Body is not None)


def _keys(literal: Node) -> list[tuple[str, Node]]:
    return [(name_of(e.Key), e) for e in literal.Elts if e.kind == "KeyValueExpr" and name_of(e.Key)]


def _literals(u: Unit, packages: set[str], name: str):
    for n in u.nodes:
        if n.kind == "CompositeLit" and (s := selector(n.Type)) and s[0] in packages and s[1] == name:
            yield n


@unit_rule("security.shell-command", "Shell command", "security", "warning", secondary=("sensitive-data",), tags=("security",), remediation="Run the program itself, with its arguments.")
def shell_command(u: Unit, o):
    packages = u.imports("os/exec", "exec") if u.tree else set()
    for n in u.nodes if packages else ():
        at = 0 if calls(n, packages, "Command") else 1 if calls(n, packages, "CommandContext") else None
        if at is None or len(n.Args) < at + 2:
            continue
        shell, flag = string_of(n.Args[at]), string_of(n.Args[at + 1])
        if shell is not None and flag is not None:
            base = shell.replace("\\", "/").rstrip("/").rpartition("/")[2].lower()
            if base in _SHELLS and flag.lower() in ("-command", "/c", "-lc", "-c"):
                yield hit(u, "exec.Command invokes a shell interpreter", n.pos)


@unit_rule("security.tls-insecure-config", "Weak TLS settings", "security", "warning", "high", tags=("security", "tls"), remediation="Verify certificates; ask for TLS 1.2 at least.")
def tls_insecure(u: Unit, o):
    packages = u.imports("crypto/tls", "tls") if u.tree else set()
    for literal in _literals(u, packages, "Config") if packages else ():
        for key, e in _keys(literal):
            if key == "InsecureSkipVerify" and name_of(e.Value) == "true":
                yield hit(u, "TLS config disables certificate verification", e.pos, field=key, value="true")
            elif key == "MinVersion" and (s := selector(e.Value)) and s[0] in packages and s[1] in ("VersionTLS11", "VersionTLS10", "VersionSSL30"):
                yield hit(u, "TLS config permits obsolete minimum version", e.pos, field=key, value=f"{s[0]}.{s[1]}")


@unit_rule("security.http-client-no-timeout", "Client without a timeout", "security", "advisory", "high", tags=("http", "security"), remediation="Set Timeout.")
def http_client(u: Unit, o):
    packages = u.imports("net/http", "http") if u.tree is not None and u.production else set()
    for n in _literals(u, packages, "Client") if packages else ():
        if "Timeout" not in dict(_keys(n)):
            yield hit(u, "http.Client literal does not set Timeout", n.pos, type="http.Client")


@unit_rule("security.http-server-no-timeout", "Server without a timeout", "security", "advisory", "high", tags=("http", "security"), remediation="Set timeouts on a server value.")
def http_server(u: Unit, o):
    packages = u.imports("net/http", "http") if u.tree is not None and u.production and not u.generated else set()
    for n in u.nodes if packages else ():
        if n.kind == "CompositeLit" and (s := selector(n.Type)) and s[0] in packages and s[1] == "Server":
            if not {"WriteTimeout", "ReadTimeout", "ReadHeaderTimeout"} & {k for k, _ in _keys(n)}:
                yield hit(u, "http.Server starts without explicit timeout controls", n.pos, type="http.Server")
        elif calls(n, packages, "ListenAndServe", "ListenAndServeTLS"):
            yield hit(u, "http server helper starts without explicit timeout controls", n.pos, call=u.slice(n.Fun))


def _creates(x: Node, packages: set[str]) -> bool | None:
    """Whether open flags have O_CREATE; None where they can't be told."""
    if x.kind == "ParenExpr":
        return _creates(x.X, packages)
    if x.kind == "BinaryExpr" and x.Op == "|":
        a, b = _creates(x.X, packages), _creates(x.Y, packages)
        return None if a is None or b is None else a or b
    s = selector(x)
    return s[1] == "O_CREATE" if s and s[0] in packages and s[1].startswith("O_") else None


def go_int(text: str) -> int | None:
    """The value of an integer literal with any base prefix; a leading 0 is octal."""
    digits = text.replace("_", "")
    try:
        return int(digits, 8) if re.fullmatch(r"0\d+", digits) else int(digits, 0)
    except ValueError:
        return None


@unit_rule("security.permissive-file-mode", "Permissive file mode", "security", "advisory", "high", tags=("filesystem", "security"), remediation="Grant only what is needed.")
def permissive_mode(u: Unit, o):
    os_ = u.imports("os", "os") if u.tree is not None and u.production and not u.generated else set()
    if not os_:
        return
    fs = u.imports("io/fs", "fs")
    for n in u.nodes:
        for name, at in (("OpenFile", 2), ("Chmod", 1), ("Mkdir", 1), ("MkdirAll", 1)):
            if not calls(n, os_, name) or len(n.Args) <= at or (name == "OpenFile" and _creates(n.Args[1], os_) is False):
                continue
            x = n.Args[at]
            s = selector(x)
            mode = 0o777 if s and s[1] == "ModePerm" and s[0] in os_ | fs else go_int(x.Value) if x.kind == "BasicLit" and x.Kind == "int" else None
            if mode is not None and (mode & 2 or (name == "OpenFile" and mode & 1)):
                reason = f"{'world-writable' if mode & 2 else 'world-executable file'} (0{mode:o})"
                yield hit(u, "filesystem call uses a permissive file mode", x.pos, call=f"{n.Fun.X.Name}.{name}", mode=u.slice(x), reason=reason)


@unit_rule("security.request-body-without-limit", "Unbounded request body", "security", tags=("http", "security"), remediation="Limit the body before reading all of it.")
def request_body(u: Unit, o):
    http = u.imports("net/http", "http") if u.tree is not None and u.production else set()
    io = u.imports("io", "io") if http else set()
    ioutil = u.imports("io/ioutil", "ioutil") if http else set()
    if not io and not ioutil:
        return
    for fn in _bodies(u):
        requests = {n.Name for f in fields(fn.Type.Params) if f.Type.kind == "StarExpr" and (s := selector(f.Type.X)) and s[0] in http and s[1] == "Request" for n in f.Names} - {"_"}
        if not requests:
            continue

        def body(x: Node) -> str | None:
            s = selector(x)
            return s[0] if s and s[1] == "Body" and s[0] in requests else None

        def limited(x: Node) -> bool:
            return (calls(x, http, "MaxBytesReader") and any(body(a) for a in x.Args)) or (calls(x, io, "LimitReader") and bool(x.Args) and body(x.Args[0]) is not None)

        inner = list(walk(fn.Body, "FuncLit"))
        bounded = {f"{body(a)}.Body" if body(a) else name_of(a) for n in inner for a, b, _ in pairs(n) if limited(b)} - {"_", None}
        for n in inner:
            if (calls(n, io, "ReadAll") or calls(n, ioutil, "ReadAll")) and n.Args:
                x = n.Args[0]
                if body(x) and f"{body(x)}.Body" not in bounded:
                    yield hit(u, "request body is read without a size limit", n.pos, symbol=symbol_of(fn), request=body(x), call=u.slice(n.Fun))


#: Word bounds in ASCII, as linear-time engines have them.
SQL_VERB = re.compile(r"(?<![A-Za-z0-9_])(?:alter|drop|create|delete|update|insert|select)(?![A-Za-z0-9_])", re.I)


def _assigned(body: Node):
    """(name, value) of assignments to names outside function literals, in order."""
    for n in walk(body, "FuncLit"):
        for a, b, _ in pairs(n):
            if (name := name_of(a)) and name != "_":
                yield name, b


@unit_rule("security.sql-string-query", "Query made of strings", "security", tags=("security", "sql"), remediation="Use parameters.")
def sql_string(u: Unit, o):
    if u.tree is None:
        return
    fmt, time = u.imports("fmt", "fmt"), u.imports("time", "time")
    support = u.is_test or "/testutil/" in f"/{u.path}/".replace("\\", "/")

    def kind(x: Node, known: dict[str, str]) -> str | None:
        if x.kind == "Ident":
            return known.get(x.Name)
        made = "fmt.Sprintf" if calls(x, fmt, "Sprintf") else "string-concat" if x.kind == "BinaryExpr" and x.Op == "+" else None
        return made if made and any(SQL_VERB.search(string_of(n) or "") for n in walk(x)) else None

    def schema_name(x: Node) -> bool:
        if not calls(x, fmt, "Sprintf") or len(x.Args) != 2 or not re.fullmatch(r"test(?:_[0-9A-Za-z]+)*_%d", string_of(x.Args[0]) or ""):
            return False
        y = x.Args[1]
        return y.kind == "CallExpr" and not y.Args and y.Fun.kind == "SelectorExpr" and y.Fun.Sel.Name == "UnixNano" and calls(y.Fun.X, time, "Now") and not y.Fun.X.Args

    def bare(x: Node) -> Node:
        return bare(x.X) if x.kind == "ParenExpr" else x

    for fn in _bodies(u):
        known: dict[str, str] = {}
        schemas = set()
        for name, value in _assigned(fn.Body):
            if k := kind(value, known):
                known[name] = k
            if schema_name(value):
                schemas.add(name)
        for n in walk(fn.Body, "FuncLit"):
            m = re.fullmatch(r"(?:Query|QueryRow|Exec)(Context)?", n.Fun.Sel.Name) if n.kind == "CallExpr" and n.Fun.kind == "SelectorExpr" else None
            if not m:
                continue
            at = 1 if m[1] or (len(n.Args) > 1 and _context(n.Args[0])) else 0
            if len(n.Args) <= at or not (k := kind(x := n.Args[at], known)):
                continue
            if support and x.kind == "BinaryExpr" and x.Op == "+" and (string_of(x.X) or "").strip().upper() == "CREATE SCHEMA" and name_of(bare(x.Y)) in schemas:
                continue
            yield hit(u, "SQL query string is constructed dynamically", x.pos, call=m[0], kind=k)


def _context(x: Node) -> bool:
    return name_of(x) in ("ctx", "context") or (x.kind == "CallExpr" and (selector(x.Fun) or ("",))[0] == "context")


@unit_rule("security.archive-path-traversal", "Archive path", "security", tags=("archive", "security"), remediation="Check that the cleaned path stays inside.")
def archive_path(u: Unit, o):
    if u.tree is None or not (u.imports("archive/zip", "zip") or u.imports("archive/tar", "tar")):
        return
    packages = u.imports("path/filepath", "filepath") | u.imports("path", "path")

    def entry(x: Node) -> bool:
        return x.kind == "SelectorExpr" and x.Sel.Name == "Name"

    def guards(x: Node) -> bool:
        name = called_name(x) if x.kind == "CallExpr" else ""
        return name in ("Contains", "HasPrefix", "Rel", "Clean") or any(w in name.lower() for w in ("contain", "within", "sanit", "safe"))

    for fn in _bodies(u):
        assigned = list(_assigned(fn.Body))
        names = {n: v for n, v in assigned if entry(v)}
        for n in walk(fn.Body, "FuncLit"):
            if not calls(n, packages, "Join"):
                continue
            x = next((a if entry(a) else names[a.Name] for a in n.Args if entry(a) or name_of(a) in names), None)
            if x is None:
                continue
            results = {name for name, v in assigned if contains(v, n)}
            if not any(guards(c) and (contains(c, n) or any(name_of(i) in results for i in walk(c))) for c in walk(fn.Body, "FuncLit")):
                yield hit(u, "archive entry path is joined without containment check", n.pos, entry=u.slice(x), missingCheck="containment")


_SECRET = frozenset("otp salt csrf key secret passwd password session nonce token".split())
_HARMLESS = frozenset("test simulation shuffle sample order mock jitter game fuzz fixture dice benchmark bench".split())
_DIGEST = frozenset("token signing signature session secret salt passwd password otp nonce key csrf credential auth".split())
_RANDOM = frozenset("Read NewSource New Intn Int63n Int63 Int31n Int31 Int Float64 Float32".split())


def _random_word(text: str) -> str | None:
    return first_word(text, _SECRET) or (None if first_word(text, _HARMLESS) else first_word(text, frozenset(["state"])))


def _text_word(x: Node, classify) -> str | None:
    for n in walk(x):
        text = n.Name if n.kind == "Ident" else n.Sel.Name if n.kind == "SelectorExpr" else string_of(n)
        if text is not None and (word := classify(text)):
            return word
    return None


def _around(call: Node, parents: dict[int, Node], classify) -> str | None:
    """What the target of the assignment that a call belongs to is named, or else what its arguments are."""
    p = parents.get(id(call))
    while p is not None and p.kind not in ("ReturnStmt", "FuncLit"):
        if p.kind in ("AssignStmt", "ValueSpec"):
            for a, b, _ in pairs(p):
                if contains(b, call) and (word := _text_word(a, classify)):
                    return word
            break
        p = parents.get(id(p))
    return next((w for a in call.Args if (w := _text_word(a, classify))), None)


@unit_rule("security.insecure-random-secret", "Guessable secret", "security", tags=("random", "security"), remediation="Use the cryptographic generator.")
def insecure_random(u: Unit, o):
    packages = u.imports("math/rand", "rand") if u.tree else set()
    for fn in _bodies(u) if packages else ():
        parents, seen = parents_of(fn.Body), set()
        for n in walk(fn.Body, "FuncLit"):
            if calls(n, packages, *_RANDOM):
                word = _random_word(fn.Name.Name) or _around(n, parents, _random_word)
                api = u.slice(n.Fun)
                if word and (n.pos, api) not in seen:
                    seen.add((n.pos, api))
                    yield hit(u, "math/rand used for security-sensitive random value", n.pos, api=api, context=word)


@unit_rule("security.weak-crypto", "Weak cryptography", "security", tags=("crypto", "security"), remediation="Use current primitives and key sizes.")
def weak_crypto(u: Unit, o):
    if u.tree is None:
        return
    known = {name: u.imports(f"crypto/{name}", name) for name in ("md5", "sha1", "des", "rc4", "rsa")}
    if not any(known.values()):
        return

    def digest_word(text: str) -> str | None:
        return first_word(text, _DIGEST)

    for fn in _bodies(u):
        parents = parents_of(fn.Body)
        for n in walk(fn.Body, "FuncLit"):
            found = None
            for name in ("md5", "sha1"):
                if calls(n, known[name], "New", "Sum"):
                    word = digest_word(fn.Name.Name) or (digest_word(fn.Doc.text()) if fn.Doc else None) or _around(n, parents, digest_word)
                    found = (f"{name}.{n.Fun.Sel.Name}", word) if word else None
            if calls(n, known["des"], "NewCipher", "NewTripleDESCipher"):
                found = ("DES" if n.Fun.Sel.Name == "NewCipher" else "3DES", "obsolete-block-cipher")
            elif calls(n, known["rc4"], "NewCipher"):
                found = ("RC4", "obsolete-stream-cipher")
            elif calls(n, known["rsa"], "GenerateKey") and len(n.Args) > 1 and n.Args[1].kind == "BasicLit" and n.Args[1].Value.isdecimal() and int(n.Args[1].Value) < 2048:
                found = ("RSA", f"key-size-{int(n.Args[1].Value)}")
            if found:
                yield hit(u, "weak cryptographic primitive used", n.pos, primitive=found[0], reason=found[1])
