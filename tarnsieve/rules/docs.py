"""Documentation and naming, as far as one file tells."""

from __future__ import annotations

import re

from tarnsieve.functions.paths import matches_any
from tarnsieve.goparse.lexer import CommentGroup
from tarnsieve.goparse.syntax import Node, walk
from tarnsieve.rules.base import Unit, exported, field_count, fields, has_doc, hit, letter_tokens, name_of, name_tokens, receiver_base, symbol_of, unit_rule

# documentation


@unit_rule("docs.exported-symbol-comment", "Undocumented symbol", "documentation", options={"ignoreInternalPackages": True}, remediation="Say what the symbol is for, beginning with its name.")
def exported_symbol_comment(u: Unit, o):
    if u.tree is None or u.is_test or (o["ignoreInternalPackages"] and "internal" in u.path.split("/")[:-1]):
        return
    for d in u.tree.Decls:
        if d.kind == "FuncDecl":
            method = d.Recv is not None and bool(d.Recv.List)
            if exported(d.Name.Name) and not has_doc(d.Doc) and (not method or exported(receiver_base(d) or "")):
                kind = "method" if d.Recv is not None else "function"
                yield hit(u, f'exported {kind} "{d.Name.Name}" has no doc comment', d.pos, column=False, end=0, symbol=symbol_of(d), kind=kind)
        elif d.Tok != "import" and not has_doc(d.Doc):
            for s in d.Specs:
                if has_doc(s.Doc):
                    continue
                for name in [s.Name] if s.kind == "TypeSpec" else s.Names:
                    if exported(name.Name):
                        yield hit(u, f'exported {d.Tok} "{name.Name}" has no doc comment', name.pos, column=False, symbol=name.Name, kind=d.Tok)


_STOP = frozenset("no not those these that this its it being been be were was are is onto into as with from to for by at on in of but or and the an a".split())


def comment_tokens(text: str) -> list[str]:
    words = "".join(c if c.isalpha() or c.isdigit() else " " for c in text).split()
    return [t.lower() for w in words for t in name_tokens(w)]


def _plain(text: str) -> str:
    return " ".join("".join(c.lower() if c.isalpha() or c.isdigit() else " " for c in text).split())


def useful(group: CommentGroup | None, symbol: str, beyond: int = 0) -> bool:
    """Whether a comment says more than the symbol's name."""
    if group is None or not group.text().split():
        return False
    text = group.text()
    return _plain(text) != _plain(symbol) and (beyond <= 0 or len(set(comment_tokens(text)) - _STOP - set(comment_tokens(symbol))) >= beyond)


_REQUIRED = ("PackageSummary", "FunctionComments", "NamedTypeComments", "StructComments", "InterfaceComments", "ConstComments", "VarComments")
RUBRIC_OPTIONS = {"includePaths": [], "excludePaths": [], "ignoreTests": False, "minWordsBeyondSymbol": 0, **{f"require{x}": False for x in _REQUIRED}}


def rubric_applies(o, path: str) -> bool:
    if (o["includePaths"] and not matches_any(o["includePaths"], path)) or matches_any(o["excludePaths"], path):
        return False
    return not (o["ignoreTests"] and path.endswith("_test.go"))


@unit_rule("docs.comment-rubric", "Comment rubric", "documentation", thresholds={"minPackageCommentLines": 1}, options=RUBRIC_OPTIONS, tags=("comments", "documentation", "rubric"), remediation="Attach a comment that says more than the name does.")
def comment_rubric(u: Unit, o):
    if u.tree is None or not rubric_applies(o, u.path):
        return
    beyond = int(o["minWordsBeyondSymbol"] or 0)
    for d in u.tree.Decls:
        if d.kind == "FuncDecl":
            symbol = symbol_of(d)
            if o["requireFunctionComments"] and not useful(d.Doc, symbol, beyond):
                kind = "method" if d.Recv is not None else "function"
                yield hit(u, f'{kind} "{symbol}" has no attached comment', d.Name.pos, symbol=symbol, kind=kind)
        elif d.Tok == "type":
            for s in d.Specs:
                kind = {"StructType": "struct type", "InterfaceType": "interface type"}.get(s.Type.kind, "named type")
                wanted = o["requireNamedTypeComments"] or (s.Type.kind == "StructType" and o["requireStructComments"]) or (s.Type.kind == "InterfaceType" and o["requireInterfaceComments"])
                shared = useful(d.Doc, "" if len(d.Specs) > 1 else s.Name.Name, 0 if len(d.Specs) > 1 else beyond)
                if wanted and not useful(s.Doc, s.Name.Name, beyond) and not shared:
                    yield hit(u, f'{kind} "{s.Name.Name}" has no attached comment', s.Name.pos, symbol=s.Name.Name, kind=kind)
        elif d.Tok in ("const", "var") and not u.is_test and o[f"require{d.Tok.title()}Comments"]:
            for s in d.Specs:
                several = len(d.Specs) > 1 or len(s.Names) > 1
                for n in s.Names:
                    if not useful(s.Doc, n.Name, beyond) and not useful(d.Doc, "" if several else n.Name, 0 if several else beyond):
                        yield hit(u, f'package-scope {d.Tok} "{n.Name}" has no attached comment', n.pos, symbol=n.Name, kind=d.Tok)


@unit_rule("docs.config-field-comment", "Undocumented setting", "documentation", options={"includePaths": [], "excludePaths": []}, tags=("comments", "documentation", "struct-fields"), remediation="Document every exported field of these structs.")
def config_field_comment(u: Unit, o):
    if u.tree is None or not matches_any(o["includePaths"], u.path) or matches_any(o["excludePaths"], u.path):
        return
    for d in u.tree.Decls:
        for s in d.Specs if d.kind == "GenDecl" and d.Tok == "type" else ():
            for f in fields(s.Type.Fields) if s.Type.kind == "StructType" else ():
                for n in f.Names:
                    if exported(n.Name) and not useful(f.Doc, n.Name) and not useful(f.Comment, n.Name):
                        yield hit(u, f'struct field "{n.Name}" on "{s.Name.Name}" has no doc comment', n.pos, symbol=f"{s.Name.Name}.{n.Name}", kind="field", type=s.Name.Name)


_CODE = re.compile(r"G\d+\Z")


def _reason(text: str) -> bool:
    return any(len(w.encode()) >= 3 and not _CODE.match(w) and any(c.isalpha() for c in w) for w in (x.strip("()[]{} \t.,;:#/-") for x in text.split()))


def _directive(text: str) -> tuple[str, str] | None:
    return next(((name, text[len(mark) :]) for mark, name in (("nolint", "nolint"), ("#nosec", "nosec")) if text.startswith(mark)), None)


def _explained(rest: str) -> bool:
    rest = rest.strip()
    if rest.startswith(":"):
        m = re.search(r"[ \t/]", rest[1:])
        rest = rest[1 + m.start() :] if m else ""
    words = rest.split()
    codes = next((i for i, w in enumerate(words) if not _CODE.match(w)), len(words))
    return _reason((" ".join(words[codes:]) if codes else rest).lstrip(" \t:-/"))


def _rationale(text: str) -> bool:
    m = re.match(r"(?:reason|rationale|because):", text.strip(), re.I)
    return m is not None and _reason(text.strip()[m.end() :])


@unit_rule("docs.suppression-without-rationale", "Unexplained suppression", "documentation", tags=("comments", "documentation"), remediation="Say after the suppression why it is right.")
def suppression_without_rationale(u: Unit, o):
    if not u.text or u.generated or "/vendor/" in "/" + u.path.replace("\\", "/"):
        return
    message = "suppression comment lacks a rationale"
    if u.tree is None:
        lines = u.text.split("\n")
        bare = [re.sub(r"^(?://|#)\s*", "", x.strip()).strip() for x in lines]
        for i, line in enumerate(lines):
            found = _directive(line.strip())
            if found and not _explained(found[1]) and not any(_rationale(bare[j]) for j in (i - 1, i + 1) if 0 <= j < len(lines)):
                yield hit(u, message, line=i + 1, directive=found[0])
        return
    comments = [(_clean(c.text), c.pos) for g in u.tree.Comments for c in g.comments]
    for i, (text, pos) in enumerate(comments):
        found = _directive(text)
        if found and not _explained(found[1]):
            at = u.line(pos)
            if not any(abs(u.line(comments[j][1]) - at) <= 1 and _rationale(comments[j][0]) for j in (i - 1, i + 1) if 0 <= j < len(comments)):
                yield hit(u, message, pos, directive=found[0])


def _clean(text: str) -> str:
    return text.removeprefix("//").strip().removeprefix("/*").removesuffix("*/").strip()


# naming

ACRONYMS = "OS CPU GPU IP DNS SSL TLS UDP TCP CLI SQL ASCII SARIF YAML HTML CSS OAUTH AWS JWT API XML ID JSON URL HTTP".split()[::-1]


@unit_rule("naming.acronym-case", "Mixed-case acronym", "naming", options={"acronyms": ACRONYMS, "allow": []}, tags=("go-style", "naming"), remediation="Write initialisms in one case.")
def acronym_case(u: Unit, o):
    if u.tree is None or u.generated:
        return
    known = {x.strip().lower() for x in o["acronyms"]} - {""} - {x.strip().lower() for x in o.abbreviations}
    allow = set(o["allow"])
    for n in u.nodes:
        names = [n.Name] if n.kind in ("TypeSpec", "FuncDecl") else n.Names if n.kind in ("ValueSpec", "Field") else ()
        for name in names:
            if name.Name != "_" and name.Name not in allow:
                bad = next((t for t in name_tokens(name.Name) if t.lower() in known and t != t.upper() and t != t.lower()), None)
                if bad:
                    yield hit(u, f'identifier "{name.Name}" uses mixed-case acronym "{bad}"; prefer "{bad.upper()}"', name.pos, symbol=name.Name, token=bad)


@unit_rule("naming.contextual-generic", "Generic name far from its meaning", "naming", thresholds={"minBodyLines": 15, "minFunctionLines": 50}, options={"genericNames": ["v", "elem", "entry", "value", "item"], "accumulatorNames": ["result", "out"], "requireMultiple": True}, tags=("naming",), remediation="Name what the value holds.")
def contextual_generic(u: Unit, o):
    if u.tree is None or u.is_test or u.generated:
        return
    generic, accumulators = ({x.strip().lower() for x in o[k]} for k in ("genericNames", "accumulatorNames"))
    for fn in u.functions:
        if fn.Body is None:
            continue
        inner = list(walk(fn.Body, "FuncLit"))
        for n in inner:
            if n.kind == "RangeStmt" and (name := name_of(n.Value)) and name != "_" and name.lower() in generic:
                lines = max(0, u.line(n.Body.Rbrace) - u.line(n.Body.Lbrace) - 1)
                if lines > o.threshold("minBodyLines"):
                    source = _range_name(n.X)
                    yield hit(u, f'range variable "{name}" is generic in a {lines}-line loop; rename it to describe elements from "{source}"', n.Value.pos, symbol=name, bodyLines=lines, range=source)
        size = u.line(fn.end) - u.line(fn.pos) + 1
        if size > o.threshold("minFunctionLines"):
            found = [x for n in inner if n.kind == "AssignStmt" and n.Tok == ":=" for x in n.Lhs if (name_of(x) or "_").lower() in accumulators]
            if len(found) > 1 or not o["requireMultiple"]:
                for x in found:
                    yield hit(u, f'accumulator "{x.Name}" is generic in {size}-line function "{fn.Name.Name}"', x.pos, symbol=x.Name, functionLines=size)


def _range_name(x: Node) -> str:
    while x.kind not in ("Ident", "SelectorExpr"):
        x = {"CallExpr": lambda: x.Fun, "IndexExpr": lambda: x.X, "IndexListExpr": lambda: x.X, "StarExpr": lambda: x.X, "ParenExpr": lambda: x.X}.get(x.kind, lambda: None)()
        if x is None:
            return "range expression"
    return x.Name if x.kind == "Ident" else x.Sel.Name


@unit_rule("naming.get-prefix", "Get prefix", "modernisation", options={"excludePaths": [], "excludeNames": []}, tags=("go-style", "naming"), remediation="Name the method after what it returns.")
def get_prefix(u: Unit, o):
    if u.tree is None or u.generated or matches_any(o["excludePaths"], u.path):
        return
    for fn in u.functions:
        name, results = fn.Name.Name, fields(fn.Type.Results)
        n = field_count(fn.Type.Results)
        if name.startswith("Get") and name[3:4].isupper() and name not in o["excludeNames"] and fn.Recv is not None and not field_count(fn.Type.Params):
            if n == 1 or (n == 2 and name_of(results[-1].Type) == "error"):
                yield hit(u, f'function "{name}" uses Get prefix for an accessor-style receiver method', fn.Name.pos, symbol=name, method=name)


@unit_rule("naming.identifier-quality", "Placeholder name", "naming", options={"placeholderNames": "stuff thing todo obj temp tmp baz bar foo".split()}, tags=("naming",), remediation="Name the role.")
def identifier_quality(u: Unit, o):
    if u.tree is None or u.is_test:
        return
    bad = {x.strip().lower() for x in o["placeholderNames"]} - {""}
    for n in u.nodes:
        for x in n.Lhs if n.kind == "AssignStmt" and n.Tok == ":=" else n.Names if n.kind == "ValueSpec" else ():
            if (name := name_of(x)) and name != "_" and name.lower() in bad:
                yield hit(u, f'identifier "{name}" matches placeholder list; rename to describe the role', x.pos, symbol=name, identifier=name)


MISSPELLINGS = dict(x.split("=") for x in """wierd=weird wich=which wether=whether useable=usable untill=until thier=their succesful=successful sucess=success seperated=separated seperate=separate
responce=response regsiter=register recieves=receives recieved=received recieve=receive priviledge=privilege prefered=preferred paramaters=parameters paramater=parameter occurence=occurrence occured=occurred
mantain=maintain lenght=length langauge=language intialized=initialized intialize=initialize intial=initial independant=independent existance=existence enviroment=environment effecient=efficient dervied=derived
definately=definitely conatin=contain comparsion=comparison begining=beginning agressive=aggressive adress=address accomodate=accommodate""".split())  # fmt: skip


@unit_rule("naming.misspelling", "Misspelling", "naming", options={"extra": {}, "ignore": []}, tags=("naming",), remediation="Correct the word, or list it as meant.")
def misspelling(u: Unit, o):
    if u.tree is None:
        return
    extra = {k.strip().lower(): v.strip() for k, v in o["extra"].items()}
    known = {**MISSPELLINGS, **{k: v for k, v in extra.items() if k and v}}
    for word in o["ignore"]:
        known.pop(word.strip().lower(), None)
    texts: list[tuple[str, int]] = []

    def comments(group):
        texts.extend((c.text, c.pos) for c in (group.comments if group else ()))

    def field(f):
        comments(f.Doc)
        texts.extend((n.Name, n.pos) for n in f.Names)
        if f.Tag is not None:
            texts.append((f.Tag.Value, f.Tag.pos))

    comments(u.tree.Doc)
    for d in u.tree.Decls:
        comments(d.Doc)
        if d.kind == "FuncDecl":
            texts.append((d.Name.Name, d.Name.pos))
            for f in fields(d.Type.Params):
                field(f)
            continue
        for s in d.Specs:
            if s.kind == "TypeSpec":
                texts.append((s.Name.Name, s.Name.pos))
                for f in fields(s.Type.Fields) if s.Type.kind == "StructType" else ():
                    field(f)
            elif s.kind == "ValueSpec":
                comments(s.Doc)
                texts.extend((n.Name, n.pos) for n in s.Names)
    seen = set()
    for text, pos in texts:
        for word in letter_tokens(text):
            if word in known and (pos, word) not in seen:
                seen.add((pos, word))
                yield hit(u, f'"{word}" looks like a misspelling of "{known[word]}"', pos, token=word, suggestion=known[word])


@unit_rule("naming.negated-boolean", "Negated boolean", "naming", options={"prefixes": "Suppress Without Disallow Disable Not No".split(), "allowList": "Notebook Notation NoCopy Now Notice Notify NoOp".split(), "scope": "exported"}, tags=("go-style", "naming"), remediation="Name the positive.")
def negated_boolean(u: Unit, o):
    if u.tree is None:
        return
    prefixes = [x.strip() for x in o["prefixes"] if x.strip()]
    prefixes += [p[:1].lower() + p[1:] for p in prefixes]
    scope = o["scope"] if o["scope"] in ("all", "locals") else "exported"

    def check(names):
        for n in names:
            if n.Name != "_" and (scope == "all" or exported(n.Name) == (scope == "exported")) and n.Name not in o["allowList"]:
                if any(n.Name.startswith(p) and n.Name[len(p) : len(p) + 1].isupper() for p in prefixes):
                    yield hit(u, f'identifier "{n.Name}" uses negated form; rename to the positive equivalent ' 'to avoid double-negation at call sites', n.pos, symbol=n.Name, identifier=n.Name)

    def struct(t):
        for f in fields(t.Fields):
            if name_of(f.Type) == "bool":
                yield from check(f.Names)
            if f.Type.kind == "StructType":
                yield from struct(f.Type)

    for d in u.tree.Decls:
        if d.kind == "FuncDecl":
            results = fields(d.Type.Results)
            if len(results) == 1 and name_of(results[0].Type) == "bool":
                yield from check([d.Name])
            for f in fields(d.Type.Params):
                if name_of(f.Type) == "bool":
                    yield from check(f.Names)
            if scope != "exported":
                for n in walk(d.Body):
                    if n.kind == "ValueSpec" and name_of(n.Type) == "bool":
                        yield from check(n.Names)
            continue
        for s in d.Specs:
            if s.kind == "ValueSpec" and name_of(s.Type) == "bool":
                yield from check(s.Names)
            elif s.kind == "TypeSpec" and s.Type.kind == "StructType":
                yield from struct(s.Type)


@unit_rule("naming.package-stutter", "Stutter", "naming", options={"allowStutter": ["Finding", "Config"]}, tags=("go-style", "naming"), remediation="Drop the package's name from the identifier.")
def package_stutter(u: Unit, o):
    if u.tree is None:
        return
    package = u.tree.Name.Name.lower()
    for d in u.tree.Decls:
        if d.kind == "FuncDecl":
            names = [d.Name] if d.Recv is None else []
        else:
            names = [n for s in d.Specs for n in ([s.Name] if s.kind == "TypeSpec" else s.Names if s.kind == "ValueSpec" else [])]
        for n in names:
            rest = n.Name[len(package) :]
            if exported(n.Name) and n.Name not in o["allowStutter"] and n.Name.lower().startswith(package) and (not rest or "A" <= rest[0] <= "Z"):
                yield hit(u, f'identifier "{n.Name}" stutters package "{package}"; rename so call sites read without repetition', n.pos, symbol=n.Name, package=package)
