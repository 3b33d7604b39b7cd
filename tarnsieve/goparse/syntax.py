"""Syntax trees of Go files: a recursive descent over the tokens of lexer.scan(), by the language specification."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

from tarnsieve.goparse.lexer import CommentGroup, GoSyntaxError, Source, Token, scan

sys.setrecursionlimit(max(sys.getrecursionlimit(), 100_000))

#: Levels of nesting beyond which a file is refused, and errors after which the rest of a file is left alone.
MAX_DEPTH, MAX_ERRORS = 10_000, 10

#: kind -> its parts in source order, which is the order of walks.
PARTS = {
    "File": "Name Decls", "FuncDecl": "Recv Name Type Body", "GenDecl": "Specs", "ImportSpec": "Name Path", "ValueSpec": "Names Type Values", "TypeSpec": "Name TypeParams Type",
    "FieldList": "List", "Field": "Names Type Tag", "Ident": "", "BasicLit": "", "Ellipsis": "Elt", "FuncLit": "Type Body", "CompositeLit": "Type Elts", "ParenExpr": "X", "SelectorExpr": "X Sel",
    "IndexExpr": "X Index", "IndexListExpr": "X Indices", "SliceExpr": "X Low High Max", "TypeAssertExpr": "X Type", "CallExpr": "Fun Args", "StarExpr": "X", "UnaryExpr": "X", "BinaryExpr": "X Y",
    "KeyValueExpr": "Key Value", "ArrayType": "Len Elt", "StructType": "Fields", "FuncType": "TypeParams Params Results", "InterfaceType": "Methods", "MapType": "Key Value", "ChanType": "Value",
    "DeclStmt": "Decl", "EmptyStmt": "", "LabeledStmt": "Label Stmt", "ExprStmt": "X", "SendStmt": "Chan Value", "IncDecStmt": "X", "AssignStmt": "Lhs Rhs", "GoStmt": "Call", "DeferStmt": "Call",
    "ReturnStmt": "Results", "BranchStmt": "Label", "BlockStmt": "List", "IfStmt": "Init Cond Body Else", "CaseClause": "List Body", "SwitchStmt": "Init Tag Body", "TypeSwitchStmt": "Init Assign Body",
    "CommClause": "Comm Body", "SelectStmt": "Body", "ForStmt": "Init Cond Post Body", "RangeStmt": "Key Value X Body",
}
_PARTS = {k: tuple(v.split()) for k, v in PARTS.items()}
_BACKWARDS = {k: v[::-1] for k, v in _PARTS.items()}
_PRECEDENCE = {"||": 1, "&&": 2, **dict.fromkeys(("==", "!=", "<", "<=", ">", ">="), 3), **dict.fromkeys(("+", "-", "|", "^"), 4), **dict.fromkeys(("*", "/", "%", "<<", ">>", "&", "&^"), 5)}
_ASSIGN = frozenset(["=", ":=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", "&^="])
_LITERALS = frozenset(["int", "float", "imag", "char", "string"])


class Node:
    """kind, pos and end (offsets), and the parts that PARTS names."""

    def __init__(self, kind: str, pos: int, end: int, **parts):
        self.kind, self.pos, self.end = kind, pos, end
        self.__dict__.update(parts)

    def __repr__(self) -> str:
        return f"{self.kind}@{self.pos}"

    def children(self) -> Iterator["Node"]:
        d = self.__dict__
        for name in _PARTS[self.kind]:
            x = d.get(name)
            if x is None:
                continue
            if isinstance(x, list):
                yield from x
            else:
                yield x


def inspect(root: Node | None, visit: Callable[[Node], bool | None]) -> None:
    """Calls visit for root and what is below it, in source order; below a node for which it returns False nothing is visited."""
    if root is None:
        return
    stack = [root]
    while stack:
        node = stack.pop()
        if visit(node) is not False:
            stack.extend(reversed(list(node.children())))


def walk(root: Node | None, *prune: str) -> Iterator[Node]:
    """root and what is below it, in source order; nodes of the kinds in prune and what is below them are left out."""
    stack = [root] if root is not None else []
    while stack:
        node = stack.pop()
        if node.kind not in prune:
            yield node
            d = node.__dict__
            for name in _BACKWARDS[node.kind]:
                x = d.get(name)
                if x is None:
                    continue
                if isinstance(x, list):
                    stack.extend(reversed(x))
                else:
                    stack.append(x)


class Parser:
    def __init__(self, source: Source):
        self.source = source
        self.tokens, self.groups = scan(source)
        self.i, self.level, self.depth = 0, 0, 0
        self.tok: Token = self.tokens[0]
        self.last_end = 0

    # tokens

    def next(self) -> Token:
        t = self.tok
        self.last_end = t.pos + (len(t.text) if t.text != "\n" else 0)
        self.i += 1
        self.tok = self.tokens[min(self.i, len(self.tokens) - 1)]
        return t

    def peek(self, n: int = 1) -> str:
        return self.tokens[min(self.i + n, len(self.tokens) - 1)].kind

    def fail(self, wanted: str):
        got = "newline" if self.tok.text == "\n" else self.tok.text or self.tok.kind
        raise self.source.fail(self.tok.pos, f"expected {wanted}, found {got!r}")

    def enter(self) -> None:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise self.source.fail(self.tok.pos, "exceeded max nesting depth")

    def expect(self, kind: str) -> Token:
        if self.tok.kind != kind:
            self.fail(f"'{kind}'")
        return self.next()

    def got(self, kind: str) -> bool:
        if self.tok.kind == kind:
            self.next()
            return True
        return False

    def semicolon(self) -> None:
        if self.tok.kind not in (")", "}", "EOF"):
            self.expect(";")

    def ident(self) -> Node:
        t = self.expect("ident")
        return Node("Ident", t.pos, self.last_end, Name=t.text)

    def literal(self) -> Node:
        t = self.next()
        return Node("BasicLit", t.pos, self.last_end, Kind=t.kind, Value=t.text)

    # declarations

    def file(self) -> Node:
        doc = self.tok.lead
        self.expect("package")
        name = self.ident()
        self.semicolon()
        decls, imports = [], []
        while self.tok.kind == "import":
            d = self.gen_decl("import", self.import_spec)
            decls.append(d)
            imports += d.Specs
            self.semicolon()
        errors: list[GoSyntaxError] = []
        while self.tok.kind != "EOF" and len(errors) <= MAX_ERRORS:
            if self.got(";"):
                continue
            try:
                decls.append(self.top_level())
                if self.tok.kind != "EOF":
                    self.expect(";")
            except GoSyntaxError as e:
                if not errors or errors[-1].line != e.line:  # a second one of a line most often comes from the first
                    errors.append(e)
                self.resume()
        if errors:
            errors[0].all = errors
            raise errors[0]
        return Node("File", 0, len(self.source.text), Doc=doc, Name=name, Decls=decls, Imports=imports, Comments=self.groups)

    def top_level(self) -> Node:
        if self.tok.kind == "func":
            return self.func_decl()
        if self.tok.kind in ("const", "var", "type"):
            return self.declaration()
        raise self.source.fail(self.tok.pos, "imports must appear before other declarations" if self.tok.kind == "import" else "non-declaration statement outside function body")

    def resume(self) -> None:
        """After an error: on to the next declaration that begins a line."""
        self.level = self.depth = 0
        begins = ("func", "const", "var", "type")
        if self.tok.kind not in begins and self.tok.kind != "EOF":
            self.next()
        while self.tok.kind != "EOF" and not (self.tok.kind in begins and self.source.column(self.tok.pos) == 1):
            self.next()

    def declaration(self) -> Node:
        kind = self.tok.kind
        return self.gen_decl(kind, self.type_spec if kind == "type" else self.value_spec)

    def gen_decl(self, keyword: str, spec) -> Node:
        doc, pos = self.tok.lead, self.expect(keyword).pos
        specs = []
        if self.got("("):
            while self.tok.kind not in (")", "EOF"):
                specs.append(spec(self.tok.lead))
                self.semicolon()
            self.expect(")")
        else:
            specs.append(spec(None))
        return Node("GenDecl", pos, self.last_end, Tok=keyword, Doc=doc, Specs=specs)

    def import_spec(self, doc) -> Node:
        pos, name = self.tok.pos, None
        if self.tok.kind == "ident":
            name = self.ident()
        elif self.tok.kind == ".":
            t = self.next()
            name = Node("Ident", t.pos, self.last_end, Name=".")
        if self.tok.kind != "string":
            self.fail("import path")
        return Node("ImportSpec", pos, 0, Doc=doc, Name=name, Path=self.literal())

    def value_spec(self, doc) -> Node:
        pos, names = self.tok.pos, self.ident_list()
        typ = None if self.tok.kind in ("=", ";", ")", "}", "EOF") else self.type()
        values = self.expr_list() if self.got("=") else []
        return Node("ValueSpec", pos, self.last_end, Doc=doc, Names=names, Type=typ, Values=values)

    def ident_list(self) -> list[Node]:
        names = [self.ident()]
        while self.got(","):
            names.append(self.ident())
        return names

    def type_spec(self, doc) -> Node:
        pos, name, params = self.tok.pos, self.ident(), None
        if self.tok.kind == "[" and self.type_params_follow():
            params = self.type_params()
        alias = self.got("=")
        typ = self.type()
        return Node("TypeSpec", pos, self.last_end, Doc=doc, Name=name, TypeParams=params, Alias=alias, Type=typ)

    def type_params_follow(self) -> bool:
        """Whether the bracket after a type's name opens type parameters and not an array's length."""
        if self.peek() != "ident":
            return False
        after = self.peek(2)
        if after in ("ident", ",", "interface", "~", "func", "map", "chan", "["):
            return True
        if after in ("*", "("):  # [P *T, ...] against [N * 2]
            depth, j = 0, 1
            while (k := self.peek(j)) != "EOF":
                depth += (k in "([{") - (k in ")]}")
                if k == "," and depth == 0:
                    return True
                if depth < 0:
                    return False
                j += 1
        return False

    def type_params(self) -> Node:
        pos, fields = self.expect("[").pos, []
        while self.tok.kind != "]":
            names = self.ident_list()
            fields.append(Node("Field", names[0].pos, 0, Doc=None, Comment=None, Names=names, Type=self.constraint(), Tag=None))
            if not self.got(","):
                break
        self.expect("]")
        return Node("FieldList", pos, self.last_end, List=fields)

    def constraint(self) -> Node:
        def term() -> Node:
            if self.tok.kind == "~":
                t = self.next()
                x = self.type()
                return Node("UnaryExpr", t.pos, x.end, Op="~", X=x)
            return self.type()

        x = term()
        while self.got("|"):
            y = term()
            x = Node("BinaryExpr", x.pos, y.end, Op="|", X=x, Y=y)
        return x

    def func_decl(self) -> Node:
        doc, pos, recv = self.tok.lead, self.expect("func").pos, None
        if self.tok.kind == "(":
            recv = self.params()
            if len(recv.List) != 1:
                raise self.source.fail(recv.pos, "method has no receiver" if not recv.List else "method has multiple receivers")
        name, tparams = self.ident(), None
        if self.tok.kind == "[":
            tparams = self.type_params()
        typ = self.signature(pos, tparams)
        body = None
        if self.tok.kind == "{":
            level, self.level = self.level, 0
            body = self.block()
            self.level = level
        return Node("FuncDecl", pos, self.last_end, Doc=doc, Recv=recv, Name=name, Type=typ, Body=body)

    def signature(self, pos: int, tparams: Node | None = None) -> Node:
        params = self.params()
        results = None
        if self.tok.kind == "(":
            results = self.params()
        elif self.type_starts():
            t = self.type()
            results = Node("FieldList", t.pos, t.end, List=[Node("Field", t.pos, t.end, Doc=None, Comment=None, Names=[], Type=t, Tag=None)])
        return Node("FuncType", pos, self.last_end, TypeParams=tparams, Params=params, Results=results)

    def type_starts(self) -> bool:
        return self.tok.kind in ("ident", "[", "struct", "*", "func", "interface", "map", "chan", "<-", "(")

    def params(self) -> Node:
        pos = self.expect("(").pos
        level, self.level = self.level, self.level + 1
        entries: list[tuple[Node | None, Node | None]] = []
        while self.tok.kind not in (")", "EOF"):
            entries.append(self.param())
            if not self.got(","):
                break
        self.expect(")")
        self.level = level
        fields = []
        if any(name is not None and typ is not None for name, typ in entries):
            names: list[Node] = []
            for name, typ in entries:
                if name is None:
                    if typ.kind != "Ident":
                        raise self.source.fail(typ.pos, "mixed named and unnamed parameters")
                    names.append(typ)
                    continue
                names.append(name)
                if typ is not None:
                    fields.append(Node("Field", names[0].pos, typ.end, Doc=None, Comment=None, Names=names, Type=typ, Tag=None))
                    names = []
            if names:
                raise self.source.fail(names[0].pos, "mixed named and unnamed parameters")
        else:
            fields = [Node("Field", t.pos, t.end, Doc=None, Comment=None, Names=[], Type=t, Tag=None) for _, t in entries]
        return Node("FieldList", pos, self.last_end, List=fields)

    def param(self) -> tuple[Node | None, Node | None]:
        """(name, type) or (None, type); a lone name counts as a type until the list is known."""
        if self.tok.kind == "ident":
            if self.peek() in ("ident", "...", "*", "func", "map", "chan", "struct", "interface", "(", "<-"):
                return self.ident(), self.variadic()
            if self.peek() == "[":
                name = self.ident()
                typ = self.array_or_instance(name)
                if typ.kind == "ArrayType":
                    return name, typ
                return None, typ
        return None, self.variadic()

    def variadic(self) -> Node:
        if self.tok.kind == "...":
            t = self.next()
            x = self.type()
            return Node("Ellipsis", t.pos, x.end, Elt=x)
        return self.type()

    def array_or_instance(self, name: Node) -> Node:
        """After a name that "[" follows: the array type of a field of that name, or an instance of the generic type of that name."""
        pos = self.expect("[").pos
        if self.got("]"):
            elt = self.type()
            return Node("ArrayType", pos, elt.end, Len=None, Elt=elt)
        level, self.level = self.level, self.level + 1
        if self.tok.kind == "...":
            t = self.next()
            args = [Node("Ellipsis", t.pos, self.last_end, Elt=None)]
        else:
            args = [self.type_or_expr()]
            while self.got(",") and self.tok.kind != "]":
                args.append(self.type_or_expr())
        self.level = level
        self.expect("]")
        if len(args) == 1 and self.type_starts():
            elt = self.type()
            return Node("ArrayType", pos, elt.end, Len=args[0], Elt=elt)
        return self.indexed(name, args)

    def indexed(self, x: Node, args: list[Node]) -> Node:
        if len(args) == 1:
            return Node("IndexExpr", x.pos, self.last_end, X=x, Index=args[0])
        return Node("IndexListExpr", x.pos, self.last_end, X=x, Indices=args)

    # types

    def type(self) -> Node:
        self.enter()
        x = self.type_of()
        self.depth -= 1
        return x

    def type_of(self) -> Node:
        k, pos = self.tok.kind, self.tok.pos
        if k == "ident":
            return self.type_name()
        if k == "[":
            self.next()
            if self.got("]"):
                length = None
            else:
                level, self.level = self.level, self.level + 1
                if self.tok.kind == "...":
                    t = self.next()
                    length = Node("Ellipsis", t.pos, self.last_end, Elt=None)
                else:
                    length = self.expr()
                self.level = level
                self.expect("]")
            elt = self.type()
            return Node("ArrayType", pos, elt.end, Len=length, Elt=elt)
        if k == "*":
            self.next()
            x = self.type()
            return Node("StarExpr", pos, x.end, X=x)
        if k == "(":
            self.next()
            x = self.type()
            self.expect(")")
            return Node("ParenExpr", pos, self.last_end, X=x)
        if k == "struct":
            return self.struct_type()
        if k == "interface":
            return self.interface_type()
        if k == "func":
            self.next()
            return self.signature(pos)
        if k == "map":
            self.next()
            self.expect("[")
            key = self.type()
            self.expect("]")
            value = self.type()
            return Node("MapType", pos, value.end, Key=key, Value=value)
        if k in ("chan", "<-"):
            self.next()
            if k == "<-":
                self.expect("chan")
            else:
                self.got("<-")
            value = self.type()
            return Node("ChanType", pos, value.end, Value=value)
        self.fail("type")

    def type_name(self) -> Node:
        x = self.ident()
        if self.tok.kind == ".":
            self.next()
            sel = self.ident()
            x = Node("SelectorExpr", x.pos, sel.end, X=x, Sel=sel)
        if self.tok.kind == "[" and self.peek() != "]":
            self.next()
            level, self.level = self.level, self.level + 1
            args = [self.type()]
            while self.got(",") and self.tok.kind != "]":
                args.append(self.type())
            self.level = level
            self.expect("]")
            return self.indexed(x, args)
        return x

    def struct_type(self) -> Node:
        pos = self.expect("struct").pos
        open_, fields = self.expect("{").pos, []
        while self.tok.kind not in ("}", "EOF"):
            doc, at, names = self.tok.lead, self.tok.pos, []
            if self.tok.kind == "ident" and self.peek() in (".", "string", ";", "}"):
                typ = self.type_name()
            elif self.tok.kind == "ident" and self.peek() == "[":
                name = self.ident()
                typ = self.array_or_instance(name)
                names = [name] if typ.kind == "ArrayType" else []
            elif self.tok.kind == "ident":
                names = self.ident_list()
                typ = self.type()
            else:
                typ = self.type()
            tag = self.literal() if self.tok.kind == "string" else None
            fields.append(Node("Field", at, self.last_end, Doc=doc, Comment=None, Names=names, Type=typ, Tag=tag))
            self.semicolon()
        self.expect("}")
        for f in fields:
            f.Comment = self.trailing(f.end)
        return Node("StructType", pos, self.last_end, Fields=Node("FieldList", open_, self.last_end, List=fields))

    def trailing(self, end: int) -> CommentGroup | None:
        """The comment that begins after end on its line, with nothing but a semicolon between."""
        lo, hi = 0, len(self.groups)
        while lo < hi:
            mid = (lo + hi) // 2
            if self.groups[mid].comments[0].pos < end:
                lo = mid + 1
            else:
                hi = mid
        if lo < len(self.groups):
            between = self.source.text[end : self.groups[lo].comments[0].pos]
            if "\n" not in between and not between.strip(" \t\r;"):
                return self.groups[lo]
        return None

    def interface_type(self) -> Node:
        pos = self.expect("interface").pos
        open_, methods = self.expect("{").pos, []
        while self.tok.kind not in ("}", "EOF"):
            doc, at, names = self.tok.lead, self.tok.pos, []
            if self.tok.kind == "ident" and self.peek() == "(":
                names = [self.ident()]
                typ = self.signature(at)
            else:
                typ = self.constraint()
            methods.append(Node("Field", at, self.last_end, Doc=doc, Comment=None, Names=names, Type=typ, Tag=None))
            self.semicolon()
        self.expect("}")
        return Node("InterfaceType", pos, self.last_end, Methods=Node("FieldList", open_, self.last_end, List=methods))

    def type_or_expr(self) -> Node:
        return self.expr()

    # expressions

    def expr_list(self) -> list[Node]:
        out = [self.expr()]
        while self.got(","):
            out.append(self.expr())
        return out

    def expr(self, least: int = 1) -> Node:
        return self.binary(self.unary(), least)

    def binary(self, x: Node, least: int) -> Node:
        while (p := _PRECEDENCE.get(self.tok.kind, 0)) >= least:
            op = self.next().kind
            y = self.expr(p + 1)
            x = Node("BinaryExpr", x.pos, y.end, Op=op, X=x, Y=y)
        return x

    def unary(self) -> Node:
        k, pos = self.tok.kind, self.tok.pos
        if k in ("+", "-", "!", "^", "&", "~"):
            self.enter()
            self.next()
            x = self.unary()
            self.depth -= 1
            return Node("UnaryExpr", pos, x.end, Op=k, X=x)
        if k == "<-":
            if self.peek() == "chan":
                return self.primary(self.type())
            self.enter()
            self.next()
            x = self.unary()
            self.depth -= 1
            return Node("UnaryExpr", pos, x.end, Op=k, X=x)
        if k == "*":
            self.enter()
            self.next()
            x = self.unary()
            self.depth -= 1
            return Node("StarExpr", pos, x.end, X=x)
        return self.primary(self.operand())

    def operand(self) -> Node:
        k, pos = self.tok.kind, self.tok.pos
        if k == "ident":
            return self.ident()
        if k in _LITERALS:
            return self.literal()
        if k == "(":
            return self.parens()
        if k == "func":
            self.next()
            typ = self.signature(pos)
            if self.tok.kind == "{":
                level, self.level = self.level, 0
                body = self.block()
                self.level = level
                return Node("FuncLit", pos, self.last_end, Type=typ, Body=body)
            return typ
        if k in ("[", "struct", "map", "chan", "interface"):
            return self.type()
        self.fail("operand")

    def parens(self) -> Node:
        """An expression in parentheses; a run of open ones is a loop, not a recursion."""
        begin = self.i
        while self.tok.kind == "(":
            self.i += 1
            self.tok = self.tokens[self.i]  # there is an EOF
        if self.depth + self.i - begin > MAX_DEPTH:
            self.i = begin + MAX_DEPTH - self.depth
            self.tok = self.tokens[self.i]
            raise self.source.fail(self.tok.pos, "exceeded max nesting depth")
        self.depth += self.i - begin
        outer, inner = self.level, max(self.level, 0)
        opened = [(t.pos, inner + n if n else outer) for n, t in enumerate(self.tokens[begin : self.i])]
        self.level, self.last_end = inner + len(opened), opened[-1][0] + 1
        x = self.expr()
        while True:
            pos, self.level = opened.pop()
            self.depth -= 1
            self.expect(")")
            x = Node("ParenExpr", pos, self.last_end, X=x)
            if not opened:
                return x
            x = self.binary(self.primary(x), 1)

    def primary(self, x: Node) -> Node:
        while True:
            k = self.tok.kind
            if k == ".":
                self.next()
                if self.got("("):
                    typ = None if self.got("type") else self.type()
                    self.expect(")")
                    x = Node("TypeAssertExpr", x.pos, self.last_end, X=x, Type=typ)
                else:
                    sel = self.ident()
                    x = Node("SelectorExpr", x.pos, sel.end, X=x, Sel=sel)
            elif k == "[":
                self.enter()
                x = self.index_or_slice(x)
                self.depth -= 1
            elif k == "(":
                x = self.call(x)
            elif k == "{" and self.literal_type(x):
                x = self.composite(x)
            else:
                return x

    def literal_type(self, x: Node) -> bool:
        if x.kind in ("ArrayType", "StructType", "MapType"):
            return True
        if self.level < 0:
            return False
        if x.kind in ("IndexExpr", "IndexListExpr"):
            x = x.X
        return x.kind == "Ident" or (x.kind == "SelectorExpr" and x.X.kind == "Ident")

    def index_or_slice(self, x: Node) -> Node:
        self.expect("[")
        level, self.level = self.level, max(self.level, 0) + 1
        parts: list[Node | None] = [None, None, None]
        colons = 0
        if self.tok.kind != ":":
            parts[0] = self.type_or_expr()
        if self.tok.kind == ",":
            args = [parts[0]]
            while self.got(",") and self.tok.kind != "]":
                args.append(self.type_or_expr())
            self.level = level
            self.expect("]")
            return self.indexed(x, args)
        while self.tok.kind == ":" and colons < 2:
            self.next()
            colons += 1
            if self.tok.kind not in (":", "]"):
                parts[colons] = self.expr()
        self.level = level
        self.expect("]")
        if colons:
            return Node("SliceExpr", x.pos, self.last_end, X=x, Low=parts[0], High=parts[1], Max=parts[2])
        return Node("IndexExpr", x.pos, self.last_end, X=x, Index=parts[0])

    def call(self, fun: Node) -> Node:
        self.enter()
        self.expect("(")
        level, self.level = self.level, max(self.level, 0) + 1
        args = []
        while self.tok.kind not in (")", "EOF"):
            args.append(self.expr())
            self.got("...")
            if not self.got(","):
                break
        self.level = level
        self.depth -= 1
        self.expect(")")
        return Node("CallExpr", fun.pos, self.last_end, Fun=fun, Args=args)

    def composite(self, typ: Node | None) -> Node:
        self.enter()
        open_ = self.expect("{").pos
        level, self.level = self.level, 0
        elts = []
        while self.tok.kind not in ("}", "EOF"):
            x = self.element()
            if self.got(":"):
                y = self.element()
                x = Node("KeyValueExpr", x.pos, y.end, Key=x, Value=y)
            elts.append(x)
            if not self.got(","):
                break
        self.level = level
        self.depth -= 1
        close = self.tok.pos
        self.expect("}")
        return Node("CompositeLit", typ.pos if typ else open_, self.last_end, Type=typ, Elts=elts, Lbrace=open_, Rbrace=close)

    def element(self) -> Node:
        return self.composite(None) if self.tok.kind == "{" else self.expr()

    # statements

    def block(self) -> Node:
        self.enter()
        pos = self.expect("{").pos
        stmts = self.stmt_list()
        self.depth -= 1
        close = self.tok.pos
        self.expect("}")
        return Node("BlockStmt", pos, self.last_end, List=stmts, Lbrace=pos, Rbrace=close)

    def stmt_list(self) -> list[Node]:
        out = []
        while self.tok.kind not in ("}", "case", "default", "EOF"):
            s = self.stmt()
            if s is not None:
                out.append(s)
            if self.tok.kind in ("}", "case", "default"):
                break
            self.expect(";")
        return out

    def stmt(self) -> Node | None:
        k, pos = self.tok.kind, self.tok.pos
        if k in ("const", "type", "var"):
            d = self.declaration()
            return Node("DeclStmt", d.pos, d.end, Decl=d)
        if k in ("go", "defer"):
            self.next()
            x = self.expr()
            if x.kind != "CallExpr":
                raise self.source.fail(x.pos, f"expression in {k} must be function call")
            return Node("GoStmt" if k == "go" else "DeferStmt", pos, x.end, Call=x)
        if k == "return":
            self.next()
            results = [] if self.tok.kind in (";", "}") else self.expr_list()
            return Node("ReturnStmt", pos, self.last_end, Results=results)
        if k in ("break", "continue", "goto", "fallthrough"):
            self.next()
            label = self.ident() if k != "fallthrough" and self.tok.kind == "ident" else None
            return Node("BranchStmt", pos, self.last_end, Tok=k, Label=label)
        if k == "{":
            return self.block()
        if k == "if":
            return self.if_stmt()
        if k == "switch":
            return self.switch_stmt()
        if k == "select":
            return self.select_stmt()
        if k == "for":
            return self.for_stmt()
        if k == ";":
            # one written by hand is a statement; one at a line's end after nothing can't be
            return Node("EmptyStmt", pos, pos + 1) if self.tok.text == ";" else Node("EmptyStmt", pos, pos)
        if k == "}":
            return None
        return self.simple(True)

    def simple(self, labels: bool = False, ranges: bool = False) -> Node:
        pos = self.tok.pos
        lhs = self.expr_list()
        k = self.tok.kind
        if k in _ASSIGN:
            self.next()
            if ranges and self.tok.kind == "range" and k in ("=", ":="):
                self.next()
                return Node("RangeStmt", pos, 0, Key=lhs[0], Value=lhs[1] if len(lhs) > 1 else None, X=self.expr(), Body=None, Tok=k)
            rhs = self.expr_list()
            return Node("AssignStmt", pos, self.last_end, Lhs=lhs, Rhs=rhs, Tok=k)
        if len(lhs) > 1:
            self.fail("1 expression")
        x = lhs[0]
        if k == ":" and labels and x.kind == "Ident":
            self.next()
            if self.tok.kind == "}":
                s = Node("EmptyStmt", self.tok.pos, self.tok.pos)
            else:
                s = self.stmt()
            return Node("LabeledStmt", pos, s.end, Label=x, Stmt=s)
        if k == "<-":
            self.next()
            y = self.expr()
            return Node("SendStmt", pos, y.end, Chan=x, Value=y)
        if k in ("++", "--"):
            self.next()
            return Node("IncDecStmt", pos, self.last_end, X=x, Tok=k)
        return Node("ExprStmt", pos, x.end, X=x)

    def condition(self, s: Node | None, what: str) -> Node | None:
        if s is None:
            return None
        if s.kind != "ExprStmt":
            raise self.source.fail(s.pos, f"cannot use statement as {what}")
        return s.X

    def if_stmt(self) -> Node:
        self.enter()
        pos = self.expect("if").pos
        level, self.level = self.level, -1
        init = cond = None
        if self.tok.kind == "{":
            raise self.source.fail(self.tok.pos, "missing condition in if statement")
        if self.tok.kind != ";":
            cond = self.simple()
        if self.tok.kind == ";":
            self.next()
            init, cond = cond, self.simple()
        self.level = level
        cond = self.condition(cond, "value")
        body, other = self.block(), None
        if self.got("else"):
            if self.tok.kind == "if":
                other = self.if_stmt()
            elif self.tok.kind == "{":
                other = self.block()
            else:
                self.fail("if statement or block")
        self.depth -= 1
        return Node("IfStmt", pos, self.last_end, Init=init, Cond=cond, Body=body, Else=other)

    def switch_stmt(self) -> Node:
        pos = self.expect("switch").pos
        level, self.level = self.level, -1
        init = tag = None
        if self.tok.kind != "{":
            if self.tok.kind != ";":
                tag = self.simple()
            if self.tok.kind == ";":
                self.next()
                init, tag = tag, None
                if self.tok.kind != "{":
                    tag = self.simple()
        self.level = level
        by_type = tag is not None and any(x.kind == "TypeAssertExpr" and x.Type is None for x in ([tag.X] if tag.kind == "ExprStmt" else tag.Rhs if tag.kind == "AssignStmt" and tag.Tok == ":=" else []))
        open_, clauses = self.expect("{").pos, []
        while self.tok.kind in ("case", "default"):
            at, exprs = self.tok.pos, []
            if self.next().kind == "case":
                exprs = [self.type() if by_type else self.expr()]
                while self.got(","):
                    exprs.append(self.type() if by_type else self.expr())
            self.expect(":")
            body = self.stmt_list()
            clauses.append(Node("CaseClause", at, self.last_end, List=exprs, Body=body))
        close = self.tok.pos
        self.expect("}")
        body = Node("BlockStmt", open_, self.last_end, List=clauses, Lbrace=open_, Rbrace=close)
        if by_type:
            return Node("TypeSwitchStmt", pos, self.last_end, Init=init, Assign=tag, Body=body)
        return Node("SwitchStmt", pos, self.last_end, Init=init, Tag=self.condition(tag, "tag"), Body=body)

    def select_stmt(self) -> Node:
        pos = self.expect("select").pos
        open_, clauses = self.expect("{").pos, []
        while self.tok.kind in ("case", "default"):
            at = self.tok.pos
            comm = self.simple() if self.next().kind == "case" else None
            self.expect(":")
            body = self.stmt_list()
            clauses.append(Node("CommClause", at, self.last_end, Comm=comm, Body=body))
        close = self.tok.pos
        self.expect("}")
        return Node("SelectStmt", pos, self.last_end, Body=Node("BlockStmt", open_, self.last_end, List=clauses, Lbrace=open_, Rbrace=close))

    def for_stmt(self) -> Node:
        pos = self.expect("for").pos
        level, self.level = self.level, -1
        init = cond = post = None
        loop = None
        if self.tok.kind == "range":
            self.next()
            loop = Node("RangeStmt", pos, 0, Key=None, Value=None, X=self.expr(), Tok="", Body=None)
        elif self.tok.kind != "{":
            if self.tok.kind != ";":
                cond = self.simple(ranges=True)
            if cond is not None and cond.kind == "RangeStmt":
                loop = cond
            elif self.tok.kind == ";":
                self.next()
                init, cond = cond, None
                if self.tok.kind != ";":
                    if self.tok.kind == "{":
                        self.fail("for loop condition")
                    cond = self.simple()
                self.expect(";")
                if self.tok.kind != "{":
                    post = self.simple()
        self.level = level
        body = self.block()
        if loop is not None:
            loop.pos, loop.end, loop.Body = pos, self.last_end, body
            return loop
        return Node("ForStmt", pos, self.last_end, Init=init, Cond=self.condition(cond, "condition"), Post=post, Body=body)


def parse(text: str) -> tuple[Node, Source, list[Token]]:
    """The File node, its source and tokens. Raises GoSyntaxError for the first error, which names all of them."""
    source = Source(text)
    p = Parser(source)
    try:
        return p.file(), source, p.tokens
    except RecursionError:
        raise source.fail(p.tok.pos, "exceeded max nesting depth") from None
