import pytest

from tarnsieve.goparse.lexer import GoSyntaxError
from tarnsieve.goparse.syntax import MAX_DEPTH, parse, walk

WIDE = """package p
type A[T any, U ~int | string] struct {
	a, b []T
	c    [4]int
	B[T]
	*C
	d.E `x`
	m map[string][]func(int) (a int, err error) // trailing
}
type X [N]int
type Y[P *T, Q any] int
func (r *A[T, U]) M(x, y int, z ...string) (n int, _ error) {
L:
	for i := range 10 {
		if v, ok := m[i]; ok && v == (T{1}) { continue L } else if x := f(); x { goto L }
	}
	switch y := x.(type) { case int, []string: return 1, nil; default: }
	select { case v := <-c: _ = v; case c <- 1: default: }
	for ;; { break }
	for range ch {}
	go func() { defer wg.Done() }()
	a[1:2:3] = []struct{ a int }{{1}, {2}}
	var f = Map[int, string](x, func(a int) string { return "" })
	if (struct{}{}) == x {}
	x.y.z[0].(*T).m(a...)
	ch <- <-c
	p := &T{a: 1, b: map[string]int{"a": 1}}
	var _ [2]int = [...]int{1, 2}
	return
}
func g(a []int, b [3]int, c T[int], d func()) {}
func h([]int, T[int], ...string) chan<- int
"""


def test_everything_parses():
    tree, source, _ = parse(WIDE)
    kinds = {n.kind for n in walk(tree)}
    assert {"RangeStmt", "TypeSwitchStmt", "SelectStmt", "IndexListExpr", "SliceExpr", "LabeledStmt", "Ellipsis", "ChanType", "FuncLit"} <= kinds
    fields = tree.Decls[0].Specs[0].Type.Fields.List
    assert [[n.Name for n in f.Names] for f in fields] == [["a", "b"], ["c"], [], [], [], ["m"]]
    assert fields[-1].Comment.text() == "trailing\n"
    assert tree.Decls[0].Specs[0].TypeParams is not None and tree.Decls[1].Specs[0].TypeParams is None and tree.Decls[2].Specs[0].TypeParams is not None


@pytest.mark.parametrize("text, line, column", [
    ("package p\nfunc {", 2, 6), ("package p\nx", 2, 1), ("package p\nvar s = \"abc\n", 2, 9), ("package p /* x", 1, 11), ("", 1, 1), ("package p\nfunc f() { a b }", 2, 14), ("package p\nvar é = ]", 2, 10),
])
def test_errors_have_places_in_bytes(text, line, column):
    with pytest.raises(GoSyntaxError) as e:
        parse(text)
    assert (e.value.line, e.value.column) == (line, column)


def test_comments_attach():
    tree, _, _ = parse("// Doc.\npackage p\n\n// far\n\n// near\n//nolint:x\nfunc f() {}\n\nvar (\n\t// one\n\ta = 1 // tail\n\tb = 2\n)\n")
    assert tree.Doc.text() == "Doc.\n"
    f, v = tree.Decls
    assert f.Doc.text() == "near\n" and len(f.Doc.comments) == 2
    assert v.Doc is None and v.Specs[0].Doc.text() == "one\n" and v.Specs[1].Doc is None


def test_deep_nesting_and_long_files():
    parse("package p\nfunc f() {\n" + "if a {\n" * 2000 + "}\n" * 2000 + "}\n")
    tree, source, _ = parse("package p\n" + "func f() {}\n" * 5000)
    assert len(tree.Decls) == 5000 and source.line(tree.Decls[-1].pos) == 5001


def _errors(text):
    with pytest.raises(GoSyntaxError) as e:
        parse(text)
    return [(x.line, x.column) for x in e.value.all]


def test_all_errors_of_a_file():
    assert _errors("package p\n]\nfunc ok() {}\n]\nfunc f() { a b c }\nfunc g() { d e }\n") == [(2, 1), (4, 1), (5, 14), (6, 14)]
    assert len(_errors("package p\n" + "]\nfunc f() {}\n" * 50)) == 11
    assert _errors("package p\n] ]\n") == [(2, 1)]
    assert _errors("package p\nimport \"a\"\nvar x int\nimport \"b\"\nfunc ok() {}\n") == [(4, 1)]


@pytest.mark.parametrize("text", ["func f() { x = " + "(" * 20_000, "func f() { " + "if a { " * 20_000, "var x " + "*" * 20_000 + "int", "var x = " + "f(" * 20_000, "var x = " + "[]T{{" * 20_000, "var x = " + "func() { " * 20_000, "var x = a" + "[a" * 20_000, "var x = " + "!" * 20_000 + "a", "type T " + "struct { a " * 20_000, "var x " + "map[int]" * 20_000 + "int"])
def test_nesting_has_a_bound(text):
    with pytest.raises(GoSyntaxError, match="nesting"):
        parse("package p\n" + text)


def test_long_chains_are_fine():
    parse("package p\nvar x = 1" + " + 1" * 30_000)
    parse("package p\nfunc f() { if a {} " + "else if b {} " * 5_000 + "}")
    parse("package p\nvar x = a" + ".b()" * 20_000)


def test_open_parentheses_are_a_loop():
    """A level of parentheses costs no frames: with few of them left, thousands of levels parse as they did."""
    import sys

    depth, limit = 0, sys.getrecursionlimit()
    frame = sys._getframe()
    while frame:
        depth, frame = depth + 1, frame.f_back
    sys.setrecursionlimit(depth + 200)
    try:
        n = 5000
        tree, _, _ = parse("package e\n\nvar x = a * " + "(" * n + "b" + ").c" * n + " + d\n")
        e = tree.Decls[0].Specs[0].Values[0]
        assert (e.Op, e.X.Op, e.Y.Name) == ("+", "*", "d")
        x, seen = e.X.Y, []
        while x.kind != "Ident":
            assert x.kind == "SelectorExpr" and x.Sel.Name == "c" and x.X.kind == "ParenExpr"
            seen.append(x.X.pos)
            x = x.X.X
        assert seen == list(range(23, 23 + n)) and x.Name == "b"
        with pytest.raises(GoSyntaxError) as wrong:
            parse("package e\n\nfunc f() { x = -" + "(" * (MAX_DEPTH + 1) + "\nfunc g() { a b }\n")
        assert [(w.line, w.column, w.message) for w in wrong.value.all] == [(3, 15 + MAX_DEPTH, "exceeded max nesting depth"), (4, 14, "expected ';', found 'b'")]
    finally:
        sys.setrecursionlimit(limit)
