"""Go text for the rules over one file: positives and near misses, and what is found in each, whole."""

from __future__ import annotations

#: Kind of file (test: a file of tests; conf: below c/, where comments of all declarations are asked for), imports, declarations, and the
#: findings as (rule, line, column, symbol, message).
SNIPPETS: list[tuple[str, str, str, list[tuple[str, int, int, str, str]]]] = [
    ('go', 'os/exec', 'func f() { exec.Command("/bin/bash", "-c", s) }', [('security.shell-command', 5, 12, '', 'exec.Command invokes a shell interpreter')]),
    ('go', 'os/exec', 'func f() { exec.Command("git", "-c", s) }', []),
    ('go', 'x:os/exec', 'func f() { x.CommandContext(ctx, "sh", "-lc", s) }', [('security.shell-command', 5, 12, '', 'exec.Command invokes a shell interpreter')]),
    ('go', 'crypto/tls', "var c = tls.Config{InsecureSkipVerify: true}", [('security.tls-insecure-config', 5, 20, '', 'TLS config disables certificate verification')]),
    ('go', 'crypto/tls', "var c = tls.Config{MinVersion: tls.VersionTLS12}", []),
    ('go', 'net/http', "var c = http.Client{}", [('security.http-client-no-timeout', 5, 9, '', 'http.Client literal does not set Timeout')]),
    ('go', 'net/http', "var c = &http.Client{Timeout: t}", []),
    ('go', 'net/http', 'func f() { http.ListenAndServe(":1", nil) }', [('security.http-server-no-timeout', 5, 12, '', 'http server helper starts without explicit timeout controls')]),
    ('go', 'os', 'func f() { os.OpenFile("x", os.O_CREATE|os.O_WRONLY, 0777) }', [('security.permissive-file-mode', 5, 54, '', 'filesystem call uses a permissive file mode')]),
    ('go', 'os', 'func f() { os.OpenFile("x", os.O_RDONLY, 0777) }', []),
    ('go', 'os', 'func f() { os.MkdirAll("x", 0o755) }', []),
    ('go', 'net/http,io', "func f(out http.ResponseWriter, in *http.Request) { b, _ := io.ReadAll(in.Body) }", [('security.request-body-without-limit', 6, 61, 'f', 'request body is read without a size limit')]),
    ('go', 'net/http,io', "func f(out http.ResponseWriter, in *http.Request) { in.Body = http.MaxBytesReader(out, in.Body, 9); b, _ := io.ReadAll(in.Body) }", []),
    ('go', 'fmt', 'func f() { q := fmt.Sprintf("SELECT %s", x); db.Query(q) }', [('security.sql-string-query', 5, 55, '', 'SQL query string is constructed dynamically')]),
    ('go', 'fmt', 'func f() { db.Query("SELECT ?", x) }', []),
    ('go', 'archive/zip,path/filepath', "func f() { p := filepath.Join(d, e.Name); open(p) }", [('security.archive-path-traversal', 6, 17, '', 'archive entry path is joined without containment check')]),
    ('go', 'archive/zip,path/filepath', "func f() { p := filepath.Join(d, e.Name); if isWithin(d, p) { open(p) } }", []),
    ('go', 'math/rand', "func newToken() int { return rand.Intn(9) }", [('security.insecure-random-secret', 5, 30, '', 'math/rand used for security-sensitive random value')]),
    ('go', 'math/rand', "func roll() int { return rand.Intn(6) }", []),
    ('go', 'crypto/md5', "func f() { passwordHash := md5.Sum(b) }", [('security.weak-crypto', 5, 28, '', 'weak cryptographic primitive used')]),
    ('go', 'crypto/md5', "func f() { etag := md5.Sum(b) }", []),
    ('go', 'crypto/rsa', "func f() { rsa.GenerateKey(r, 1024) }", [('security.weak-crypto', 5, 12, '', 'weak cryptographic primitive used')]),
    ('go', 'context', "func f() { g(context.TODO()) }", [('maintainability.context-todo-production', 5, 14, '', 'context.TODO used in production code')]),
    ('go', '', "func f() { for { defer g() } }", [('maintainability.defer-in-loop', 4, 18, 'f', 'defer inside loop delays cleanup until function return')]),
    ('go', '', "func f() { for { func() { defer g() }() } }", []),
    ('go', '', "func f() { _ = readErr }", [('maintainability.ignored-error', 4, 12, '', 'error value is assigned to the blank identifier')]),
    ('go', 'log', 'func f() { log.Fatalf("x") }', [('maintainability.log-fatal-library', 5, 12, 'f', 'library code terminates the process instead of returning an error')]),
    ('go', '', "func f() []*T { for _, v := range xs { out = append(out, &v) } }", [('maintainability.loop-variable-address', 4, 58, 'f', 'range variable "v" address escapes the iteration')]),
    ('go', '', 'func f() { panic("no") }', [('maintainability.production-panic', 4, 12, 'f', 'production code calls panic with a literal message')]),
    ('go', '', '// MustF is.\nfunc MustF() { panic("no") }', []),
    ('go', 'io/ioutil', 'func f() { ioutil.ReadFile("x") }', [('modernisation.ioutil-deprecated', 5, 12, '', 'io/ioutil API has a modern replacement')]),
    ('go', '', "func f() { if a { } }", [('dead-code.empty-block', 4, 17, '', 'empty control-flow block')]),
    ('go', '', "func f() { if a { b() } else { } }", []),
    ('go', '', "func f() { return; g() }", [('dead-code.unreachable-code', 4, 20, '', 'statement is unreachable after return')]),
    ('go', '', "func f() { goto l; l: g() }", []),
    ('test', 'testing', "func TestA(q *testing.T) { }", [('test-quality.empty-test', 5, 6, 'TestA', 'test TestA has an empty body')]),
    ('test', 'testing', "func TestA(q *testing.T) { g() }", [('test-quality.no-failure-path', 5, 6, 'TestA', 'test TestA has no path that calls a testing failure method')]),
    ('test', 'testing', 'func TestA(q *testing.T) { q.Run("x", func(q *testing.T) { q.Fatal(1) }) }', []),
    ('test', 'testing', "func TestA(x *testing.T) { func(x int) { x.Fatal(1) }(2) }", [('test-quality.no-failure-path', 5, 6, 'TestA', 'test TestA has no path that calls a testing failure method')]),
    ('test', 'testing', "func need(q testing.TB) { q.Fatal(1) }", [('test-quality.helper-missing-t-helper', 5, 6, 'need', 'test helper need can fail without calling Helper')]),
    ('test', 'testing', "func need(q testing.TB) { q.Helper(); q.Fatal(1) }", []),
    ('test', 'testing', "func TestA(q *testing.T) { go func() { q.Fatal(1) }() }", [('test-quality.fatal-in-goroutine', 5, 40, 'TestA', 'testing fatal call runs inside a goroutine')]),
    ('test', 'testing', 'func TestA(q *testing.T) { q.Skip("later"); q.Fail() }', [('test-quality.skipped-test', 5, 28, '', 'test contains a skip call')]),
    ('test', 'testing', 'func TestA(q *testing.T) { if short { q.Skip("slow") }; q.Fail() }', []),
    ('test', 'testing', 'func TestA(q *testing.T) { if short { q.Skip("TODO") }; q.Fail() }', [('test-quality.skipped-test', 5, 39, '', 'test contains a skip call')]),
    ('test', 'testing,time', "func TestA(q *testing.T) { time.Sleep(1); q.Fail() }", [('test-quality.sleep-in-test', 6, 28, 'TestA', 'test calls time.Sleep; replace with explicit synchronisation')]),
    ('test', 'testing,os', 'func TestA(q *testing.T) { os.MkdirTemp("", "x"); q.Fail() }', [('test-quality.tempdir-misuse', 6, 28, 'TestA', 'test creates a temp directory without t.TempDir cleanup')]),
    ('test', 'testing', "func TestA(q *testing.T) { for _, c := range cs { q.Run(c.n, func(q *testing.T) { q.Parallel(); q.Fatal(c) }) } }", [('test-quality.parallel-range-capture', 5, 51, '', 'parallel subtest captures range variable "c"')]),
    ('test', 'testing', "func TestA(q *testing.T) { for _, c := range cs { c := c; q.Run(c.n, func(q *testing.T) { q.Parallel(); q.Fatal(c) }) } }", []),
    ('go', '', "// UserId is one.\nvar UserId int", [('naming.acronym-case', 5, 5, 'UserId', 'identifier "UserId" uses mixed-case acronym "Id"; prefer "ID"')]),
    ('go', '', "func f() { tmp := 1 }", [('naming.identifier-quality', 4, 12, 'tmp', 'identifier "tmp" matches placeholder list; rename to describe the role')]),
    ('go', '', "// A is.\ntype A struct { NoColor bool }", [('naming.negated-boolean', 5, 17, 'NoColor', 'identifier "NoColor" uses negated form; rename to the positive equivalent to avoid double-negation at call sites')]),
    ('go', '', "// A is.\ntype A struct { Notify bool }", []),
    ('go', '', "// SRun is.\nfunc SRun() {}", [('naming.package-stutter', 5, 6, 'SRun', 'identifier "SRun" stutters package "s"; rename so call sites read without repetition')]),
    ('go', '', "// GetName is.\nfunc (a *A) GetName() string { return a.name }", [('naming.get-prefix', 5, 13, 'GetName', 'function "GetName" uses Get prefix for an accessor-style receiver method')]),
    ('go', '', "// GetName is.\nfunc (a *A) GetName(k int) string { return a.name }", []),
    ('go', '', "// lenght of it.\nfunc size() {}", [('naming.misspelling', 4, 1, '', '"lenght" looks like a misspelling of "length"')]),
    ('go', '', "func Open() {}", [('docs.exported-symbol-comment', 4, 0, 'Open', 'exported function "Open" has no doc comment')]),
    ('go', '', "var x = 1 //nolint:errcheck", [('docs.suppression-without-rationale', 4, 11, '', 'suppression comment lacks a rationale')]),
    ('go', '', "var x = 1 //nolint:errcheck // it can't fail here", []),
    ('go', 'os/exec', 'func f() { exec.Command("cmd", "/c", s) }', [('security.shell-command', 5, 12, '', 'exec.Command invokes a shell interpreter')]),
    ('go', 'os/exec', 'func f() { exec.Command("powershell.exe", "-Command", s) }', [('security.shell-command', 5, 12, '', 'exec.Command invokes a shell interpreter')]),
    ('go', 'os/exec', 'func f() { exec.Command("sh", "script.sh") }', []),
    ('go', 'os/exec', 'func f() { run.Command("sh", "-c", s) }', []),
    ('go', 'crypto/tls', "var c = tls.Config{MinVersion: tls.VersionTLS10}", [('security.tls-insecure-config', 5, 20, '', 'TLS config permits obsolete minimum version')]),
    ('go', 'crypto/tls', "var c = tls.Config{InsecureSkipVerify: false}", []),
    ('go', 'net/http', "func f() { http.Get(u) }", []),
    ('go', 'net/http', "var c = http.Client{Transport: t}", [('security.http-client-no-timeout', 5, 9, '', 'http.Client literal does not set Timeout')]),
    ('go', 'net/http', 'var s = http.Server{Addr: ":1"}', [('security.http-server-no-timeout', 5, 9, '', 'http.Server starts without explicit timeout controls')]),
    ('go', 'net/http', 'var s = http.Server{Addr: ":1", ReadHeaderTimeout: t}', []),
    ('go', 'os', 'func f() { os.WriteFile("x", b, 0o666) }', []),
    ('go', 'os', 'func f() { os.WriteFile("x", b, 0600) }', []),
    ('go', 'os', 'func f() { os.Mkdir("x", 0o777) }', [('security.permissive-file-mode', 5, 26, '', 'filesystem call uses a permissive file mode')]),
    ('go', 'os', 'func f() { os.Chmod("x", os.ModePerm) }', [('security.permissive-file-mode', 5, 26, '', 'filesystem call uses a permissive file mode')]),
    ('go', 'math/rand', "func f() { sessionKey := rand.Int63() }", [('security.insecure-random-secret', 5, 26, '', 'math/rand used for security-sensitive random value')]),
    ('go', 'crypto/sha1', "func f() { signature := sha1.Sum(b) }", [('security.weak-crypto', 5, 25, '', 'weak cryptographic primitive used')]),
    ('go', 'crypto/des', "func f() { des.NewCipher(k) }", [('security.weak-crypto', 5, 12, '', 'weak cryptographic primitive used')]),
    ('go', 'crypto/rsa', "func f() { rsa.GenerateKey(r, 4096) }", []),
    ('go', 'fmt', 'func f() { db.Exec("DELETE FROM t WHERE id = " + id) }', [('security.sql-string-query', 5, 20, '', 'SQL query string is constructed dynamically')]),
    ('go', 'fmt', 'func f() { db.QueryRow(fmt.Sprintf("SELECT %d", n)) }', [('security.sql-string-query', 5, 24, '', 'SQL query string is constructed dynamically')]),
    ('go', 'context', "func f() { g(context.Background()) }", []),
    ('test', 'context,testing', "func TestA(q *testing.T) { g(context.TODO()); q.Fail() }", []),
    ('go', '', "func f() { for i := range xs { if i > 0 { defer g(i) } } }", [('maintainability.defer-in-loop', 4, 43, 'f', 'defer inside loop delays cleanup until function return')]),
    ('go', '', "func f() { defer g() }", []),
    ('go', '', "func f() { _ = closer.Close() }", []),
    ('go', '', "func f() { _ = err }", [('maintainability.ignored-error', 4, 12, '', 'error value is assigned to the blank identifier')]),
    ('go', '', "func f() { x, _ := readErr() }", []),
    ('go', 'log', 'func f() { log.Panic("x") }', []),
    ('go', 'log', 'func f() { log.Printf("x") }', []),
    ('go', '', "func f() { for i := range xs { v := i; keep(&v) } }", []),
    ('go', '', "func f() { for k, v := range m { ps[k] = &v } }", [('maintainability.loop-variable-address', 4, 42, 'f', 'range variable "v" address escapes the iteration')]),
    ('test', '', 'func TestA() { panic("no") }', []),
    ('go', 'io/ioutil', 'func f() { ioutil.TempDir("", "x") }', [('modernisation.ioutil-deprecated', 5, 12, '', 'io/ioutil API has a modern replacement')]),
    ('go', 'io', "func f() { io.ReadAll(r) }", []),
    ('go', '', "func f() { for { } }", [('dead-code.empty-block', 4, 16, '', 'empty control-flow block')]),
    ('go', '', "func f() { switch x { } }", [('dead-code.empty-block', 4, 21, '', 'empty control-flow block')]),
    ('go', '', "func f() { select { case <-c: } }", []),
    ('go', '', "func f() { for { break; g() } }", [('dead-code.unreachable-code', 4, 25, '', 'statement is unreachable after break')]),
    ('go', '', 'func f() { panic("x"); g() }', [('maintainability.production-panic', 4, 12, 'f', 'production code calls panic with a literal message'), ('dead-code.unreachable-code', 4, 24, '', 'statement is unreachable after panic')]),
    ('go', '', "func f() { if a { return }; g() }", []),
    ('test', 'testing', "func TestA(q *testing.T) { q.Log(1) }", [('test-quality.no-failure-path', 5, 6, 'TestA', 'test TestA has no path that calls a testing failure method')]),
    ('test', 'testing', "func TestA(q *testing.T) { check(q) }", [('test-quality.no-failure-path', 5, 6, 'TestA', 'test TestA has no path that calls a testing failure method')]),
    ('test', 'testing', "func BenchmarkA(b *testing.B) { }", [('test-quality.empty-test', 5, 6, 'BenchmarkA', 'test BenchmarkA has an empty body')]),
    ('test', 'testing', "func TestA(q *testing.T) { go func() { q.Error(1) }() }", []),
    ('test', 'testing', "func TestA(q *testing.T) { go func() { q.FailNow() }() }", [('test-quality.fatal-in-goroutine', 5, 40, 'TestA', 'testing fatal call runs inside a goroutine')]),
    ('test', 'testing', 'func TestA(q *testing.T) { q.Skipf("flaky: %d", 1) }', [('test-quality.no-failure-path', 5, 6, 'TestA', 'test TestA has no path that calls a testing failure method'), ('test-quality.skipped-test', 5, 28, '', 'test contains a skip call')]),
    ('test', 'testing,time', "func TestA(q *testing.T) { time.After(1); q.Fail() }", []),
    ('test', 'testing,io/ioutil', "func TestA(q *testing.T) { d := q.TempDir(); q.Fatal(d) }", []),
    ('test', 'testing,os', 'func TestA(q *testing.T) { d, _ := os.MkdirTemp("", "x"); q.Cleanup(func() { os.RemoveAll(d) }); q.Fail() }', [('test-quality.tempdir-misuse', 6, 36, 'TestA', 'test creates a temp directory without t.TempDir cleanup')]),
    ('go', '', "// JsonUrl is.\ntype JsonUrl string", [('naming.acronym-case', 5, 6, 'JsonUrl', 'identifier "JsonUrl" uses mixed-case acronym "Json"; prefer "JSON"')]),
    ('go', '', "// UserID is.\nvar UserID int", []),
    ('go', '', "func f() { foo, ok := g(), true; use(foo, ok) }", [('naming.identifier-quality', 4, 12, 'foo', 'identifier "foo" matches placeholder list; rename to describe the role')]),
    ('go', '', "func f() { total := 1; use(total) }", []),
    ('go', '', "// DisableCache is.\nvar DisableCache bool", [('naming.negated-boolean', 5, 5, 'DisableCache', 'identifier "DisableCache" uses negated form; rename to the positive equivalent to avoid double-negation at call sites')]),
    ('go', '', "func f(notReady bool) {}", []),
    ('go', '', "// Notation is.\nvar Notation bool", []),
    ('go', '', "// SFinding is.\ntype SFinding struct{}", [('naming.package-stutter', 5, 6, 'SFinding', 'identifier "SFinding" stutters package "s"; rename so call sites read without repetition')]),
    ('go', '', "// Sum is.\nfunc Sum() {}", []),
    ('go', '', "// GetName is.\nfunc (a *A) GetName() (string, error) { return a.name, nil }", [('naming.get-prefix', 5, 13, 'GetName', 'function "GetName" uses Get prefix for an accessor-style receiver method')]),
    ('go', '', "// GetName is.\nfunc GetName() string { return name }", []),
    ('go', '', "// Getter is.\nfunc (a *A) Getter() string { return a.name }", []),
    ('go', '', "// We recieve and seperate it.\nfunc size() {}", [('naming.misspelling', 4, 1, '', '"recieve" looks like a misspelling of "receive"'), ('naming.misspelling', 4, 1, '', '"seperate" looks like a misspelling of "separate"')]),
    ('go', '', "func recieve() {}", [('naming.misspelling', 4, 6, '', '"recieve" looks like a misspelling of "receive"')]),
    ('go', '', "// length of it.\nfunc size() {}", []),
    ('go', '', "type Open struct{}", [('docs.exported-symbol-comment', 4, 0, 'Open', 'exported type "Open" has no doc comment')]),
    ('go', '', "// Open opens.\nfunc Open() {}", []),
    ('go', '', "func open() {}", []),
    ('go', '', "var x = 1 // #nosec G101", [('docs.suppression-without-rationale', 4, 11, '', 'suppression comment lacks a rationale')]),
    ('go', '', "var x = 1 // #nosec G101 -- a fixture without a secret", []),
    ('go', '', "// reason: the value is fixed\nvar x = 1 //nolint:gosec", []),
    ('go', '', 'func f() {\nfor _, item := range sections {\n' + '\tuse(item)\n' * 16 + '}\n}', [('naming.contextual-generic', 5, 8, 'item', 'range variable "item" is generic in a 16-line loop; rename it to describe elements from "sections"')]),
    ('go', '', "func f() {\nfor _, item := range sections {\n\tuse(item)\n}\n}", []),
    ('go', '', 'func f() {\nfor _, section := range sections {\n' + '\tuse(section)\n' * 16 + '}\n}', []),
    ('go', '', 'func f() {\nresult := 1\nout := 2\n' + 'use(result, out)\n' * 48 + '}', [('naming.contextual-generic', 5, 1, 'result', 'accumulator "result" is generic in 52-line function "f"'), ('naming.contextual-generic', 6, 1, 'out', 'accumulator "out" is generic in 52-line function "f"')]),
    ('go', '', 'func f() {\nresult := 1\n' + 'use(result)\n' * 49 + '}', []),
    ('conf', '', "func f() {}\n\n// g goes.\nfunc g() {}", [('docs.comment-rubric', 4, 6, 'f', 'function "f" has no attached comment')]),
    ('conf', '', "type a struct{ Field int }\n\ntype b interface{}\n\ntype c int", [('docs.comment-rubric', 4, 6, 'a', 'struct type "a" has no attached comment'), ('docs.comment-rubric', 6, 6, 'b', 'interface type "b" has no attached comment'), ('docs.comment-rubric', 8, 6, 'c', 'named type "c" has no attached comment'), ('docs.config-field-comment', 4, 16, 'a.Field', 'struct field "Field" on "a" has no doc comment')]),
    ('conf', '', "// a is.\ntype a struct {\n\t// Field says.\n\tField int\n\tOther int // Other says.\n\tother int\n}", []),
    ('conf', '', "var x, y = 1, 2\n\n// z is.\nconst z = 3", [('docs.comment-rubric', 4, 5, 'x', 'package-scope var "x" has no attached comment'), ('docs.comment-rubric', 4, 8, 'y', 'package-scope var "y" has no attached comment')]),
]


def source_of(kind: str, imports: str, body: str) -> str:
    lines = ["package s", ""]
    for x in filter(None, imports.split(",")):
        name, _, path = x.rpartition(":")
        lines.append(f'import {name} "{path}"' if name else f'import "{path}"')
    return "\n".join([*lines, "", body, ""])
