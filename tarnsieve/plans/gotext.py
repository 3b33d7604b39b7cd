"""Queries over Go text made of the rows of part: SQL tells in closed form, or by the case that chose a snippet, what rules must find."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnsieve.goparse.syntax import MAX_DEPTH
from tarnsieve.operators import packages
from tarnsieve.operators.findings import fingerprint
from tarnsieve.plans import parse
from tarnsieve.plans.snippets import SNIPPETS, source_of
from tarnsieve.plans.views import FINGERPRINT_SQL, table
from tarnsieve.rules.base import CATALOGUE, Options
from tarnsieve.shared import cut as persist

GO_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
GO_SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        GO_QUERIES[f.__name__], GO_SQL[f.__name__] = f, sql
        return f

    return register


_METRICS = {"complexity.cyclomatic": ("maxComplexity", 1), "complexity.cognitive": ("maxComplexity", 1), "complexity.npath": ("maxComplexity", 1), "complexity.nesting-depth": ("maxDepth", 1), "size.parameter-count": ("maxParameters", 1), "size.function-length": ("maxLines", 5), "size.file-length": ("maxLines", 8)}


@query("""WITH p AS (SELECT concat('m/f', p_partkey, '.go') AS file, p_size % 9 AS k, p_size % 13 AS n, p_size % 5 AS s FROM part),
m AS (SELECT file, 'complexity.cyclomatic' AS rule_id, 1 + k + s AS metric, 1 AS most FROM p UNION ALL SELECT file, 'complexity.cognitive', k * (k + 1) // 2 + s, 1 FROM p UNION ALL SELECT file, 'complexity.npath', (k + 1) * CAST(power(2, s) AS BIGINT), 1 FROM p
UNION ALL SELECT file, 'complexity.nesting-depth', greatest(k, CASE WHEN s > 0 THEN 1 ELSE 0 END), 1 FROM p UNION ALL SELECT file, 'size.parameter-count', n, 1 FROM p UNION ALL SELECT file, 'size.function-length', 2 * k + 3 + 2 * s, 5 FROM p UNION ALL SELECT file, 'size.file-length', 2 * k + 3 + 2 * s + 3, 8 FROM p)
SELECT file, rule_id, CAST(metric AS BIGINT) AS metric FROM m WHERE metric > most""")
def go_metrics(spark, d):
    """k nested and s sequential ifs and n parameters: every metric has a closed form."""
    t = table(spark, d, "part")
    k, n, s = F.col("p_size") % 9, F.col("p_size") % 13, F.col("p_size") % 5
    text = F.concat(F.lit("package m\n\n// F is made.\nfunc F("), F.repeat(F.lit("a int, "), n), F.lit(") {\n"), F.repeat(F.lit("if a {\n"), k), F.lit("x()\n"), F.repeat(F.lit("}\n"), k), F.repeat(F.lit("if b {\n}\n"), s), F.lit("}\n"))
    files = t.select(F.concat(F.lit("m/f"), F.col("p_partkey").cast("string"), F.lit(".go")).alias("path"), text.alias("text"))
    rules = {id: Options(CATALOGUE[id], {name: most}) for id, (name, most) in _METRICS.items()}
    return parse.raw_findings(parse.parsed(files, rules)).select("file", "rule_id", "metric")


_N = len(SNIPPETS)
_SUFFIX = f"CASE WHEN p_partkey % {_N} IN ({', '.join(str(i) for i, s in enumerate(SNIPPETS) if s[0] == 'test')}) THEN '_test.go' ELSE '.go' END"
_FOLDER = f"CASE WHEN p_partkey % {_N} IN ({', '.join(str(i) for i, s in enumerate(SNIPPETS) if s[0] == 'conf')}) THEN 'c/f' ELSE 's/f' END"


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_FOUND = ", ".join(f"({i}, {_quoted(rule)}, {line}, {col}, {_quoted(symbol)}, {_quoted(message)})" for i, s in enumerate(SNIPPETS) for rule, line, col, symbol, message in s[3])
#: All comments that the rubric may ask for, and documented fields, below c/ alone.
CONF = {"docs.comment-rubric": {"includePaths": ["c/**"], **{f"require{x}Comments": True for x in ("Function", "Const", "Var", "NamedType", "Struct", "Interface")}}, "docs.config-field-comment": {"includePaths": ["c/**"]}}


@query(f"""SELECT file, rule_id, CAST(line AS INT) AS line, CAST(col AS INT) AS col, symbol, message, {FINGERPRINT_SQL} AS fingerprint FROM (
  SELECT concat({_FOLDER}, p_partkey, {_SUFFIX}) AS file, rule_id, line, col, 0 AS end_line, symbol, message FROM part JOIN (VALUES {_FOUND}) AS x(i, rule_id, line, col, symbol, message) ON p_partkey % {_N} = i)""")
def go_snippets(spark, d):
    """Positives or near misses of a rule in each file: findings whole, with their fingerprints."""
    t = table(spark, d, "part").withColumn("i", (F.col("p_partkey") % _N).cast("int"))
    chosen = F.array(*[F.lit(source_of(*s[:3])) for s in SNIPPETS])
    path = F.concat(F.expr(_FOLDER), F.col("p_partkey").cast("string"), F.expr(_SUFFIX))
    files = t.select(path.alias("path"), F.get(chosen, F.col("i")).alias("text"), F.struct(F.lit(1).alias("major"), F.lit(20).alias("minor")).alias("go_version"))
    rules = parse.default_rules() | {r: Options(CATALOGUE[r], {}, o) for r, o in CONF.items()}
    x = parse.raw_findings(parse.parsed(files, rules))
    return x.select("file", "rule_id", "line", "col", "symbol", "message", fingerprint().alias("fingerprint"))


def _package_files(spark, d) -> DataFrame:
    """Files of the package of a brand: some documented, some with an underscore, some of external tests alone."""
    t = table(spark, d, "part")
    brand, key = F.regexp_replace("p_brand", "[^0-9]", ""), F.col("p_partkey").cast("string")
    b = brand.cast("int")
    name = F.concat(F.lit("b"), F.when(b % 5 == 0, "_").otherwise(""), brand)
    doc = F.when((b % 3 == 0) & (F.col("p_size") == 7), F.lit("// Package says.\n")).otherwise("")
    recv = F.when(F.col("p_size") % 10 == 0, "x *T").when(F.col("p_size") % 10 == 1, "t T").otherwise("t *T")
    text = F.concat(doc, F.lit("package "), name, F.lit("\n\nfunc ("), recv, F.lit(") M"), key, F.lit("() {}\n\nfunc u"), key, F.lit("() {}\n\nfunc v"), key, F.lit("() {}\n\nvar w"), key, F.lit(" = v"), key, F.lit("\n"))
    return t.select(F.concat(F.lit("p/"), name, F.lit("/f"), key, F.lit(".go")).alias("path"), text.alias("text"))


_B = "WITH t AS (SELECT CAST(regexp_replace(p_brand, '[^0-9]', '', 'g') AS INT) AS b, p_partkey AS k, p_size AS s FROM part), f AS (SELECT *, concat('b', CASE WHEN b % 5 = 0 THEN '_' ELSE '' END, b) AS package, concat('p/b', CASE WHEN b % 5 = 0 THEN '_' ELSE '' END, b, '/f', k, '.go') AS file FROM t)"


@query(f"""{_B}, m AS (SELECT *, CASE WHEN s % 10 = 0 THEN 'x' ELSE 't' END AS name, CASE WHEN s % 10 = 1 THEN 'value' ELSE 'pointer' END AS form FROM f),
nm AS (SELECT package, name FROM m GROUP BY package, name QUALIFY row_number() OVER (PARTITION BY package ORDER BY count(*) DESC, name) = 1), fm AS (SELECT package, form FROM m GROUP BY package, form QUALIFY row_number() OVER (PARTITION BY package ORDER BY count(*) DESC, form) = 1)
SELECT 'docs.package-comment' AS rule_id, min(file) AS file, CAST(1 AS INT) AS line, concat('package ', package, ' has no package comment') AS message FROM f GROUP BY package HAVING NOT bool_or(b % 3 = 0 AND s = 7)
UNION ALL SELECT 'naming.package-underscore', min(file), CAST(min_by(CASE WHEN b % 3 = 0 AND s = 7 THEN 2 ELSE 1 END, file) AS INT), concat('package name "', package, '" contains an underscore') FROM f WHERE b % 5 = 0 GROUP BY package
UNION ALL SELECT 'dead-code.unused-private-function', file, CAST(CASE WHEN b % 3 = 0 AND s = 7 THEN 6 ELSE 5 END AS INT), concat('private function "u', k, '" is not referenced in package "', package, '"') FROM f
UNION ALL SELECT 'naming.receiver-consistency', file, CAST(CASE WHEN b % 3 = 0 AND s = 7 THEN 4 ELSE 3 END AS INT), CASE WHEN m.name <> nm.name AND m.form <> fm.form THEN 'receiver for type "T" differs from dominant convention' WHEN m.name <> nm.name THEN concat('receiver name "', m.name, '" differs from dominant receiver name "', nm.name, '" for type "T"')
  ELSE concat('receiver form "', m.form, '" differs from dominant receiver form "', fm.form, '" for type "T"') END FROM m JOIN nm USING (package) JOIN fm USING (package) WHERE m.name <> nm.name OR m.form <> fm.form""")
def go_packages(spark, d):
    """The four rules over packages, by group-bys over facts that one parse of each file gave."""
    facts = persist(parse.parsed(_package_files(spark, d), {}))
    parts = [packages.package_comments(facts), packages.package_underscores(facts), packages.unused_functions(facts), packages.receivers(facts)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("rule_id", "file", "line", "message")


_UNEXPECTED = _quoted("expected ';', found 'b'")


@query(f"""WITH f AS (SELECT concat('e/f', p_partkey, '.go') AS path, p_size % 3 AS k, 2 + p_size % 4 AS line, p_size = 50 AS deep FROM part)
SELECT path, CAST(line AS INT) AS line, CAST(1 AS INT) AS col, 'non-declaration statement outside function body' AS message FROM f WHERE k = 0 AND NOT deep
UNION ALL SELECT path, CAST(line + 2 AS INT), CAST(14 AS INT), {_UNEXPECTED} FROM f WHERE k = 0 AND NOT deep
UNION ALL SELECT path, CAST(line AS INT), CAST({15 + MAX_DEPTH} AS INT), 'exceeded max nesting depth' FROM f WHERE deep""")
def go_diagnostics(spark, d):
    """Files with two errors after some lines, or nested beyond measure: all their errors, and nothing else of them."""
    deep, bad = F.col("p_size") == 50, F.col("p_size") % 3 == 0
    good = "func f() { return; g() }\n"
    body = F.when(deep, F.concat(F.lit("func f() { x = "), F.repeat(F.lit("("), F.lit(MAX_DEPTH + 1)))).when(bad, "]\nfunc ok() {}\nfunc f() { a b c }\n").otherwise(good)
    text = F.concat(F.lit("package e\n"), F.repeat(F.lit("\n"), F.col("p_size") % 4), body)
    files = table(spark, d, "part").select(F.concat(F.lit("e/f"), F.col("p_partkey").cast("string"), F.lit(".go")).alias("path"), text.alias("text"))
    wrong = parse.parsed(files, parse.default_rules()).where("error is not null").select("path", F.explode("errors").alias("e"))
    return wrong.select("path", "e.line", "e.col", "e.message")


_SCOPES = ["s/f", "s/examples/f", "s/testdata/f", "cmd/x/f", "t/f", "s/internal/f", "m/f", "example/f", "a/vendor/f", "g/f"]
_SCOPE_PATH = "concat(" + "CASE p_partkey % 10 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_SCOPES)) + " END, CAST(p_partkey AS {0}), CASE WHEN p_partkey % 10 = 4 THEN '_test.go' ELSE '.go' END)"
_SCOPE_RULES = ["maintainability.production-panic", "docs.exported-symbol-comment", "docs.suppression-without-rationale"]


@query(f"""WITH f AS (SELECT {_SCOPE_PATH.format('VARCHAR')} AS file, p_partkey % 10 AS k, CASE WHEN p_partkey % 10 = 9 THEN 1 ELSE 0 END AS head FROM part)
SELECT file, '{_SCOPE_RULES[0]}' AS rule_id, CAST(3 + head AS INT) AS line, CAST(12 AS INT) AS col FROM f WHERE k NOT IN (1, 2, 3, 4, 6, 7)
UNION ALL SELECT file, '{_SCOPE_RULES[1]}', CAST(5 + head AS INT), CAST(0 AS INT) FROM f WHERE k NOT IN (4, 5)
UNION ALL SELECT file, '{_SCOPE_RULES[2]}', CAST(7 + head AS INT), CAST(11 AS INT) FROM f WHERE k NOT IN (8, 9)""")
def go_path_scopes(spark, d):
    """The same text in production code, examples, test data, commands, tests, internal and vendored folders, a main package and a generated file."""
    k = F.col("p_partkey") % 10
    text = F.concat(F.when(k == 9, "// Code generated by hand.\n").otherwise(""), F.lit("package "), F.when(k == 6, "main").otherwise("s"), F.lit('\n\nfunc f() { panic("no") }\n\nfunc Open() {}\n\nvar x = 1 //nolint:errcheck\n'))
    files = table(spark, d, "part").select(F.expr(_SCOPE_PATH.format("STRING")).alias("path"), text.alias("text"))
    return parse.raw_findings(parse.parsed(files, {r: Options(CATALOGUE[r]) for r in _SCOPE_RULES})).select("file", "rule_id", "line", "col")


_QUIET = ["", "//nolint", "//nolint:funlen", "//nolint:gosec,all // why", "//nolint:gosec", "// nolint:funlen", "// says nolint"]


@query(f"SELECT concat('q/f', p_partkey, '.go') AS file, CAST(CASE WHEN p_partkey % {len(_QUIET)} = 0 THEN 3 ELSE 4 END AS INT) AS line, CAST(CASE WHEN p_partkey % {len(_QUIET)} = 0 THEN 3 ELSE 4 END + 2 + p_size % 3 AS INT) AS end_line, CAST(3 + p_size % 3 AS BIGINT) AS metric FROM part WHERE p_partkey % {len(_QUIET)} IN (0, 4, 6) AND p_size % 3 > 0")
def go_quiet_functions(spark, d):
    """Functions longer than allowed, but for those whose comment says nolint for their length."""
    note = F.get(F.array(*[F.lit(x + "\n" if x else "") for x in _QUIET]), (F.col("p_partkey") % len(_QUIET)).cast("int"))
    text = F.concat(F.lit("package q\n\n"), note, F.lit("func f() {\n"), F.repeat(F.lit("\tg()\n"), 1 + F.col("p_size") % 3), F.lit("}\n"))
    files = table(spark, d, "part").select(F.concat(F.lit("q/f"), F.col("p_partkey").cast("string"), F.lit(".go")).alias("path"), text.alias("text"))
    rule = "size.function-length"
    return parse.raw_findings(parse.parsed(files, {rule: Options(CATALOGUE[rule], {"maxLines": 3})})).select("file", "line", "end_line", "metric")
