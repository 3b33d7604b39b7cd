"""The reference operators as queries over whole tables, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnsieve.operators import composites, findings as fnd, scoring, secrets, suppression
from tarnsieve.plans import views
from tarnsieve.plans.gotext import GO_QUERIES, GO_SQL
from tarnsieve.functions import text as tx
from tarnsieve.rules.base import CATALOGUE
from tarnsieve.shared import cut as persist
from tarnsieve.sinks import formats, report
from tarnsieve.sources import tree
from tarnsieve.sources.patches import hunks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_V = f"v AS ({views.FINGERPRINTED_SQL})"
_B = f"b AS ({views.BASELINE_SQL})"
_C = f"c AS ({views.CHANGED_SQL})"
_COUNTED = "rule_id NOT LIKE 'design.%'"
_DETAILS = f"""d AS (SELECT pillar, CAST(greatest(0, 100 - sum({views.PENALTY_SQL})) AS BIGINT) AS score, count(*) AS findings, count(*) FILTER (severity = 'advisory') AS advisory,
  count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'error') AS error, CAST(sum({views.PENALTY_SQL}) AS DOUBLE) AS penalty FROM v WHERE {_COUNTED} GROUP BY pillar)"""


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _findings(spark, d) -> DataFrame:
    return views.findings(spark, d)


# findings


@query(f"WITH {_V} SELECT rule_id, file, line, col, fingerprint FROM v")
def findings_fingerprint(spark, d):
    return _findings(spark, d).select("rule_id", "file", "line", "col", "fingerprint")


@query(f"WITH {_V} SELECT CAST(row_number() OVER (ORDER BY file, line, col, rule_id, message, fingerprint) AS BIGINT) AS place, file, line, col, rule_id, message, fingerprint FROM v ORDER BY place LIMIT 1000")
def findings_first_in_order(spark, d):
    """The head of the report (a top-k report of 1000 rows): the total order as one take-ordered, numbered afterwards."""
    top = fnd.ordered(_findings(spark, d)).limit(1000)
    w = Window.orderBy("file", "line", "col", "rule_id", "message", "fingerprint")
    return top.withColumn("place", F.row_number().over(w).cast("long")).select("place", "file", "line", "col", "rule_id", "message", "fingerprint")


@query(f"""WITH {_V} SELECT rule_id, file, line, fingerprint, CASE WHEN rule_id = 'size.function-length' AND file LIKE '%\\_test.go' ESCAPE '\\' THEN 'advisory' ELSE CASE rule_id WHEN 'design.god-function' THEN 'advisory' ELSE 'warning' END END AS severity,
  CASE WHEN rule_id = 'security.shell-command' OR (rule_id = 'size.function-length' AND file LIKE '%\\_test.go' ESCAPE '\\') THEN 'medium' ELSE 'high' END AS confidence,
  CASE rule_id WHEN 'design.god-function' THEN 'size,complexity' WHEN 'security.shell-command' THEN 'sensitive-data' ELSE '' END AS secondary FROM v""")  # fmt: skip
def findings_enriched(spark, d):
    """Definitions joined to what rules said, test files' size findings eased."""
    raw = views.view(spark, d, views.FINDINGS_SQL, "lineitem").drop("pillar", "severity", "confidence")
    raw = raw.withColumn("metadata", F.create_map(F.lit("testFile"), F.col("file").endswith("_test.go").cast("string")))
    x = fnd.enrich(raw, fnd.definitions(spark, CATALOGUE.values()))
    return x.select("rule_id", "file", "line", "fingerprint", "severity", "confidence", F.array_join("secondary_pillars", ",").alias("secondary"))


@query(f"WITH {_V} SELECT rule_id, file, line, severity, confidence, CAST({views.PENALTY_SQL} AS BIGINT) AS penalty FROM v")
def findings_penalty(spark, d):
    return _findings(spark, d).select("rule_id", "file", "line", "severity", "confidence", fnd.penalty().alias("penalty"))


# scores


@query(f"WITH {_V}, {_DETAILS} SELECT pillar, score, {views.GRADE_SQL.format('score')} AS grade, findings, advisory, warning, error, penalty FROM d")
def score_pillars(spark, d):
    return scoring.pillar_details(_findings(spark, d))


@query(f"""WITH {_V}, {_DETAILS}, s AS (SELECT coalesce(CAST(sum(score) // count(*) AS BIGINT), 100) AS composite, count(*) AS n, coalesce(string_agg(pillar, ',' ORDER BY pillar), '') AS contributing FROM d)
SELECT composite, {views.GRADE_SQL.format('composite')} AS grade, contributing, CASE WHEN n = 0 THEN 'nothing that counts was found' WHEN n <= 2 THEN concat('driven by ', n, CASE WHEN n = 1 THEN ' pillar' ELSE ' pillars' END, '; others have nothing above their thresholds') END AS caveat FROM s""")
def score_composite(spark, d):
    x = scoring.composite(scoring.pillar_details(_findings(spark, d)))
    return x.select("composite", "grade", F.array_join("contributing_pillars", ",").alias("contributing"), "caveat")


_FILES = f"""fs AS (SELECT file, CAST(sum({views.PENALTY_SQL}) AS BIGINT) AS penalty, count(*) AS findings, max(metric) FILTER (rule_id = 'complexity.cyclomatic') AS max_cyclomatic FROM v WHERE {_COUNTED} GROUP BY file)"""


@query(f"WITH {_V}, {_FILES} SELECT file, penalty, findings, {views.GRADE_SQL.format('greatest(0, 100 - penalty)')} AS grade, max_cyclomatic FROM fs")
def score_files(spark, d):
    return scoring.file_scores(_findings(spark, d))


@query(f"WITH {_V}, {_FILES} SELECT file, penalty, findings, {views.GRADE_SQL.format('greatest(0, 100 - penalty)')} AS grade, max_cyclomatic FROM fs ORDER BY penalty DESC, file LIMIT 5")
def score_top_offenders(spark, d):
    return scoring.top_offenders(_findings(spark, d))


@query(f"""WITH {_V}, bins(bin) AS (VALUES ('1-5'), ('6-10'), ('11-15'), ('16-20'), ('21+')) SELECT bin, count(metric) AS n FROM bins LEFT JOIN v ON rule_id = 'complexity.cyclomatic' AND
  bin = CASE WHEN metric <= 5 THEN '1-5' WHEN metric <= 10 THEN '6-10' WHEN metric <= 15 THEN '11-15' WHEN metric <= 20 THEN '16-20' ELSE '21+' END GROUP BY bin""")
def score_histogram(spark, d):
    return scoring.histogram(_findings(spark, d))


@query(f"WITH {_V}, s(severity) AS (VALUES ('error'), ('warning'), ('advisory')) SELECT s.severity, count(v.file) AS n FROM s LEFT JOIN v ON s.severity = v.severity GROUP BY s.severity")
def count_severities(spark, d):
    return scoring.severity_counts(_findings(spark, d))


@query(f"WITH {_V} SELECT pillar, count(*) AS n FROM v GROUP BY pillar")
def count_pillars(spark, d):
    return scoring.pillar_counts(_findings(spark, d))


@query(f"WITH {_V} SELECT rule_id, count(*) AS n FROM v GROUP BY rule_id ORDER BY n DESC, rule_id LIMIT 10")
def count_top_rules(spark, d):
    return scoring.top_rules(_findings(spark, d))


_PILLARS = ", ".join(f"('{p}')" for p in "complexity dead-code documentation maintainability modernisation naming security sensitive-data size test-quality".split())


@query(f"""WITH {_V}, {_DETAILS}, p(pillar) AS (VALUES {_PILLARS}) SELECT p.pillar, CASE WHEN d.score IS NULL THEN 'A' ELSE {views.GRADE_SQL.format('d.score')} END AS grade, coalesce(CAST(score AS DOUBLE), 100.0) AS score, true AS applicable,
  coalesce(findings, 0) AS findings, coalesce(advisory, 0) AS advisory, coalesce(warning, 0) AS warning, coalesce(error, 0) AS error, coalesce(penalty, 0.0) AS penalty FROM p LEFT JOIN d ON p.pillar = d.pillar""")
def summary_pillars(spark, d):
    return scoring.pillar_summary(_findings(spark, d))


@query(f"WITH {_V}, f(fail_on, least) AS (VALUES ('advisory', 0), ('warning', 1), ('error', 2), ('none', 9)) SELECT fail_on, CAST(max(CASE WHEN CASE severity WHEN 'error' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END >= least THEN 1 ELSE 0 END) AS INT) AS exit_code FROM f, v GROUP BY fail_on")
def gate_exit_codes(spark, d):
    return scoring.exit_codes(_findings(spark, d), ["advisory", "warning", "error", "none"])


@query(f"WITH {_V} SELECT rule_id, pillar, file, line, fingerprint FROM v WHERE pillar IN ('complexity', 'size') AND rule_id <> 'size.function-length'")
def display_filter(spark, d):
    return scoring.displayed(_findings(spark, d), pillars=("complexity", "size"), without_rules=("size.function-length",)).select("rule_id", "pillar", "file", "line", "fingerprint")


# joins


def _both(spark, d) -> tuple[DataFrame, DataFrame]:
    """Findings and a baseline made of them; fingerprints are made once."""
    f = persist(_findings(spark, d).select("rule_id", "file", "line", "metric", "fingerprint"))
    return f, views.baseline(f)


@query(f"WITH {_V}, {_B} SELECT rule_id, file, line, fingerprint FROM v WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.rule_id = v.rule_id AND b.file = v.file AND b.fingerprint = v.fingerprint)")
def baseline_kept(spark, d):
    return suppression.kept(*_both(spark, d)).select("rule_id", "file", "line", "fingerprint")


@query(f"WITH {_V}, {_B} SELECT rule_id, file, line, fingerprint FROM v WHERE EXISTS (SELECT 1 FROM b WHERE b.rule_id = v.rule_id AND b.file = v.file AND b.fingerprint = v.fingerprint)")
def baseline_suppressed(spark, d):
    return suppression.suppressed(*_both(spark, d)).select("rule_id", "file", "line", "fingerprint")


@query(f"WITH {_V}, {_B} SELECT DISTINCT rule_id, file, fingerprint FROM b WHERE NOT EXISTS (SELECT 1 FROM v WHERE b.rule_id = v.rule_id AND b.file = v.file AND b.fingerprint = v.fingerprint)")
def baseline_stale(spark, d):
    return suppression.stale(*_both(spark, d))


@query(f"""WITH {_V}, {_B}, e AS (SELECT DISTINCT * FROM b), k AS (SELECT rule_id, file, fingerprint, count(*) AS n FROM v GROUP BY ALL)
SELECT CAST(count(e.rule_id) AS BIGINT) AS entries, CAST(coalesce(sum(n) FILTER (e.rule_id IS NOT NULL), 0) AS BIGINT) AS suppressed, CAST(coalesce(sum(n) FILTER (e.rule_id IS NULL), 0) AS BIGINT) AS kept, count(*) FILTER (k.rule_id IS NULL) AS stale
FROM k FULL JOIN e ON k.rule_id = e.rule_id AND k.file = e.file AND k.fingerprint = e.fingerprint""")
def baseline_counts(spark, d):
    return suppression.baseline_counts(*_both(spark, d))


@query(f"WITH {_V} SELECT rule_id, file, fingerprint FROM v")
def baseline_entries(spark, d):
    return suppression.entries(_findings(spark, d))


_ON_LINES = "EXISTS (SELECT 1 FROM c WHERE c.file = v.file AND (v.line = 0 OR (v.line <= c.last AND greatest(v.line, v.end_line) >= c.first)))"


@query(f"WITH {_V}, {_C} SELECT rule_id, file, line, end_line, fingerprint FROM v WHERE {_ON_LINES}")
def diff_changed_lines(spark, d):
    return suppression.on_changed_lines(_findings(spark, d), views.changed(spark, d)).select("rule_id", "file", "line", "end_line", "fingerprint")


_GOD = """g AS (SELECT file, symbol, count(*) FILTER (pillar = 'size') AS n_size, count(*) FILTER (pillar = 'complexity') AS n_complexity, list_sort(list(DISTINCT fingerprint)) AS underlying, list_sort(list(DISTINCT rule_id)) AS rule_ids,
  min(line) FILTER (line > 0) AS primary_line FROM v WHERE pillar IN ('size', 'complexity') GROUP BY file, symbol HAVING n_size > 0 AND n_complexity > 0)"""


@query(f"WITH {_V}, {_GOD} SELECT file, symbol, CAST(n_size AS VARCHAR) AS n_size, CAST(n_complexity AS VARCHAR) AS n_complexity, array_to_string(underlying, ',') AS underlying, CAST(primary_line AS VARCHAR) AS primary_line FROM g")
def composite_god_functions(spark, d):
    x = composites.god_functions(_findings(spark, d))
    m = F.col("metadata")
    return x.select("file", "symbol", m["sizeFindings"].alias("n_size"), m["complexityFindings"].alias("n_complexity"), F.array_join("underlying", ",").alias("underlying"), m["primaryLine"].alias("primary_line"))


@query(f"""WITH {_V} SELECT file, CAST(count(*) AS VARCHAR) AS n, CAST(to_json(list_sort(list(DISTINCT pillar))) AS VARCHAR) AS pillars, array_to_string(list_sort(list(DISTINCT fingerprint)), ',') AS underlying
FROM v WHERE pillar <> 'design' GROUP BY file HAVING count(*) >= 3 AND count(DISTINCT pillar) >= 2""")
def composite_hotspots(spark, d):
    x = composites.hotspots(_findings(spark, d))
    return x.select("file", F.col("metadata")["findings"].alias("n"), F.col("metadata")["pillars"].alias("pillars"), F.array_join("underlying", ",").alias("underlying"))


@query(f"""WITH {_V}, {_C}, {_GOD}, alive AS (SELECT DISTINCT fingerprint FROM v WHERE {_ON_LINES}), changed AS (SELECT DISTINCT file FROM c)
SELECT g.file, g.symbol FROM g JOIN changed USING (file) WHERE EXISTS (SELECT 1 FROM (SELECT unnest(g.underlying) AS fp) u JOIN alive ON alive.fingerprint = u.fp)""")
def composite_without_orphans(spark, d):
    """Composites after the narrowing to changed lines, without those whose evidence is gone."""
    # read several times, so kept, but not the columns that nothing below reads
    f = persist(_findings(spark, d).select("rule_id", "pillar", "file", "symbol", "line", "end_line", "fingerprint"))
    c = views.changed(spark, d)
    x = composites.god_functions(f).withColumn("fingerprint", fnd.fingerprint())
    cols = ["rule_id", "file", "symbol", "line", "end_line", "fingerprint", "underlying"]
    both = f.withColumn("underlying", F.lit(None).cast("array<string>")).select(*cols).unionByName(x.select(*cols))
    left = suppression.without_orphans(persist(suppression.on_changed_lines(both, c)))
    return left.where("underlying is not null").select("file", "symbol")


# sinks as columns


@query(f"WITH {_V} SELECT concat('::', CASE severity WHEN 'error' THEN 'error' WHEN 'warning' THEN 'warning' ELSE 'notice' END, ' file=', file, CASE WHEN line > 0 THEN concat(',line=', line) ELSE '' END, CASE WHEN line > 0 AND end_line > line THEN concat(',endLine=', end_line) ELSE '' END, CASE WHEN line > 0 AND col > 0 THEN concat(',col=', col) ELSE '' END, ',title=', rule_id, '::', replace(message, '%', '%25')) AS annotation FROM v")
def sink_annotations(spark, d):
    return _findings(spark, d).select(formats.annotation().alias("annotation"))


@query(f"WITH {_V} SELECT fingerprint, CASE severity WHEN 'error' THEN 'error' WHEN 'warning' THEN 'warning' ELSE 'note' END AS level, CASE WHEN line > 0 THEN line END AS start_line, CAST(dense_rank() OVER (ORDER BY rule_id) - 1 AS INT) AS rule_index, replace(file, chr(92), '/') AS uri FROM v")
def sink_sarif_results(spark, d):
    # as in a report, whose rules are known before its findings
    rules = spark.createDataFrame([(r,) for r in views.RULES], "rule_id string").coalesce(1)
    x = formats.sarif_results(_findings(spark, d), formats.rule_index(rules))
    r = F.col("result")
    return x.select(r["partialFingerprints"]["primary"].alias("fingerprint"), r["level"].alias("level"), r["locations"][0]["physicalLocation"]["region"]["startLine"].alias("start_line"), r["ruleIndex"].alias("rule_index"), r["locations"][0]["physicalLocation"]["artifactLocation"]["uri"].alias("uri"))


@query(f"WITH {_V} SELECT concat(file, CASE WHEN line > 0 THEN concat(':', line, CASE WHEN col > 0 THEN concat(':', col) ELSE '' END) ELSE '' END, ' [', severity, '] ', rule_id, ': ', message) AS said FROM v")
def sink_text_lines(spark, d):
    return _findings(spark, d).select(formats.text_line().alias("said"))


@query(f"WITH {_V} SELECT rule_id, file, line, end_line, severity, message, fingerprint FROM v")
def sink_json_lines(spark, d):
    """Findings as the lines of JSON that write_table() writes, read again."""
    shape = "ruleId string, file string, location struct<line:int,column:int,endLine:int>, severity string, message string, fingerprint string"
    f = _findings(spark, d).withColumns({"secondary_pillars": F.array().cast("array<string>"), "remediation": F.lit("")})
    x = f.select(F.from_json(report.finding_json(), shape).alias("j"), "end_line")
    # a finding without a line has no location, and so no last line either
    return x.select(F.col("j.ruleId").alias("rule_id"), "j.file", F.coalesce("j.location.line", F.lit(0)).alias("line"), F.coalesce("j.location.endLine", "end_line").alias("end_line"), "j.severity", "j.message", "j.fingerprint")


# secrets in documents


def _documents(spark, d) -> DataFrame:
    """Documents as files, with a secret of a kind that depends on the id in a line of its own after the text."""
    t = views.table(spark, d, "documents")
    return t.select(F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), F.expr(_TOKEN)).alias("text"))


_HASH = "sha256(CAST(doc_id AS VARCHAR(20)))"
_KINDS = [
    f"concat('AK', 'IA', upper(substr({_HASH}, 1, 16)))",
    f"concat('gh', 'p_', substr({_HASH}, 1, 40))",
    f"concat('// gh', 'p_', substr({_HASH}, 1, 40))",
    f"concat('gl', 'pat-', substr({_HASH}, 1, 24))",
    f"concat('sk_', 'live_', substr({_HASH}, 1, 30), ' #nosec')",
    f"concat('sk_', 'live_', substr({_HASH}, 1, 30))",
    f"concat('npm', '_', substr({_HASH}, 1, 36))",
    f"concat('AI', 'za', substr({_HASH}, 1, 35))",
    f"concat('ey', 'J', substr({_HASH}, 1, 12), '.', substr({_HASH}, 13, 12), '.', substr({_HASH}, 25, 12))",
    f"concat('xox', 'b-1234567890-1234567890-', substr({_HASH}, 1, 24))",
    f"concat('postgres', '://user:', substr({_HASH}, 1, 8), '@db.example.com/x')",
    "concat('postgres', '://user:changeme@localhost:5432/x')",
    "concat('-----BEGIN RSA ', 'PRIVATE KEY-----')",
    f"concat('api_', 'key = \"', substr({_HASH}, 1, 32), '\"')",
    f"concat('sk', '-ant-', substr({_HASH}, 1, 28))",
    "'nothing here'",
]
_TOKEN = "CASE " + " ".join(f"WHEN doc_id % {len(_KINDS)} = {i} THEN {k}" for i, k in enumerate(_KINDS)) + " ELSE '' END"
_TOKEN = _TOKEN.replace("sha256(CAST(doc_id AS VARCHAR(20)))", "sha2(CAST(doc_id AS STRING), 256)")
_TOKEN_SQL = _TOKEN.replace("sha2(CAST(doc_id AS STRING), 256)", "sha256(CAST(doc_id AS VARCHAR))")


def _re2(p: str) -> str:
    return p.replace("'", "''")


def _secrets_sql() -> str:
    """Lines by SQL; block comments don't occur in the table, which a guard in the SQL makes sure of."""
    parts = []
    for rule, (p, group, _, _) in secrets.PATTERNS.items():
        bears = "" if rule == "secret-pattern" else "NOT starts_with(ltrim(line, ' ' || chr(9)), '//') AND NOT contains(line, '#nosec') AND "
        local = " AND NOT (m LIKE '%:changeme@localhost:%')" if rule == "connection-string" else ""
        parts.append(f"SELECT file, line_no, '{rule}' AS rule, m FROM (SELECT file, line_no, line, regexp_extract(line, '{_re2(p)}', {group}) AS m FROM l WHERE {bears}regexp_matches(line, '{_re2(p)}')) WHERE m <> ''{local}")
    return f"""WITH t AS (SELECT concat('docs/', doc_id, '.txt') AS file, concat(coalesce(text, ''), chr(10), {_TOKEN_SQL}) AS text FROM documents),
l AS (SELECT file, unnest(string_split(text, chr(10))) AS line, CAST(unnest(generate_series(1, len(string_split(text, chr(10))))) AS INT) AS line_no FROM t WHERE CASE WHEN contains(text, '/*') THEN error('a block comment') ELSE true END),
m AS ({' UNION ALL '.join(parts)})
SELECT concat('sensitive-data.', rule) AS rule_id, file, line_no AS line, CASE WHEN strlen(m) <= 12 THEN '[redacted]' ELSE concat(substr(m, 1, 6), '...', substr(m, -4)) END AS preview FROM m"""


@query(_secrets_sql())
def secrets_in_documents(spark, d):
    """Every line of every document against all twelve expressions, previews redacted."""
    return secrets.scan(_documents(spark, d), {*secrets.PATTERNS}).select("rule_id", "file", "line", F.col("metadata")["preview"].alias("preview"))


@query("""WITH t AS (SELECT concat('docs/', doc_id, '.json') AS file, CASE doc_id % 4 WHEN 0 THEN concat('{"type": "service_account",', chr(10), '"key": "-----BEGIN ', 'PRIVATE KEY-----"}') WHEN 1 THEN '{"type": "service_account"}'
  WHEN 2 THEN concat('-----BEGIN ', 'PRIVATE KEY-----') ELSE '' END AS extra, coalesce(text, '') AS text, doc_id FROM documents)
SELECT file, CAST(len(string_split(text, chr(10))) + 1 AS INT) AS line, CAST(len(string_split(text, chr(10))) + 2 AS VARCHAR) AS secondary_line FROM t WHERE doc_id % 4 = 0""")
def secrets_service_accounts(spark, d):
    """Files that hold both marks of a service account's key: two firsts of one group, not a self-join."""
    t = views.table(spark, d, "documents")
    key = F.concat(F.lit('-----BEGIN '), F.lit('PRIVATE KEY-----'))
    extra = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit('{"type": "service_account",\n"key": "'), key, F.lit('"}'))).when(F.col("doc_id") % 4 == 1, '{"type": "service_account"}').when(F.col("doc_id") % 4 == 2, key).otherwise("")
    files = t.select(F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".json")).alias("path"), F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), extra).alias("text"))
    return secrets.scan(files, {"gcp-service-account"}).select("file", "line", F.col("metadata")["secondaryLine"].alias("secondary_line"))


#: Lines of a file, and whether each bears code.
_COMMENTED = [
    [("a", 1), ("/* b", 0), ("c", 0), ("d */", 0), ("e", 1)], [("// a", 0), ("b // c", 1), ("  // d", 0), ("e", 1)], [("/* a */ b", 1), ("/* c */", 0), ("d /* e", 1), ("f", 1)],
    [("/* a", 0), ("b */ c", 1), ("d", 1)], [("a #nosec", 0), ("b //nolint:gosec", 0), ("c //nolint:errcheck", 1), ("d //nolint:errcheck,all", 0)], [("/* a", 0), ("// b", 0), ("*/", 0), ("/* c */ // d", 1), ("", 1)],
]
_BEARING = ", ".join(f"({i}, {n}, {bears})" for i, rows in enumerate(_COMMENTED) for n, (_, bears) in enumerate(rows, 1))


@query(f"SELECT concat('c/f', p_partkey) AS path, CAST(n AS INT) AS line_no, bears = 1 AS bears FROM part JOIN (VALUES {_BEARING}) AS x(i, n, bears) ON p_partkey % {len(_COMMENTED)} = i")
def text_code_bearing(spark, d):
    """Whether lines bear code: block comments over lines, line comments, comments with code after them, and suppressions."""
    texts = F.array(*[F.lit("\n".join(x for x, _ in rows)) for rows in _COMMENTED])
    files = views.table(spark, d, "part").select(F.concat(F.lit("c/f"), F.col("p_partkey").cast("string")).alias("path"), F.get(texts, (F.col("p_partkey") % len(_COMMENTED)).cast("int")).alias("text"))
    return secrets.code_bearing(secrets.lines(files)).select("path", "line_no", "bears")


# lines, names and paths


@query("SELECT doc_id, CAST(CASE WHEN text IS NULL OR text = '' THEN 0 ELSE len(string_split(text, chr(10))) - CASE WHEN ends_with(text, chr(10)) THEN 1 ELSE 0 END END AS BIGINT) AS lines FROM documents")
def text_line_counts(spark, d):
    return views.table(spark, d, "documents").select("doc_id", tx.line_count(F.col("text")).alias("lines"))


_NAMES = "concat(p_name, '_', p_brand, CAST(p_size AS {0}), 'HTTPServer', p_type)"


@query(f"""SELECT p_partkey, array_to_string(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(regexp_replace(n, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1_\\2', 'g'), '([A-Za-z])([0-9])', '\\1_\\2', 'g'), '([0-9])([A-Za-z])', '\\1_\\2', 'g'), '_'), lambda x: x <> ''), ' ') AS tokens
FROM (SELECT p_partkey, regexp_replace({_NAMES.format('VARCHAR')}, '[^A-Za-z0-9]', '_', 'g') AS n FROM part)""")
def text_identifier_tokens(spark, d):
    t = views.table(spark, d, "part").select("p_partkey", F.regexp_replace(F.expr(_NAMES.format("STRING")), "[^A-Za-z0-9]", "_").alias("n"))
    return t.select("p_partkey", F.array_join(tx.identifier_tokens(F.col("n")), " ").alias("tokens"))


_FLAG = "concat(CASE p_size % 5 WHEN 0 THEN 'No' WHEN 1 THEN 'not' WHEN 2 THEN 'Disable' WHEN 3 THEN 'Note' ELSE 'x' END, CASE p_partkey % 3 WHEN 0 THEN 'Color' WHEN 1 THEN 'ify' ELSE 'Op' END)"


@query(f"SELECT p_partkey, {_FLAG} AS name FROM part WHERE regexp_matches({_FLAG}, '^(?:[Nn]ot?|[Dd]isable)[A-Z]') AND {_FLAG} NOT IN ('NoOp')")
def text_negated_names(spark, d):
    t = views.table(spark, d, "part").select("p_partkey", F.expr(_FLAG).alias("name"))
    return t.where(tx.negated(F.col("name"), ["No", "Not", "Disable"], ["NoOp"]))


@query("SELECT p_partkey FROM (SELECT p_partkey, concat('Rule', CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN 'Set' WHEN 2 THEN 'r' ELSE '2' END) AS name, CASE p_partkey % 2 WHEN 0 THEN 'rule' ELSE 'rules' END AS package FROM part) WHERE starts_with(lower(name), package) AND regexp_matches(substr(name, length(package) + 1), '^(?:[A-Z]|$)')")
def text_stutters(spark, d):
    t = views.table(spark, d, "part")
    name = F.concat(F.lit("Rule"), F.when(F.col("p_size") % 4 == 0, "").when(F.col("p_size") % 4 == 1, "Set").when(F.col("p_size") % 4 == 2, "r").otherwise("2"))
    return t.where(tx.stutters(name, F.when(F.col("p_partkey") % 2 == 0, "rule").otherwise("rules"))).select("p_partkey")


@query("SELECT p_partkey, CASE WHEN strlen(p_name) <= 12 THEN '[redacted]' ELSE concat(substr(p_name, 1, 6), '...', substr(p_name, -4)) END AS redacted FROM part")
def text_redacted(spark, d):
    return views.table(spark, d, "part").select("p_partkey", secrets.redact(F.col("p_name")).alias("redacted"))


_PATH = "concat(CASE p_partkey % 9 WHEN 0 THEN 'vendor/' WHEN 1 THEN 'a/.git/' WHEN 2 THEN '.github/x/' WHEN 3 THEN 'build/' WHEN 4 THEN 'a/.idea/' WHEN 5 THEN 'gen/' ELSE 'src/' END, 'f', CAST(p_partkey AS {0}), CASE p_size % 6 WHEN 0 THEN '.go' WHEN 1 THEN '.YAML' WHEN 2 THEN '.md' WHEN 3 THEN '.json' WHEN 4 THEN '/.env.local' ELSE '_test.go' END)"


@query(f"""SELECT p AS path, CASE WHEN k < 6 THEN NULL WHEN s IN (0, 5) THEN 'go' WHEN s IN (1, 3, 4) THEN 'text' END AS type,
  CASE k WHEN 0 THEN 'dependency' WHEN 1 THEN 'vcs' WHEN 2 THEN 'non-application-metadata' WHEN 3 THEN 'build-output' WHEN 4 THEN 'local-tooling' WHEN 5 THEN 'config-ignore' END AS reason
FROM (SELECT {_PATH.format('VARCHAR')} AS p, p_partkey % 9 AS k, p_size % 6 AS s FROM part)""")
def paths_classified(spark, d):
    return tree.classify(views.table(spark, d, "part").select(F.expr(_PATH.format("STRING")).alias("path")), ["gen/**"])


_DEEP = "concat('a', CAST(p_partkey % 3 AS {0}), '/b', CAST(p_partkey % 5 AS {0}), '/c', CAST(p_partkey AS {0}), CASE WHEN p_size % 2 = 0 THEN '.log' ELSE '.go' END)"


@query(f"SELECT concat('a', k3, '/b', k5, '/c', k, ext) AS path, CASE WHEN k3 = 1 THEN k5 = 4 OR (ext = '.log' AND k % 10 <> 7) ELSE ext = '.log' OR (k3 = 2 AND k5 = 2) END AS ignored FROM (SELECT p_partkey AS k, p_partkey % 3 AS k3, p_partkey % 5 AS k5, CASE WHEN p_size % 2 = 0 THEN '.log' ELSE '.go' END AS ext FROM part)")
def paths_gitignored(spark, d):
    """Ignore files at the root (*.log and /a2/b2/) and in a1 (!c*7.log and b4): later and deeper rules win."""
    rows = []
    for folder, text in (("", "*.log\n/a2/b2/\n"), ("a1", "!c*7.log\nb4\n")):
        rows += [(folder, i, r.regex, r.negated, r.dirs_only) for i, r in enumerate(tree.ignore_rules(text)[0])]
    rules = spark.createDataFrame(rows, "dir string, position int, regex string, negated boolean, dirs_only boolean")
    paths = views.table(spark, d, "part").select(F.expr(_DEEP.format("STRING")).alias("path"), F.lit(False).alias("is_dir"))
    return tree.gitignored(paths, rules).select("path", "ignored")


@query("SELECT concat('a', k % 3, '/b', k % 5, '/c', k, ext) AS path, CASE WHEN k % 3 = 0 AND k % 5 = 0 THEN 1 WHEN k % 3 = 0 THEN 1 WHEN k % 3 = 1 THEN NULL ELSE 1 END AS major, CASE WHEN k % 3 = 0 AND k % 5 = 0 THEN 18 WHEN k % 3 = 0 THEN 21 WHEN k % 3 = 1 THEN NULL ELSE 22 END AS minor FROM (SELECT p_partkey AS k, CASE WHEN p_size % 2 = 0 THEN '.log' ELSE '.go' END AS ext FROM part)")
def paths_nearest_module(spark, d):
    """The as-of join over folders: the nearest module file above decides, a1's without a version too."""
    modules = spark.createDataFrame([("", "1.22rc1"), ("a0", "1.21"), ("a0/b0", "1.18.3"), ("a1", None)], "dir string, version string")
    files = views.table(spark, d, "part").select(F.expr(_DEEP.format("STRING")).alias("path"))
    return tree.nearest(files, modules).select("path", F.col("go_version.major").alias("major"), F.col("go_version.minor").alias("minor"))


@query("""SELECT concat('p', o_custkey % 7, '/f', o_custkey, '.go') AS file, CAST(o_orderkey % 90 + 1 AS INT) AS first, CAST(o_orderkey % 90 + o_orderkey % 5 AS INT) AS last FROM orders WHERE o_orderkey % 5 > 0 AND o_custkey % 11 > 0
UNION ALL SELECT concat('p', o_custkey % 7, '/f', o_custkey, '.go'), NULL, NULL FROM orders WHERE o_custkey % 11 > 0 AND o_orderkey % 5 = 0""")
def patch_hunks(spark, d):
    """One patch an order: hunks with and without a count, deletions alone, and removed files."""
    t = views.table(spark, d, "orders")
    name = F.format_string("p%d/f%d.go", F.col("o_custkey") % 7, F.col("o_custkey"))
    n = F.col("o_orderkey") % 5
    head = F.when(F.col("o_custkey") % 11 == 0, "+++ /dev/null").otherwise(F.concat(F.lit("+++ b/"), name))
    hunk = F.concat(F.lit("@@ -3,2 +"), (F.col("o_orderkey") % 90 + 1).cast("string"), F.when(n == 1, "").otherwise(F.concat(F.lit(","), n.cast("string"))), F.lit(" @@ func x()"))
    return hunks(t.select(F.col("o_orderkey").alias("patch_id"), F.concat_ws("\n", F.lit("diff --git a b"), F.concat(F.lit("--- a/"), name), head, hunk, F.lit("+x")).alias("text"))).select("file", "first", "last")


QUERIES |= GO_QUERIES
ORACLE_SQL |= GO_SQL
