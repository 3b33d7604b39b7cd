"""Operator 9: quality rules judged by host.

Every document is held against RULES, which are built-in expressions over its whole text. What fails is counted for
each host (the column source) over all documents. A host of few documents has a rough failure rate, so rates are shrunk:
for each rule a beta prior is fitted to the hosts' rates by the method of moments (mean m, variance v across hosts,
strength s = m (1 - m) / v - 1, held within STRENGTH), and a host with f failures in n documents has the posterior mean
(f + m s) / (n + s). A host whose rate exceeds LIMIT for any rule is refused, and the verdict is joined back to each of
its documents.

Result: one row for each row of docs: doc_id, source, the rules that the document itself fails, the host's documents, its
worst rule and that rule's shrunk rate, and keep, the host's verdict. Clean hosts keep even their failing documents;
which of these to drop is for filters by document to say.

Nulls and cases: rows without a source share one host of their own. A null or empty text fails "few-words" alone; texts
are measured whole, however long. A doc_id that is no whole number is null. Ties: of rules with equal rates the one whose
name sorts last is the worst. Repeated rows count as often as they are there and come out as often. An empty table gives
no rows. Other columns are ignored, whatever their names. Characters are counted, not bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnsieve.llm import common

LIMIT, STRENGTH = 0.5, (2.0, 1e6)
_SYMBOLS = "#$%&*|<>{}~^"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_ENDS = "!?"
_TEXT = "coalesce(text, '')"


def _count(chars: str) -> str:
    return f"(length({_TEXT}) - length(translate({_TEXT}, '{chars}', '')))"


#: name -> condition under which a document fails, in SQL that Spark and others read alike (n_words, n_lines, n_distinct are given).
RULES = {
    "few-words": "n_words < 5",
    "many-symbols": f"{_count(_SYMBOLS)} * 20 > length({_TEXT})",
    "shouting": f"{_count(_UPPER)} * 2 > length({_TEXT})",
    "many-exclamations": f"{_count(_ENDS)} * 5 > n_words and n_words > 0",
    "long-words": f"length({_TEXT}) > 20 * n_words and n_words > 0",
    "short-words": f"length({_TEXT}) < 3 * n_words",
    "repeated-lines": "n_lines - n_distinct > 0.3 * n_lines",
}


def _measured(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.split(text, "\n")
    rows = common.picked(docs, "doc_id", "source", "text").select("doc_id", F.col("source").cast("string").alias("source"), text.alias("text"))
    rows = rows.withColumns({"n_words": F.regexp_count(text, F.lit(r"[^ \t\n\r\f]+")), "n_lines": F.size(lines), "n_distinct": F.size(F.array_distinct(lines))})
    return rows.select("doc_id", "source", *(F.expr(c).cast("int").alias(f"f{i}") for i, c in enumerate(RULES.values())))


def _verdicts(hosts: DataFrame) -> DataFrame:
    """Counts of hosts -> source, n_docs, worst_rule, rate, keep."""
    rate = [F.col(f"f{i}") / F.col("n") for i in range(len(RULES))]
    prior = hosts.agg(*(x for i, r in enumerate(rate) for x in (F.avg(r).alias(f"m{i}"), F.var_pop(r).alias(f"v{i}"))))

    def shrunk(i: int) -> Column:
        m, v = F.col(f"m{i}"), F.col(f"v{i}")
        s = F.when(v > 1e-12, F.greatest(F.lit(STRENGTH[0]), F.least(F.lit(STRENGTH[1]), m * (1 - m) / v - 1))).otherwise(F.lit(STRENGTH[1]))
        return F.round((F.col(f"f{i}") + m * s) / (F.col("n") + s), 6)

    rates = F.array(*(F.struct(shrunk(i).alias("rate"), F.lit(name).alias("rule")) for i, name in enumerate(RULES)))
    # of equal rates the rule whose name sorts last
    worst = hosts.crossJoin(F.broadcast(prior)).withColumn("worst", F.array_max(rates))
    return worst.select(F.col("source").alias("host"), F.col("n").alias("n_docs"), F.col("worst.rule").alias("worst_rule"), F.col("worst.rate").alias("rate"), (F.col("worst.rate") <= LIMIT).alias("keep"))


def judge(docs: DataFrame) -> DataFrame:
    rows = common.cut(_measured(docs))
    hosts = rows.groupBy("source").agg(F.count("*").alias("n"), *(F.sum(f"f{i}").alias(f"f{i}") for i in range(len(RULES))))
    failed = F.array_join(F.filter(F.array(*(F.when(F.col(f"f{i}") == 1, F.lit(n)) for i, n in enumerate(RULES))), lambda x: x.isNotNull()), ",")
    out = rows.select("doc_id", "source", failed.alias("failed"))
    verdicts = common.by_size(common.cut(_verdicts(hosts)), 128)
    return out.join(verdicts, out["source"].eqNullSafe(verdicts["host"])).drop("host")


def op9_host_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.load(spark, sf_dir, "documents"))


def _sql() -> str:
    names = [*RULES]
    fails = ", ".join(f"CAST({c} AS INT) AS f{i}" for i, c in enumerate(RULES.values()))
    prior = ", ".join(f"avg(f{i} / n) AS m{i}, var_pop(f{i} / n) AS v{i}" for i in range(len(names)))
    s = lambda i: f"(CASE WHEN v{i} > 1e-12 THEN greatest({STRENGTH[0]}, least(1e6, m{i} * (1 - m{i}) / v{i} - 1)) ELSE 1e6 END)"
    rates = " UNION ALL ".join(f"SELECT source, n, '{n}' AS rule, round((f{i} + m{i} * {s(i)}) / (n + {s(i)}), 6) AS rate FROM hosts, prior" for i, n in enumerate(names))
    failed = ", ".join(f"CASE WHEN f{i} = 1 THEN '{n}' END" for i, n in enumerate(names))
    return f"""WITH measured AS (SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r\\f]+')) AS n_words,
  len(string_split(coalesce(text, ''), chr(10))) AS n_lines, len(list_distinct(string_split(coalesce(text, ''), chr(10)))) AS n_distinct FROM documents),
failing AS (SELECT doc_id, source, {fails} FROM measured),
hosts AS (SELECT source, count(*) AS n, {", ".join(f"CAST(sum(f{i}) AS DOUBLE) AS f{i}" for i in range(len(names)))} FROM failing GROUP BY source),
prior AS (SELECT {prior} FROM hosts),
rates AS ({rates}),
worst AS (SELECT source, n AS n_docs, rule AS worst_rule, rate FROM rates QUALIFY row_number() OVER (PARTITION BY source ORDER BY rate DESC, rule DESC) = 1)
SELECT doc_id, f.source, concat_ws(',', {failed}) AS failed, n_docs, worst_rule, rate, rate <= {LIMIT} AS keep
FROM failing f JOIN worst w ON f.source IS NOT DISTINCT FROM w.source"""


OP9_SQL = _sql()
