"""Rows that have given trouble: nulls everywhere, empty and very long texts, ties, repeats, columns with clashing names."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASHING = "k unit_key unit_id u p s c shard_key shard_id quality_probability probability keep tokens host slice n h".split()
LONG = " ".join(f"word{i % 977}" for i in range(60_000))


def prose(seed: int, n: int = 60) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(n))


def weird(spark, columns=CLASHING):
    """14 rows and a column of each clashing name."""
    rows = [(None, None, None, None, None), (None, "no id " + prose(1), "en", "a", 5), (1, None, "en", "a", 0), (2, "", "en", None, 0), (3, LONG, "en", "a", len(LONG)), (4, " \n\t ", "de", "b", 4), (5, "x", None, "b", 1)]
    rows += [(6, prose(2), "en", "b", 9)] * 3 + [(7, prose(2), "en", "b", 9), (7, prose(3), "fr", "c", 9), (8, "é ß   \U0001f600 " * 5, "fr", "c", 9), (9, "A" * 5000, "en", "c", 5000)]
    df = spark.createDataFrame(rows, SCHEMA)
    for i, c in enumerate(columns):
        df = df.selectExpr("*", f"cast({i} as string) as {c}")
    return df


def odd_columns(spark, rows):
    """rows (doc_id, text), with columns of odd names and types; the names hold dots, backticks and blanks, one is there twice."""
    df = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], SCHEMA)
    more = {"a.b": "1", "c`d": "'x'", "e f": "map('k', 1)", "struct.of`map": "named_struct('m', map(1, array(map('a', 2))), 'x', 1)", "array of map": "array(map(1, 2), null)", "doc_id.text": "null"}
    for name, value in more.items():
        df = df.selectExpr("*", f"{value} as `{name.replace('`', '``')}`")
    return df.toDF(*df.columns[:-1], "a.b")


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def docs(spark, texts, source="s"):
    return spark.createDataFrame([(i, t, "en", source, len(t)) for i, t in enumerate(texts)], SCHEMA)


def same_rows(a, b) -> bool:
    return sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
