"""Baseline files: strict JSON of the findings that were reviewed."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession

from tarnsieve import schema
from tarnsieve.operators.suppression import entries

SCHEMA_ID = "tarnsieve.baseline.v1"


class BaselineError(ValueError):
    """A baseline that can't be used."""


def parse(text: str) -> list[tuple[str, str, str]]:
    try:
        data = json.loads(text)
    except ValueError as e:
        raise BaselineError(f"no JSON: {e}") from e
    if not isinstance(data, dict) or set(data) - {"schemaVersion", "findings"}:
        raise BaselineError("unknown fields")
    if data.get("schemaVersion") != SCHEMA_ID:
        raise BaselineError(f"the schema is {data.get('schemaVersion')!r}, not {SCHEMA_ID!r}")
    rows = []
    for i, e in enumerate(data.get("findings") or []):
        if not isinstance(e, dict) or set(e) - {"ruleId", "file", "fingerprint"}:
            raise BaselineError(f"finding {i} has unknown fields")
        row = tuple(e.get(k) or "" for k in ("ruleId", "file", "fingerprint"))
        if not all(isinstance(x, str) and x for x in row):
            raise BaselineError(f"finding {i} lacks its rule, file or fingerprint")
        rows.append(row)
    return rows


def load(spark: SparkSession, path: str) -> DataFrame:
    with open(path, encoding="utf-8") as f:
        return spark.createDataFrame(parse(f.read()), schema.BASELINE)


def write(findings: DataFrame, path: str) -> int:
    """Writes the baseline of findings for its owner alone; the number of entries."""
    rows = [{"ruleId": r.rule_id, "file": r.file, "fingerprint": r.fingerprint} for r in entries(findings).collect()]
    with open(os.open(path, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600), "w", encoding="utf-8") as f:
        f.write(json.dumps({"schemaVersion": SCHEMA_ID, "findings": rows}, indent=2, ensure_ascii=False) + "\n")
    return len(rows)
