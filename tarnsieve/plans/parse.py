"""Files parsed once: one row of facts and unit findings for each, in Arrow batches."""

from __future__ import annotations

import json
import posixpath
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnsieve.goparse.lexer import GoSyntaxError
from tarnsieve.goparse.syntax import Node, parse, walk
from tarnsieve.rules import docs, maintain, metrics, security, testing  # noqa: F401  they fill the catalogue
from tarnsieve.rules.base import CATALOGUE, Options, Unit, name_of

FACTS = (
    "path string, dir string, package string, package_line int, is_test boolean, has_doc boolean, doc_lines int, reflects boolean, line_count bigint, "
    "names array<struct<name:string,n:bigint>>, privates array<struct<name:string,line:int,col:int>>, methods array<struct<type:string,name:string,form:string,symbol:string,line:int,col:int>>, "
    "findings array<struct<rule_id:string,message:string,line:int,col:int,end_line:int,symbol:string,metadata:map<string,string>,metric:bigint>>, "
    "error struct<line:int,col:int,message:string>, errors array<struct<line:int,col:int,message:string>>"
)


def unit(path: str, text: str, go_version: tuple[int, int] | None = None) -> Unit:
    """A file as the rules take it. Raises GoSyntaxError for a Go file that can't be parsed."""
    if not path.endswith(".go"):
        return Unit(path, text)
    tree, source, tokens = parse(text)
    return Unit(path, text, tree, source, tokens, go_version)


def _receiver(t: Node) -> tuple[str, str]:
    form = "pointer" if t.kind == "StarExpr" else "value"
    while t.kind in ("StarExpr", "IndexExpr", "IndexListExpr"):
        t = t.X
    return name_of(t) or "", form


def facts(u: Unit) -> dict:
    """What the package rules need of a file."""
    tree = u.tree
    if tree is None:
        return {}
    at = lambda n: {"line": u.source.line(n.pos), "col": u.source.column(n.pos)}
    count = Counter(n.Name for n in walk(tree) if n.kind == "Ident" and n.Name[:1].islower())
    methods = []
    for fn in u.functions:
        if fn.Recv is not None and fn.Recv.List:
            f = fn.Recv.List[0]
            typ, form = _receiver(f.Type)
            if typ:
                methods.append({"type": typ, "name": f.Names[0].Name if f.Names else "", "form": form, "symbol": fn.Name.Name, **at(fn.Name)})
    doc = tree.Doc.text() if tree.Doc else ""
    return {
        "package": tree.Name.Name, "package_line": u.source.line(tree.Name.pos), "is_test": u.is_test, "has_doc": tree.Doc is not None, "doc_lines": sum(bool(x.strip()) for x in doc.split("\n")),
        "reflects": any(s.Path.Value in ('"reflect"', "`reflect`") for s in tree.Imports), "names": [{"name": k, "n": v} for k, v in count.items()],
        "privates": [{"name": f.Name.Name, **at(f)} for f in u.functions if f.Recv is None and f.Name.Name[0].islower() and f.Name.Name not in ("init", "main")], "methods": methods,
    }


def unit_findings(u: Unit, rules: dict[str, Options]) -> list[dict]:
    out = []
    for id, options in rules.items():
        for f in options.rule.check(u, options):
            meta = f["metadata"]
            metric = next((meta[k] for k in ("complexity", "depth", "lines", "parameters") if k in meta), None)
            text = {k: v if isinstance(v, str) else json.dumps(v) for k, v in meta.items()}
            out.append({"rule_id": id, "message": f["message"], "line": f["line"], "col": f["column"], "end_line": f["end_line"], "symbol": f["symbol"], "metadata": list(text.items()), "metric": metric})
    return out


def default_rules() -> dict[str, Options]:
    return {r.id: Options(r) for r in CATALOGUE.values() if r.kind == "unit"}


_ERROR = pa.struct([("line", pa.int32()), ("col", pa.int32()), ("message", pa.string())])
_ARROW = pa.schema([
    ("path", pa.string()), ("dir", pa.string()), ("package", pa.string()), ("package_line", pa.int32()), ("is_test", pa.bool_()), ("has_doc", pa.bool_()), ("doc_lines", pa.int32()), ("reflects", pa.bool_()), ("line_count", pa.int64()),
    ("names", pa.list_(pa.struct([("name", pa.string()), ("n", pa.int64())]))), ("privates", pa.list_(pa.struct([("name", pa.string()), ("line", pa.int32()), ("col", pa.int32())]))),
    ("methods", pa.list_(pa.struct([("type", pa.string()), ("name", pa.string()), ("form", pa.string()), ("symbol", pa.string()), ("line", pa.int32()), ("col", pa.int32())]))),
    ("findings", pa.list_(pa.struct([("rule_id", pa.string()), ("message", pa.string()), ("line", pa.int32()), ("col", pa.int32()), ("end_line", pa.int32()), ("symbol", pa.string()), ("metadata", pa.map_(pa.string(), pa.string())), ("metric", pa.int64())]))),
    ("error", _ERROR), ("errors", pa.list_(_ERROR)),
])


_DEEP = {"line": 1, "col": 1, "message": "exceeded max nesting depth"}


def _parser(rules: list[tuple[str, dict, dict, tuple]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = {id: Options(CATALOGUE[id], t, o, a) for id, t, o, a in rules}
        for batch in batches:
            rows = []
            for path, text, version in zip(*(batch.column(j).to_pylist() for j in range(3))):
                row = {"path": path, "dir": posixpath.dirname(path) or "."}
                try:
                    u = unit(path, text, (version["major"], version["minor"]) if version else None)
                    row |= facts(u) | {"line_count": u.line_count, "findings": unit_findings(u, mine)}
                except GoSyntaxError as e:
                    row["errors"] = [{"line": x.line, "col": x.column, "message": x.message} for x in e.all]
                    row["error"] = row["errors"][0]
                except RecursionError:  # a tree that parses, but is too deep for some rule
                    row = {"path": path, "dir": row["dir"], "error": _DEEP, "errors": [_DEEP]}
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return run


def parsed(files: DataFrame, rules: dict[str, Options] | None = None) -> DataFrame:
    """A row (FACTS) for each row of files (path, text, go_version struct<major, minor> or null): one pass, no shuffle.

    A file that can't be parsed has errors (error is the first of them), and neither facts nor findings. Files other than *.go have no facts. A
    null text is an empty one. Where the result is used more than once, write or checkpoint it: parsing is the dear part.
    """
    wanted = [(id, o.thresholds, o.options, tuple(o.abbreviations)) for id, o in (default_rules() if rules is None else rules).items()]
    rows = files.select(F.col("path"), F.coalesce("text", F.lit("")).alias("text"), F.col("go_version") if "go_version" in files.columns else F.lit(None).cast("struct<major:int,minor:int>").alias("go_version"))
    return rows.mapInArrow(_parser(wanted), FACTS)


def raw_findings(parsed_files: DataFrame) -> DataFrame:
    """Unit findings (schema.RAW) of parsed()."""
    x = parsed_files.select("path", F.explode("findings").alias("f"))
    return x.select("f.rule_id", "f.message", F.col("path").alias("file"), "f.line", "f.col", "f.end_line", "f.symbol", "f.metadata", "f.metric", F.lit(None).cast("array<string>").alias("underlying"))
