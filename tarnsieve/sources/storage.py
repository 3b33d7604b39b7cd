"""Discovery by executors, of trees on storage that all of them reach: folders listed level by level, rules of ignore files as joins.

The driver knows the root alone. What it decides equals sources/tree.discover(), but that each skipped file is told, not
the folder above it; only folders of version control and of metadata, which aren't entered, are told as such.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnsieve.shared import cut, sized
from tarnsieve.sources import tree

_RULES = "path string, dir string, position int, regex string, negated boolean, dirs_only boolean, bad boolean"


def _system(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root if "://" in root else "file://" + posixpath.abspath(root))


def _lister(root: str, enter_all: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, top = _system(root)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                below = system.get_file_info(fs.FileSelector(posixpath.join(top, folder)))
                names = [posixpath.join(folder, x.base_name) for x in below]
                dirs = [x.type == fs.FileType.Directory for x in below]
                open_ = [d and (enter_all or tree.dir_reason([x.base_name], False) is None) for d, x in zip(dirs, below)]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(dirs, pa.bool_()), pa.array(open_, pa.bool_())], names=["path", "is_dir", "enter"])

    return run


def listed(spark: SparkSession, root: str, enter_all: bool) -> DataFrame:
    """path, is_dir, enter of all below root: a pass a level of folders, each of which executors list."""
    level = spark.createDataFrame([("",)], "path string")
    out = None
    while True:
        below = cut(level.mapInArrow(_lister(root, enter_all), "path string, is_dir boolean, enter boolean"))
        out = below if out is None else out.unionByName(below)
        level = below.where("enter").select("path")
        n = level.count()
        if not n:
            return out
        level = level.repartition(max(1, min(n, 4 * spark.sparkContext.defaultParallelism)))


def texts(files: DataFrame, root: str) -> DataFrame:
    """files with text, read by executors; bytes that are no UTF-8 are replaced."""
    names = [f.name for f in files.schema.fields]
    schema = files.schema.add("text", "string")
    at = names.index("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = _system(root)
        for batch in batches:
            for i, path in enumerate(batch.column(at).to_pylist()):
                with system.open_input_stream(posixpath.join(top, path)) as f:
                    text = f.read().decode("utf-8", "replace")
                yield pa.RecordBatch.from_arrays([*(c.slice(i, 1) for c in batch.columns), pa.array([text])], names=[*names, "text"])

    # by a hash of the path: names in one folder go to different tasks
    return files.repartition("path").mapInArrow(run, schema)


def _rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """path, text of ignore files -> their rules; a file without any has one row without an expression."""
    for batch in batches:
        rows = []
        for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rules, bad = tree.ignore_rules(text)
            folder = posixpath.dirname(path)
            rows += [(path, folder, i, r.regex, r.negated, r.dirs_only, bad) for i, r in enumerate(rules)] or [(path, folder, None, None, None, None, bad)]
        if rows:
            types = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[x.split()[0] for x in _RULES.split(", ")])


def _generated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        of_go = zip(batch.column(batch.schema.get_field_index("type")).to_pylist(), batch.column(batch.schema.get_field_index("text")).to_pylist())
        yield batch.append_column("generated", pa.array([k == "go" and tree.generated_go(t) for k, t in of_go], pa.bool_()))


def discover(spark: SparkSession, root: str, ignore: list[str] | None = None, include_ignored: bool = False) -> tuple[DataFrame, DataFrame]:
    """files (path, type, text, go_version) and skipped (path, reason) of a tree, both as tables."""
    everything = listed(spark, root, include_ignored)
    names = everything.where("not is_dir").select("path")
    base = F.element_at(F.split("path", "/"), -1)
    rules = cut(texts(names.where(base == ".gitignore"), root).mapInArrow(_rules, _RULES))
    hidden = tree.gitignored(names.withColumn("is_dir", F.lit(False)), rules.where("regex is not null").select("dir", "position", "regex", "negated", "dirs_only"))
    # ignore files above a folder of dependencies or output switch the fallback off, not those within
    above = names.select("path", F.explode(tree.ancestors(F.col("path"))).alias("dir")).where(~F.arrays_overlap(F.split("dir", "/"), F.array(*(F.lit(x) for x in sorted(tree.FALLBACK)))))
    led = above.join(sized(rules.select("dir").distinct()), "dir").select(F.col("path").alias("led")).distinct()
    told = hidden.join(led, F.col("path") == F.col("led"), "left")
    reason = tree.folder_reason(F.col("path"), F.col("led").isNull())
    config = F.when(tree.config_ignored(F.col("path"), ignore), "config-ignore")
    reason = config if include_ignored else F.coalesce(F.when(F.col("ignored"), "gitignored"), config, reason)
    told = told.select("path", tree.type_of(F.col("path")).alias("type"), reason.alias("reason"))
    wanted = texts(told.where("reason is null and type is not null").select("path", "type"), root)
    marked = cut(wanted.mapInArrow(_generated, "path string, type string, text string, generated boolean"))
    made = F.lit(False) if include_ignored else F.col("generated")
    skipped = told.where("reason is not null").select("path", "reason").unionByName(marked.where(made).select("path", F.lit("generated").alias("reason")))
    shut = everything.where("is_dir and not enter").select("path", F.when(base.isin(*sorted(tree.VCS)), "vcs").otherwise("non-application-metadata").alias("reason"))
    wrong = rules.where("bad").select("path", F.lit("gitignore-parse-error").alias("reason")).distinct()
    skipped = skipped.unionByName(shut) if include_ignored else skipped.unionByName(shut).unionByName(wrong)
    modules = cut(texts(names.where(base == "go.mod"), root).select(F.regexp_replace("path", "/?go\\.mod$", "").alias("dir"), tree.go_directive(F.col("text")).alias("version")))
    return tree.nearest(marked.where(~made).select("path", "type", "text"), modules), skipped
