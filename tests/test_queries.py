import pytest

from tarnsieve.plans.queries import ORACLE_SQL, QUERIES
from tarnsieve.sources import tree
from tests.oracle import DATA, same


@pytest.mark.parametrize("name", [*QUERIES])
def test_query_against_sql(spark, name):
    same(QUERIES[name](spark, DATA), ORACLE_SQL[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["rule_id", "file", "line", "preview"]


def test_line_rules_stay_in_the_jvm(spark):
    plan = QUERIES["secrets_in_documents"](spark, DATA)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_narrowing_is_a_semi_join_on_the_file(spark):
    plan = QUERIES["diff_changed_lines"](spark, DATA)._jdf.queryExecution().toString()
    assert "LeftSemi" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


@pytest.mark.parametrize("name", ["paths_gitignored", "paths_nearest_module"])
def test_rules_are_broadcast_and_never_the_paths(spark, name):
    """The optimizer takes exploded folders for small: the driver then held all paths of the table."""
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().sparkPlan().toString()
    assert "BuildLeft" not in plan and plan.count("BuildRight") == 1


def test_ignored_paths_by_rules_too_large_to_broadcast(spark):
    rows = [("", 0, r"^[^/]*\.log$", False, False), ("a", 0, "^keep$", True, False), ("", 1, "^(?:.*/)?out$", False, True), ("a/b", 0, "^x$", False, False), ("a/b", 1, "^x$", True, False)]
    rules = spark.createDataFrame(rows, "dir string, position int, regex string, negated boolean, dirs_only boolean")
    paths = spark.createDataFrame([("1.log", False), ("a/out", True), ("a/out", False), ("a/out/1.go", False), ("a/b/x", False), ("c", False), ("1.log", False)], "path string, is_dir boolean")
    want = [("1.log", False, True), ("a/b/x", False, False), ("a/out", False, False), ("a/out", True, True), ("a/out/1.go", False, True), ("c", False, False)]
    for limit in (1 << 20, 0):
        assert sorted(map(tuple, tree.gitignored(paths, rules, limit).collect())) == want
    assert "SortMergeJoin" in tree.gitignored(paths, rules, 0)._jdf.queryExecution().sparkPlan().toString()
    modules = spark.createDataFrame([("", "1.22"), ("a", None)], "dir string, version string")
    for limit in (1 << 20, 0):
        assert sorted((r.path, r.go_version and tuple(r.go_version)) for r in tree.nearest(paths.select("path").distinct(), modules, limit).collect()) == [("1.log", (1, 22)), ("a/b/x", None), ("a/out", None), ("a/out/1.go", None), ("c", (1, 22))]


def test_narrowing_joins_once(spark):
    """Findings with and without a line are told by one join, with files of deletions alone too."""
    from tarnsieve.operators import suppression

    f = spark.createDataFrame([(1, "a", 5, 0), (2, "a", 0, 0), (3, "a", None, None), (4, "b", 5, 9), (5, "b", None, 0), (6, "c", 0, 0), (7, "c", 1, 1), (8, "a", 9, 2)], "i int, file string, line int, end_line int")
    changed = spark.createDataFrame([("a", 4, 5), ("a", 5, 5), ("b", 9, 9)], "file string, first int, last int")
    files = spark.createDataFrame([("a",), ("c",), ("c",)], "file string")
    for given, want in ((None, [1, 2, 3, 4, 5]), (files, [1, 2, 3, 4, 6])):
        x = suppression.on_changed_lines(f, changed, given)
        assert sorted(r.i for r in x.collect()) == want
        assert x._jdf.queryExecution().sparkPlan().toString().count("LeftSemi") == 1


def test_hunks_need_no_shuffle(spark):
    from tarnsieve.sources.patches import hunks

    text = "@@ -1 +7 @@\n+++ b/a\n@@ -1,2 +3,0 @@\n--- x\n+++ b/c d \n@@ -1 +4 @@\n@@ odd\n+y\n+++ /dev/null\n@@ -1 +0,0 @@\n+++ b/a\n@@ -9 +9,2 @@ f\n+++ e\n@@ -1 +2,0 @@\n+++ e\n"
    two = spark.createDataFrame([(1, text), (1, "+++ b/z"), (None, "+++ z\r\n@@ -1 +0,1 @@"), (2, ""), (3, None), (4, "x +++ b/n\n@@ -1 +1 @@")], "patch_id int, text string")
    x = hunks(two)
    want = [(None, "z\r", 0, 0), (1, "a", 9, 10), (1, "c d", 4, 4), (1, "e", None, None), (1, "z", None, None)]
    assert sorted(map(tuple, x.collect()), key=str) == sorted(want, key=str)
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and "Sort" not in plan
