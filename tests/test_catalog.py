"""Catalog joins and upserts on repeated rows and further columns."""

import re

from pyspark.sql import functions as F

from tuneframe.operators import catalog as C
from tuneframe.operators import runs as M


def test_library_with_repeated_repos(spark):
    cat = spark.createDataFrame([("a",), ("b",)], "repo_id string")
    lib = spark.createDataFrame([("a", True, False, 1), ("a", False, True, 2)], "repo_id string, downloaded boolean, bookmarked boolean, _order int")
    either = C.catalog_with_library(cat, lib.drop("_order")).orderBy("repo_id").collect()
    assert [tuple(r) for r in either] == [("a", True, True), ("b", False, False)]
    last = C.catalog_with_library(cat, lib).orderBy("repo_id").collect()
    assert [tuple(r) for r in last] == [("a", False, True), ("b", False, False)]


def test_upsert_keeps_columns_and_takes_one_row_per_repo(spark):
    schema = (
        "repo_id string, display_name string, architecture string, param_count long, context_length long, license string, "
        "is_vision boolean, local_path string, downloaded boolean, bookmarked boolean, metadata_json string, note string"
    )
    cur = spark.createDataFrame([("a", "A", "x", 5, 7, "mit", False, None, False, True, "old", "kept")], schema)
    new = "repo_id string, display_name string, architecture string, param_count long, context_length long, license string, tags array<string>, local_path string, metadata_json string, _order int"
    rows = [
        ("a", "", "z", 0, 9, "", ["t"], "p1", "first", 1),
        ("a", "", "y", 0, 8, "", ["t"], "p2", "last", 2),
        ("b", "B", "y", 1, 2, "mit", ["vision"], "p3", None, 1),
    ]
    out = {r.repo_id: r for r in C.upsert_models(cur, spark.createDataFrame(rows, new)).collect()}
    a = out["a"]
    assert len(out) == 2 and (a.display_name, a.architecture, a.param_count, a.context_length, a.license) == ("A", "y", 5, 8, "mit")
    assert (a.local_path, a.downloaded, a.bookmarked, a.metadata_json, a.note) == ("p2", True, True, "last", "kept")
    assert (out["b"].is_vision, out["b"].downloaded, out["b"].note) == (True, True, None)


def test_retention_joins_on_run_and_step(spark):
    ck = spark.range(20).selectExpr("id % 2 AS run_id", "id AS step", "cast(id AS string) AS path")
    out = M.retention(ck, 3)
    assert sorted(r.step for r in out.collect()) == list(range(14))
    plan = M.retention(ck, 3)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"\[run_id#\d+L, step#\d+L\], \[run_id#\d+L, step#\d+L\], LeftAnti", plan)
    assert M.retention(ck.filter(F.col("step") < 4), 3).count() == 0
