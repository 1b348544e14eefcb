"""Operators whose intermediate rows must grow with the input, not with the square of a group."""

import duckdb
import pytest

from graphloom.operators import extract as X
from graphloom.operators import resolve as V
from graphloom.plans import catalog
from graphloom.sources import tables

SF = "/root/testdata/sf0.001"
NODE = "id string, kind string, name string, qualified_name string, file_path string, language string, start_line int, end_line int, is_exported boolean"
REF = "id long, from_node_id string, reference_name string, reference_kind string, line int, file_path string, language string"


def joined_rows(df) -> int:
    """Rows that the joins of a query made, by the metrics of its last plan."""
    df.collect()
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(p.plan())
        else:
            if "Join" in name and p.metrics().contains("numOutputRows"):
                total += p.metrics().apply("numOutputRows").value()
            todo += [p.children().apply(i) for i in range(p.children().size())]
    return total


@pytest.mark.parametrize("step, name", [("by_path", "x/get.py"), ("by_qualified_name", "A::get"), ("by_method", "A::get"), ("by_exact_name", "get"), ("by_fuzzy_name", "GET")])
def test_a_frequent_name_is_not_paired_with_each_of_its_nodes(spark, step, name):
    n = 300
    nodes = spark.createDataFrame([(f"n{i}", "file" if step == "by_path" else "method", "get", "A::get", f"d{i}/x/get.py", "python", 1, 1, False) for i in range(n)], NODE)
    refs = spark.createDataFrame([(i, "t", name, "calls", 1, f"d{i}/x/get.py", "python") for i in range(n)], REF)
    assert joined_rows(getattr(V, step)(refs, nodes)) < n * n / 10


def test_pools_choose_what_pairs_would(spark, monkeypatch):
    where = ["a/b/x.py", "a/c/x.py", "z.py", None]
    nodes = spark.createDataFrame([(f"n{i:02}", ["function", "class"][i % 2], "get", "get", where[i % 4], ["python", "go"][i % 3 % 2], 30 * i, 30 * i, i % 5 == 0) for i in range(40)], NODE)
    refs = spark.createDataFrame([(i, "t", "get", ["calls", "instantiates", "imports"][i % 3], 40 * i, where[i % 4], ["go", "python", None][i % 3]) for i in range(30)], REF)
    pooled = sorted(map(tuple, V.by_exact_name(refs, nodes).collect()))
    monkeypatch.setattr(V, "PAIRED", 100)
    assert len(pooled) == 30 and pooled == sorted(map(tuple, V.by_exact_name(refs, nodes).collect()))


@pytest.mark.parametrize("name", ["callers_depth1", "callees_depth1", "find_usages", "children_outline", "relations_best_edge", "affected_tests", "file_dependents"])
def test_questions_about_a_part_do_not_hold_the_graph(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    tables._held.clear()
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, df.select(*cols).collect())) == sorted(map(key, con.sql(catalog.ORACLES[name]).project(", ".join(cols)).fetchall()))
    assert not tables._held


def test_extraction_is_dealt_out_to_all_cores(spark):
    files = spark.createDataFrame([(f"p{i}.py", f"def f{i}():\n    pass\n") for i in range(64)], "path string, content string").coalesce(1)
    df = X.extract(files)
    assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert sorted(r["name"] for r in df.where("kind = 'function'").collect()) == sorted(f"f{i}" for i in range(64))
