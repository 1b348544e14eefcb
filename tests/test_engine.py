"""Operators on a small hand-made graph, and a sample of the registered queries against DuckDB."""

import duckdb
import pytest

from graphloom.functions import text as T
from graphloom.operators import extract as X
from graphloom.operators import resolve as V
from graphloom.operators import search as R
from graphloom.operators import snapshot as S
from graphloom.operators import traverse as G
from graphloom.plans import catalog

SF = "/root/testdata/sf0.001"
NODES = [("F1", "file", "a.ts", "a.ts", False), ("F2", "file", "b.ts", "b.ts", False), ("F3", "file", "a.test.ts", "tests/a.test.ts", False), ("C", "class", "C", "a.ts", True), ("m1", "method", "m1", "a.ts", False), ("m2", "method", "m2", "a.ts", False), ("f", "function", "f", "b.ts", True), ("g", "function", "g", "b.ts", False), ("t", "function", "t", "tests/a.test.ts", False), ("I", "interface", "I", "b.ts", True)]
EDGES = [("F1", "C", "contains"), ("C", "m1", "contains"), ("C", "m2", "contains"), ("F2", "f", "contains"), ("F2", "g", "contains"), ("F2", "I", "contains"), ("F3", "t", "contains"), ("f", "m1", "calls", 3), ("f", "m1", "calls", 9), ("t", "f", "calls"), ("m2", "m2", "calls"), ("F2", "F1", "imports"), ("F3", "F2", "imports"), ("C", "I", "implements")]


@pytest.fixture(scope="module")
def nodes(spark):
    rows = [(i, k, n, n, p, "typescript", 1, 20, x, "h" if i in "fg" else None, "s" if i in "fgt" else None) for i, k, n, p, x in NODES]
    return spark.createDataFrame(rows, "id string, kind string, name string, qualified_name string, file_path string, language string, start_line int, end_line int, is_exported boolean, ast_hash string, ast_shape_hash string").cache()


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(s, t, k, *(r or [None]), 0.9, "import") for s, t, k, *r in EDGES], "source string, target string, kind string, line int, confidence double, resolved_by string").cache()


def ids(df, col="id"):
    return sorted(r[col] for r in df.collect())


def test_callers_keep_one_row_a_call_site(nodes, edges):
    assert ids(G.call_sites(nodes, edges, "m1")) == ["f", "f"]
    assert ids(G.call_sites(nodes, edges, "m2")) == []


def test_dead_code_counts_self_calls_as_use(nodes, edges):
    assert ids(G.dead_code(nodes, edges)) == ["g", "t"]


def test_usages_and_impact(spark, nodes, edges):
    assert ids(G.usages(nodes, edges, "m1")) == ["C", "f", "f"]
    assert ids(G.impact(spark, nodes, edges, ["m1"], 1)) == ["C", "f", "m1"]
    assert ids(G.impact(spark, nodes, edges, ["C"], 1)) == ["C", "F1", "f", "m1", "m2"]


def test_files(spark, nodes, edges):
    assert ids(G.file_dependencies(nodes, edges).where("file = 'b.ts'"), "depends_on") == ["a.ts"]
    assert "b.ts" in ids(G.file_dependents(nodes, edges).where("file = 'a.ts'"), "dependent")
    assert ids(G.affected_tests(spark, nodes, edges, ["a.ts"], lambda p: p.contains("tests/")), "file_path") == ["tests/a.test.ts"]


def test_paths_ancestors_hierarchy(spark, nodes, edges):
    assert [r["id"] for r in G.shortest_path(spark, edges, "t", "m1").orderBy("step").collect()] == ["t", "f", "m1"]
    assert ids(G.ancestors(spark, edges, "m1")) == ["C", "F1"]
    assert ids(G.type_hierarchy(spark, edges, "C")) == ["C", "I"]
    assert G.shortest_path(spark, edges, "m1", "t").isEmpty()


def test_wide_frontier_agrees_with_the_narrow_one(spark, edges, monkeypatch):
    adj = G.adjacency(edges, "both")
    want = sorted(map(tuple, G.reach(spark, adj, ["m1"]).collect()))
    monkeypatch.setattr(G, "DRIVER_FRONTIER", 1)
    assert sorted(map(tuple, G.reach(spark, adj, ["m1"]).collect())) == want


def test_clones(nodes):
    assert [(r["members"], r["files"]) for r in S.clone_groups(nodes, "ast_hash").collect()] == [(2, 1)]
    assert [r["members"] for r in S.shape_groups(nodes).collect()] == [3]
    assert S.shape_groups(nodes.where("id <> 't'")).isEmpty()


def test_diff(nodes):
    new = nodes.where("id <> 'g'").replace("f", "ff", subset="name")
    got = {(r["id"], r["status"], r["changed_fields"]) for r in S.diff_nodes(nodes, new).collect()}
    assert got == {("g", "removed", ""), ("f", "changed", "name")}


def test_globs_and_tests(spark):
    df = spark.createDataFrame([("src/a/b.ts",), ("src/b.ts",), ("lib/x.py",), ("src/FooTest.kt",), ("src/latest.kt",), ("demo/a.c",)], "p string")
    match = lambda *a: sorted(r[0] for r in df.where(T.path_filter(df.p, *a)).collect())
    assert match(["src/**/*.ts"]) == ["src/a/b.ts", "src/b.ts"]
    assert match(["src/*.ts"]) == ["src/b.ts"]
    assert match(["src/"], ["**/a/**"]) == ["src/FooTest.kt", "src/b.ts", "src/latest.kt"]
    assert sorted(r[0] for r in df.where(T.is_test_file(df.p)).collect()) == ["demo/a.c", "src/FooTest.kt"]


def test_query_parser():
    q = R.parse_query('kind:function lang:go path:"my dir" auth http:x')
    assert (q.kinds, q.languages, q.paths, q.text) == (["function"], ["go"], ["my dir"], "auth http:x")


def test_resolution(spark, nodes):
    refs = spark.createDataFrame([(1, "t", "f", "calls", 1, "tests/a.test.ts", "typescript"), (2, "t", "M1", "calls", 1, "x/y.go", "go"), (3, "t", "src/a.ts", "imports", 1, "b.ts", "typescript"), (4, "t", "nothing", "calls", 1, "b.ts", "typescript")], "id long, from_node_id string, reference_name string, reference_kind string, line int, file_path string, language string")
    got = {r["ref_id"]: (r["target"], r["confidence"], r["resolved_by"]) for r in V.resolve(refs, nodes).collect()}
    assert got == {1: ("f", 0.9, "exact-match"), 2: ("m1", 0.3, "fuzzy"), 3: ("F1", 0.7, "file-path")}


def test_re_exports(spark):
    imports = spark.createDataFrame([(1, "b/index.ts", "x"), (2, "loop.ts", "z")], "ref_id long, file string, name string")
    re = spark.createDataFrame([("b/index.ts", "*", "b/inner.ts", None), ("b/inner.ts", "x", "leaf.ts", "y"), ("loop.ts", "*", "loop.ts", None)], "file string, name string, to_file string, to_name string")
    exported = spark.createDataFrame([("leaf.ts", "y", "function:y")], "file string, name string, id string")
    assert [tuple(r) for r in V.follow_re_exports(imports, re, exported).collect()] == [(1, "function:y")]


def test_extraction(spark):
    files = spark.createDataFrame([("a.py", "import os\nclass A(B):\n    @d\n    def m(self):\n        return self.n(os.x())\n"), ("b.ts", "export function go() {}\nimport { x } from './y';\napp.get('/users', listUsers);\n"), ("bad.py", "def ("), ("c.txt", "x"), ("n.py", None)], "path string, content string")
    rows = X.extract(files).collect()
    got = {(r["file_path"], r["kind"], r["name"]) for r in rows}
    assert {("a.py", "class", "A"), ("a.py", "method", "m"), ("a.py", "extends", "B"), ("a.py", "decorates", "d"), ("a.py", "calls", "n"), ("a.py", "calls", "os.x"), ("b.ts", "function", "go"), ("b.ts", "imports", "./y"), ("b.ts", "route", "GET /users"), ("b.ts", "references", "listUsers")} <= got
    assert any(r["record"] == "error" and r["file_path"] == "bad.py" for r in rows) and not any(r["file_path"] == "c.txt" for r in rows)


def test_entry_and_guard(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 37
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["node_metrics", "callers_depth3", "impact_radius", "dead_code", "dup_shape", "diff_nodes", "search_fts_bm25", "resolve_qualified", "line_clusters", "debounce_sessions"])
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events documents pages".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = con.sql(catalog.ORACLES[name]).project(", ".join(cols)).fetchall()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, df.select(*cols).collect())) == sorted(map(key, want))
