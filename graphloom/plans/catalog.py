"""Registered queries of the engine over the driver's tables, each with its DuckDB twin where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import extract as X
from ..operators import resolve as V
from ..operators import search as R
from ..operators import snapshot as S
from ..operators import style as C
from ..operators import traverse as G
from ..sources.tables import SQL_GRAPH, _read, around, build_edges, build_nodes, graph
from ..streaming.watch import debounced

QUERIES: dict = {}
ORACLES: dict = {}
_held: dict = {}


def query(sql: str | None = None, view: bool = True, recursive: bool = False):
    """Register a function (spark, sf_dir) under its name; ``view`` puts the graph view before the SQL."""

    def add(f):
        name = f.__name__.removeprefix("q_")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = (f"WITH {'RECURSIVE ' if recursive else ''}{SQL_GRAPH}{sql if sql.lstrip().startswith(',') else ' ' + sql}") if view else sql
        return f

    return add


def _n(spark, sf):
    return graph(spark, sf)[0]


def _e(spark, sf):
    return graph(spark, sf)[1]


P0 = "function:p0"
LONG = "bigint"


def _count(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


# --- lookups -------------------------------------------------------------------------------------------------------


@query("SELECT id, kind, name, file_path FROM nodes WHERE id = 'class:c7'")
def node_by_id(spark, sf):
    return _n(spark, sf).where("id = 'class:c7'").select("id", "kind", "name", "file_path")


@query("SELECT id, name FROM nodes WHERE id IN (SELECT 'method:o' || o_orderkey FROM orders WHERE o_orderpriority = '2-HIGH')")
def nodes_by_ids(spark, sf):
    ids = _read(spark, sf, "orders").where("o_orderpriority = '2-HIGH'").select(F.concat(F.lit("method:o"), F.col("o_orderkey").cast("string")).alias("id"))
    return _n(spark, sf).join(ids, "id", "left_semi").select("id", "name")


@query("SELECT id, name, file_path FROM nodes WHERE kind = 'interface'")
def nodes_by_kind(spark, sf):
    return _n(spark, sf).where("kind = 'interface'").select("id", "name", "file_path")


@query("SELECT n.id, n.name FROM nodes n WHERE n.name = (SELECT name FROM nodes WHERE id = 'function:p3')")
def nodes_by_name(spark, sf):
    n = _n(spark, sf)
    return n.join(n.where("id = 'function:p3'").select("name"), "name", "left_semi").select("id", "name")


@query("SELECT n.id, lower(n.name) AS low FROM nodes n WHERE lower(n.name) = (SELECT lower(name) FROM nodes WHERE id = 'class:c11')")
def nodes_by_name_ci(spark, sf):
    n = _n(spark, sf).withColumn("low", F.lower("name"))
    return n.join(n.where("id = 'class:c11'").select("low"), "low", "left_semi").select("id", "low")


@query("SELECT id, qualified_name FROM nodes WHERE regexp_matches(qualified_name, '^Brand#1.::.*ed.*$') AND kind IN ('class','function','method','interface','type_alias','variable','constant')")
def glob_qualified(spark, sf):
    kinds = ("class", "function", "method", "interface", "type_alias", "variable", "constant")
    return _n(spark, sf).where(F.col("kind").isin(*kinds) & T.wildcard(F.col("qualified_name"), "Brand#1?::*ed*")).select("id", "qualified_name")


@query("SELECT id, start_line FROM nodes WHERE file_path = (SELECT min(file_path) FROM nodes WHERE kind = 'file')")
def nodes_in_file(spark, sf):
    n = _n(spark, sf)
    first = n.where("kind = 'file'").agg(F.min("file_path").alias("file_path"))
    return n.join(first, "file_path", "left_semi").select("id", "start_line")


@query("SELECT id, file_path FROM nodes WHERE is_exported AND file_path LIKE 'asia/%'")
def exported_symbols(spark, sf):
    return _n(spark, sf).where("is_exported AND startswith(file_path, 'asia/')").select("id", "file_path")


@query("SELECT target, kind, line FROM edges WHERE source = 'method:o1'")
def edges_out(spark, sf):
    return _e(spark, sf).where("source = 'method:o1'").select("target", "kind", "line")


@query("SELECT source, kind, line FROM edges WHERE target = 'class:c7' AND kind IN ('contains', 'references')")
def edges_in(spark, sf):
    return _e(spark, sf).where("target = 'class:c7' AND kind IN ('contains', 'references')").select("source", "kind", "line")


@query("SELECT source, target, kind FROM edges WHERE source IN (SELECT id FROM nodes WHERE kind IN ('file', 'interface')) AND target IN (SELECT id FROM nodes WHERE kind IN ('file', 'interface'))")
def edges_between(spark, sf):
    return G.induced(_n(spark, sf), _e(spark, sf), F.col("kind").isin("file", "interface")).select("source", "target", "kind")


@query("SELECT file_path, count(*) AS n FROM nodes WHERE (regexp_full_match(file_path, '(?:.*/)?[^/]*a[^/]*') OR regexp_full_match(file_path, 'parts/.*')) AND NOT regexp_full_match(file_path, 'asia/.*') GROUP BY 1")
def path_filter(spark, sf):
    return _count(_n(spark, sf).where(T.path_filter(F.col("file_path"), ["**/*a*", "parts/**"], ["asia/"])), "file_path")


@query("SELECT DISTINCT name FROM nodes WHERE kind = 'function'")
def distinct_names(spark, sf):
    return _n(spark, sf).where("kind = 'function'").select("name").distinct()


@query("SELECT file_path, regexp_matches(file_path, '(brand#1|east)') AS hit, count(*) AS n FROM nodes GROUP BY 1, 2")
def glob_unanchored(spark, sf):
    return _count(_n(spark, sf).withColumn("hit", F.col("file_path").rlike("(brand#1|east)")), "file_path", "hit")


@query("SELECT p_partkey, regexp_matches(lower(p), '(^|/)tests?/') OR regexp_matches(p, '(Tests?|TestCase|Tester|Specs?)\\.[A-Za-z0-9]+$') AS is_test FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'tests/p' || p_partkey || '.py' WHEN 1 THEN 'src/P' || p_partkey || 'Test.java' ELSE 'src/latest' || p_partkey || '.kt' END AS p FROM part)", view=False)
def is_test_file(spark, sf):
    p, key = _read(spark, sf, "part"), F.col("p_partkey")
    path = F.when(key % 3 == 0, F.concat(F.lit("tests/p"), key, F.lit(".py"))).when(key % 3 == 1, F.concat(F.lit("src/P"), key, F.lit("Test.java"))).otherwise(F.concat(F.lit("src/latest"), key, F.lit(".kt")))
    return p.select("p_partkey", T.is_test_file(path).alias("is_test"))


@query("SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'modified' END AS status FROM (SELECT p_partkey::VARCHAR AS path, sha256(p_name) AS h FROM part WHERE p_partkey % 7 <> 0) a FULL JOIN (SELECT p_partkey::VARCHAR AS path, sha256(CASE WHEN p_size > 40 THEN p_type ELSE p_name END) AS h FROM part WHERE p_partkey % 5 <> 0) b ON a.path = b.path WHERE a.h IS DISTINCT FROM b.h", view=False)
def stale_files(spark, sf):
    p = _read(spark, sf, "part")
    path = F.col("p_partkey").cast("string").alias("path")
    known = p.where("p_partkey % 7 <> 0").select(path, F.sha2("p_name", 256).alias("content_hash"))
    current = p.where("p_partkey % 5 <> 0").select(path, F.sha2(F.when(F.col("p_size") > 40, F.col("p_type")).otherwise(F.col("p_name")), 256).alias("content_hash"))
    return S.stale_files(known, current)


@query("SELECT CASE WHEN contains(file_path, '/') THEN regexp_replace(file_path, '/[^/]*$', '') ELSE '.' END AS dir, count(DISTINCT file_path) AS files FROM nodes GROUP BY 1")
def module_structure(spark, sf):
    return _n(spark, sf).groupBy(T.dir_name(F.col("file_path")).alias("dir")).agg(F.countDistinct("file_path").alias("files"))


# --- statistics ----------------------------------------------------------------------------------------------------


@query("SELECT kind, count(*) AS n FROM nodes GROUP BY 1")
def stats_nodes_by_kind(spark, sf):
    return _count(_n(spark, sf), "kind")


@query("SELECT kind, count(*) AS n FROM edges GROUP BY 1")
def stats_edges_by_kind(spark, sf):
    return _count(_e(spark, sf), "kind")


@query("SELECT language, count(*) AS n, count(DISTINCT file_path) AS files FROM nodes GROUP BY 1")
def stats_by_language(spark, sf):
    return _n(spark, sf).groupBy("language").agg(F.count("*").alias("n"), F.countDistinct("file_path").alias("files"))


@query("SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM nodes WHERE kind = 'file') AS files")
def stats_totals(spark, sf):
    n, e = graph(spark, sf)
    a = n.agg(F.count("*").alias("nodes"), F.count(F.when(F.col("kind") == "file", 1)).alias("files"))
    return a.join(e.agg(F.count("*").alias("edges")), how="cross").select("nodes", "edges", "files")  # one row each


@query("SELECT resolved_by, count(*) AS n, round(avg(confidence), 6) AS confidence FROM edges GROUP BY 1")
def resolution_by_method(spark, sf):
    return _e(spark, sf).groupBy("resolved_by").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))


@query("SELECT count(*) AS n FROM edges WHERE confidence < 0.5")
def low_confidence_count(spark, sf):
    return S.low_confidence(_e(spark, sf))[0]


@query("SELECT source, target, kind, confidence FROM edges WHERE confidence < 0.5 ORDER BY confidence, source, target, kind LIMIT 5")
def low_confidence_examples(spark, sf):
    return S.low_confidence(_e(spark, sf))[1].select("source", "target", "kind", "confidence")


@query(", d AS (SELECT source AS id, kind, true AS o FROM edges UNION ALL SELECT target, kind, false FROM edges), m AS (SELECT id, count(*) FILTER (NOT o) AS n_in, count(*) FILTER (o) AS n_out, count(*) FILTER (o AND kind = 'calls') AS n_calls, count(*) FILTER (NOT o AND kind = 'calls') AS n_callers, count(*) FILTER (o AND kind = 'contains') AS n_children FROM d GROUP BY id) SELECT n.id, coalesce(n_in, 0) AS n_in, coalesce(n_out, 0) AS n_out, coalesce(n_calls, 0) AS n_calls, coalesce(n_callers, 0) AS n_callers, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN m ON n.id = m.id")
def node_metrics(spark, sf):
    return G.metrics(*graph(spark, sf))


@query("SELECT 'file:' || path AS file, (SELECT count(*) FROM edges e WHERE e.source = 'file:' || path AND kind = 'contains') AS members FROM np")
def inventory_members(spark, sf):
    e = _count(_e(spark, sf).where("kind = 'contains'"), "source").withColumnRenamed("n", "members")
    return _n(spark, sf).where("kind = 'file'").select(F.col("id").alias("file")).join(e, F.col("file") == F.col("source"), "left").select("file", F.coalesce("members", F.lit(0)).alias("members"))


@query("SELECT kind, count(*) AS n, count(*) FILTER (is_exported) AS exported, count(ast_hash) AS fingerprinted FROM nodes GROUP BY 1")
def inventory(spark, sf):
    return _n(spark, sf).groupBy("kind").agg(F.count("*").alias("n"), F.count(F.when(F.col("is_exported"), 1)).alias("exported"), F.count("ast_hash").alias("fingerprinted"))


@query("SELECT source, target, kind, line, count(*) AS copies FROM raw GROUP BY ALL HAVING count(*) > 1")
def edge_dedup(spark, sf):
    items = _read(spark, sf, "lineitem")
    key = [F.concat(F.lit("method:o"), F.col("l_orderkey").cast("string")).alias("source"), F.concat(F.lit("function:p"), F.col("l_partkey").cast("string")).alias("target"), F.lit("calls").alias("kind"), F.col("l_linenumber").cast("int").alias("line")]
    return items.select(*key).groupBy("source", "target", "kind", "line").agg(F.count("*").alias("copies")).where("copies > 1")


# --- graph ---------------------------------------------------------------------------------------------------------

_CALLERS = "kind IN ('calls', 'references', 'imports')"


@query(f"SELECT e.source AS id, e.kind AS edge_kind, e.line, e.confidence, n.name, n.file_path FROM edges e JOIN nodes n ON n.id = e.source WHERE e.target = '{P0}' AND e.source <> e.target AND e.{_CALLERS}")
def callers_depth1(spark, sf):
    return G.call_sites(*around(spark, sf, "target", P0), P0)


@query(f"SELECT e.target AS id, e.kind AS edge_kind, e.line, e.confidence, n.name, n.file_path FROM edges e JOIN nodes n ON n.id = e.target WHERE e.source = 'method:o1' AND e.source <> e.target AND e.{_CALLERS}")
def callees_depth1(spark, sf):
    return G.call_sites(*around(spark, sf, "source", "method:o1"), "method:o1", incoming=False)


def _bfs_sql(start: str, step: str, depth: int, kinds: str = "true") -> str:
    ends = {"in": ("target", "source"), "out": ("source", "target")}
    pairs = " UNION ALL ".join(f"SELECT {ends[d][0]} AS a, {ends[d][1]} AS b FROM edges WHERE {kinds}" for d in (["in", "out"] if step == "both" else [step]))
    return f", adj AS ({pairs}), r AS (SELECT '{start}' AS id, 0 AS depth UNION SELECT adj.b, r.depth + 1 FROM r JOIN adj ON adj.a = r.id WHERE r.depth < {depth}) SELECT id, min(depth) AS depth FROM r GROUP BY id"


@query(_bfs_sql(P0, "in", 3), recursive=True)
def bfs_in(spark, sf):
    return G.reach(spark, G.adjacency(_e(spark, sf), "incoming"), [P0], 3)


@query(_bfs_sql("class:c7", "out", 2), recursive=True)
def bfs_out(spark, sf):
    return G.reach(spark, G.adjacency(_e(spark, sf), "outgoing"), ["class:c7"], 2)


@query(_bfs_sql("method:o1", "both", 2, "kind IN ('contains', 'references')"), recursive=True)
def bfs_both_kinds(spark, sf):
    return G.reach(spark, G.adjacency(_e(spark, sf), "both", ["contains", "references"]), ["method:o1"], 2)


@query(_bfs_sql(P0, "in", 3, _CALLERS), recursive=True)
def callers_depth3(spark, sf):
    return G.reach(spark, G.adjacency(_e(spark, sf), "incoming", G.CALLER_KINDS), [P0], 3)


@query(_bfs_sql("method:o1", "out", 3, _CALLERS), recursive=True)
def callees_depth3(spark, sf):
    return G.reach(spark, G.adjacency(_e(spark, sf), "outgoing", G.CALLER_KINDS), ["method:o1"], 3)


@query(f", u AS (SELECT source AS id FROM edges WHERE target = 'method:o1' AND {_CALLERS} UNION SELECT target FROM edges WHERE source = 'method:o1' AND {_CALLERS} UNION SELECT 'method:o1') SELECT n.id, n.kind, n.name, n.file_path FROM nodes n JOIN u ON n.id = u.id")
def call_graph(spark, sf):
    return G.call_graph(spark, *graph(spark, sf), "method:o1", 1)


@query("SELECT e.source AS id, e.kind AS edge_kind, e.line, n.name, n.file_path FROM edges e JOIN nodes n ON n.id = e.source WHERE e.target = 'class:c7'")
def find_usages(spark, sf):
    return G.usages(*around(spark, sf, "target", "class:c7"), "class:c7")


@query(", step AS (SELECT target AS a, source AS b, 1 AS cost FROM edges UNION ALL SELECT source, target, 0 FROM edges JOIN nodes n ON n.id = source WHERE edges.kind = 'contains' AND n.kind IN ('class', 'interface')), r AS (SELECT 'class:c7' AS id, 0 AS depth UNION SELECT s.b, r.depth + s.cost FROM r JOIN step s ON s.a = r.id WHERE r.depth + s.cost <= 2 AND r.depth < 2) SELECT id, min(depth) AS depth FROM r GROUP BY id", recursive=True)
def impact_radius(spark, sf):
    return G.impact(spark, *graph(spark, sf), ["class:c7"], 2)


@query(", step AS (SELECT target AS a, source AS b, 1 AS cost FROM edges UNION ALL SELECT source, target, 0 FROM edges JOIN nodes n ON n.id = source WHERE edges.kind = 'contains' AND n.kind IN ('class', 'interface')), r AS (SELECT unnest(['function:p0', 'function:p1', 'class:c3']) AS id, 0 AS depth UNION SELECT s.b, r.depth + s.cost FROM r JOIN step s ON s.a = r.id WHERE r.depth + s.cost <= 1 AND r.depth < 1) SELECT id, min(depth) AS depth FROM r GROUP BY id", recursive=True)
def impact_multi_root(spark, sf):
    return G.impact(spark, *graph(spark, sf), [P0, "function:p1", "class:c3"], 1)


@query(", up AS (SELECT 'interface:s6' AS id UNION SELECT e.target FROM up JOIN edges e ON e.source = up.id AND e.kind IN ('extends', 'implements')), down AS (SELECT 'interface:s6' AS id UNION SELECT e.source FROM down JOIN edges e ON e.target = down.id AND e.kind IN ('extends', 'implements')) SELECT id, 'ancestor' AS role FROM up WHERE id <> 'interface:s6' UNION ALL SELECT id, 'descendant' FROM down WHERE id <> 'interface:s6' UNION ALL SELECT 'interface:s6', 'focal'", recursive=True)
def type_hierarchy(spark, sf):
    return G.type_hierarchy(spark, _e(spark, sf), "interface:s6")


@query(", p AS (SELECT target AS a, min(source) AS b FROM edges WHERE kind = 'contains' GROUP BY 1), r AS (SELECT 'method:o1' AS id, 0 AS depth UNION SELECT p.b, r.depth + 1 FROM r JOIN p ON p.a = r.id) SELECT id, depth FROM r WHERE depth > 0", recursive=True)
def ancestors(spark, sf):
    return G.ancestors(spark, _e(spark, sf), "method:o1")


@query("SELECT n.id, n.name, n.start_line FROM edges e JOIN nodes n ON n.id = e.target WHERE e.source = 'class:c7' AND e.kind = 'contains'")
def children_outline(spark, sf):
    return G.children(*around(spark, sf, "source", "class:c7"), "class:c7").select("id", "name", "start_line")


@query(", r AS (SELECT 'interface:s9' AS id, 0 AS depth UNION SELECT e.target, r.depth + 1 FROM r JOIN edges e ON e.source = r.id AND e.kind = 'extends' WHERE r.depth < 20) SELECT id, min(depth)::INT AS step FROM r GROUP BY id", recursive=True)
def shortest_path(spark, sf):
    return G.shortest_path(spark, _e(spark, sf), "interface:s9", "interface:s0", ["extends"])


@query("SELECT DISTINCT s.file_path AS file, t.file_path AS depends_on FROM edges e JOIN nodes s ON s.id = e.source JOIN nodes t ON t.id = e.target WHERE e.kind = 'imports' AND s.kind = 'file' AND s.file_path <> t.file_path")
def file_dependencies(spark, sf):
    return G.file_dependencies(*graph(spark, sf))


_DEP = "fd AS (SELECT DISTINCT t.file_path AS file, s.file_path AS dependent FROM edges e JOIN nodes s ON s.id = e.source JOIN nodes t ON t.id = e.target WHERE e.kind IN ('imports', 'calls', 'references', 'extends', 'implements', 'instantiates', 'decorates') AND (t.kind = 'file' OR t.is_exported) AND s.file_path <> t.file_path)"


@query(f", {_DEP} SELECT file, dependent FROM fd")
def file_dependents(spark, sf):
    return G.file_dependents(*_dependency_graph(spark, sf))


def _dependency_graph(spark, sf):
    """(nodes, edges) for dependencies of files, which are distinct pairs: not held, calls may repeat."""
    return build_nodes(spark, sf), build_edges(spark, sf, F.col("kind").isin(*G.DEPENDENCY_KINDS), repeats=True)


@query(f", {_DEP}, a AS (SELECT min(path) AS f FROM np), r AS (SELECT f AS file, 0 AS depth FROM a UNION SELECT fd.dependent, r.depth + 1 FROM r JOIN fd ON fd.file = r.file WHERE r.depth < 5 AND NOT contains(r.file, 'europe/')) SELECT DISTINCT file AS file_path FROM r WHERE contains(file, 'europe/')", recursive=True)
def affected_tests(spark, sf):
    n, e = _dependency_graph(spark, sf)
    first = n.where("kind = 'file'").agg(F.min("file_path")).first()[0]
    return G.affected_tests(spark, n, e, [first], lambda p: p.contains("europe/"))


@query(", d AS (SELECT DISTINCT s.file_path AS a, t.file_path AS b FROM edges e JOIN nodes s ON s.id = e.source JOIN nodes t ON t.id = e.target WHERE e.kind = 'imports' AND s.file_path <> t.file_path), r AS (SELECT a, b FROM d UNION SELECT r.a, d.b FROM r JOIN d ON d.a = r.b) SELECT x.a AS file, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a", recursive=True)
def import_cycles(spark, sf):
    return G.cycle_members(G.file_dependencies(*graph(spark, sf)))


@query("SELECT id, kind FROM nodes n WHERE kind IN ('function', 'method', 'class') AND NOT is_exported AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.target = n.id AND e.kind <> 'contains')")
def dead_code(spark, sf):
    return G.dead_code(*graph(spark, sf)).select("id", "kind")


@query("SELECT e.source, e.target, e.kind FROM edges e JOIN nodes s ON s.id = e.source JOIN nodes t ON t.id = e.target WHERE s.is_exported AND t.is_exported")
def filtered_subgraph(spark, sf):
    return G.induced(*graph(spark, sf), F.col("is_exported")).select("source", "target", "kind")


@query(f"SELECT source AS neighbour, kind, line, confidence, confidence < 0.5 AS low_confidence FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY confidence DESC NULLS LAST, line NULLS FIRST, kind) AS rn FROM edges WHERE target = '{P0}' AND {_CALLERS}) WHERE rn = 1")
def relations_best_edge(spark, sf):
    return G.best_relations(around(spark, sf, "target", P0)[1], P0)


@query("SELECT 'child' AS role, target AS id FROM edges WHERE source = 'class:c7' AND kind = 'contains' UNION ALL SELECT 'parent', source FROM edges WHERE target = 'class:c7' AND kind = 'contains' UNION ALL SELECT 'in', source FROM edges WHERE target = 'class:c7' AND kind <> 'contains' UNION ALL SELECT 'out', target FROM edges WHERE source = 'class:c7' AND kind <> 'contains'")
def context_parts(spark, sf):
    here, box = F.lit("class:c7"), F.col("kind") == "contains"
    hit = _e(spark, sf).where((F.col("source") == here) | (F.col("target") == here))
    role = F.when(F.col("source") == here, F.when(box, "child").otherwise("out")).otherwise(F.when(box, "parent").otherwise("in"))
    return hit.select(role.alias("role"), F.when(F.col("source") == here, F.col("target")).otherwise(F.col("source")).alias("id"))


# --- snapshots -----------------------------------------------------------------------------------------------------

_SPAN = "kind = 'function' AND end_line - start_line + 1 >= 10"


def _groups_sql(col: str) -> str:
    return f"SELECT {col} AS hash, count(*) AS members, count(DISTINCT file_path) AS files, max(end_line - start_line + 1)::BIGINT AS max_span, string_agg(id, ',' ORDER BY id) AS ids FROM nodes WHERE {_SPAN} AND {col} IS NOT NULL GROUP BY 1 HAVING count(*) > 1"


@query(f"SELECT hash, members, files, max_span FROM ({_groups_sql('ast_hash')})")
def dup_exact(spark, sf):
    return S.clone_groups(_n(spark, sf), "ast_hash").drop("member_key")


@query(f"SELECT hash, members, files, max_span FROM ({_groups_sql('ast_shape_hash')}) WHERE ids NOT IN (SELECT ids FROM ({_groups_sql('ast_hash')}))")
def dup_shape(spark, sf):
    return S.shape_groups(_n(spark, sf)).drop("member_key")


@query(f"SELECT (SELECT count(*) FROM ({_groups_sql('ast_hash')})) AS exact_groups, (SELECT sum(members)::BIGINT FROM ({_groups_sql('ast_hash')})) AS exact_members, (SELECT sum(members)::BIGINT FROM ({_groups_sql('ast_shape_hash')})) AS shape_members")
def dup_summary(spark, sf):
    n = _n(spark, sf)
    a = S.clone_groups(n, "ast_hash").agg(F.count("*").alias("exact_groups"), F.sum("members").alias("exact_members"))
    return a.join(S.clone_groups(n, "ast_shape_hash").agg(F.sum("members").alias("shape_members")), how="cross")  # one row each


@query("SELECT sha256(text) AS hash, count(*) AS members FROM documents GROUP BY 1 HAVING count(*) > 1", view=False)
def dup_documents(spark, sf):
    return _read(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("hash")).agg(F.count("*").alias("members")).where("members > 1")


_OLD, _NEW = "kind <> 'method' OR start_line % 10 <> 0", "kind <> 'class' OR start_line % 7 <> 0"


def _snapshots(spark, sf):
    n = _n(spark, sf)
    return n.where(_OLD), n.where(_NEW).withColumn("end_line", F.when((F.col("kind") == "function") & (F.col("start_line") % 3 == 0), F.col("end_line") + 1).otherwise(F.col("end_line")))


_DIFF = f", o AS (SELECT * FROM nodes WHERE {_OLD}), w AS (SELECT * REPLACE (CASE WHEN kind = 'function' AND start_line % 3 = 0 THEN end_line + 1 ELSE end_line END AS end_line) FROM nodes WHERE {_NEW}), d AS (SELECT coalesce(w.id, o.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN w.id IS NULL THEN 'removed' ELSE 'changed' END AS status, CASE WHEN o.id IS NULL OR w.id IS NULL THEN '' ELSE 'end_line' END AS changed_fields FROM o FULL JOIN w ON o.id = w.id WHERE o.id IS NULL OR w.id IS NULL OR o.end_line <> w.end_line)"


@query(_DIFF + " SELECT id, status, changed_fields FROM d")
def diff_nodes(spark, sf):
    return S.diff_nodes(*_snapshots(spark, sf))


@query(_DIFF + " SELECT status, count(*) AS n FROM d GROUP BY 1")
def diff_summary(spark, sf):
    return _count(S.diff_nodes(*_snapshots(spark, sf)), "status")


@query("SELECT source, target, kind, line, CASE WHEN line % 4 = 0 THEN 'removed' ELSE 'changed' END AS status, CASE WHEN line % 4 = 0 THEN '' ELSE 'confidence' END AS changed_fields FROM edges WHERE kind = 'calls' AND (line % 4 = 0 OR resolved_by = 'fuzzy')")
def diff_edges(spark, sf):
    old = _e(spark, sf).where("kind = 'calls'")
    new = old.where("line % 4 <> 0").withColumn("confidence", F.when(F.col("resolved_by") == "fuzzy", F.lit(2.0)).otherwise(F.col("confidence")))
    return S.diff_edges(old, new)


@query("SELECT p_partkey::VARCHAR AS path, 'changed' AS status, 'content_hash,size' AS changed_fields FROM part WHERE p_size % 2 = 0", view=False)
def diff_files(spark, sf):
    p = _read(spark, sf, "part")
    old = p.select(F.col("p_partkey").cast("string").alias("path"), F.sha2("p_name", 256).alias("content_hash"), F.col("p_size").alias("size"))
    return S.diff_files(old, old.withColumn("content_hash", F.when(F.col("size") % 2 == 0, F.lit("x")).otherwise(F.col("content_hash"))).withColumn("size", F.when(F.col("size") % 2 == 0, F.col("size") + 100).otherwise(F.col("size"))))


@query("SELECT e.source, e.target, e.kind, e.confidence, e.resolved_by, s.name AS source_name, t.name AS target_name FROM edges e JOIN nodes s ON s.id = e.source JOIN nodes t ON t.id = e.target WHERE e.source = 'interface:s9' AND e.target = 'interface:s4' AND e.kind = 'extends'")
def explain_edge(spark, sf):
    return S.explain(*graph(spark, sf), "interface:s9", "interface:s4", "extends").select("source", "target", "kind", "confidence", "resolved_by", "source_name", "target_name")


@query(", x AS (SELECT *, max(end_line) OVER (PARTITION BY file_path ORDER BY start_line, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM nodes WHERE kind = 'function'), y AS (SELECT *, sum(CASE WHEN m IS NULL OR start_line > m + 10 THEN 1 ELSE 0 END) OVER (PARTITION BY file_path ORDER BY start_line, id) AS cluster FROM x) SELECT file_path, cluster::BIGINT AS cluster, min(start_line) AS start_line, max(end_line) AS end_line, count(*) AS symbols FROM y GROUP BY file_path, cluster")
def line_clusters(spark, sf):
    return S.line_clusters(_n(spark, sf).where("kind = 'function'"))


# --- search --------------------------------------------------------------------------------------------------------

_TOK = "list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda x: x <> '')"


@query(f", t AS (SELECT id, {_TOK.format('name')} AS a, {_TOK.format('qualified_name')} AS b FROM nodes), u AS (SELECT id, unnest(a) AS term, 20.0::DOUBLE AS w FROM t UNION ALL SELECT id, unnest(b), 5.0 FROM t), l AS (SELECT id, len(a) + len(b) AS len FROM t), h AS (SELECT id, q, sum(w) AS f FROM u, (SELECT unnest(['steel', 'brand']) AS q) WHERE starts_with(term, q) GROUP BY id, q), df AS (SELECT q, count(*) AS df FROM h GROUP BY q), s AS (SELECT count(*) AS n, avg(len) AS av FROM l) SELECT id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / av))), 6) AS score FROM h JOIN df USING (q) JOIN l USING (id), s GROUP BY id ORDER BY score DESC, id LIMIT 50")
def search_fts_bm25(spark, sf):
    return R.full_text(_n(spark, sf), ["steel", "brand"])


@query("SELECT id, CASE WHEN name = 'order_12' THEN 1.0 WHEN starts_with(lower(name), 'order_12') THEN 0.9 WHEN contains(lower(name), 'order_12') THEN 0.8 ELSE 0.7 END::DOUBLE AS score FROM nodes WHERE contains(lower(name), 'order_12') OR contains(lower(qualified_name), 'order_12') ORDER BY score DESC, length(name), id LIMIT 50")
def search_like(spark, sf):
    return R.substring(_n(spark, sf), "order_12")


@query(", d AS (SELECT name, levenshtein(lower(name), 'order_12') AS distance FROM (SELECT DISTINCT name FROM nodes) WHERE abs(length(name) - 8) <= 2), c AS (SELECT * FROM d WHERE distance <= 2 ORDER BY distance, name LIMIT 100), r AS (SELECT n.id, c.distance, row_number() OVER (PARTITION BY c.name ORDER BY n.id) AS rn FROM c JOIN nodes n ON n.name = c.name) SELECT id, distance::INT AS distance, 1.0 / (1 + distance) AS score FROM r WHERE rn <= 5")
def search_fuzzy(spark, sf):
    return R.fuzzy(_n(spark, sf), "order_12")


@query(", h AS (SELECT id, lower(name) AS name, file_path FROM nodes WHERE lower(name) IN ('order_1', 'order_2', 'order_77')), f AS (SELECT DISTINCT file_path FROM h) SELECT id, 21.0 AS score FROM h")
def search_exact_colocated(spark, sf):
    return R.exact_names(_n(spark, sf), ["order_1", "order_2", "order_77"])


@query("SELECT id, name FROM nodes WHERE kind = 'class' AND language = 'building' ORDER BY name, id LIMIT 500")
def search_filters_only(spark, sf):
    return R.filtered(_n(spark, sf), ["class"], ["building"]).orderBy("name", "id").limit(500).select("id", "name")


@query("SELECT kind, CASE kind WHEN 'function' THEN 10 WHEN 'method' THEN 10 WHEN 'interface' THEN 9 WHEN 'class' THEN 8 ELSE 0 END AS bonus, count(*) AS n FROM nodes GROUP BY 1, 2")
def rank_kind_bonus(spark, sf):
    return _count(_n(spark, sf).withColumn("bonus", T.kind_bonus(F.col("kind"))), "kind", "bonus")


@query("SELECT id, (CASE WHEN lower(name) = 'order_7' THEN 80 WHEN starts_with(lower(name), 'order_7') THEN floor(10.5 + 30.0 * 7 / length(name)) WHEN contains(lower(name), 'order_7') THEN 10 ELSE 0 END)::INT AS bonus FROM nodes WHERE kind = 'method'")
def rank_name_bonus(spark, sf):
    return _n(spark, sf).where("kind = 'method'").select("id", T.name_bonus(F.col("name"), "order_7").alias("bonus"))


@query("SELECT file_path, (CASE WHEN contains(regexp_extract(file_path, '[^/]*$'), 'a') THEN 10 ELSE 0 END + CASE WHEN contains(regexp_replace(file_path, '/[^/]*$', ''), 'a') THEN 5 WHEN contains(file_path, 'a') THEN 3 ELSE 0 END) AS score, count(*) AS n FROM nodes GROUP BY 1, 2")
def rank_path_signals(spark, sf):
    return _count(_n(spark, sf).withColumn("score", T.path_relevance(F.col("file_path"), ["a"])), "file_path", "score")


@query()
def search_cascade(spark, sf):
    return R.search(_n(spark, sf), "kind:function steel brand")


# --- resolution ----------------------------------------------------------------------------------------------------


def _refs(spark, sf) -> DataFrame:
    """A reference from each order's method: to a part's qualified name, to the order's class, or to a part's name in capitals.

    Written once a session, since every strategy reads it more than once and long plans are slow to optimize."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _held:
        _held[key] = G.written(_built_refs(spark, sf))
    return _held[key]


def _built_refs(spark, sf) -> DataFrame:
    parts = _read(spark, sf, "part").count()  # every part is meant by some order
    o = _read(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % parts).alias("k"))
    n = _n(spark, sf)
    parts = n.where("kind = 'function'").select(F.col("start_line").cast("bigint").alias("k"), "name", "qualified_name")
    m = n.where("kind = 'method'").select(F.col("id").alias("from_node_id"), "file_path", "language", F.col("start_line").alias("line"), F.col("start_line").cast("bigint").alias("o_orderkey"), F.substring_index("qualified_name", "::", 1).alias("owner"))
    rows = o.join(parts, "k").join(m, "o_orderkey")
    name = F.when(F.col("o_orderkey") % 3 == 0, F.col("qualified_name")).when(F.col("o_orderkey") % 3 == 1, F.col("owner")).otherwise(F.upper("name"))
    return rows.select(F.col("o_orderkey").alias("id"), "from_node_id", name.alias("reference_name"), F.lit("calls").alias("reference_kind"), "line", "file_path", "language")


_REFS = ", refs AS (SELECT o_orderkey AS ref_id, CASE o_orderkey % 3 WHEN 0 THEN p.qualified_name WHEN 1 THEN split_part(m.qualified_name, '::', 1) ELSE upper(p.name) END AS r_name, m.file_path AS r_file, m.language AS r_language FROM orders JOIN nodes p ON p.kind = 'function' AND p.start_line = o_orderkey % (SELECT count(*) FROM part) JOIN nodes m ON m.id = 'method:o' || o_orderkey)"


@query(_REFS + ", c AS (SELECT ref_id, n.id, n.language = r_language AS same, count(*) OVER (PARTITION BY ref_id) AS c, row_number() OVER (PARTITION BY ref_id ORDER BY CASE WHEN n.language = r_language THEN 50 ELSE -80 END + 25 + CASE WHEN n.is_exported THEN 10 ELSE 0 END DESC, n.id) AS rn FROM refs JOIN nodes n ON n.name = r_name) SELECT ref_id, id AS target, CASE WHEN same THEN 0.9 ELSE 0.5 END::DOUBLE AS confidence FROM c WHERE c = 1")
def resolve_exact(spark, sf):
    return V.by_exact_name(_refs(spark, sf), _n(spark, sf)).select("ref_id", "target", "confidence")


@query(_REFS + ", q AS (SELECT ref_id, r_name FROM refs WHERE contains(r_name, '::')), e AS (SELECT ref_id, id, count(*) OVER (PARTITION BY ref_id) AS c FROM q JOIN nodes n ON n.qualified_name = r_name), x AS (SELECT ref_id, id, 0.95 AS k FROM e WHERE c = 1 UNION ALL SELECT ref_id, n.id, 0.85 FROM q JOIN nodes n ON n.name = split_part(r_name, '::', 2) AND ends_with(n.qualified_name, r_name)), y AS (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY k DESC, id) AS rn FROM x) SELECT ref_id, id AS target, k::DOUBLE AS confidence FROM y WHERE rn = 1")
def resolve_qualified(spark, sf):
    return V.by_qualified_name(_refs(spark, sf), _n(spark, sf)).select("ref_id", "target", "confidence")


@query(_REFS + ", p AS (SELECT ref_id, n.id, n.language = r_language AS same FROM refs JOIN nodes n ON lower(n.name) = lower(r_name) WHERE n.kind IN ('function', 'method', 'class')), s AS (SELECT *, count(*) FILTER (same) OVER (PARTITION BY ref_id) AS s FROM p), f AS (SELECT *, count(*) OVER (PARTITION BY ref_id) AS c FROM s WHERE s = 0 OR same) SELECT ref_id, id AS target, CASE WHEN same THEN 0.5 ELSE 0.3 END::DOUBLE AS confidence FROM f WHERE c = 1")
def resolve_fuzzy(spark, sf):
    return V.by_fuzzy_name(_refs(spark, sf), _n(spark, sf)).select("ref_id", "target", "confidence")


@query()
def resolve_method(spark, sf):
    return V.by_method(_refs(spark, sf), _n(spark, sf))


@query()
def resolve_final(spark, sf):
    return V.resolve(_refs(spark, sf), _n(spark, sf))


@query()
def edge_kind_promotion(spark, sf):
    r = _refs(spark, sf)
    return V.to_edges(V.resolve(r, _n(spark, sf)), r, _n(spark, sf))


# --- markup, extraction, streams -----------------------------------------------------------------------------------


@query("SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href FROM pages", view=False)
def extract_links(spark, sf):
    return C.links(_read(spark, sf, "pages"))


@query("SELECT trim(selector) AS selector, count(*) AS n FROM (SELECT unnest(string_split(split_part(rule, '{', 1), ',')) AS selector FROM (SELECT unnest(regexp_extract_all(css, '[^{}]+\\{[^{}]*\\}')) AS rule FROM (SELECT unnest(regexp_extract_all(html, '(?s)<style[^>]*>(.*?)</style>', 1)) AS css FROM pages))) GROUP BY 1", view=False)
def css_selectors(spark, sf):
    return _count(C.style_rules(_read(spark, sf, "pages")), "selector")


@query("SELECT DISTINCT 'p' AS selector, 1 AS specificity FROM pages WHERE contains(html, '<style>p{')", view=False)
def css_specificity(spark, sf):
    return C.style_rules(_read(spark, sf, "pages")).select("selector", C.specificity(F.col("selector")).alias("specificity")).distinct()


@query("SELECT page_id, token FROM (SELECT page_id, unnest(regexp_split_to_array(a, '\\s+')) AS token FROM (SELECT page_id, unnest(regexp_extract_all(html, 'class=\"([^\"]*)\"', 1)) AS a FROM pages)) WHERE token <> ''", view=False)
def class_consumers(spark, sf):
    return C.class_tokens(_read(spark, sf, "pages"))


@query("SELECT 'x' AS selector WHERE false", view=False)
def unused_selectors(spark, sf):
    p = _read(spark, sf, "pages")
    return C.unused_selectors(C.style_rules(p), C.class_tokens(p))


@query("SELECT page_id FROM pages WHERE regexp_matches(html, 'var\\(\\s*--accent\\s*[,)]')", view=False)
def token_usage(spark, sf):
    return C.token_uses(C.style_rules(_read(spark, sf, "pages")), "--accent")


@query("SELECT 'src/p' || p_partkey || '.py' AS file_path, 'part_' || p_partkey AS name, 1 AS start_line, 2 AS end_line FROM part", view=False)
def extract_python(spark, sf):
    p = _read(spark, sf, "part")
    key = F.col("p_partkey").cast("string")
    files = p.select(F.concat(F.lit("src/p"), key, F.lit(".py")).alias("path"), F.concat(F.lit("def part_"), key, F.lit("(x):\n    return size(x)\n")).alias("content"))
    return X.extract(files).where("record = 'node' AND kind = 'function'").select("file_path", "name", "start_line", "end_line")


@query("SELECT user_id, min(ts) AS first, count(*) AS events FROM (SELECT *, sum(CASE WHEN g IS NULL OR ts - g >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events)) GROUP BY user_id, s", view=False)
def debounce_sessions(spark, sf):
    return debounced(_read(spark, sf, "events"), "user_id", "ts", "30 minutes").select("user_id", F.col("start").alias("first"), "events")
