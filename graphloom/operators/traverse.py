"""Graph traversal as level loops: joins from a frontier to its neighbours, never recursion over rows."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import CALLER_KINDS, CONTAINERS, DEPENDENCY_KINDS

#: A frontier of at most so many ids is held by the driver and sent as a filter; a larger one stays a table.
DRIVER_FRONTIER = 5000
REACH = "id string, depth int"


def adjacency(edges: DataFrame, direction: str = "outgoing", kinds: Iterable[str] | None = None) -> DataFrame:
    """(src, dst) in the direction of travel."""
    if kinds is not None:
        edges = edges.where(F.col("kind").isin(*kinds))
    out = edges.select(F.col("source").alias("src"), F.col("target").alias("dst"))
    back = edges.select(F.col("target").alias("src"), F.col("source").alias("dst"))
    return {"outgoing": out, "incoming": back, "both": out.union(back)}[direction]


def _checkpoint_dir(spark: SparkSession) -> str:
    if spark.sparkContext.getCheckpointDir() is None:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            import tempfile

            root = tempfile.mkdtemp(prefix="graphloom-")
        spark.sparkContext.setCheckpointDir(root)
    return spark.sparkContext.getCheckpointDir()


def _checkpointed(df: DataFrame) -> DataFrame:
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """As a checkpoint, but in columns and compressed: for tables as large as the input."""
    folder = f"{_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def reach(spark: SparkSession, adj: DataFrame, start: list[str], depth: int | None = None) -> DataFrame:
    """(id, depth): every node within ``depth`` steps of the start, with its least depth.

    While the frontier is small, a level is one filtered scan whose new ids return to the driver, at most
    DRIVER_FRONTIER + 1 of them; once it is larger, frontier and visited ids become tables, cut by a checkpoint a
    level, and levels are joins.
    """
    level, seen = 0, {s: 0 for s in start}
    frontier = list(seen)
    while frontier and (depth is None or level < depth):
        level += 1
        step = adj.where(F.col("src").isin(*frontier)).select("dst").distinct()
        found = [r[0] for r in step.limit(DRIVER_FRONTIER + 1).collect()]
        if len(found) > DRIVER_FRONTIER or len(seen) > 4 * DRIVER_FRONTIER:
            return _wide(spark, adj, seen, level - 1, depth)
        frontier = [x for x in found if x not in seen]
        seen.update(dict.fromkeys(frontier, level))
    return spark.createDataFrame(list(seen.items()), REACH)


def _wide(spark: SparkSession, adj: DataFrame, seen: dict[str, int], level: int, depth: int | None) -> DataFrame:
    visited = spark.createDataFrame(list(seen.items()), REACH)
    frontier = visited.where(F.col("depth") == level)
    while depth is None or level < depth:
        level += 1
        step = adj.join(frontier.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        new = _checkpointed(step.join(visited.select("id"), "id", "left_anti").withColumn("depth", F.lit(level)))
        if new.isEmpty():
            break
        visited, frontier = _checkpointed(visited.unionByName(new)), new
    return visited


def with_nodes(ids: DataFrame, nodes: DataFrame) -> DataFrame:
    return ids.join(nodes.select("id", "kind", "name", "file_path"), "id")


def call_sites(nodes: DataFrame, edges: DataFrame, id_: str, incoming: bool = True, kinds=CALLER_KINDS) -> DataFrame:
    """One row for each edge at the symbol, itself excluded: direct callers or callees."""
    here, there = ("target", "source") if incoming else ("source", "target")
    hits = edges.where((F.col(here) == id_) & (F.col(there) != id_) & F.col("kind").isin(*kinds))
    return hits.select(F.col(there).alias("id"), F.col("kind").alias("edge_kind"), "line", "confidence").join(nodes.select("id", "name", "file_path"), "id")


def usages(nodes: DataFrame, edges: DataFrame, id_: str) -> DataFrame:
    """Every incoming edge of any kind, with its source."""
    hits = edges.where(F.col("target") == id_).select(F.col("source").alias("id"), F.col("kind").alias("edge_kind"), "line")
    return hits.join(nodes.select("id", "name", "file_path"), "id")


def call_graph(spark, nodes, edges, id_: str, depth: int = 2) -> DataFrame:
    up = reach(spark, adjacency(edges, "incoming", CALLER_KINDS), [id_], depth)
    down = reach(spark, adjacency(edges, "outgoing", CALLER_KINDS), [id_], depth)
    return with_nodes(up.union(down).select("id").distinct(), nodes)


def impact(spark: SparkSession, nodes: DataFrame, edges: DataFrame, roots: list[str], depth: int = 3) -> DataFrame:
    """(id, depth): what depends on the roots. Members of containers cost nothing; any incoming edge is a step."""
    boxes = nodes.where(F.col("kind").isin(*CONTAINERS)).select(F.col("id").alias("source"))
    members = edges.where("kind = 'contains'").join(boxes, "source", "left_semi").select(F.col("source").alias("src"), F.col("target").alias("dst"))
    back = adjacency(edges, "incoming")
    seen = {r: 0 for r in roots}
    frontier = list(seen)
    for level in range(depth):
        inside = frontier
        while inside:
            new = [r["id"] for r in reach(spark, members, inside, 1).where("depth > 0").collect() if r["id"] not in seen]
            seen.update(dict.fromkeys(new, level))
            frontier = frontier + new
            inside = new
        new = [r["id"] for r in reach(spark, back, frontier, 1).where("depth > 0").collect() if r["id"] not in seen]
        seen.update(dict.fromkeys(new, level + 1))
        frontier = new
        if not frontier:
            break
    return spark.createDataFrame(list(seen.items()), REACH)


def type_hierarchy(spark: SparkSession, edges: DataFrame, id_: str) -> DataFrame:
    """(id, role): ancestors and descendants over extends and implements, and the focal type."""
    kinds = ("extends", "implements")
    up = reach(spark, adjacency(edges, "outgoing", kinds), [id_]).where("depth > 0").select("id", F.lit("ancestor").alias("role"))
    down = reach(spark, adjacency(edges, "incoming", kinds), [id_]).where("depth > 0").select("id", F.lit("descendant").alias("role"))
    return up.union(down).union(spark.createDataFrame([(id_, "focal")], "id string, role string"))


def ancestors(spark: SparkSession, edges: DataFrame, id_: str) -> DataFrame:
    """(id, depth): containing symbols from the inside out."""
    parents = edges.where("kind = 'contains'").groupBy(F.col("target").alias("src")).agg(F.min("source").alias("dst"))
    return reach(spark, parents, [id_]).where("depth > 0")


def children(nodes: DataFrame, edges: DataFrame, id_: str) -> DataFrame:
    hits = edges.where((F.col("source") == id_) & (F.col("kind") == "contains")).select(F.col("target").alias("id"))
    return hits.join(nodes, "id")


def shortest_path(spark: SparkSession, edges: DataFrame, start: str, goal: str, kinds=None, depth: int = 50) -> DataFrame:
    """(step, id): a path of least hops along outgoing edges, the smallest ids first; empty where there is none."""
    adj = adjacency(edges, "outgoing", kinds)
    parent, frontier = {start: None}, [start]
    for _ in range(depth):
        if goal in parent or not frontier:
            break
        rows = adj.where(F.col("src").isin(*frontier)).groupBy("dst").agg(F.min("src").alias("src")).collect()
        frontier = [r["dst"] for r in rows if r["dst"] not in parent]
        parent.update({r["dst"]: r["src"] for r in rows if r["dst"] not in parent})
    path, at = [], goal if goal in parent else None
    while at is not None:
        path.append(at)
        at = parent[at]
    return spark.createDataFrame([(i, x) for i, x in enumerate(reversed(path))], "step int, id string")


def file_dependencies(nodes: DataFrame, edges: DataFrame, kinds=("imports",)) -> DataFrame:
    """(file, depends_on): files that a file node imports from."""
    n = nodes.select("id", "file_path", "kind")
    e = edges.where(F.col("kind").isin(*kinds))
    s = n.where("kind = 'file'").select(F.col("id").alias("source"), F.col("file_path").alias("file"))
    t = n.select(F.col("id").alias("target"), F.col("file_path").alias("depends_on"))
    return e.join(s, "source").join(t, "target").where("file <> depends_on").select("file", "depends_on").distinct()


def file_dependents(nodes: DataFrame, edges: DataFrame, kinds=DEPENDENCY_KINDS) -> DataFrame:
    """(file, dependent): files with an edge into a file node or an exported symbol of another file."""
    e = edges.where(F.col("kind").isin(*kinds))
    t = nodes.where("kind = 'file' OR is_exported").select(F.col("id").alias("target"), F.col("file_path").alias("file"))
    s = nodes.select(F.col("id").alias("source"), F.col("file_path").alias("dependent"))
    return e.join(t, "target").join(s, "source").where("file <> dependent").select("file", "dependent").distinct()


def affected_tests(spark: SparkSession, nodes: DataFrame, edges: DataFrame, changed: list[str], is_test, depth: int = 5) -> DataFrame:
    """(file_path): tests among the changed files and their transitive dependents; a test is not followed further."""
    dep = file_dependents(nodes, edges).withColumn("test", is_test(F.col("dependent"))).persist()
    flags = spark.createDataFrame([(c,) for c in changed], "file string").withColumn("test", is_test(F.col("file"))).collect()
    tests = {r["file"] for r in flags if r["test"]}
    seen = {r["file"] for r in flags if not r["test"]}
    frontier = list(seen)
    for _ in range(depth):
        if not frontier:
            break
        rows = dep.where(F.col("file").isin(*frontier)).select("dependent", "test").distinct().collect()
        tests |= {r["dependent"] for r in rows if r["test"]}
        frontier = [r["dependent"] for r in rows if not r["test"] and r["dependent"] not in seen]
        seen.update(frontier)
    dep.unpersist()
    return spark.createDataFrame([(t,) for t in sorted(tests)], "file_path string")


def cycle_members(deps: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(file, component): files on a dependency cycle, with the smallest file that each reaches and is reached from.

    Reachability by squaring: pairs double their length each round, so rounds grow with the logarithm.
    """
    paths = _checkpointed(deps.select(F.col("file").alias("a"), F.col("depends_on").alias("b")).distinct())
    count = paths.count()
    for _ in range(max_rounds):
        longer = paths.join(paths.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b"))
        paths = _checkpointed(paths.union(longer).distinct())
        now = paths.count()
        if now == count:
            break
        count = now
    mutual = paths.join(paths.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"])
    return mutual.groupBy(F.col("a").alias("file")).agg(F.min("b").alias("component"))


def dead_code(nodes: DataFrame, edges: DataFrame, kinds=("function", "method", "class")) -> DataFrame:
    """Symbols that are not exported and that no edge but containment enters; a self-call counts as use."""
    used = edges.where("kind <> 'contains'").select(F.col("target").alias("id"))
    return nodes.where(F.col("kind").isin(*kinds) & ~F.col("is_exported")).join(used, "id", "left_anti")


def metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, n_in, n_out, n_calls, n_callers, n_children) of every node, from one pass over the edges."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("source").alias("id"), F.lit(True).alias("out")), F.struct(F.col("target").alias("id"), F.lit(False).alias("out")))).alias("e"), "kind").select("e.*", "kind")
    count = lambda c: F.count(F.when(c, 1))
    call = F.col("kind") == "calls"
    m = ends.groupBy("id").agg(count(~F.col("out")).alias("n_in"), count(F.col("out")).alias("n_out"), count(F.col("out") & call).alias("n_calls"), count(~F.col("out") & call).alias("n_callers"), count(F.col("out") & (F.col("kind") == "contains")).alias("n_children"))
    return nodes.select("id").join(m, "id", "left").fillna(0)


def induced(nodes: DataFrame, edges: DataFrame, predicate) -> DataFrame:
    """Edges between nodes that satisfy the predicate."""
    ids = nodes.where(predicate).select("id")
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def best_relations(edges: DataFrame, id_: str, incoming: bool = True, kinds=CALLER_KINDS) -> DataFrame:
    """Per neighbour the edge of highest confidence (null lowest, then the smallest line)."""
    here, there = ("target", "source") if incoming else ("source", "target")
    hits = edges.where((F.col(here) == id_) & F.col("kind").isin(*kinds)).withColumn("neighbour", F.col(there))
    w = Window.partitionBy("neighbour").orderBy(F.col("confidence").desc_nulls_last(), F.col("line").asc_nulls_first(), "kind")
    return hits.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select("neighbour", "kind", "line", "confidence", (F.col("confidence") < 0.5).alias("low_confidence"))
