"""One object over the tables of a graph, with the questions as methods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import is_affected_test, path_filter
from .operators import context as X
from .operators import search as R
from .operators import snapshot as S
from .operators import traverse as G
from .plans import index as I


class SymbolGraph:
    def __init__(self, spark: SparkSession, nodes: DataFrame, edges: DataFrame, files: DataFrame | None = None, refs: DataFrame | None = None):
        self.spark, self.nodes, self.edges, self.files, self.refs = spark, nodes, edges, files, refs

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> SymbolGraph:
        t = I.read_snapshot(spark, f"{folder}/graph")
        return cls(spark, t["nodes"], t["edges"], t["files"], t["refs"])

    @classmethod
    def index(cls, spark: SparkSession, root: str, folder: str) -> SymbolGraph:
        I.index(spark, root, folder)
        return cls.open(spark, folder)

    def find(self, symbol: str) -> list[str]:
        """Ids of the symbols meant by a name or a qualified name (``::`` or ``.``)."""
        qualified = symbol.replace(".", "::")
        hit = (F.col("name") == symbol) | (F.col("qualified_name") == qualified) | F.col("qualified_name").endswith("::" + qualified)
        return [r["id"] for r in self.nodes.where(hit & (F.col("kind") != "file")).select("id").orderBy("id").limit(1000).collect()]

    def search(self, text: str, limit: int = 100) -> DataFrame:
        return R.search(self.nodes, text, limit)

    def _merged(self, symbol: str, one) -> DataFrame:
        out = None
        for i in self.find(symbol):
            out = one(i) if out is None else out.union(one(i))
        return self.nodes.select("id", "name", "file_path").limit(0) if out is None else out.select("id", "name", "file_path").distinct()

    def callers(self, symbol: str) -> DataFrame:
        return self._merged(symbol, lambda i: G.call_sites(self.nodes, self.edges, i))

    def callees(self, symbol: str) -> DataFrame:
        return self._merged(symbol, lambda i: G.call_sites(self.nodes, self.edges, i, incoming=False))

    def usages(self, symbol: str) -> DataFrame:
        return self._merged(symbol, lambda i: G.usages(self.nodes, self.edges, i))

    def impact(self, symbol: str, depth: int = 3) -> DataFrame:
        return G.with_nodes(G.impact(self.spark, self.nodes, self.edges, self.find(symbol), depth), self.nodes)

    def hierarchy(self, symbol: str) -> DataFrame:
        return G.type_hierarchy(self.spark, self.edges, self.find(symbol)[0])

    def path(self, start: str, goal: str) -> DataFrame:
        return G.shortest_path(self.spark, self.edges, self.find(start)[0], self.find(goal)[0])

    def dead_code(self, kinds=("function", "method", "class")) -> DataFrame:
        return G.dead_code(self.nodes, self.edges, kinds).select("id", "kind", "name", "file_path")

    def cycles(self) -> DataFrame:
        return G.cycle_members(G.file_dependencies(self.nodes, self.edges))

    def affected(self, changed: list[str], depth: int = 5) -> DataFrame:
        return G.affected_tests(self.spark, self.nodes, self.edges, changed, is_affected_test, depth)

    def duplicates(self, kinds=S.FINGERPRINTED, min_lines: int = 10) -> DataFrame:
        exact = S.clone_groups(self.nodes, "ast_hash", kinds, min_lines).withColumn("level", F.lit("exact"))
        shape = S.shape_groups(self.nodes, kinds, min_lines).withColumn("level", F.lit("shape"))
        return exact.unionByName(shape).orderBy(F.col("members").desc(), F.col("max_span").desc(), "hash")

    def diff(self, other: SymbolGraph) -> dict[str, DataFrame]:
        return {"nodes": S.diff_nodes(self.nodes, other.nodes), "edges": S.diff_edges(self.edges, other.edges), "files": S.diff_files(self.files, other.files)}

    def explain(self, source: str, target: str, kind: str) -> DataFrame:
        return S.explain(self.nodes, self.edges, source, target, kind)

    def list_files(self, include=(), exclude=()) -> DataFrame:
        return self.files.where(path_filter(F.col("path"), list(include), list(exclude))).orderBy("path")

    def status(self) -> dict[str, int]:
        return {"nodes": self.nodes.count(), "edges": self.edges.count(), "files": self.files.count() if self.files is not None else 0}

    def context(self, question: str, max_nodes: int = X.MAX_NODES) -> DataFrame:
        return X.relevant_context(self.spark, self.nodes, self.edges, question, max_nodes)
