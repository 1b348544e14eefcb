"""Context for a task: the symbols a question means, what surrounds them, and their source lines, within budgets."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import is_test_file
from .search import search
from .traverse import adjacency, reach

# Words of a question that name nothing, and the default budgets.
STOP_WORDS = frozenset("a an and are as at be by do does for from has have how i in is it of on or that the this to was what when where which who why will with work works".split())
MAX_NODES, MAX_BLOCKS, MAX_CHARS = 20, 5, 1500


def search_terms(text: str) -> list[str]:
    """Words of three letters or more: compounds as written, then their camel-case and snake-case parts."""
    out: list[str] = []
    for word in re.findall(r"[A-Za-z_$][\w$]*", text):
        parts = [word] + re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", word).replace("_", " ").split()
        out += [p.lower() for p in parts if len(p) > 2 and p.lower() not in STOP_WORDS]
    return list(dict.fromkeys(out))


def relevant_context(spark: SparkSession, nodes: DataFrame, edges: DataFrame, question: str, max_nodes: int = MAX_NODES, depth: int = 1) -> DataFrame:
    """(id, name, file_path, depth, score): the best matches of the question's terms and their neighbours.

    Tests count for less; a file gives a fifth of the nodes at most, five at least.
    """
    terms = search_terms(question)
    if not terms:
        return nodes.select("id", "name", "file_path", F.lit(0).alias("depth"), F.lit(0.0).alias("score")).limit(0)
    hits = search(nodes, " ".join(terms), max(5 * max_nodes, 100)).join(nodes.select("id", "file_path"), "id")
    hits = hits.withColumn("score", F.when(is_test_file(F.col("file_path")), F.col("score") * 0.3).otherwise(F.col("score")))
    roots = {r["id"]: r["score"] for r in hits.orderBy(F.col("score").desc(), "id").limit(max_nodes).collect()}
    around = reach(spark, adjacency(edges, "both"), list(roots), depth)
    scores = spark.createDataFrame(list(roots.items()) or [("", 0.0)], "id string, score double")
    rows = around.join(nodes.select("id", "name", "file_path"), "id").join(scores, "id", "left").fillna(0.0, ["score"])
    cap = max(5, -(-max_nodes // 5))
    w = Window.partitionBy("file_path").orderBy("depth", F.col("score").desc(), "id")
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= cap).drop("_rn").orderBy("depth", F.col("score").desc(), "id").limit(max_nodes)


def code_blocks(context: DataFrame, nodes: DataFrame, files: DataFrame, blocks: int = MAX_BLOCKS, chars: int = MAX_CHARS) -> DataFrame:
    """(id, file_path, start_line, code): source lines of the first symbols, cut to ``chars``; files (path, content)."""
    chosen = context.orderBy("depth", F.col("score").desc(), "id").limit(blocks).select("id")
    lines = nodes.where("kind <> 'file'").join(chosen, "id", "left_semi").join(files.select(F.col("path").alias("file_path"), "content"), "file_path")
    code = F.array_join(F.expr("slice(split(content, '\\n'), start_line, greatest(end_line - start_line + 1, 1))"), "\n")
    return lines.select("id", "file_path", "start_line", F.substring(code, 1, chars).alias("code"))


def evaluate(ranked: DataFrame, expected: DataFrame) -> DataFrame:
    """(case, recall, precision, mrr): ranked (case, name, rank) against expected (case, name)."""
    marked = ranked.join(expected.withColumn("good", F.lit(True)), ["case", "name"], "left")
    got = marked.groupBy("case").agg(F.count("good").alias("hits"), F.count("*").alias("shown"), F.min(F.when(F.col("good"), F.col("rank"))).alias("first"))
    want = expected.groupBy("case").agg(F.count("*").alias("wanted"))
    out = want.join(got, "case", "left").fillna(0, ["hits", "shown"])
    return out.select("case", (F.col("hits") / F.col("wanted")).alias("recall"), F.when(F.col("shown") > 0, F.col("hits") / F.col("shown")).otherwise(0.0).alias("precision"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"))
