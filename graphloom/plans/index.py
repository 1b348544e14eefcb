"""From a source tree to a snapshot of nodes, edges, references and files, and from a snapshot to a fresh one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.extract import LANGUAGES, extract
from ..operators.resolve import resolve, to_edges
from ..operators.snapshot import stale_files
from ..schema import symbol_id
from ..sources.scan import scan

TABLES = ("nodes", "edges", "refs", "files")


def _language(path):
    table = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    return F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)))


def tables_of(files: DataFrame) -> dict[str, DataFrame]:
    """``files`` (path, content, content_hash, size) to nodes, containment edges and pending references."""
    rows = extract(files)
    path, name = F.col("file_path"), F.col("name")
    own = F.when(F.col("kind") == "file", F.concat(F.lit("file:"), path)).otherwise(symbol_id(F.col("kind"), path, name, F.col("start_line")))
    nodes = rows.where("record = 'node'").select(own.alias("id"), "kind", "name", "qualified_name", "file_path", _language(path).alias("language"), "start_line", "end_line", "is_exported", "ast_hash", "ast_shape_hash", "parent")
    nodes = nodes.dropDuplicates(["id"])
    scope = nodes.select("file_path", F.col("qualified_name").alias("parent"), F.col("id").alias("parent_id")).groupBy("file_path", "parent").agg(F.min("parent_id").alias("parent_id"))
    at_file = F.concat(F.lit("file:"), F.col("file_path"))
    inside = nodes.where("kind <> 'file'").join(scope, ["file_path", "parent"], "left")
    edges = inside.select(F.coalesce("parent_id", at_file).alias("source"), F.col("id").alias("target"), F.lit("contains").alias("kind"), F.lit(None).cast("int").alias("line"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("resolved_by"))
    pending = rows.where("record = 'ref'").join(scope, ["file_path", "parent"], "left")
    refs = pending.select(F.xxhash64("file_path", "kind", "name", "start_line", "parent").alias("id"), F.coalesce("parent_id", at_file).alias("from_node_id"), name.alias("reference_name"), F.col("kind").alias("reference_kind"), F.col("start_line").alias("line"), "file_path", _language(path).alias("language")).dropDuplicates(["id"])
    counts = nodes.groupBy(F.col("file_path").alias("path")).agg(F.count("*").cast("int").alias("node_count"))
    listed = files.select("path", "content_hash", "size", _language(F.col("path")).alias("language")).join(counts, "path", "left")
    return {"nodes": nodes.drop("parent"), "edges": edges, "refs": refs, "files": listed}


def resolved_edges(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    return to_edges(resolve(refs, nodes), refs, nodes).dropDuplicates(["source", "target", "kind", "line"])


def write_snapshot(tables: dict[str, DataFrame], folder: str) -> None:
    for name in TABLES:
        tables[name].write.mode("overwrite").parquet(f"{folder}/{name}")


def read_snapshot(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in TABLES}


def index(spark: SparkSession, root: str, folder: str, include=(), exclude=()) -> dict[str, DataFrame]:
    """Scan, extract and resolve a tree; references are kept, so that a later change can resolve them anew."""
    files = scan(spark, root, include, exclude).where("skip_reason is null")
    made = tables_of(files)
    write_snapshot(made, f"{folder}/raw")
    made = read_snapshot(spark, f"{folder}/raw")
    made["edges"] = made["edges"].unionByName(resolved_edges(made["refs"], made["nodes"]))
    write_snapshot(made, f"{folder}/graph")
    return read_snapshot(spark, f"{folder}/graph")


def sync(spark: SparkSession, root: str, old_folder: str, new_folder: str) -> DataFrame:
    """(path, status) of the files that changed; writes the snapshot that results to ``new_folder``.

    Unchanged files keep their symbols and references; all references are resolved anew, since one of an unchanged
    file may mean a symbol of a changed one.
    """
    old = read_snapshot(spark, f"{old_folder}/graph")
    files = scan(spark, root).where("skip_reason is null")
    changes = stale_files(old["files"], files).cache()
    gone = changes.where("status <> 'added'").select("path")
    made = tables_of(files.join(changes.where("status <> 'removed'").select("path"), "path", "left_semi"))
    at = gone.withColumnRenamed("path", "file_path")
    kept = old["nodes"].join(at, "file_path", "left_anti")
    boxes = old["edges"].where("kind = 'contains'").join(kept.select(F.col("id").alias("target")), "target", "left_semi")
    raw = {
        "nodes": kept.unionByName(made["nodes"]),
        "edges": boxes.unionByName(made["edges"]),
        "refs": old["refs"].join(at, "file_path", "left_anti").unionByName(made["refs"]),
        "files": old["files"].join(gone, "path", "left_anti").unionByName(made["files"]),
    }
    write_snapshot(raw, f"{new_folder}/raw")
    made = read_snapshot(spark, f"{new_folder}/raw")
    made["edges"] = made["edges"].unionByName(resolved_edges(made["refs"], made["nodes"]))
    write_snapshot(made, f"{new_folder}/graph")
    return changes
