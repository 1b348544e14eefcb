"""Table schemas of the graph store and its identity rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NODES = """id string, kind string, name string, qualified_name string, file_path string, language string,
start_line int, end_line int, start_column int, end_column int, docstring string, signature string, visibility string,
is_exported boolean, is_async boolean, is_static boolean, is_abstract boolean, decorators array<string>,
type_parameters array<string>, updated_at bigint, ast_hash string, ast_shape_hash string, sig_hash string,
call_pattern_hash string"""
EDGES = """id bigint, source string, target string, kind string, metadata string, line int, col int,
provenance string, confidence double, resolved_by string"""
FILES = """path string, content_hash string, language string, size bigint, modified_at bigint, indexed_at bigint,
node_count int, errors array<string>"""
REFS = """id bigint, from_node_id string, reference_name string, reference_kind string, line int, col int,
candidates array<string>, file_path string, language string"""
EDGE_IDENTITY = ("source", "target", "kind", "line", "col")
# Kinds whose members belong to them in impact analysis.
CONTAINERS = ("class", "interface", "struct", "trait", "protocol", "module", "enum")
# Kinds that connect files for affected tests.
DEPENDENCY_KINDS = ("imports", "calls", "references", "extends", "implements", "instantiates", "decorates")
CALLER_KINDS = ("calls", "references", "imports")


def symbol_id(kind: Column, path: Column, name: Column, line: Column) -> Column:
    """``kind:`` and the first 32 hex digits of sha256("path:kind:name:line")."""
    return F.concat(kind, F.lit(":"), F.substring(F.sha2(F.concat_ws(":", path, kind, name, line.cast("string")), 256), 1, 32))


def _first_by(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def upsert_nodes(old: DataFrame, new: DataFrame, order: str = "updated_at") -> DataFrame:
    """Rows that lack a required field are skipped; of equal ids the last wins; qualified_name defaults to name."""
    need = [F.col(c).isNotNull() & (F.col(c) != "") for c in ("id", "kind", "name", "file_path", "language")]
    ok = need[0]
    for c in need[1:]:
        ok = ok & c
    new = _first_by(new.where(ok), [F.col("id")], [F.col(order).desc()]).withColumn("qualified_name", F.coalesce("qualified_name", "name"))
    return old.join(new.select("id"), "id", "left_anti").unionByName(new, allowMissingColumns=True)


def insert_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Of equal identities the first wins (smallest id), with a null line or column equal to another."""
    both = old.unionByName(new, allowMissingColumns=True)
    keys = [F.col(c) for c in ("source", "target", "kind")] + [F.coalesce(c, F.lit(-1)) for c in ("line", "col")]
    return _first_by(both, keys, [F.col("id")])


def delete_nodes(nodes: DataFrame, edges: DataFrame, refs: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Delete nodes by id, and with them their edges and pending references."""
    ids = gone.select("id").distinct()
    keep = lambda df, col: df.join(ids.withColumnRenamed("id", col), col, "left_anti")
    return keep(nodes, "id"), keep(keep(edges, "source"), "target").select(*edges.columns), keep(refs, "from_node_id").select(*refs.columns)


def replace_file(nodes, edges, files, new_nodes, new_edges, new_file):
    """Replace what one file holds, unless its hash is unchanged; edges keep only ends that exist."""
    changed = new_file.join(files.select("path", F.col("content_hash").alias("_old")), "path", "left").where(F.col("_old").isNull() | (F.col("_old") != F.col("content_hash"))).drop("_old")
    fresh = new_nodes.join(changed.select(F.col("path").alias("file_path")), "file_path", "left_semi")
    gone = nodes.join(changed.select(F.col("path").alias("file_path")), "file_path", "left_semi").select("id")
    kept_nodes, kept_edges, _ = delete_nodes(nodes, edges, edges.select(F.col("source").alias("from_node_id")), gone)
    all_nodes = kept_nodes.unionByName(fresh, allowMissingColumns=True)
    ids = all_nodes.select("id")
    ok = new_edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    all_files = files.join(changed.select("path"), "path", "left_anti").unionByName(changed, allowMissingColumns=True)
    return all_nodes, insert_edges(kept_edges, ok), all_files
