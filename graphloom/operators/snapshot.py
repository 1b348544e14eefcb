"""Clones inside a snapshot, differences between two, and explanations of single edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The fields of a node and of a file that a diff tracks.
NODE_FIELDS = ("name", "qualified_name", "kind", "file_path", "start_line", "end_line", "is_exported", "ast_hash", "ast_shape_hash", "language")
FINGERPRINTED = ("function", "method")


def eligible(nodes: DataFrame, kinds=FINGERPRINTED, min_lines: int = 10) -> DataFrame:
    if not kinds:
        raise ValueError("no kinds given")
    return nodes.where(F.col("kind").isin(*kinds)).withColumn("span", F.col("end_line") - F.col("start_line") + 1).where(F.col("span") >= min_lines)


def clone_members(nodes: DataFrame, column: str, kinds=FINGERPRINTED, min_lines: int = 10) -> DataFrame:
    """(hash, id, file_path, span) of every eligible symbol that shares its hash with another."""
    rows = eligible(nodes, kinds, min_lines).where(F.col(column).isNotNull()).select(F.col(column).alias("hash"), "id", "file_path", "span")
    several = rows.groupBy("hash").agg(F.count("*").alias("c")).where("c > 1").select("hash")
    return rows.join(several, "hash", "left_semi")


def clone_groups(nodes: DataFrame, column: str, kinds=FINGERPRINTED, min_lines: int = 10) -> DataFrame:
    """(hash, members, files, max_span, member_key): one row a group; the key is a digest of its members' ids."""
    m = clone_members(nodes, column, kinds, min_lines)
    key = F.sha2(F.concat(F.sum(F.xxhash64("id").cast("decimal(38,0)")).cast("string"), F.lit("/"), F.bit_xor(F.xxhash64("id")).cast("string"), F.lit("/"), F.count("*").cast("string")), 256)
    return m.groupBy("hash").agg(F.count("*").alias("members"), F.countDistinct("file_path").alias("files"), F.max("span").cast("bigint").alias("max_span"), key.alias("member_key"))


def shape_groups(nodes: DataFrame, kinds=FINGERPRINTED, min_lines: int = 10) -> DataFrame:
    """Groups of one shape, without those that have just the members of an exact group."""
    exact = clone_groups(nodes, "ast_hash", kinds, min_lines).select("member_key")
    return clone_groups(nodes, "ast_shape_hash", kinds, min_lines).join(exact, "member_key", "left_anti")


def _changes(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Full outer join by null-safe keys; status and the tracked fields that differ."""
    a = old.select(*(F.col(c).alias(f"o_{c}") for c in [*keys, *fields]), F.lit(True).alias("o_here"))
    b = new.select(*(F.col(c).alias(f"n_{c}") for c in [*keys, *fields]), F.lit(True).alias("n_here"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"o_{k}").eqNullSafe(F.col(f"n_{k}"))
    both = a.join(b, on, "full_outer")
    changed = F.array_compact(F.array(*(F.when(~F.col(f"o_{c}").eqNullSafe(F.col(f"n_{c}")), F.lit(c)) for c in fields)))
    status = F.when(F.col("o_here").isNull(), "added").when(F.col("n_here").isNull(), "removed").when(F.size(changed) > 0, "changed")
    rows = both.withColumn("status", status).where("status is not null").withColumn("changed_fields", F.when(F.col("status") == "changed", F.array_join(changed, ",")).otherwise(F.lit("")))
    return rows.select(*(F.coalesce(f"n_{k}", f"o_{k}").alias(k) for k in keys), "status", "changed_fields")


def diff_nodes(old: DataFrame, new: DataFrame, fields=NODE_FIELDS) -> DataFrame:
    return _changes(old, new, ["id"], list(fields))


def diff_edges(old: DataFrame, new: DataFrame, fields=("confidence", "resolved_by")) -> DataFrame:
    return _changes(old, new, ["source", "target", "kind", "line"], list(fields))


def diff_files(old: DataFrame, new: DataFrame, fields=("content_hash", "size")) -> DataFrame:
    return _changes(old, new, ["path"], list(fields))


def explain(nodes: DataFrame, edges: DataFrame, source: str, target: str, kind: str) -> DataFrame:
    """The edges of one identity with both ends; confidence only where it is in [0, 1]."""
    hit = edges.where((F.col("source") == source) & (F.col("target") == target) & (F.col("kind") == kind))
    end = lambda side: nodes.select(F.col("id").alias(side), F.col("name").alias(f"{side}_name"), F.col("file_path").alias(f"{side}_file"))
    ok = F.when(F.col("confidence").between(0, 1), F.col("confidence"))
    return hit.join(end("source"), "source", "left").join(end("target"), "target", "left").withColumn("confidence", ok)


def low_confidence(edges: DataFrame, threshold: float = 0.5, examples: int = 5) -> tuple[DataFrame, DataFrame]:
    """(count, examples) of edges below the threshold; an unknown confidence is not low."""
    low = edges.where(F.col("confidence") < threshold)
    return low.agg(F.count("*").alias("n")), low.orderBy("confidence", "source", "target", "kind").limit(examples)


def line_clusters(ranges: DataFrame, gap: int = 10) -> DataFrame:
    """(file_path, cluster, start_line, end_line, symbols): ranges of lines that lie within ``gap`` of each other."""
    w = Window.partitionBy("file_path").orderBy("start_line", "id")
    before = F.max("end_line").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(before.isNull() | (F.col("start_line") > before + gap), 1).otherwise(0)
    rows = ranges.withColumn("fresh", fresh).withColumn("cluster", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("file_path", "cluster").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.count("*").alias("symbols"))


def stale_files(known: DataFrame, current: DataFrame) -> DataFrame:
    """(path, status): added, modified or removed against the hashes of a listing."""
    rows = known.select("path", F.col("content_hash").alias("old")).join(current.select("path", F.col("content_hash").alias("new")), "path", "full_outer")
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "modified")
    return rows.select("path", status.alias("status")).where("status is not null")
